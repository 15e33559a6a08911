"""Approximate distinct counts that can be merged: the cheap variant of the exact ones.

An exact count of distinct values has to see every value again for every span of days.  A HyperLogLog sketch a
(key, day) is a few kilobytes whatever it has seen; sketches of days or keys are merged to those of spans or totals
without going back to the rows.  With ``bits`` of 14 the standard error is about 0.8 %, and small counts are exact
or nearly so.  The exact summaries stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.jsontext import json_scalars
from tidewatch.functions.text import fold_case, not_blank

BITS = 14


def value_sketches(rows: DataFrame, values: Mapping[str, Column], by: Iterable[str] = (), bits: int = BITS) -> DataFrame:
    """A sketch of each named text by the columns ``by``; nulls count for nothing, null keys are keys."""
    return rows.groupBy(*by).agg(*[F.hll_sketch_agg(column, bits).alias(name) for name, column in values.items()])


def merged_sketches(sketches: DataFrame, names: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """The sketches of larger groups, of days to weeks or of keys to all; as if all their rows had been read again."""
    return sketches.groupBy(*by).agg(*[F.hll_union_agg(name).alias(name) for name in names])


def estimated(sketches: DataFrame, names: Iterable[str]) -> DataFrame:
    """The numbers of distinct values in place of the sketches."""
    return sketches.withColumns({name: F.coalesce(F.hll_sketch_estimate(name), F.lit(0).cast("bigint")) for name in names})


#: What the public summary counts.
SUMMARY_LABELS = ("number_of_publishers", "number_of_activities", "number_of_facility_types", "number_of_activity_providers")


def summary_sketches(summary: DataFrame, by: Iterable[str] = (), bits: int = BITS) -> DataFrame:
    """Sketches of the labels that the public summary counts, by columns of the rows."""
    listed = F.col("is_activity")
    values = {
        "number_of_publishers": F.array("publisher"),
        "number_of_activities": F.when(listed, json_scalars(F.col("activity_or_facility"))),
        "number_of_facility_types": F.when(~listed, json_scalars(F.col("activity_or_facility"))),
        "number_of_activity_providers": json_scalars(F.col("organization_names")),
    }
    # One row a label: a row's lists side by side, the shorter ones filled with nulls that count for nothing.
    labels = summary.select(*by, F.arrays_zip(*[
        F.coalesce(column, F.array().cast("array<string>")).alias(name) for name, column in values.items()
    ]).alias("labels")).select(*by, F.inline("labels"))
    return value_sketches(labels, {name: F.col(name) for name in SUMMARY_LABELS}, by, bits)


#: What the quality summary counts, ignoring case.
QUALITY_LABELS = ("total_datasets", "total_publishers")


def quality_sketches(assessed: DataFrame, by: Iterable[str] = (), bits: int = BITS) -> DataFrame:
    """Sketches of the datasets and publishers that the quality summary counts."""
    columns = {"total_datasets": "dataset_url", "total_publishers": "publisher_name"}
    return value_sketches(assessed, {
        name: F.when(not_blank(F.col(column)), fold_case(F.col(column))) for name, column in columns.items()
    }, by, bits)
