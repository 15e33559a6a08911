"""Schema drift: feeds that publish custom properties."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import (
    UNKNOWN,
    blank_to_null,
    dataset_display_name,
    not_blank,
    publisher_id,
    strip,
)
from tidewatch.operators.filters import all_of, value_in
from tidewatch.plans.quality import distinct_ignoring_case


def assessed_properties(
    custom_properties: DataFrame, dataset_urls: Iterable[str] = (), publishers: Iterable[str] = ()
) -> DataFrame:
    return custom_properties.where(
        all_of([value_in("dataset_url", dataset_urls), value_in("publisher_name", publishers)])
    )


def _reported() -> Column:
    """The stored count decides; the array does not."""
    return F.coalesce(F.col("num_custom_properties") > 0, F.lit(False))


def property_rows(assessed: DataFrame) -> DataFrame:
    """Reported feeds, most properties first; each feed's usages by presence."""
    def sort_key(usage: Column) -> Column:
        presence = usage["presence_pct"]
        return F.struct(
            presence.isNull().alias("absent"),
            (-presence).alias("order"),
            usage["property"].alias("property"),
            usage["entity_type"].alias("entity_type"),
            usage["namespace"].alias("namespace"),
            presence.alias("presence_pct"),
        )

    usages = F.transform(
        F.array_sort(F.transform(F.coalesce("custom_properties", F.array()), sort_key)),
        lambda usage: F.struct(
            usage["property"].alias("property"),
            usage["namespace"].alias("namespace"),
            usage["entity_type"].alias("entity_type"),
            usage["presence_pct"].alias("presence_pct"),
        ),
    )
    return (
        assessed.where(_reported())
        .select(
            "feed_id", "feed_url", "feed_type", "is_regular", "dataset_url",
            dataset_display_name(F.col("dataset_url"), F.col("dataset_name")).alias("dataset_name"),
            publisher_id(F.col("publisher_name")).alias("publisher_id"),
            F.coalesce("publisher_name", F.lit("")).alias("publisher_name"),
            "sampled_items", "num_custom_properties", "num_custom_property_usages",
            usages.alias("custom_properties"),
        )
        .orderBy(F.desc_nulls_last("num_custom_properties"), "dataset_url", "feed_id")
    )


def property_usages(assessed: DataFrame) -> DataFrame:
    """One row per usage of a named property by a reported feed."""
    return (
        assessed.where(_reported())
        .select("dataset_url", "feed_id", F.inline("custom_properties"))
        .where(not_blank(F.col("property")))
    )


def property_summary(assessed: DataFrame) -> DataFrame:
    """One headline row; the denominators cover every assessed feed."""
    reported = _reported()
    url = F.col("dataset_url")
    properties = property_usages(assessed).agg(F.count_distinct("property")).scalar()
    return assessed.agg(
        F.count(F.lit(1)).alias("feeds_assessed"),
        distinct_ignoring_case(url).alias("datasets_assessed"),
        F.count_if(reported).alias("feeds_with_custom_properties"),
        distinct_ignoring_case(F.when(reported, url)).alias("datasets_with_custom_properties"),
        distinct_ignoring_case(F.when(reported, F.col("publisher_name"))).alias(
            "publishers_with_custom_properties"
        ),
        F.coalesce(F.sum(F.when(reported, F.col("num_custom_property_usages"))), F.lit(0)).alias(
            "total_custom_property_usages"
        ),
    ).select(
        "*",
        (
            F.col("feeds_with_custom_properties")
            / F.when(F.col("feeds_assessed") > 0, F.col("feeds_assessed"))
        ).alias("feed_share"),
        properties.alias("distinct_custom_properties"),
    )


def _reach() -> list[Column]:
    """Feeds by (dataset, feed) pair, datasets ignoring case."""
    return [
        F.count_distinct(F.struct("dataset_url", "feed_id")).alias("feed_count"),
        distinct_ignoring_case(F.col("dataset_url")).alias("dataset_count"),
    ]


def namespace_breakdown(assessed: DataFrame) -> DataFrame:
    namespace = strip(blank_to_null(F.col("namespace")))
    return (
        property_usages(assessed)
        .groupBy(namespace.alias("namespace"))
        .agg(F.count_distinct("property").alias("property_count"), *_reach())
        .orderBy(F.desc("feed_count"), F.asc_nulls_last("namespace"))
    )


def entity_type_breakdown(assessed: DataFrame) -> DataFrame:
    entity_type = F.coalesce(strip(blank_to_null(F.col("entity_type"))), F.lit(UNKNOWN))
    return (
        property_usages(assessed)
        .groupBy(entity_type.alias("entity_type"))
        .agg(F.count_distinct("property").alias("property_count"), *_reach())
        .orderBy(F.desc("feed_count"), "entity_type")
    )


def property_breakdown(assessed: DataFrame) -> DataFrame:
    """Per property: smallest namespace, its entity types, feeds and datasets.

    The set of types is merged on the map side and holds distinct type names only.
    """
    return (
        property_usages(assessed)
        .groupBy("property")
        .agg(
            F.min(blank_to_null(F.col("namespace"))).alias("namespace"),
            F.sort_array(F.collect_set(strip(blank_to_null(F.col("entity_type"))))).alias("entity_types"),
            *_reach(),
        )
        .orderBy(F.desc("feed_count"), "property")
    )
