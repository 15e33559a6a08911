"""Filtering and ordering of site/venue pairs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import fold_case
from tidewatch.operators.filters import all_of, clean_values


def _in_ignoring_case(column: str, values: Iterable[str]) -> Column | None:
    wanted = sorted({value.upper() for value in clean_values(values)})
    return fold_case(F.col(column)).isin(wanted) if wanted else None


def site_mappings(
    pairs: DataFrame,
    site_ids: Iterable[str] = (),
    local_authority_codes: Iterable[str] = (),
    publishers: Iterable[str] = (),
    match_methods: Iterable[str] = (),
) -> DataFrame:
    """Pairs matching every given filter: sites by name, each site's nearest venue first."""
    sites, names = clean_values(site_ids), clean_values(publishers)
    wanted = all_of(
        [
            F.col("site_id").isin(sites) if sites else None,
            _in_ignoring_case("local_authority_code", local_authority_codes),
            F.exists("oa_publisher_names", lambda name: name.isin(names)) if names else None,
            _in_ignoring_case("match_method", match_methods),
        ]
    )
    # The sort reads its input twice, to find its ranges and to deal rows out: dealt out once before, the pairs are
    # read and parsed once.  Keys are columns, so that a comparison does not work them out again.
    keys = {
        "_name": F.coalesce("site_name", F.lit("")),
        "_documents": F.array_join("oa_location_json", "|"),
    }
    return (
        pairs.where(wanted)
        .withColumns(keys)
        .repartition("_name", "site_id", "distance_metres", "_documents")
        .orderBy("_name", "site_id", F.asc_nulls_last("distance_metres"), "_documents")
        .drop(*keys)
    )
