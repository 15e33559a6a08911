"""The public queries: headline figures, opportunities, areas and the lists."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.jsontext import json_scalars
from tidewatch.functions.text import fold_case, not_blank
from tidewatch.operators.filters import PublicFilter, clean_values, live_opportunity
from tidewatch.operators.paging import SortKey, records_after, records_page
from tidewatch.schemas import COMPLETENESS_COLUMNS, SOCIO_MEASURES
from tidewatch.sources.snapshots import latest_insight_run

EVERYTHING = PublicFilter()

# Fixed value published with the headline figures.
PERCENTAGE_OF_LOCAL_AUTHORITIES = 74


def public_summary(summary: DataFrame, insight_runs: DataFrame) -> DataFrame:
    """The headline row."""
    label_kind = F.when(F.col("is_activity"), "activity").when(~F.col("is_activity"), "facility")

    def entry(kind: Column, text: str) -> Column:
        return F.struct(
            kind.alias("kind"), F.col(text).alias("text"), F.col("opportunity_count_narrow").alias("narrow")
        )

    # Each row counts once under every kind.  Few distinct texts stand behind many rows: they
    # are grouped as they are, in one pass, and only then is their JSON read.
    texts = (
        summary.select(
            F.inline(
                F.array(
                    entry(F.lit("publisher"), "publisher"),
                    entry(label_kind, "activity_or_facility"),
                    entry(F.lit("organization"), "organization_names"),
                )
            )
        )
        .where(F.col("kind").isNotNull())
        .groupBy("kind", "text")
        .agg(F.sum("narrow").alias("narrow"))
    )
    values = F.when(F.col("kind") == "publisher", F.array("text")).otherwise(json_scalars(F.col("text")))
    labels = (
        texts.select("kind", "narrow", F.posexplode_outer(values).alias("position", "label"))
        # The text's figure stays with one of its labels.
        .withColumn("narrow", F.when(F.coalesce("position", F.lit(0)) == 0, F.col("narrow")))
        .groupBy("kind", "label")
        .agg(F.sum("narrow").alias("narrow"))
    )

    def of_kind(kind: str) -> Column:
        return F.col("kind") == kind

    def distinct_labels(kind: str) -> Column:
        return F.count_if(of_kind(kind) & F.col("label").isNotNull())

    return labels.agg(
        F.sum(F.when(of_kind("publisher"), F.col("narrow"))).alias("number_of_opportunities"),
        distinct_labels("publisher").alias("number_of_publishers"),
        distinct_labels("activity").alias("number_of_activities"),
        distinct_labels("facility").alias("number_of_facility_types"),
        F.sum(F.when(of_kind("facility"), F.col("narrow"))).alias("number_of_facilities"),
        F.lit(PERCENTAGE_OF_LOCAL_AUTHORITIES).alias("percentage_of_local_authorities"),
        distinct_labels("organization").alias("number_of_activity_providers"),
    ).withColumn("date", latest_insight_run(insight_runs).select("run_date").scalar())


def opportunities(summary: DataFrame, where: PublicFilter = EVERYTHING) -> DataFrame:
    """Filtered summary rows; the narrow count is the one shown."""
    return (
        summary.where(where.on_summary())
        .drop("opportunity_count")
        .withColumnRenamed("opportunity_count_narrow", "opportunity_count")
    )


RECORD_KEYS = (SortKey("startDate"), SortKey("feed_id"), SortKey("id"))

# The columns of a record.
RECORD_COLUMNS = (
    "publisher_name", "feed_id", "id", "kind", "startDate", "endDate", "last_updated", "location",
    "district_name", "district_code", "region_name", "region_code", "country_name", "country_code",
    "activity", "facility", "json_data", "ageRange", "level", "accessibilitySupport",
    "genderRestriction", "organization_name",
)


def live_records(
    opportunity_rows: DataFrame, today: dt.date, where: PublicFilter = EVERYTHING
) -> DataFrame:
    """All live records with a kind other than Slot, without an order."""
    return opportunity_rows.where(
        live_opportunity(today) & (F.col("kind") != "Slot") & where.on_opportunities()
    ).select(*RECORD_COLUMNS)


def opportunity_records(
    opportunity_rows: DataFrame,
    today: dt.date,
    where: PublicFilter = EVERYTHING,
    offset: int = 0,
    limit: int = 20,
) -> DataFrame:
    """A page of live records by start, feed and id, with ``has_more``.

    Everything before ``offset`` is ordered too; ``opportunity_records_after`` costs its own page.
    """
    order = [key.order() for key in RECORD_KEYS]
    return records_page(live_records(opportunity_rows, today, where), order, offset, limit)


def opportunity_records_after(
    opportunity_rows: DataFrame,
    today: dt.date,
    where: PublicFilter = EVERYTHING,
    after: tuple | None = None,
    limit: int = 20,
) -> DataFrame:
    """The live records that follow the (start, feed, id) of the last one seen, with ``has_more``."""
    return records_after(live_records(opportunity_rows, today, where), RECORD_KEYS, after, limit)


_NODE_KEYS = ("level", "country_name", "region_name", "district_name", "code")


def areas(
    summary: DataFrame, where: PublicFilter = EVERYTHING, socio_data: DataFrame | None = None
) -> DataFrame:
    """Countries, regions and districts as one row per node, with socio columns on request.

    Districts without a region hang on their country, and a country that has such districts
    lists no regions.  Conflicting codes of one country or region give the smallest.
    """
    region = F.when(not_blank(F.col("region_name")), F.col("region_name"))
    tuples = (
        summary.where(
            F.col("country_name").isNotNull()
            & F.col("district_name").isNotNull()
            & where.on_summary()
        )
        .select(
            "country_name", "country_code", "region_name", "region_code", "district_name", "district_code"
        )
        .distinct()
        .withColumn("region_name", region)
        # Only the distinct areas of a country are left by now, not its rows.
        .withColumn(
            "has_direct_districts",
            F.bool_or(F.col("region_name").isNull()).over(Window.partitionBy("country_name")),
        )
    )
    no_text = F.lit(None).cast("string")

    def node(level: str, region_name: Column, district_name: Column, key: Column, code: str) -> Column:
        return F.struct(
            F.lit(level).alias("level"), F.col("country_name"), region_name.alias("region_name"),
            district_name.alias("district_name"), key.alias("key"), F.col(code).alias("code"),
        )

    has_region = F.col("region_name").isNotNull()
    under_region = has_region & ~F.col("has_direct_districts")
    # Each tuple offers its country, its region and its district; districts of one name and
    # different codes are different nodes, so the code is part of their key.
    nodes = (
        tuples.select(
            F.inline(
                F.array(
                    node("country", no_text, no_text, no_text, "country_code"),
                    F.when(under_region, node("region", F.col("region_name"), no_text, no_text, "region_code")),
                    F.when(
                        ~has_region | under_region,
                        node(
                            "district", F.col("region_name"), F.col("district_name"),
                            F.col("district_code"), "district_code",
                        ),
                    ),
                )
            )
        )
        .where(F.col("level").isNotNull())
        .groupBy("level", "country_name", "region_name", "district_name", "key")
        .agg(F.min("code").alias("code"))
        .drop("key")
    )
    if socio_data is not None:
        # One row per code: of conflicting ones the smallest, as for codes.
        names = ("area_name", "total_population", *SOCIO_MEASURES)
        measures = socio_data.where(F.col("area_code").isNotNull()).groupBy(F.col("area_code").alias("code")).agg(
            F.min(F.struct(*names)).alias("socio")
        )
        nodes = nodes.join(measures, "code", "left").select(
            *nodes.columns, *[F.col("socio")[name].alias(name) for name in names]
        )
    return nodes.orderBy(
        fold_case(F.col("country_name")), "country_name",
        fold_case(F.col("region_name")), "region_name",
        fold_case(F.col("district_name")), "district_name", "code",
    )


def area_tree(nodes: DataFrame) -> DataFrame:
    """``areas`` as one row per country with its regions and districts nested, in their order.

    The lists are as long as the map has areas, whatever the number of opportunities.
    ``regions`` is null where the country lists districts of its own, and the other way round;
    ``socio`` is null where nothing is known about the area.  Two aggregates fold the nodes:
    districts and the region above them by (country, region), then both by country.
    """
    extra = [name for name in nodes.columns if name not in _NODE_KEYS]
    known = F.coalesce(*[F.col(name).cast("string") for name in extra]).isNotNull() if extra else F.lit(False)
    context = F.when(known, F.struct(*extra)) if extra else F.lit(None).cast("string")
    labelled = nodes.withColumn("socio", context)

    def sort_key(name: str) -> Column:
        return F.struct(fold_case(F.col(name)).alias("fold"), F.col(name).alias("name")).alias("key")

    def listed(entry: Column) -> Column:
        """The entries that are not null in the order of their keys; null where there are none."""
        entries = F.transform(F.array_sort(F.collect_list(entry)), lambda item: item["entry"])
        return F.when(F.size(entries) > 0, entries)

    def of_level(level: str, value: Column) -> Column:
        return F.when(F.col("level") == level, value)

    code_and_socio = F.struct("code", "socio")
    district = F.struct("district_name", F.col("code").alias("district_code"), "socio").alias("entry")
    folded = labelled.groupBy("country_name", "region_name").agg(
        F.first(of_level("country", code_and_socio), ignorenulls=True).alias("country"),
        F.first(of_level("region", code_and_socio), ignorenulls=True).alias("region"),
        listed(of_level("district", F.struct(sort_key("district_name"), district))).alias("districts"),
    )
    region = F.struct(
        "region_name", F.col("region.code").alias("region_code"), F.col("region.socio").alias("socio"), "districts"
    ).alias("entry")
    return (
        folded.groupBy("country_name")
        .agg(
            F.first("country", ignorenulls=True).alias("country"),
            listed(
                F.when(F.col("region").isNotNull(), F.struct(sort_key("region_name"), region))
            ).alias("regions"),
            F.first(F.when(F.col("region_name").isNull(), F.col("districts")), ignorenulls=True).alias("districts"),
        )
        .select("country_name", F.col("country.code").alias("country_code"), "country.socio", "regions", "districts")
        .orderBy(fold_case(F.col("country_name")), "country_name")
    )


def socio(socio_data: DataFrame, where: PublicFilter = EVERYTHING) -> DataFrame:
    """Socio-economic rows of the wanted areas, of all areas when none is named."""
    codes = clean_values([*where.district, *where.region, *where.country])
    rows = socio_data.where(F.col("area_code").isin(codes)) if codes else socio_data
    return rows.orderBy("area_name", "area_code")


def _alphabetic(values: DataFrame, *names: str) -> DataFrame:
    keys = [fold_case(F.coalesce(F.col(name), F.lit(""))) for name in names]
    return values.distinct().orderBy(*keys, *names)


def publishers(summary: DataFrame, where: PublicFilter = EVERYTHING) -> DataFrame:
    named = summary.where(F.col("publisher").isNotNull() & where.on_summary())
    return _alphabetic(named.select("publisher"), "publisher")


def activities(summary: DataFrame, where: PublicFilter = EVERYTHING) -> DataFrame:
    # Distinct before the JSON is read: the same lists stand in very many rows.
    lists = summary.where(where.on_summary()).select("activity_or_facility").distinct()
    labels = lists.select(F.explode(json_scalars(F.col("activity_or_facility"))).alias("activity"))
    return _alphabetic(labels, "activity")


def nhs_trusts(summary: DataFrame, where: PublicFilter = EVERYTHING) -> DataFrame:
    named = summary.where(F.col("nhstrust_name").isNotNull() & where.on_summary())
    return _alphabetic(named.select("nhstrust_name", "nhstrust_code"), "nhstrust_name", "nhstrust_code")


def organizations(
    opportunity_rows: DataFrame, today: dt.date, where: PublicFilter = EVERYTHING
) -> DataFrame:
    """Providers of live records of any kind."""
    live = opportunity_rows.where(
        (F.col("organization_name") != "") & live_opportunity(today) & where.on_opportunities()
    )
    return _alphabetic(live.select(F.col("organization_name").alias("organization")), "organization")


QUALITY_COLUMNS = (
    "dataset_name", "dataset_url", "feed_type", "feed_url", "status", "warnings", "errors",
    *COMPLETENESS_COLUMNS, "num_future_opportunity_items", "feed_version", "last_assessed",
)


def feed_quality(
    quality: DataFrame, feeds: DataFrame, summary: DataFrame, where: PublicFilter = EVERYTHING
) -> DataFrame:
    """Quality rows of the feeds whose publishers match the filter, newest first.

    The filter works through the summary's publishers and their datasets; a filter that
    binds no values (``nhs_trust=all`` alone included) leaves every row.
    """
    rows = quality
    if where.binds_values():
        wanted = (
            summary.where(F.col("publisher").isNotNull() & where.on_summary())
            .select(F.col("publisher").alias("publisher_name"))
            .distinct()
        )
        datasets = feeds.join(wanted, "publisher_name", "left_semi").select("dataset_url").distinct()
        rows = quality.join(datasets, "dataset_url", "left_semi")
    return rows.select(*QUALITY_COLUMNS).orderBy(
        F.desc("last_assessed"), F.asc("dataset_name"), F.asc("feed_url")
    )
