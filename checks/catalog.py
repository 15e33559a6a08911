"""Every operator as a named query over the driver's tables.

Dates and arrays are rendered as text and doubles rounded, so that both engines' results
compare value by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import views
from tidewatch.operators import decline, errors, hydrate, orphans, stalls
from tidewatch.operators.filters import PublicFilter
from tidewatch.operators.paging import page, page_after
from tidewatch.operators.daily import FeedDayState, attributed, failure_details, supply_level
from tidewatch.plans import estate, growth, notifications, properties, public, quality, sites
from tidewatch.sources import feed_day_store, snapshots
from tidewatch.sources.notification_store import WRITABLE, merge_notifications
from tidewatch.sources.site_csv import site_mappings_from_text
from tidewatch.thresholds import DeclineThresholds, ErrorThresholds, OrphanThresholds, StallThresholds

AS_OF = dt.date(2024, 1, 30)
GROWTH_AS_OF = dt.date(2001, 8, 1)
# A running month with enough crawls, and a window that begins before the first crawl.
EARLY_AS_OF = dt.date(1995, 5, 20)
TODAY = dt.date(2001, 1, 1)
CONTACT_TODAY = dt.date(2001, 8, 1)
STALLS = StallThresholds(stall_days=3)
ERRORS = ErrorThresholds()
DECLINE = DeclineThresholds()
ORPHANS = OrphanThresholds(min_orphans=10, min_share=0.05, past_threshold_orphans=30)
NARROW = PublicFilter(
    district=("D3-1", "D4-2"), region=("R7",), country=("C1",),
    activity=("ECONOMY", "Brand#7"), organization=("HOUSEHOLD", "BUILDING"),
)
PLACE = PublicFilter(region=("R9", "R3"), activity=("Brand#7", "Brand#12", "ECONOMY"), nhs_trust=("T3", "T9"))
ANY_TRUST = PublicFilter(nhs_trust=("ALL", "T3"))
SOME_PUBLISHERS = PublicFilter(district=("D3-1", "D4-2"), activity=("Brand#7",))
SOME_ACTIVITIES = PublicFilter(district=("D3-1", "D4-2"), activity=("Brand#7", "Brand#12"))
SOME_PROVIDERS = PublicFilter(country=("C1", "C2"), activity=("ECONOMY",), nhs_trust=("all",))
ONE_TRUST = PublicFilter(publisher=tuple(f"Supplier#{n:09d}" for n in range(1, 5)), nhs_trust=("T3",))
ONE_PROVIDER = PublicFilter(organization=("BUILDING 3", "MACHINERY 3", "HOUSEHOLD 7", "AUTOMOBILE 7", "FURNITURE 7"))
#: A moment within a day: the runs of that day are in both halves of the state.
STATE_FROM = dt.datetime(2024, 1, 16, 12)
AFTER_RECORD = (dt.datetime(2001, 3, 1), "feed-3", "5")
AFTER_SCORE = (55.0, "https://d3.example/data/", "feed-6")


def _plain(name: str, kind: T.DataType) -> Column:
    column = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return column.cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
        return column.cast("bigint")
    if isinstance(kind, T.DoubleType):
        return F.round(column, 6)
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(column, lambda item: item.cast("string")), ",", "~")
    return column


def comparable(df: DataFrame) -> DataFrame:
    """Values both engines print alike."""
    return df.select(*[_plain(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


class Views:
    """The domain tables at one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._tables = views.Tables(spark, sf_dir)

    @cached_property
    def ingestion(self):
        return self._tables.view(views.INGESTION)

    @cached_property
    def feed_day_state(self):
        """The log's state as merged from that of the runs until its middle and that of the later ones."""
        parts = [self.ingestion.where(F.coalesce(test, F.lit(late))) for test, late in (
            (F.col("ingestion_date") < STATE_FROM, False), (F.col("ingestion_date") >= STATE_FROM, True))]
        return FeedDayState(
            feed_day_store.merged_rows(*map(feed_day_store.state_rows, parts)),
            feed_day_store.merged_failures(*(failure_details(attributed(p)) for p in parts)),
            feed_day_store.merged_index(*map(feed_day_store.day_index, parts)),
        )

    @cached_property
    def references(self):
        return self._tables.view(views.REFERENCES)

    @cached_property
    def orphan_state(self):
        """The counts of all records after each has changed once: as they were, minus that, plus as they are."""
        former = self.references.withColumns(
            {"data_id": F.concat("data_id", F.lit("-old")), "location": F.lit(None).cast("string")}
        )
        loads = [orphans.edge_counts(rows, sign) for rows, sign in ((former, 1), (former, -1), (self.references, 1))]
        return orphans.OrphanState(orphans.merged_counts(*loads))

    @cached_property
    def opportunities(self):
        return self._tables.view(views.OPPORTUNITIES)

    @cached_property
    def summary(self):
        return self._tables.view(views.SUMMARY)

    @cached_property
    def insight_runs(self):
        return self._tables.view(views.INSIGHT_RUNS)

    @cached_property
    def crawls(self):
        return self._tables.view(views.GROWTH_CRAWLS)

    @cached_property
    def growth_ingestion(self):
        return self._tables.view(views.GROWTH_INGESTION)

    @cached_property
    def feeds(self):
        return self._tables.view(views.FEEDS)

    @cached_property
    def supplier_feeds(self):
        return self._tables.view(views.SUPPLIER_FEEDS)

    @cached_property
    def quality(self):
        return self._tables.view(views.QUALITY)

    @cached_property
    def supplier_quality(self):
        """The quality rows spread over ten datasets, which the suppliers' feeds belong to."""
        return self.quality.withColumn(
            "dataset_url", F.regexp_replace("dataset_url", r"d\d*(\d)\.example", "d$1.example")
        )

    @cached_property
    def socio(self):
        return self._tables.view(views.SOCIO)

    @cached_property
    def custom_properties(self):
        return views.custom_properties(self._tables)

    @cached_property
    def notifications(self):
        return views.notifications(self._tables)

    @cached_property
    def site_cells(self):
        return self._tables.view(views.SITE_CELLS)

    @cached_property
    def dataset_names(self):
        return hydrate.dataset_names(self.feeds, self.quality)

    @cached_property
    def feed_names(self):
        return hydrate.feed_names(self.feeds, self.quality)

    @cached_property
    def assessed(self):
        return quality.assessed_feeds(self.quality, self.feeds)

    @cached_property
    def assessed_properties(self):
        return properties.assessed_properties(self.custom_properties)


def _notification_changes(v: Views) -> DataFrame:
    """A batch derived from the stored rows: edits, removals, repeats, unknown and new ids."""
    key = F.col("id").cast("bigint")
    stored = v.notifications
    edits = stored.where(key % 7 == 0).select(
        "id", (key * 10).alias("seq"),
        F.when(key % 21 == 0, "delete").when(key % 14 == 0, "insert").otherwise("update").alias("op"),
        *[name for name in WRITABLE if name != "notes"], F.lit("edited").alias("notes"),
    )
    again = edits.where(key % 42 == 0).withColumns(
        {"seq": F.col("seq") + 1, "op": F.lit("insert"), "notes": F.lit("again")}
    )
    fresh = edits.where(key % 35 == 0).withColumns(
        {
            "id": F.concat(F.lit("n"), "id"),
            "op": F.when(key % 70 == 0, "insert").otherwise("update"),
            "notes": F.lit("new"),
        }
    )
    return edits.unionByName(again).unionByName(fresh)


def _merged(v: Views):
    return merge_notifications(
        v.notifications, _notification_changes(v), F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")
    )


def _tiles(v: Views) -> DataFrame:
    return estate.monitor_tiles(v.ingestion, v.references, AS_OF, orphan_thresholds=ORPHANS)


def _flat_tree(tree: DataFrame) -> DataFrame:
    """Countries with their nested lists written out as text."""
    def names(districts: Column) -> Column:
        return F.array_join(
            F.transform(
                districts,
                lambda d: F.concat_ws(
                    ":", F.lit(""), d["district_name"], d["district_code"], d["socio"]["total_population"]
                ),
            ),
            ",",
        )

    regions = F.transform(
        "regions",
        lambda r: F.concat_ws(
            ":", r["region_name"], r["region_code"], r["socio"]["total_population"], names(r["districts"])
        ),
    )
    return tree.select(
        "country_name", "country_code", F.col("socio.total_population").alias("population"),
        F.array_join(regions, ";").alias("regions"), names(F.col("districts")).alias("districts"),
    )


def _state_columns(rows: DataFrame) -> DataFrame:
    """The state with its packed level read."""
    level = supply_level(F.col("level")).alias("future")
    return rows.select(*[name for name in rows.columns if name not in ("level", "failure", "least_status")], level)


SITE_COLUMNS = (
    "site_id", "site_name", "local_authority_code", "site_lat", "ap_facility_count", "oa_publisher_names",
    "oa_location_json", "distance_metres", "match_method", "spatial_match", "is_mutual_best", "oa_kinds",
)

_CATALOG: dict[str, Callable[[Views], DataFrame]] = {
    # Monitors
    "orphaned_children": lambda v: orphans.orphaned_children(v.references, v.dataset_names, ORPHANS),
    "orphaned_children_by_kind": lambda v: orphans.orphaned_children_by_kind(v.references, ORPHANS),
    "orphaned_missing_parents": lambda v: orphans.missing_parents(v.references, ORPHANS),
    "orphaned_missing_parents_all": lambda v: orphans.missing_parents(v.references, ORPHANS, evidence_size=None),
    "orphaned_children_from_changes": lambda v: orphans.orphaned_children(v.orphan_state, v.dataset_names, ORPHANS),
    "single_feed_stalls": lambda v: stalls.single_feed_stalls(
        v.ingestion, v.feed_names, v.dataset_names, AS_OF, STALLS
    ),
    "single_feed_stall_trend": lambda v: stalls.single_feed_stall_trend(v.ingestion, AS_OF, STALLS),
    "dataset_stalls": lambda v: stalls.dataset_stalls(v.ingestion, v.dataset_names, AS_OF, STALLS),
    "dataset_stall_feeds": lambda v: stalls.dataset_stall_feeds(v.ingestion, v.feed_names, AS_OF, STALLS),
    "dataset_stall_trend": lambda v: stalls.dataset_stall_trend(v.ingestion, AS_OF, STALLS),
    "feed_ingestion_errors": lambda v: errors.feed_ingestion_errors(
        v.ingestion, v.feed_names, v.dataset_names, AS_OF, ERRORS
    ),
    "feed_ingestion_error_trend": lambda v: errors.feed_ingestion_error_trend(v.ingestion, AS_OF, ERRORS),
    "dataset_future_decline": lambda v: decline.dataset_future_decline(
        v.ingestion, v.dataset_names, AS_OF, DECLINE
    ),
    "dataset_future_decline_feeds": lambda v: decline.dataset_future_decline_feeds(
        v.ingestion, v.feed_names, AS_OF, DECLINE
    ),
    "dataset_future_decline_trend": lambda v: decline.dataset_future_decline_trend(v.ingestion, AS_OF, DECLINE),
    # The feed-day state and monitors over it
    "feed_day_state": lambda v: _state_columns(v.feed_day_state.rows),
    "feed_day_index": lambda v: v.feed_day_state.index,
    "single_feed_stalls_from_state": lambda v: stalls.single_feed_stalls(
        v.feed_day_state, v.feed_names, v.dataset_names, AS_OF, STALLS
    ),
    "dataset_stall_trend_from_state": lambda v: stalls.dataset_stall_trend(v.feed_day_state, AS_OF, STALLS),
    "feed_ingestion_errors_from_state": lambda v: errors.feed_ingestion_errors(
        v.feed_day_state, v.feed_names, v.dataset_names, AS_OF, ERRORS
    ),
    "dataset_future_decline_from_state": lambda v: decline.dataset_future_decline(
        v.feed_day_state, v.dataset_names, AS_OF, DECLINE
    ),
    "history_trends": lambda v: estate.history_trends(v.ingestion, AS_OF, STALLS, ERRORS, DECLINE),
    # Estate
    "monitor_tiles": _tiles,
    "estate_headline": lambda v: estate.estate_headline(
        v.crawls, v.ingestion, estate.history_tiles(v.ingestion, AS_OF), AS_OF
    ),
    "datasets_with_errors_today": lambda v: estate.datasets_with_errors_today(v.ingestion, AS_OF),
    "snapshot_date": lambda v: snapshots.snapshot_date(v.ingestion),
    "assessment_date": lambda v: snapshots.assessment_date(v.quality),
    "latest_crawl": lambda v: snapshots.latest_crawl(v.crawls),
    "latest_insight_run": lambda v: snapshots.latest_insight_run(v.insight_runs),
    # Public
    "public_summary": lambda v: public.public_summary(v.summary, v.insight_runs),
    "opportunities": lambda v: public.opportunities(v.summary),
    "opportunities_filtered": lambda v: public.opportunities(v.summary, NARROW),
    "opportunities_any_trust": lambda v: public.opportunities(v.summary, ANY_TRUST),
    "live_records": lambda v: public.live_records(v.opportunities, TODAY),
    "live_records_by_organization": lambda v: public.live_records(v.opportunities, TODAY, ONE_PROVIDER),
    "opportunity_records_after": lambda v: public.opportunity_records_after(
        v.opportunities, TODAY, PLACE, AFTER_RECORD, 20
    ),
    "opportunity_records": lambda v: public.opportunity_records(v.opportunities, TODAY, PLACE, 5, 20),
    "areas": lambda v: public.areas(v.summary, socio_data=v.socio),
    "area_tree": lambda v: _flat_tree(public.area_tree(public.areas(v.summary, socio_data=v.socio))),
    "areas_filtered": lambda v: public.areas(v.summary, PublicFilter(activity=("Brand#7",), nhs_trust=("T3", "T6"))),
    "socio": lambda v: public.socio(v.socio),
    "socio_filtered": lambda v: public.socio(
        v.socio, PublicFilter(district=("D3-1",), region=("R7",), country=("C1", " "))
    ),
    "publishers": lambda v: public.publishers(v.summary),
    "publishers_filtered": lambda v: public.publishers(v.summary, SOME_PUBLISHERS),
    "activities": lambda v: public.activities(v.summary),
    "activities_filtered": lambda v: public.activities(v.summary, SOME_ACTIVITIES),
    "nhs_trusts": lambda v: public.nhs_trusts(v.summary),
    "organizations": lambda v: public.organizations(v.opportunities, TODAY),
    "organizations_filtered": lambda v: public.organizations(v.opportunities, TODAY, SOME_PROVIDERS),
    "public_feed_quality": lambda v: public.feed_quality(v.supplier_quality, v.supplier_feeds, v.summary, ONE_TRUST),
    "public_feed_quality_filtered": lambda v: public.feed_quality(
        v.supplier_quality, v.supplier_feeds, v.summary,
        PublicFilter(
            publisher=tuple(f"Supplier#{n:09d}" for n in range(6)), district=("D3-1",), activity=("Brand#7",)
        ),
    ),
    # Quality and drift
    "feed_quality_rows": lambda v: quality.quality_rows(v.assessed),
    "feed_quality_page": lambda v: page(v.assessed, quality.row_order(), 3, 40).select("feed_id", "score"),
    "feed_quality_page_after": lambda v: page_after(v.assessed, quality.ROW_KEYS, AFTER_SCORE, 40).select(
        "feed_id", "score"
    ),
    "feed_quality_filtered": lambda v: quality.quality_rows(
        quality.assessed_feeds(
            v.quality, v.feeds,
            dataset_urls=tuple(f"https://d{n}.example/data/" for n in range(0, 60)),
            publishers=tuple(f"Customer#{n:09d}" for n in range(0, 80, 2)),
        )
    ),
    "feed_quality_summary": lambda v: quality.quality_summary(v.assessed),
    "feed_quality_completeness": lambda v: quality.completeness_averages(v.assessed),
    "feed_quality_histogram": lambda v: quality.score_histogram(v.assessed),
    "feed_quality_breakdowns": lambda v: quality.quality_breakdowns(v.assessed),
    "custom_property_rows": lambda v: properties.property_rows(v.assessed_properties),
    "custom_property_rows_filtered": lambda v: properties.property_rows(
        properties.assessed_properties(
            v.custom_properties,
            dataset_urls=tuple(f"https://d{n}.example/data/" for n in range(0, 60)),
            publishers=tuple(f"Customer#{n:09d}" for n in range(0, 80, 2)),
        )
    ),
    "custom_property_summary": lambda v: properties.property_summary(v.assessed_properties),
    "custom_property_namespaces": lambda v: properties.namespace_breakdown(v.assessed_properties),
    "custom_property_entity_types": lambda v: properties.entity_type_breakdown(v.assessed_properties),
    "custom_property_properties": lambda v: properties.property_breakdown(v.assessed_properties),
    # Growth
    "ecosystem_growth": lambda v: growth.ecosystem_growth(v.crawls, v.growth_ingestion, GROWTH_AS_OF),
    "ecosystem_growth_datasets": lambda v: growth.ecosystem_growth_datasets(
        v.crawls, v.growth_ingestion, v.dataset_names, GROWTH_AS_OF
    ),
    "ecosystem_growth_in_progress": lambda v: growth.ecosystem_growth(v.crawls, v.growth_ingestion, EARLY_AS_OF),
    # Sites and notifications
    "site_mappings": lambda v: sites.site_mappings(site_mappings_from_text(v.site_cells)).select(*SITE_COLUMNS),
    "site_mappings_filtered": lambda v: sites.site_mappings(
        site_mappings_from_text(v.site_cells),
        local_authority_codes=("e3", "E4", "e15", "e20"), publishers=("Brand#7", "ECONOMY"),
        match_methods=("postCODE",),
    ).select(*SITE_COLUMNS),
    "site_mappings_by_id": lambda v: sites.site_mappings(
        site_mappings_from_text(v.site_cells), site_ids=("1", "3", " ", "none")
    ).select(*SITE_COLUMNS),
    "notification_list": lambda v: notifications.notification_list(v.notifications),
    "notification_summary": lambda v: notifications.notification_summary(v.notifications, CONTACT_TODAY),
    "notification_merge": lambda v: _merged(v).snapshot.select(
        "id", "status", "notes", "problem_count", "created_at", "updated_at"
    ),
    "notification_merge_outcomes": lambda v: _merged(v).outcomes,
}


def _runner(build: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: comparable(build(Views(spark, sf_dir)))


QUERIES = {name: _runner(build) for name, build in _CATALOG.items()}
