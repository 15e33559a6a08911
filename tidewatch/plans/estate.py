"""The estate summary: one tile per monitor and the headline row."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import decline, errors, orphans, stalls
from tidewatch.operators.daily import FeedDayState, day_spine, feed_days, first_log_day, shared_days, supply_columns
from tidewatch.sources.snapshots import latest_crawl
from tidewatch.thresholds import DeclineThresholds, ErrorThresholds, OrphanThresholds, StallThresholds

SPARKLINE_DAYS = 7
MONITOR_ORDER = (
    stalls.SINGLE_FEED, stalls.DATASET, errors.MONITOR_ID, decline.MONITOR_ID, orphans.MONITOR_ID,
)


def _labelled(trend: DataFrame, monitor_id: str) -> DataFrame:
    return trend.select(F.lit(monitor_id).alias("monitor_id"), "day", "open_count", "past_threshold_count")


def summarise_trends(trends: DataFrame, sparkline_days: int = SPARKLINE_DAYS) -> DataFrame:
    """One tile per monitor from its (monitor_id, day, open_count, past_threshold_count) points.

    A monitor has a point per trend day (at most 365), so its points fit one row.
    """
    points = trends.groupBy("monitor_id").agg(
        F.sort_array(
            F.collect_list(F.struct("day", "open_count", "past_threshold_count")), asc=False
        ).alias("newest_first")
    )
    latest = F.col("newest_first")[0]
    previous = F.get(F.col("newest_first"), F.lit(1))
    sparkline = F.reverse(F.slice(F.col("newest_first")["open_count"], 1, max(1, sparkline_days)))
    return points.select(
        "monitor_id",
        latest["open_count"].alias("count"),
        latest["past_threshold_count"].alias("past_threshold_count"),
        sparkline.alias("sparkline"),
        (latest["open_count"] - previous["open_count"]).alias("count_delta"),
        (latest["past_threshold_count"] - previous["past_threshold_count"]).alias("past_threshold_delta"),
    )


def orphan_tile(
    opportunities: DataFrame, thresholds: OrphanThresholds = OrphanThresholds()
) -> DataFrame:
    """The orphans of all reported datasets; this monitor has no history."""
    found = orphans.orphaned_datasets(
        orphans.kind_counts(orphans.reference_edges(opportunities)), thresholds
    )
    total = F.coalesce(F.sum("orphan_count"), F.lit(0))
    return found.agg(total.cast("bigint").alias("count")).select(
        F.lit(orphans.MONITOR_ID).alias("monitor_id"),
        "count",
        F.lit(0).cast("bigint").alias("past_threshold_count"),
        F.array().cast("array<bigint>").alias("sparkline"),
        F.lit(None).cast("bigint").alias("count_delta"),
        F.lit(None).cast("bigint").alias("past_threshold_delta"),
    )


def history_trends(
    history: DataFrame | FeedDayState,
    as_of: dt.date,
    stall_thresholds: StallThresholds = StallThresholds(),
    error_thresholds: ErrorThresholds = ErrorThresholds(),
    decline_thresholds: DeclineThresholds = DeclineThresholds(),
    ignored_kinds: Iterable[str] = decline.IGNORED_KINDS,
) -> DataFrame:
    """The trends of the four monitors with a history, (monitor_id, day, counts), from one read of the history."""
    first = {
        th: as_of - dt.timedelta(days=th.trend_history_days)
        for th in (stall_thresholds, error_thresholds, decline_thresholds)
    }
    days = shared_days(feed_days(history, min(first.values()), as_of, ignored_kinds))

    def since(thresholds: StallThresholds | ErrorThresholds | DeclineThresholds) -> DataFrame:
        return days.where(F.col("day") >= F.lit(first[thresholds]))

    stall_days = since(stall_thresholds).where(F.col("day") > first_log_day(history))
    found = (
        stalls.stall_counts(stall_days, as_of, stall_thresholds)
        .unionByName(_labelled(errors.error_counts(since(error_thresholds), as_of, error_thresholds), errors.MONITOR_ID))
        .unionByName(
            _labelled(
                decline.decline_counts(supply_columns(since(decline_thresholds)), as_of, decline_thresholds),
                decline.MONITOR_ID,
            )
        )
    )
    none = [F.lit(0).cast("bigint").alias(name) for name in ("open_count", "past_threshold_count")]
    for monitor, thresholds in (
        (stalls.SINGLE_FEED, stall_thresholds), (stalls.DATASET, stall_thresholds),
        (errors.MONITOR_ID, error_thresholds), (decline.MONITOR_ID, decline_thresholds),
    ):
        spine = day_spine(days, as_of, thresholds.trend_days)
        found = found.unionByName(spine.select(F.lit(monitor).alias("monitor_id"), "day", *none))
    return found.groupBy("monitor_id", "day").agg(
        F.sum("open_count").alias("open_count"), F.sum("past_threshold_count").alias("past_threshold_count")
    )


def history_tiles(
    history: DataFrame | FeedDayState,
    as_of: dt.date,
    stall_thresholds: StallThresholds = StallThresholds(trend_days=SPARKLINE_DAYS, incident_trend_days=1),
    error_thresholds: ErrorThresholds = ErrorThresholds(trend_days=SPARKLINE_DAYS, incident_trend_days=1),
    decline_thresholds: DeclineThresholds = DeclineThresholds(
        trend_days=SPARKLINE_DAYS, incident_trend_days=1
    ),
) -> DataFrame:
    """The tiles of the monitors with a history."""
    return summarise_trends(history_trends(history, as_of, stall_thresholds, error_thresholds, decline_thresholds))


def monitor_tiles(
    history: DataFrame | FeedDayState,
    opportunities: DataFrame,
    as_of: dt.date,
    *thresholds: StallThresholds | ErrorThresholds | DeclineThresholds,
    orphan_thresholds: OrphanThresholds = OrphanThresholds(),
) -> DataFrame:
    """One row per monitor in display order; ``thresholds`` as for ``history_tiles``."""
    tiles = history_tiles(history, as_of, *thresholds).unionByName(orphan_tile(opportunities, orphan_thresholds))
    position = F.array_position(F.array(*[F.lit(name) for name in MONITOR_ORDER]), F.col("monitor_id"))
    return tiles.withColumn("position", position).orderBy("position")


def datasets_with_errors_today(ingestion: DataFrame, today: dt.date) -> DataFrame:
    """One row: datasets with a failed run since midnight."""
    return ingestion.where(
        (F.col("status") == "ERROR") & (F.col("ingestion_date") >= F.lit(today))
    ).agg(F.count_distinct("dataset_id").alias("publishers_with_issues"))


def estate_headline(
    feed_ingestion: DataFrame, ingestion: DataFrame, tiles: DataFrame, today: dt.date
) -> DataFrame:
    """The headline row; deltas add up the tiles that have one and are null when none has.

    The tiles of the monitors with a history are enough: the orphans' never has a delta.
    """
    deltas = tiles.agg(
        F.struct(
            F.sum("count_delta").alias("issues"), F.sum("past_threshold_delta").alias("past_threshold")
        )
    ).scalar()
    issues = datasets_with_errors_today(ingestion, today).scalar()
    return latest_crawl(feed_ingestion).select(
        F.col("datasets").alias("publishers_monitored"),
        issues.alias("publishers_with_issues"),
        F.lit(None).cast("bigint").alias("open_incidents"),
        F.lit(None).cast("bigint").alias("past_threshold"),
        "feeds",
        "datasets",
        deltas["issues"].alias("publishers_with_issues_delta"),
        F.lit(None).cast("bigint").alias("open_incidents_delta"),
        deltas["past_threshold"].alias("past_threshold_delta"),
        "generated_at",
    )
