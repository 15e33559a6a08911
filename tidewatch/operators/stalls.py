"""Feeds and datasets that stopped publishing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.daily import FeedDayState, feed_days, first_log_day, on_spine, trailing_array, trailing_days
from tidewatch.operators.hydrate import (
    incident_columns,
    with_dataset_identity,
    with_feed_identity,
    with_feed_label,
)
from tidewatch.thresholds import StallThresholds

SINGLE_FEED = "single_feed_stall"
DATASET = "dataset_stall"


def _published() -> Column:
    return F.col("updated") > 0


def _is_stalled(silent: Column, th: StallThresholds) -> Column:
    return silent.between(th.stall_days, th.lookback_days)


def publishing_days(history: DataFrame | FeedDayState, first: dt.date, last: dt.date) -> DataFrame:
    """``feed_days`` without the log's very first day."""
    return feed_days(history, first, last).where(F.col("day") > first_log_day(history))


def feed_silence(history: DataFrame | FeedDayState, as_of: dt.date, th: StallThresholds) -> DataFrame:
    """One row per feed seen in the incident window: the dataset of its latest run, last_published, trend array."""
    first = as_of - dt.timedelta(days=th.incident_history_days)
    recent = trailing_days(as_of, th.incident_trend_days)
    return publishing_days(history, first, as_of).groupBy("feed_id").agg(
        F.max(F.when(_published(), F.col("day"))).alias("last_published"),
        trailing_array(F.coalesce("updated", F.lit(0)), recent).alias("trend"),
        F.min("owner")["dataset_id"].alias("dataset_id"),
    )


def _with_incident_days(df: DataFrame, as_of: dt.date, th: StallThresholds) -> DataFrame:
    silent = F.datediff(F.lit(as_of), F.col("last_published"))
    return (
        df.withColumn("consecutive_days", silent)
        .where(_is_stalled(F.col("consecutive_days"), th))
        .withColumn("past_threshold", F.col("consecutive_days") >= th.past_days)
        .withColumn("first_detected", F.col("last_published"))
        .withColumn("days_open", F.col("consecutive_days"))
    )


def single_feed_stalls(
    history: DataFrame | FeedDayState,
    feed_names: DataFrame,
    dataset_names: DataFrame,
    as_of: dt.date,
    thresholds: StallThresholds = StallThresholds(),
) -> DataFrame:
    """Silent feeds of datasets in which at least one other feed still publishes."""
    feeds = feed_silence(history, as_of, thresholds)
    # A dataset is alive when its latest publisher is; keyed by dataset, one row each.
    alive = (
        feeds.groupBy("dataset_id")
        .agg(F.max("last_published").alias("latest"))
        .where(F.datediff(F.lit(as_of), F.col("latest")) < thresholds.stall_days)
        .select("dataset_id")
    )
    stalled = _with_incident_days(feeds, as_of, thresholds).join(alive, "dataset_id", "left_semi")
    return (
        with_feed_identity(stalled, feed_names, dataset_names)
        .select("*", *incident_columns(SINGLE_FEED))
        .orderBy(F.desc("consecutive_days"), F.asc("feed_id"))
    )


def _stalled_datasets(feeds: DataFrame, as_of: dt.date, th: StallThresholds) -> DataFrame:
    positions = range(th.incident_trend_days)
    datasets = feeds.groupBy("dataset_id").agg(
        F.max("last_published").alias("last_published"),
        F.count(F.lit(1)).alias("feed_count"),
        # Sum per day over the feeds that ran; null only when none did.
        F.array(*[F.sum(F.col("trend")[i]) for i in positions]).alias("trend"),
    )
    return _with_incident_days(datasets, as_of, th)


def dataset_stalls(
    history: DataFrame | FeedDayState,
    dataset_names: DataFrame,
    as_of: dt.date,
    thresholds: StallThresholds = StallThresholds(),
) -> DataFrame:
    """Datasets none of whose feeds has published for the stall period."""
    stalled = _stalled_datasets(feed_silence(history, as_of, thresholds), as_of, thresholds)
    return (
        with_dataset_identity(stalled, dataset_names)
        .select("*", *incident_columns(DATASET))
        .orderBy(F.desc("consecutive_days"), F.asc("dataset_url"))
    )


def dataset_stall_feeds(
    history: DataFrame | FeedDayState,
    feed_names: DataFrame,
    as_of: dt.date,
    thresholds: StallThresholds = StallThresholds(),
) -> DataFrame:
    """Per-feed silences of the stalled datasets: most recent first, never published last."""
    feeds = feed_silence(history, as_of, thresholds)
    stalled = _stalled_datasets(feeds, as_of, thresholds).select("dataset_id")
    rows = feeds.join(stalled, "dataset_id", "left_semi").select(
        F.col("dataset_id").alias("dataset_url"),
        "feed_id",
        "last_published",
        F.datediff(F.lit(as_of), F.col("last_published")).alias("consecutive_days"),
    )
    return with_feed_label(rows, feed_names).orderBy(
        "dataset_url", F.asc_nulls_last("consecutive_days"), "feed_id"
    )


def silence_by_day(days: DataFrame, as_of: dt.date, th: StallThresholds) -> DataFrame:
    """Per (dataset, day of the trend): stalled feeds, past-threshold feeds, shortest silence; from feed days.

    Each published day of a feed is its last one until the next, so one row per feed and
    trend day follows from the gaps alone.  The rows are added up per (dataset, day) before
    they leave the task.  A feed's dataset is the one of its latest run for every day.
    """
    trend_start = as_of - dt.timedelta(days=th.trend_days - 1)
    of_feed = Window.partitionBy("feed_id")
    # Of the days before the trend only each feed's last published one matters.
    published = (
        days.groupBy("feed_id", F.when(F.col("day") >= F.lit(trend_start), F.col("day")).alias("slot"))
        .agg(F.max(F.when(_published(), F.col("day"))).alias("day"), F.min("owner").alias("owner"))
        .withColumn("dataset_id", F.min("owner").over(of_feed)["dataset_id"])
        .where(F.col("day").isNotNull())
    )
    gaps = (
        published
        .withColumn("next_day", F.lead("day").over(of_feed.orderBy("day")))
        .withColumn("first", F.greatest("day", F.lit(trend_start)))
        .withColumn("last", F.coalesce(F.date_sub("next_day", 1), F.lit(as_of)))
        .where(F.col("first") <= F.col("last"))
    )
    silences = gaps.select(
        "dataset_id",
        F.col("day").alias("published"),
        F.explode(F.sequence("first", "last")).alias("day"),
    ).withColumn("silent", F.datediff("day", "published"))
    stalled = _is_stalled(F.col("silent"), th)
    return silences.groupBy("dataset_id", "day").agg(
        F.count_if(stalled).alias("stalled_feeds"),
        F.count_if(stalled & (F.col("silent") >= th.past_days)).alias("past_feeds"),
        F.min("silent").alias("shortest"),
    )


def _feed_counts(th: StallThresholds) -> list[Column]:
    alive = F.col("shortest") < th.stall_days
    return [
        F.sum(F.when(alive, F.col("stalled_feeds")).otherwise(0)).alias("open_count"),
        F.sum(F.when(alive, F.col("past_feeds")).otherwise(0)).alias("past_threshold_count"),
    ]


def _dataset_counts(th: StallThresholds) -> list[Column]:
    stalled = _is_stalled(F.col("shortest"), th)
    return [
        F.count_if(stalled).alias("open_count"),
        F.count_if(stalled & (F.col("shortest") >= th.past_days)).alias("past_threshold_count"),
    ]


def _trend_days(history: DataFrame | FeedDayState, as_of: dt.date, th: StallThresholds) -> DataFrame:
    return publishing_days(history, as_of - dt.timedelta(days=th.trend_history_days), as_of)


def single_feed_stall_trend(
    history: DataFrame | FeedDayState, as_of: dt.date, thresholds: StallThresholds = StallThresholds()
) -> DataFrame:
    """Open and past-threshold feeds on each of the last ``trend_days`` days."""
    silences = silence_by_day(_trend_days(history, as_of, thresholds), as_of, thresholds)
    return on_spine(silences.groupBy("day").agg(*_feed_counts(thresholds)), as_of, thresholds.trend_days)


def dataset_stall_trend(
    history: DataFrame | FeedDayState, as_of: dt.date, thresholds: StallThresholds = StallThresholds()
) -> DataFrame:
    """Open and past-threshold datasets on each of the last ``trend_days`` days."""
    silences = silence_by_day(_trend_days(history, as_of, thresholds), as_of, thresholds)
    return on_spine(silences.groupBy("day").agg(*_dataset_counts(thresholds)), as_of, thresholds.trend_days)


def stall_counts(days: DataFrame, as_of: dt.date, thresholds: StallThresholds) -> DataFrame:
    """(monitor_id, day, counts) of both stall trends from feed days without the log's first one, in one pass."""
    feed_open, feed_past = _feed_counts(thresholds)
    dataset_open, dataset_past = _dataset_counts(thresholds)
    counts = (
        silence_by_day(days, as_of, thresholds)
        .groupBy("day")
        .agg(
            F.struct(feed_open.alias("open_count"), feed_past.alias("past_threshold_count")).alias(SINGLE_FEED),
            F.struct(dataset_open.alias("open_count"), dataset_past.alias("past_threshold_count")).alias(DATASET),
        )
    )
    return counts.select(
        "day",
        F.inline(F.array(*[
            F.struct(F.lit(monitor).alias("monitor_id"), f"{monitor}.open_count", f"{monitor}.past_threshold_count")
            for monitor in (SINGLE_FEED, DATASET)
        ])),
    )
