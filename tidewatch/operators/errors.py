"""Feeds whose ingestion keeps failing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.daily import (
    FeedDayState,
    attributed,
    feed_days,
    instant,
    on_spine,
    status_columns,
    trailing_array,
    trailing_days,
)
from tidewatch.operators.filters import within_days
from tidewatch.operators.hydrate import incident_columns, with_feed_identity
from tidewatch.thresholds import ErrorThresholds

MONITOR_ID = "feed_ingestion_error"


def _details(history: DataFrame | FeedDayState, day: dt.date) -> DataFrame:
    """(feed_id, latest, error_code, error_message) of the failed runs of one day, the only ones whose texts are read."""
    if isinstance(history, FeedDayState):
        return history.failures.where(F.col("day") == F.lit(day)).select("feed_id", "latest", "error_code", "error_message")
    failed = history.where(within_days("ingestion_date", day, day) & (F.col("status") == "ERROR"))
    return attributed(failed).select(
        "feed_id", instant().alias("latest"), "error_code", F.col("warning_message").alias("error_message")
    )


def feed_ingestion_errors(
    history: DataFrame | FeedDayState,
    feed_names: DataFrame,
    dataset_names: DataFrame,
    as_of: dt.date,
    thresholds: ErrorThresholds = ErrorThresholds(),
) -> DataFrame:
    """Feeds failing on ``as_of`` that completed at some earlier day of the lookback."""
    th = thresholds
    days = status_columns(feed_days(history, as_of - dt.timedelta(days=th.incident_history_days), as_of))
    today = F.col("day") == F.lit(as_of)
    recent = trailing_days(as_of, th.incident_trend_days)
    feeds = days.groupBy("feed_id").agg(
        F.min("dataset_id").alias("dataset_id"),
        F.max(F.when(F.col("completed"), F.col("day"))).alias("last_completed"),
        F.bool_or(today & F.col("failed") & F.col("reportable")).alias("failing"),
        F.max(F.when(today & F.col("decided"), F.col("latest"))).alias("latest"),
        F.transform(
            trailing_array(F.when(F.col("failed"), 1).otherwise(0), recent),
            lambda flag: F.coalesce(flag, F.lit(0)),
        ).alias("trend"),
    )
    failing = (
        feeds.where("failing")
        .withColumn("consecutive_days", F.datediff(F.lit(as_of), F.col("last_completed")))
        .where(F.col("consecutive_days").between(th.error_days, th.success_lookback_days))
        .withColumn("past_threshold", F.col("consecutive_days") >= th.past_days)
        .withColumn("first_detected", F.date_add("last_completed", 1))
        .withColumn("days_open", F.col("consecutive_days"))
        .drop("failing")
    )
    kept = [name for name in failing.columns if name not in ("feed_id", "latest")]
    detail = F.min(F.struct(F.col("error_code").isNull().alias("no_code"), "error_code", "error_message"))
    failing = (
        failing.join(_details(history, as_of), ["feed_id", "latest"], "left")
        .groupBy("feed_id")
        .agg(F.any_value(F.struct(*kept)).alias("kept"), detail.alias("detail"))
        .select("feed_id", "kept.*", "detail.error_code", "detail.error_message")
    )
    return (
        with_feed_identity(failing, feed_names, dataset_names)
        .select("*", *incident_columns(MONITOR_ID))
        .orderBy(F.desc("consecutive_days"), F.asc("feed_id"))
    )


def feed_ingestion_error_trend(
    history: DataFrame | FeedDayState, as_of: dt.date, thresholds: ErrorThresholds = ErrorThresholds()
) -> DataFrame:
    """Open and past-threshold feeds on each of the last ``trend_days`` days."""
    days = feed_days(history, as_of - dt.timedelta(days=thresholds.trend_history_days), as_of)
    return on_spine(error_counts(days, as_of, thresholds), as_of, thresholds.trend_days)


def error_counts(days: DataFrame, as_of: dt.date, th: ErrorThresholds) -> DataFrame:
    """(day, counts) of feed days for the trend's days that have any."""
    # One feed has at most one row per day of the window.
    so_far = Window.partitionBy("feed_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    completed = F.when(F.col("completed"), F.col("day"))
    failing = (
        status_columns(days)
        .withColumn("last_completed", F.max(completed).over(so_far))
        .where(
            F.col("failed")
            & F.col("reportable")
            & (F.col("day") >= F.lit(as_of - dt.timedelta(days=th.trend_days - 1)))
        )
        .withColumn("failing", F.datediff("day", "last_completed"))
        .where(F.col("failing").between(th.error_days, th.success_lookback_days))
    )
    return failing.groupBy("day").agg(
        F.count(F.lit(1)).alias("open_count"),
        F.count_if(F.col("failing") >= th.past_days).alias("past_threshold_count"),
    )
