"""The publisher notification work list and its counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.jsontext import json_array, json_field, safe_bigint, safe_date

FOLLOW_UP_DAYS = 5
# Days open from which an unresolved problem raises an alert, by monitor;
# a single-feed stall only counts on these feed types.
ALERT_DAYS = {"dataset_stall": 5, "single_feed_stall": 10, "feed_ingestion_error": 10}
STALL_FEED_TYPES = ("Slot", "ScheduledSession")


def notification_list(notifications: DataFrame) -> DataFrame:
    """All notifications, longest open first."""
    return notifications.withColumn("monitors", F.coalesce("monitors", F.array().cast("array<string>"))).orderBy(
        F.desc_nulls_last("oldest_days_open"), F.asc("publisher_name"), F.asc("id")
    )


def _over_threshold(problem: Column) -> Column:
    monitor = json_field(problem, "$.monitor_id")
    days_open = safe_bigint(json_field(problem, "$.days_open"))
    relevant = (monitor != "single_feed_stall") | json_field(problem, "$.feed_type").isin(*STALL_FEED_TYPES)
    limit = F.lit(None).cast("bigint")
    for name, days in ALERT_DAYS.items():
        limit = F.when(monitor == name, F.lit(days).cast("bigint")).otherwise(limit)
    unresolved = json_field(problem, "$.resolved_on").isNull()
    return F.coalesce(unresolved & relevant & (days_open >= limit), F.lit(False))


def _resolved_since_contact(problem: Column) -> Column:
    resolved_on = safe_date(json_field(problem, "$.resolved_on"))
    return F.coalesce(F.col("date_contacted") < resolved_on, F.lit(False))


def needs_alert(today: dt.date) -> Column:
    """Active, and uncontacted, due a follow-up, or with a problem that says so."""
    problems = F.coalesce(json_array(F.col("problems")), F.array().cast("array<variant>"))
    # The cheap date tests settle most rows; problems are only read where they do not.
    due = F.col("date_contacted").isNull() | (
        F.col("date_contacted") < F.lit(today - dt.timedelta(days=FOLLOW_UP_DAYS))
    )
    return F.col("status").isin("open", "in_progress") & (
        due | F.exists(problems, lambda p: _over_threshold(p) | _resolved_since_contact(p))
    )


def notification_summary(notifications: DataFrame, today: dt.date) -> DataFrame:
    """One row of counts by status, never contacted and alerts."""
    status = F.col("status")
    return notifications.agg(
        F.count(F.lit(1)).alias("publishers"),
        F.count_if(status == "open").alias("open"),
        F.count_if(status == "in_progress").alias("in_progress"),
        F.count_if(status == "closed").alias("closed"),
        F.count_if(F.col("date_contacted").isNull() & status.isin("open", "in_progress")).alias(
            "never_contacted"
        ),
        F.count_if(needs_alert(today)).alias("alerts"),
    )
