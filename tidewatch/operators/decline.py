"""Datasets whose future supply drains while their feeds keep completing."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import percent_drop
from tidewatch.operators.daily import FeedDayState, on_spine, supply_days, trailing_days
from tidewatch.operators.hydrate import incident_columns, with_dataset_identity, with_feed_label
from tidewatch.thresholds import DeclineThresholds

MONITOR_ID = "dataset_future_decline"
IGNORED_KINDS = ("Slot",)


def feed_declines(
    levels: DataFrame,
    first: dt.date,
    last: dt.date,
    thresholds: DeclineThresholds,
    trend_days: Sequence[dt.date] = (),
) -> DataFrame:
    """Declining feeds on each evaluated day ``as_of`` in ``first..last``.

    ``trend`` holds the feed's level on each of ``trend_days``, null where it has none.

    A feed's observations are brought together once (its window holds one row per day).  The evaluated
    days join them as rows without an observation, and RANGE frames over day numbers give each of these
    what its windows hold; no observation is copied.
    """
    th = thresholds
    in_order = Window.partitionBy("feed_id").orderBy("day")
    whole_feed = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels_of_days = {
        f"level_{i}": F.max(F.when(F.col("day") == F.lit(day), F.col("future"))).over(whole_feed)
        for i, day in enumerate(trend_days)
    }
    observed = (
        levels.withColumn("dataset_id", F.last("dataset_id").over(whole_feed))
        .withColumn("previous_day", F.lag("day").over(in_order))
        .withColumn("previous", F.lag("future").over(in_order))
        .withColumns(levels_of_days)
        .withColumn("falls", F.coalesce(F.col("future") < F.col("previous"), F.lit(False)))
    )
    observation = F.struct(
        "day",
        "future",
        "previous_day",
        "falls",
        F.when(F.col("falls"), percent_drop(F.col("previous") - F.col("future"), F.col("previous"))).alias("percent"),
    )
    # A feed's first observation brings the days to evaluate along.
    to_evaluate = F.when(
        F.col("previous_day").isNull() & (F.greatest("day", F.lit(first)) <= F.lit(last)),
        F.sequence(F.greatest("day", F.lit(first)), F.lit(last)),
    ).otherwise(F.array().cast("array<date>"))
    own = F.struct(F.col("day").alias("at"), "updated", "deletes", observation.alias("seen"))
    rows = observed.select(
        "feed_id", "dataset_id", *levels_of_days, own.alias("own"), to_evaluate.alias("to_evaluate")
    )
    none = [F.lit(None).cast(rows.schema["own"].dataType[name].dataType).alias(name) for name in ("updated", "deletes", "seen")]
    rows = rows.select(
        "feed_id",
        "dataset_id",
        *levels_of_days,
        F.inline(F.concat(F.array("own"), F.transform("to_evaluate", lambda day: F.struct(day.alias("at"), *none)))),
    )
    by_day = Window.partitionBy("feed_id").orderBy(F.unix_date("at"))
    window, qualify = (by_day.rangeBetween(1 - days, 0) for days in (th.window_days, th.qualify_days))
    framed = (
        rows.select(
            "feed_id",
            "dataset_id",
            *levels_of_days,
            F.col("at").alias("as_of"),
            F.col("seen").isNull().alias("is_evaluated"),
            # At most one observation a day of the window, in order of days.
            F.collect_list("seen").over(window).alias("seen"),
            F.sum("updated").over(window).alias("updated_in_window"),
            F.sum("deletes").over(window).alias("deletes_in_window"),
            F.first("seen.future", ignorenulls=True).over(qualify).alias("qualify_start_future"),
        )
        .where("is_evaluated")
    )

    def days_of(seen: Column) -> Column:
        return F.transform(seen, lambda x: x["day"])

    # A step needs both of its observations inside the window, so the first one makes none.
    steps = F.slice("seen", 2, F.greatest(F.size("seen") - 1, F.lit(0)))
    falls = F.filter(F.transform(steps, lambda x: F.struct((-x["percent"]).alias("depth"), x["day"].alias("day"), x["previous_day"].alias("previous_day"))), lambda x: x["depth"] < 0)
    still = F.filter(steps, lambda x: ~x["falls"])
    folded = framed.where(F.size("seen") > 0).select(
        "feed_id",
        "dataset_id",
        "as_of",
        F.size("seen").alias("observations"),
        F.col("seen")[0]["future"].alias("start_future"),
        F.element_at("seen", -1)["future"].alias("current_future"),
        F.element_at("seen", -1)["day"].alias("last_day"),
        "qualify_start_future",
        F.size(still).alias("rises"),
        F.array_max(F.transform(steps, lambda x: x["percent"])).alias("largest_daily_drop_percent"),
        # Steepest step, the earliest one on a tie.
        F.array_min(falls).alias("steepest"),
        # The run of falls that ends the window starts at the last observation that did not fall.
        F.coalesce(F.array_max(days_of(still)), F.col("seen")[0]["day"]).alias("run_start"),
        "updated_in_window",
        "deletes_in_window",
        F.array(*levels_of_days).cast("array<bigint>").alias("trend"),
    )
    judged = (
        folded.where(
            (F.col("observations") >= th.min_observations)
            & (F.col("start_future") >= th.min_future_opportunities)
        )
        .withColumn("largest_daily_drop_percent", F.coalesce("largest_daily_drop_percent", F.lit(0.0)))
        .withColumn("monotonic", F.col("rises") == 0)
        .withColumn("sharp", F.col("largest_daily_drop_percent") >= th.drop_percent)
        .where(F.col("monotonic") | F.col("sharp"))
        .withColumn(
            "qualify_drop_percent",
            percent_drop(
                F.col("qualify_start_future") - F.col("current_future"), F.col("qualify_start_future")
            ),
        )
        .withColumn("delta_in_window", F.col("updated_in_window") - F.col("deletes_in_window"))
        .where(
            (F.col("qualify_drop_percent") >= th.qualify_drop_percent) | (F.col("delta_in_window") < 0)
        )
    )
    drop = F.col("start_future") - F.col("current_future")
    ends_in_fall = F.col("run_start") < F.col("last_day")
    return judged.select(
        "feed_id",
        "dataset_id",
        "as_of",
        F.when(F.col("monotonic") & F.col("sharp"), "both")
        .when(F.col("monotonic"), "monotonic_decline")
        .otherwise("sharp_drop")
        .alias("reason"),
        F.when(ends_in_fall, F.col("run_start"))
        .otherwise(F.coalesce("steepest.previous_day", "run_start"))
        .alias("decline_start"),
        "start_future",
        "current_future",
        "qualify_start_future",
        drop.alias("drop"),
        percent_drop(drop, F.col("start_future")).alias("drop_percent"),
        "qualify_drop_percent",
        "largest_daily_drop_percent",
        "updated_in_window",
        "deletes_in_window",
        "delta_in_window",
        "trend",
    )


def _incident_levels(
    history: DataFrame | FeedDayState, as_of: dt.date, th: DeclineThresholds, ignored_kinds: Iterable[str]
) -> DataFrame:
    first = as_of - dt.timedelta(days=th.incident_history_days)
    return supply_days(history, first, as_of, ignored_kinds)


def dataset_future_decline(
    history: DataFrame | FeedDayState,
    dataset_names: DataFrame,
    as_of: dt.date,
    thresholds: DeclineThresholds = DeclineThresholds(),
    ignored_kinds: Iterable[str] = IGNORED_KINDS,
) -> DataFrame:
    """Incidents, one row per dataset over its declining feeds only, largest loss first."""
    th = thresholds
    levels = _incident_levels(history, as_of, th, ignored_kinds)
    recent = trailing_days(as_of, th.incident_trend_days)
    folded = (
        feed_declines(levels, as_of, as_of, th, recent)
        .groupBy("dataset_id")
        .agg(
            F.count(F.lit(1)).alias("feed_count"),
            F.when(F.min("reason") == F.max("reason"), F.min("reason")).otherwise("both").alias("reason"),
            F.min("decline_start").alias("first_detected"),
            F.sum("start_future").alias("start_total"),
            F.sum("current_future").alias("current_total"),
            F.sum("qualify_start_future").alias("qualify_start_total"),
            F.array(*[F.sum(F.col("trend")[i]) for i in range(len(recent))]).alias("trend"),
        )
    )
    drop = F.col("start_total") - F.col("current_total")
    qualify_drop = F.col("qualify_start_total") - F.col("current_total")
    incidents = (
        folded.withColumn("consecutive_days", F.datediff(F.lit(as_of), F.col("first_detected")))
        .withColumn("days_open", F.col("consecutive_days"))
        .withColumn("drop", drop)
        .withColumn("drop_percent", percent_drop(drop, F.col("start_total")))
        .withColumn("qualify_drop_percent", percent_drop(qualify_drop, F.col("qualify_start_total")))
        .withColumn("past_threshold", F.col("drop_percent") >= th.past_percent)
        .withColumn("window_days", F.lit(th.window_days))
        .withColumn("qualify_window_days", F.lit(th.qualify_days))
    )
    return (
        with_dataset_identity(incidents, dataset_names)
        .select("*", *incident_columns(MONITOR_ID))
        .orderBy(F.desc("drop"), F.desc("drop_percent"), F.asc("dataset_url"))
    )


def dataset_future_decline_feeds(
    history: DataFrame | FeedDayState,
    feed_names: DataFrame,
    as_of: dt.date,
    thresholds: DeclineThresholds = DeclineThresholds(),
    ignored_kinds: Iterable[str] = IGNORED_KINDS,
) -> DataFrame:
    """The feeds behind the incidents, largest loss first within each dataset."""
    levels = _incident_levels(history, as_of, thresholds, ignored_kinds)
    declines = (
        feed_declines(levels, as_of, as_of, thresholds)
        .withColumn("consecutive_declining_days", F.datediff("as_of", "decline_start"))
        .withColumnRenamed("dataset_id", "dataset_url")
        .drop("as_of", "decline_start", "trend")
    )
    return with_feed_label(declines, feed_names).orderBy(
        "dataset_url", F.desc("drop"), F.desc("drop_percent"), F.asc("feed_id")
    )


def dataset_future_decline_trend(
    history: DataFrame | FeedDayState,
    as_of: dt.date,
    thresholds: DeclineThresholds = DeclineThresholds(),
    ignored_kinds: Iterable[str] = IGNORED_KINDS,
) -> DataFrame:
    """Open and past-threshold datasets on each of the last ``trend_days`` days."""
    th = thresholds
    first = as_of - dt.timedelta(days=th.trend_history_days)
    counts = decline_counts(supply_days(history, first, as_of, ignored_kinds), as_of, th)
    return on_spine(counts, as_of, th.trend_days)


def decline_counts(levels: DataFrame, as_of: dt.date, th: DeclineThresholds) -> DataFrame:
    """(day, counts) of supply days for the trend's days that have any."""
    declines = feed_declines(levels, as_of - dt.timedelta(days=th.trend_days - 1), as_of, th)
    datasets = declines.groupBy("dataset_id", "as_of").agg(
        F.sum("start_future").alias("start_total"), F.sum("current_future").alias("current_total")
    )
    percent = percent_drop(F.col("start_total") - F.col("current_total"), F.col("start_total"))
    return datasets.groupBy(F.col("as_of").alias("day")).agg(
        F.count(F.lit(1)).alias("open_count"),
        F.count_if(percent >= th.past_percent).alias("past_threshold_count"),
    )
