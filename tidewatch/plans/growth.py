"""Month-over-month growth of the crawled estate."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.jsontext import json_scalars
from tidewatch.functions.text import fold_case
from tidewatch.operators.filters import within_days
from tidewatch.operators.hydrate import with_dataset_identity

DEFAULT_MONTHS = 12
MIN_DAYS_IN_PROGRESS = 5


def month_start(day: dt.date) -> dt.date:
    return day.replace(day=1)


def month_end(day: dt.date) -> dt.date:
    return day.replace(day=calendar.monthrange(day.year, day.month)[1])


def shift_month(month: dt.date, by: int) -> dt.date:
    index = month.year * 12 + month.month - 1 + by
    return dt.date(index // 12, index % 12 + 1, 1)


def candidate_months(as_of: dt.date, months: int = DEFAULT_MONTHS) -> list[dt.date]:
    """The last ``months`` complete months, and the running one when it is not complete."""
    if months < 1:
        raise ValueError(f"months must be at least 1, not {months}")
    current = month_start(as_of)
    complete = as_of == month_end(as_of)
    last = current if complete else shift_month(current, -1)
    candidates = [shift_month(last, -back) for back in range(months - 1, -1, -1)]
    return candidates if complete else [*candidates, current]


#: Months of one word of a bitmap.
WORD_MONTHS = 62

FIGURES = ("added", "removed", "with_future", "without_future", "stopped", "stopped_all_runs_failed", "not_ingested")
LISTED_FIGURES = ("added", "removed", "without_future", "stopped", "stopped_all_runs_failed", "not_ingested")


def month_count(first: dt.date, last: dt.date) -> int:
    return (last.year - first.year) * 12 + last.month - first.month + 1


def dataset_bitmaps(feed_ingestion: DataFrame, ingestion: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """One row per dataset of what was listed and ingested, with its months as bits: one read of each log.

    Each of ``crawled`` (listed or ingested), ``ingested``, ``changed`` (some run updated or deleted records),
    ``future`` (some run had future opportunities) and ``succeeded`` (some run did not fail) is an array of words,
    the month of ``first`` the lowest bit.  A bit is set by OR-ing, so the logs are reduced to these rows before
    anything is shuffled, whatever the number of months.
    """
    listed = F.filter(json_scalars(F.col("datasets")), lambda url: url != "")
    nothing = F.lit(False)
    crawls = feed_ingestion.where(within_days("ingestion_date", first, last)).select(
        F.to_date("ingestion_date").alias("run_day"),
        F.explode(listed).alias("dataset_id"),
        nothing.alias("ingested"), nothing.alias("changed"), nothing.alias("future"), nothing.alias("succeeded"),
    )
    runs = ingestion.where(within_days("ingestion_date", first, last) & (F.col("dataset_id") != "")).select(
        F.to_date("ingestion_date").alias("run_day"),
        "dataset_id",
        F.lit(True).alias("ingested"),
        (F.coalesce("updated", F.lit(0)) + F.coalesce("deleted", F.lit(0)) != 0).alias("changed"),
        (F.coalesce("total_future_opportunities", F.lit(0)) > 0).alias("future"),
        (~F.coalesce(F.col("status") == "ERROR", nothing)).alias("succeeded"),
    )
    index = (F.year("run_day") - first.year) * 12 + F.month("run_day") - first.month
    words = range(-(-month_count(first, last) // WORD_MONTHS))

    def bits(name: str, test: Column) -> list[Column]:
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(WORD_MONTHS)))
        inside = [F.floor(F.col("at") / WORD_MONTHS) == w for w in words]
        return [F.bit_or(F.when(test & own, one)).alias(f"{name}_{w}") for w, own in zip(words, inside)]

    named = {"crawled": F.lit(True), **{n: F.col(n) for n in ("ingested", "changed", "future", "succeeded")}}
    zero = F.lit(0).cast("bigint")
    return (
        crawls.unionByName(runs)
        .withColumn("at", index.cast("int"))
        .groupBy("dataset_id")
        .agg(*[column for name, test in named.items() for column in bits(name, test)])
        .select("dataset_id", *[
            F.array(*[F.coalesce(f"{name}_{w}", zero) for w in words]).alias(name) for name in named
        ])
    )


def figure_bitmaps(bitmaps: DataFrame, months: int) -> DataFrame:
    """(dataset_id, crawled, figures): the months that count a dataset under each figure, as bitmaps.

    Added and removed months are those whose bit differs from the month before, found by shifting the bitmap by
    one month; a removal counts in the month after.  The first month has none before it and adds all it has.
    """
    words = range(-(-months // WORD_MONTHS))

    def words_of(combine: Callable[[int], Column]) -> Column:
        return F.array(*[combine(w) for w in words])

    def word(name: str, w: int) -> Column:
        return F.col(name)[w]

    def before(w: int) -> Column:
        """The crawled months moved up by one, with the last month of the lower word."""
        moved = F.shiftleft(word("crawled", w), 1).bitwiseAND(F.lit(2**WORD_MONTHS - 1))
        return moved if w == 0 else moved.bitwiseOR(F.shiftright(word("crawled", w - 1), WORD_MONTHS - 1))

    def less(one: Column, other: Column) -> Column:
        return one.bitwiseAND(F.bitwise_not(other))

    def stopped(w: int) -> Column:
        return less(word("ingested", w), word("changed", w))

    figures = {
        "added": lambda w: less(word("crawled", w), before(w)),
        "removed": lambda w: less(before(w), word("crawled", w)),
        "with_future": lambda w: word("ingested", w).bitwiseAND(word("future", w)),
        "without_future": lambda w: less(word("ingested", w), word("future", w)),
        "stopped": stopped,
        "stopped_all_runs_failed": lambda w: less(stopped(w), word("succeeded", w)),
        "not_ingested": lambda w: less(word("crawled", w), word("ingested", w)),
    }
    return bitmaps.select("dataset_id", "crawled", *[words_of(figures[name]).alias(name) for name in FIGURES])


def dataset_flags(bitmaps: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(month, dataset_id, crawled and the figure flags) of ``dataset_bitmaps``, for the months with any.

    The months are read off a dataset's bits in the task that holds it.
    """
    months = month_count(first, last)
    names = ("crawled", *FIGURES)
    at = F.explode(F.sequence(F.lit(0), F.lit(months - 1))).alias("at")
    rows = figure_bitmaps(bitmaps, months).select("dataset_id", *names, at)
    word = (F.floor(F.col("at") / WORD_MONTHS) + 1).cast("int")
    flags = {n: F.getbit(F.element_at(n, word), F.pmod("at", F.lit(WORD_MONTHS))) == 1 for n in names}
    return (
        rows.withColumns(flags)
        .where(F.col("crawled") | F.col("removed"))
        .select(F.add_months(F.lit(month_start(first)), F.col("at")).alias("month"), "dataset_id", *names)
    )


def month_days(feed_ingestion: DataFrame, ingestion: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(month, crawl_days, feed_days): the days of each log as bits, counted by OR-ing; reads the timestamps alone."""
    bit = F.expr("shiftleft(1, day(run_day) - 1)")

    def of(log: DataFrame, name: str) -> DataFrame:
        days = log.where(within_days("ingestion_date", first, last)).select(F.to_date("ingestion_date").alias("run_day"))
        return days.groupBy(F.trunc("run_day", "month").alias("month")).agg(F.bit_or(bit).alias(name))

    both = of(feed_ingestion, "crawl_days").unionByName(of(ingestion, "feed_days"), allowMissingColumns=True)
    return both.groupBy("month").agg(F.max("crawl_days").alias("crawl_days"), F.max("feed_days").alias("feed_days"))


def _figures(flags: DataFrame, days: DataFrame, as_of: dt.date, months: int) -> DataFrame:
    """Reported months with their counts; every frame here has one row per month."""
    candidates = candidate_months(as_of, months)
    baseline = shift_month(candidates[0], -1)
    spine = flags.sparkSession.range(1).select(
        F.explode(
            F.sequence(F.lit(baseline), F.lit(candidates[-1]), F.expr("interval 1 month"))
        ).alias("month")
    )
    measures = ("days_with_data", "days_with_feed_data", "crawled", *FIGURES)
    counts = flags.groupBy("month").agg(*[F.count_if(name).alias(name) for name in ("crawled", *FIGURES)])
    counted_days = days.select(
        "month",
        F.bit_count("crawl_days").cast("bigint").alias("days_with_data"),
        F.bit_count("feed_days").cast("bigint").alias("days_with_feed_data"),
    )
    in_order = Window.partitionBy(F.lit(1)).orderBy("month")
    everything = Window.partitionBy(F.lit(1))
    zero = F.lit(0).cast("bigint")
    evaluated = (
        spine.join(counts, "month", "left")
        .join(counted_days, "month", "left")
        .withColumns({name: F.coalesce(name, zero) for name in measures})
        .withColumn("crawled_before", F.lag("crawled").over(in_order))
        .where(F.col("month") >= F.lit(candidates[0]))
        .withColumn("in_progress", F.last_day("month") > F.lit(as_of))
        .where(~F.col("in_progress") | (F.col("days_with_data") >= MIN_DAYS_IN_PROGRESS))
    )
    has_data = (F.col("days_with_data") > 0) | (F.col("days_with_feed_data") > 0) | (F.col("crawled") > 0)
    newest_first = Window.partitionBy(F.lit(1)).orderBy(F.desc("month"))
    return (
        evaluated.withColumn("first_month", F.min(F.when(has_data, F.col("month"))).over(everything))
        .where(F.col("month") >= F.col("first_month"))
        .withColumn("recency", F.row_number().over(newest_first))
        .where(F.col("recency") <= months)
        .drop("recency", "first_month")
    )


def _months_window(as_of: dt.date, months: int) -> tuple[dt.date, dt.date]:
    candidates = candidate_months(as_of, months)
    return shift_month(candidates[0], -1), min(month_end(candidates[-1]), as_of)


def _flags_and_days(
    feed_ingestion: DataFrame, ingestion: DataFrame, as_of: dt.date, months: int
) -> tuple[DataFrame, DataFrame]:
    window = _months_window(as_of, months)
    bitmaps = dataset_bitmaps(feed_ingestion, ingestion, *window)
    return dataset_flags(bitmaps, *window), month_days(feed_ingestion, ingestion, *window)


def _comparable() -> Column:
    return F.col("crawled_before") > 0


def _has_feed_data() -> Column:
    return F.col("days_with_feed_data") > 0


def ecosystem_growth(
    feed_ingestion: DataFrame, ingestion: DataFrame, as_of: dt.date, months: int = DEFAULT_MONTHS
) -> DataFrame:
    """One row per reported month, oldest first.

    Added and removed are null without a previous month to compare with; the publishing
    figures are null in a month without any feed run.
    """
    flags, days = _flags_and_days(feed_ingestion, ingestion, as_of, months)
    return (
        _figures(flags, days, as_of, months)
        .select(
            F.col("month").alias("period_start"),
            F.last_day("month").alias("period_end"),
            "in_progress",
            "days_with_data",
            "days_with_feed_data",
            F.col("crawled").alias("datasets_crawled"),
            *[
                F.when(_comparable() if name in ("added", "removed") else _has_feed_data(), F.col(name)).alias(
                    f"datasets_{name}"
                )
                for name in FIGURES
            ],
        )
        .orderBy("period_start")
    )


def ecosystem_growth_datasets(
    feed_ingestion: DataFrame,
    ingestion: DataFrame,
    dataset_names: DataFrame,
    as_of: dt.date,
    months: int = DEFAULT_MONTHS,
) -> DataFrame:
    """The datasets behind the figures: (period_start, figure, dataset and publisher names)."""
    flags, days = _flags_and_days(feed_ingestion, ingestion, as_of, months)
    # Counts are never negative: asking for all of them keeps this side's bitmaps the same as the listed ones, so
    # that both come from one exchange.
    counted = sum((F.col(name) for name in FIGURES[1:]), F.col(FIGURES[0])) >= 0
    reported = _figures(flags, days, as_of, months).where(counted).select(
        "month", _comparable().alias("comparable"), _has_feed_data().alias("has_feed_data")
    )
    rows = flags.join(reported, "month")
    named = F.filter(
        F.array(
            *[
                F.when(
                    F.col(name)
                    & (F.col("comparable") if name in ("added", "removed") else F.col("has_feed_data")),
                    F.lit(name),
                )
                for name in LISTED_FIGURES
            ]
        ),
        lambda name: name.isNotNull(),
    )
    listed = rows.select(F.col("month").alias("period_start"), "dataset_id", F.explode(named).alias("figure"))
    return with_dataset_identity(listed, dataset_names).orderBy(
        "period_start", "figure", fold_case(F.col("dataset_name")), "dataset_url"
    )
