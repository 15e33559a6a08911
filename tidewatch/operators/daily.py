"""Per (feed, day) frames of the ingestion log, for all history monitors.

One conditional hash aggregate reduces the log to (feed, dataset, day) rows of fixed-width measures, so a feed
holding a large part of the log is reduced on the map side before anything is shuffled; no text is carried along.
These short rows are brought together by feed once, folded to one row a (feed, day), and all that follows per
feed works in that partitioning.  A monitor that uses some measures reads only their columns; those that are
evaluated together take the same rows (``shared_days``) and share the scan and the exchange.

The rows may come from the stored feed-day state instead of the log (``tidewatch.sources.feed_day_store``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.filters import clean_values, within_days

#: Codes of failures that the publisher has to settle: fixed values, in order.
AUTH_CODES = ("401", "403")
#: What a day without a completed or failed run is taken for, where its first status in any case is one of these.
_STATUSES = ("complete", "error")
#: Above any level: packs (instant, level) into one number that can be compared.
_LEVELS = Decimal(10**20)
_LOWEST = Decimal(2**63)
#: Room for the class of an error code below an instant.
_CLASS_BITS = 3
_CLASSES = 2**_CLASS_BITS
#: How the measures of two sets of runs of one (feed, dataset, kind, day) make those of both.
MEASURES = {
    "runs": F.sum, "latest": F.max, "updated": F.sum, "completes": F.sum, "failures": F.sum, "least_status": F.min,
    "failure": F.max,
    "level": F.max, "supplied": F.max, "supply_updated": F.sum, "supply_deletes": F.sum,
}


@dataclass(frozen=True)
class FeedDayState:
    """The stored state: ``rows`` of measures by (feed_id, dataset_id, kind, day), ``failures`` with the details of
    the failed runs by (feed_id, day, latest), ``index`` with the rows of the log by day.
    """

    rows: DataFrame
    failures: DataFrame
    index: DataFrame


def instant() -> Column:
    return F.unix_micros(F.col("ingestion_date").cast("timestamp"))


def attributed(ingestion: DataFrame) -> DataFrame:
    """The runs that name their feed and dataset, with their day."""
    return ingestion.where(F.col("feed_id").isNotNull() & F.col("dataset_id").isNotNull()).withColumn(
        "day", F.to_date("ingestion_date")
    )


def _place(text: Column, among: Iterable[str]) -> Column:
    """The place of a text among others in order, as a small number that keeps the order of texts.

    Odd numbers are the others themselves, even ones what lies before, between and after them; null stays null.
    """
    return sum(((text >= a).cast("bigint") + (text > a).cast("bigint") for a in among), F.lit(0).cast("bigint"))


def _code_class() -> Column:
    """The place of an error code among AUTH_CODES, null last."""
    return F.coalesce(_place(F.col("error_code"), AUTH_CODES), F.lit(2 * len(AUTH_CODES) + 2).cast("bigint"))


def supplies(ignored_kinds: Iterable[str] = ()) -> Column:
    """A completed run that tells its future opportunities, of a kind that counts; a run without a kind does."""
    told = (F.col("status") == "COMPLETE") & F.col("total_future_opportunities").isNotNull()
    ignored = clean_values(ignored_kinds)
    return told & (F.col("kind").isNull() | ~F.col("kind").isin(ignored)) if ignored else told


def measured(runs: DataFrame, keys: Iterable[str], ignored_kinds: Iterable[str] = ()) -> DataFrame:
    """The measures of attributed runs by ``keys``; fixed-width buffers only, so this is a hash aggregate.

    ``failure`` packs the instant of the latest failed run and the class of its code, the first code on a tie;
    ``level`` packs the instant and the level of the latest supply, the higher one on a tie.
    """
    failed = F.col("status") == "ERROR"
    supply = supplies(ignored_kinds)
    failure = instant() * _CLASSES + (F.lit(_CLASSES - 1) - _code_class())
    whole = "decimal(38,0)"
    level = F.col("total_future_opportunities").cast("decimal(20,0)") + F.lit(_LOWEST).cast("decimal(20,0)")
    packed = (instant().cast("decimal(17,0)") * F.lit(_LEVELS).cast("decimal(21,0)")).cast(whole) + level
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(instant()).alias("latest"),
        F.sum("updated").alias("updated"),
        F.count_if(F.col("status") == "COMPLETE").alias("completes"),
        F.count_if(failed).alias("failures"),
        F.min(_place(F.lower("status"), _STATUSES)).alias("least_status"),
        F.max(F.when(failed, failure)).alias("failure"),
        F.max(F.when(supply, packed.cast(whole))).alias("level"),
        F.max(F.when(supply, instant())).alias("supplied"),
        F.sum(F.when(supply, F.col("updated"))).alias("supply_updated"),
        F.sum(F.when(supply, F.col("actual_deletes"))).alias("supply_deletes"),
    )


def failure_details(runs: DataFrame) -> DataFrame:
    """(feed_id, day, latest, error_code, error_message) of attributed failed runs, one row an instant.

    Of several at one instant, the first code counts, a missing one last, then the first message.
    """
    detail = F.min(F.struct(F.col("error_code").isNull().alias("no_code"), "error_code", F.col("warning_message").alias("error_message")))
    return (
        runs.where(F.col("status") == "ERROR")
        .groupBy("feed_id", "day", instant().alias("latest"))
        .agg(detail.alias("detail"))
        .select("feed_id", "day", "latest", "detail.error_code", "detail.error_message")
    )


def first_log_day(history: DataFrame | FeedDayState) -> Column:
    """The day of the log's first run, as a scalar: from the index where there is one, else by reading the log."""
    if isinstance(history, FeedDayState):
        return history.index.agg(F.min("day")).scalar()
    return history.agg(F.to_date(F.min("ingestion_date"))).scalar()


def feed_days(
    history: DataFrame | FeedDayState,
    first: dt.date,
    last: dt.date,
    ignored_kinds: Iterable[str] = (),
    only: Column | None = None,
) -> DataFrame:
    """One row per (feed, day) of the window, the days of a feed together.

    ``updated`` totals the day's publishing and is null when no run tells it; ``owner`` and ``supply_owner`` are
    (minus instant, dataset) of the day's latest run and latest supply, so that the smallest one is the latest, the
    first dataset on a tie; ``dataset_id`` is the first dataset.  ``only`` narrows the runs of a log beforehand, to
    those that the caller's measures count anyway.
    """
    if isinstance(history, FeedDayState):
        rows = history.rows.where(F.col("day").between(F.lit(first), F.lit(last)))
        ignored = clean_values(ignored_kinds)
        if ignored:
            counts = F.col("kind").isNull() | ~F.col("kind").isin(ignored)
            rows = rows.withColumns({
                name: F.when(counts, F.col(name)) for name in ("level", "supplied", "supply_updated", "supply_deletes")
            })
        if only is not None:
            rows = rows.where(F.col("supplied").isNotNull())
    else:
        runs = attributed(history.where(within_days("ingestion_date", first, last)))
        rows = measured(runs if only is None else runs.where(only), ("feed_id", "dataset_id", "day"), ignored_kinds)

    def owner(latest: str) -> Column:
        named = F.struct((-F.col(latest)).alias("order"), "dataset_id")
        return F.min(F.when(F.col(latest).isNotNull(), named))

    return (
        rows.repartition("feed_id")
        .groupBy("feed_id", "day")
        .agg(
            *(combine(name).alias(name) for name, combine in MEASURES.items()),
            F.min("dataset_id").alias("dataset_id"),
            owner("latest").alias("owner"),
            owner("supplied").alias("supply_owner"),
        )
    )


def shared_days(days: DataFrame) -> DataFrame:
    """The same rows with all their columns tied together, so that plans which use different ones share their source.

    A feed has one row a day of the window, so what is held together is bounded by the window.
    """
    tied = F.struct(*[name for name in days.columns if name != "feed_id"])
    return days.groupBy("feed_id").agg(F.collect_list(tied).alias("days")).select("feed_id", F.inline("days"))


def status_columns(days: DataFrame) -> DataFrame:
    """With ``completed``, ``failed`` (a completed run wins the day) and ``reportable`` of each (feed, day).

    The day's latest run decides the detail, a failed run before another kind at the same instant; a day whose
    latest run did not fail has none.  A day without a run of either kind goes by its first status in lower case.  Failures are reportable unless their code is one of AUTH_CODES.
    """
    decided = F.shiftright("failure", _CLASS_BITS) == F.col("latest")
    neither = (F.col("completes") == 0) & (F.col("failures") == 0)
    odd = (_CLASSES - 1 - F.pmod(F.col("failure"), F.lit(_CLASSES))) % 2 == 1
    return days.withColumns(
        {
            "completed": (F.col("completes") > 0) | (neither & F.coalesce(F.col("least_status") == 1, F.lit(False))),
            "failed": F.when(neither, F.coalesce(F.col("least_status") == 3, F.lit(False))).otherwise(F.col("completes") == 0),
            "reportable": ~F.coalesce(decided & odd, F.lit(False)),
            "decided": F.coalesce(decided, F.lit(False)),
        }
    )


def supply_level(packed: Column) -> Column:
    """The level in a packed (instant, level)."""
    return (packed % F.lit(_LEVELS).cast("decimal(21,0)") - F.lit(_LOWEST).cast("decimal(20,0)")).cast("bigint")


def supply_columns(days: DataFrame) -> DataFrame:
    """(feed_id, day, dataset_id, future, updated, deletes) of the days with a supply."""
    return days.where(F.col("level").isNotNull()).select(
        "feed_id",
        "day",
        F.col("supply_owner.dataset_id").alias("dataset_id"),
        supply_level(F.col("level")).alias("future"),
        F.coalesce("supply_updated", F.lit(0)).alias("updated"),
        F.coalesce("supply_deletes", F.lit(0)).alias("deletes"),
    )


def supply_days(
    history: DataFrame | FeedDayState, first: dt.date, last: dt.date, ignored_kinds: Iterable[str]
) -> DataFrame:
    """``supply_columns`` of a window of the history."""
    return supply_columns(feed_days(history, first, last, ignored_kinds, supplies(ignored_kinds)))


def trailing_days(as_of: dt.date, count: int) -> list[dt.date]:
    """``count`` days ending at ``as_of``, oldest first."""
    return [as_of - dt.timedelta(days=back) for back in range(count - 1, -1, -1)]


def trailing_array(value: Column, days: list[dt.date]) -> Column:
    """Array of per-day sums aligned to ``days``; a day without a row stays null."""
    return F.array(*[F.sum(F.when(F.col("day") == F.lit(day), value)) for day in days])


def day_spine(df: DataFrame, as_of: dt.date, count: int) -> DataFrame:
    """One row per day of the trend, ``count`` rows (at most 365)."""
    return df.sparkSession.range(0, 1, 1, 1).select(
        F.explode(
            F.sequence(F.lit(as_of - dt.timedelta(days=count - 1)), F.lit(as_of))
        ).alias("day")
    )


def on_spine(counts: DataFrame, as_of: dt.date, count: int) -> DataFrame:
    """Trend points (day plus counts) with zeros on the days that have none."""
    measures = [name for name in counts.columns if name != "day"]
    return (
        day_spine(counts, as_of, count)
        .join(counts, "day", "left")
        .na.fill(0, measures)
        .orderBy("day")
    )
