"""The feed-day state between runs: what the history monitors need of the log, kept day by day.

Three tables in day parts: the measures by (feed, dataset, kind, day), the details of failed runs, and an index of
the log's rows by day.  A daily run adds the new runs to their days and rewrites those days only, late runs
included; the monitors then read some hundred days of short rows instead of the log.  ``rebuild_days`` makes days
anew from the log, as often as one likes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.daily import MEASURES, FeedDayState, attributed, failure_details, measured
from tidewatch.operators.filters import within_days
from tidewatch.sources.part_store import PartStore

KEYS = ("feed_id", "dataset_id", "kind", "day")
ROWS = (
    "feed_id string, dataset_id string, kind string, day date, runs bigint, latest bigint, updated bigint, "
    "completes bigint, failures bigint, least_status bigint, failure bigint, level decimal(38,0), supplied bigint, "
    "supply_updated bigint, supply_deletes bigint"
)
FAILURES = "feed_id string, day date, latest bigint, error_code string, error_message string"
INDEX = "day date, rows bigint"


def state_rows(ingestion: DataFrame) -> DataFrame:
    """The measures of a log by (feed, dataset, kind, day)."""
    return measured(attributed(ingestion), KEYS)


def merged_rows(*states: DataFrame) -> DataFrame:
    """The state of all runs from the states of some each; no run may be in two of them."""
    return _united(states).groupBy(*KEYS).agg(*(combine(name).alias(name) for name, combine in MEASURES.items()))


def merged_failures(*details: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("error_code").isNull().alias("no_code"), "error_code", "error_message"))
    return (
        _united(details)
        .groupBy("feed_id", "day", "latest")
        .agg(first.alias("detail"))
        .select("feed_id", "day", "latest", "detail.error_code", "detail.error_message")
    )


def day_index(ingestion: DataFrame) -> DataFrame:
    """(day, rows) of a log, runs without a feed or dataset included; a run without a time has no day."""
    return ingestion.groupBy(F.to_date("ingestion_date").alias("day")).agg(F.count(F.lit(1)).alias("rows")).where(
        "day is not null"
    )


def merged_index(*indexes: DataFrame) -> DataFrame:
    return _united(indexes).groupBy("day").agg(F.sum("rows").alias("rows"))


def state_of(ingestion: DataFrame) -> FeedDayState:
    """The whole state of a log, not stored."""
    return FeedDayState(state_rows(ingestion), failure_details(attributed(ingestion)), day_index(ingestion))


def _united(frames: Iterable[DataFrame]) -> DataFrame:
    first, *others = frames
    for other in others:
        first = first.unionByName(other)
    return first


@dataclass(frozen=True)
class FeedDayStore:
    spark: SparkSession
    folder: str

    def _store(self, name: str) -> PartStore:
        return PartStore(self.spark, f"{self.folder}/{name}", {"rows": ROWS, "failures": FAILURES, "index": INDEX}[name])

    def state(self, first: dt.date | None = None) -> FeedDayState:
        """What is stored, from ``first`` on if given (the index always whole)."""
        index = self._store("index")
        snapshot = index.snapshot()
        parts = [n for n in snapshot.parts if first is None or n >= first.isoformat()]
        return FeedDayState(
            self._store("rows").read(parts=parts), self._store("failures").read(parts=parts), index.read(snapshot)
        )

    def first_day(self) -> dt.date | None:
        """The log's first day by the index; no row is read."""
        return min(map(dt.date.fromisoformat, self._store("index").snapshot().parts), default=None)

    def last_day(self) -> dt.date | None:
        return max(map(dt.date.fromisoformat, self._store("index").snapshot().parts), default=None)

    def add_runs(self, runs: DataFrame, batch: str) -> bool:
        """Add runs that are not in the state yet, of any days; a batch added before changes nothing.

        The three tables are brought up to date one after the other, each with the batch's name in its manifest,
        so an attempt that was broken off is finished by the next one with the same batch.
        """
        touched = self._touched(day_index(runs))
        new = state_of(runs)
        done = [
            self._add("rows", new.rows, touched, batch, merged_rows),
            self._add("failures", new.failures, touched, batch, merged_failures),
            self._add("index", new.index, touched, batch, merged_index),
        ]
        return any(done)

    def _touched(self, index: DataFrame) -> list[str]:
        return sorted(r.day.isoformat() for r in index.select("day").distinct().collect())  # days of one load

    def _add(self, name: str, new: DataFrame, touched: list[str], batch: str, merge) -> bool:
        store = self._store(name)
        before = store.snapshot()
        if batch in before.batches:
            return False
        rows = merge(store.read(before, touched), new)
        store.replace(before, rows, F.col("day").cast("string"), touched, batch)
        return True

    def rebuild_days(self, ingestion: DataFrame, first: dt.date, last: dt.date) -> None:
        """Make the days of a window anew from the log, whatever was stored for them."""
        new = state_of(ingestion.where(within_days("ingestion_date", first, last)))
        days = [(first + dt.timedelta(days=n)).isoformat() for n in range((last - first).days + 1)]
        for name, rows in (("rows", new.rows), ("failures", new.failures), ("index", new.index)):
            store = self._store(name)
            store.replace(store.snapshot(), rows, F.col("day").cast("string"), days)
