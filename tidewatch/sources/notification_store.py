"""Applying a batch of notification changes to the current snapshot."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.sources.part_store import PartStore

# Columns a change overwrites, all of them: what a change leaves out becomes null.
WRITABLE = (
    "publisher_id",
    "publisher_name",
    "dataset_url",
    "problem_count",
    "monitors",
    "oldest_days_open",
    "status",
    "stakeholder",
    "contact",
    "date_contacted",
    "notes",
    "problems",
)

APPLIED, CONFLICT, NOT_FOUND = "applied", "conflict", "not_found"


@dataclass(frozen=True)
class MergeResult:
    snapshot: DataFrame
    outcomes: DataFrame


# Changes judged together: an id with more of them is taken in stretches of this many requests.
STRETCH = 100_000


def _judged(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with their outcome: each sees the effect of the earlier ones to its id.

    Only an insert or a delete decides whether the id exists afterwards.  The last of them is
    found per stretch of requests, handed on from stretch to stretch, and looked for within
    the stretch, so the many changes of one id are not one task's work.
    """
    leaves = F.when(F.col("op") == "insert", True).when(F.col("op") == "delete", False)
    earlier = Window.unboundedPreceding, -1
    placed = changes.withColumn("stretch", F.floor(F.col("seq") / STRETCH)).withColumn("leaves", leaves)
    from_before = (
        placed.groupBy("id", "stretch")
        .agg(F.max_by("leaves", F.when(F.col("leaves").isNotNull(), F.col("seq"))).alias("leaves"))
        .withColumn(
            "before_stretch",
            F.last("leaves", ignorenulls=True).over(
                Window.partitionBy("id").orderBy("stretch").rowsBetween(*earlier)
            ),
        )
        .drop("leaves")
        .join(current.select("id", F.lit(True).alias("stored")), "id", "left")
    )
    within = F.last("leaves", ignorenulls=True).over(
        Window.partitionBy("id", "stretch").orderBy("seq").rowsBetween(*earlier)
    )
    exists_before = F.coalesce(within, F.col("before_stretch"), F.col("stored"), F.lit(False))
    return placed.join(from_before, ["id", "stretch"]).withColumn(
        "outcome",
        F.when((F.col("op") == "insert") & exists_before, CONFLICT)
        .when((F.col("op") != "insert") & ~exists_before, NOT_FOUND)
        .otherwise(APPLIED),
    )


def merge_notifications(current: DataFrame, changes: DataFrame, now: Column) -> MergeResult:
    """New snapshot and per-change outcomes.

    ``changes`` has ``seq`` (running number of the request), ``op`` (insert, update or delete),
    ``id`` and the writable columns.  An insert of a stored id is a conflict and an update
    or delete of an absent one is not found; neither changes anything.
    """
    judged = _judged(current, changes)
    applied = F.col("outcome") == APPLIED
    latest = judged.where(applied).groupBy("id").agg(
        F.max_by(F.struct("op", *WRITABLE), "seq").alias("change"),
        # A row put in by this batch is new even when it replaces a deleted one.
        F.bool_or(F.col("op") == "insert").alias("created"),
    )
    snapshot = (
        current.alias("old")
        .join(latest.alias("new"), "id", "full_outer")
        .where(F.col("change").isNull() | (F.col("change.op") != "delete"))
        .select(
            "id",
            *[
                F.when(F.col("change").isNull(), F.col(f"old.{name}"))
                .otherwise(F.col(f"change.{name}"))
                .alias(name)
                for name in WRITABLE
            ],
            F.when(F.coalesce("created", F.lit(False)), now).otherwise(F.col("created_at")).alias("created_at"),
            F.when(F.col("change").isNull(), F.col("updated_at")).otherwise(now).alias("updated_at"),
        )
    )
    return MergeResult(snapshot, judged.select("seq", "id", "op", "outcome"))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """Write the merged snapshot to a new folder; an existing one is refused, not replaced."""
    snapshot.write.mode("errorifexists").parquet(path)


@dataclass(frozen=True)
class NotificationStore:
    """The snapshot in hash buckets of the id; a merge reads and rewrites the buckets of the changed ids alone.

    ``buckets`` stays what it was at the first write.
    """

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _store(self) -> PartStore:
        return PartStore(self.spark, self.folder, schemas.TABLES["publisher_notifications"])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("string")

    def current(self) -> DataFrame:
        return self._store().read()

    def merge(self, changes: DataFrame, now: Column, batch: str | None = None) -> DataFrame:
        """Apply a batch of changes and give their outcomes, judged against the version before.

        A batch whose name was merged before is not merged again and gives no outcomes.
        """
        store = self._store()
        before = store.snapshot()
        if batch is not None and batch in before.batches:
            return merge_notifications(store.read(before, ()), changes.limit(0), now).outcomes
        touched = [r.part for r in changes.select(self._bucket().alias("part")).distinct().collect()]  # at most buckets
        merged = merge_notifications(store.read(before, touched), changes, now)
        store.replace(before, merged.snapshot, self._bucket(), touched, batch)
        return merged.outcomes
