"""The counts behind the orphan monitor between runs, in hash buckets of (dataset, id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.orphans import COUNTS, OrphanState, edge_counts, merged_counts
from tidewatch.sources.part_store import PartStore

SCHEMA = "dataset_id string, ref_id string, " + ", ".join(f"{name} bigint" for name in COUNTS)


@dataclass(frozen=True)
class OrphanStore:
    """``buckets`` stays what it was at the first load."""

    spark: SparkSession
    folder: str
    buckets: int = 256

    def _store(self) -> PartStore:
        return PartStore(self.spark, self.folder, SCHEMA)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("dataset_id", "ref_id"), F.lit(self.buckets)).cast("string")

    def state(self) -> OrphanState:
        return OrphanState(self._store().read())

    def apply(self, batch: str, added: DataFrame | None = None, removed: DataFrame | None = None) -> bool:
        """Take up records: new ones and changed ones as they are now in ``added``, those that went and changed
        ones as they were in ``removed``.  A batch applied before changes nothing.

        The changes alone are shuffled, with the counts of the buckets that their ids fall into.
        """
        store = self._store()
        before = store.snapshot()
        if batch in before.batches:
            return False
        changes = [edge_counts(rows, sign) for rows, sign in ((added, 1), (removed, -1)) if rows is not None]
        if not changes:
            raise ValueError("neither added nor removed records")
        changed = merged_counts(*changes)
        touched = [r.part for r in changed.select(self._bucket().alias("part")).distinct().collect()]  # at most buckets
        rows = merged_counts(store.read(before, touched), changed)
        store.replace(before, rows, self._bucket(), touched, batch)
        return True
