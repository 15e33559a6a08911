"""A table kept in parts (days, hash buckets) of which an update rewrites only those it touches.

Each update writes the new content of its parts to a folder of its own, then a small manifest that says in which
folder every part is to be found; untouched parts stay the files they were.  The manifest is one file that appears
by a rename, so a reader sees the table before an update or after it, and an update that fails leaves only unused
files.  Two updates at a time can't both succeed: the second finds its manifest taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "kind string, name string, held string, version int"


@dataclass(frozen=True)
class Snapshot:
    """One version: the folders that hold its parts, and the batches applied so far."""

    version: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    batches: frozenset[str] = frozenset()


@dataclass(frozen=True)
class PartStore:
    """``folder`` on storage that all executors see; ``schema`` of the rows as Spark DDL."""

    spark: SparkSession
    folder: str
    schema: str

    def snapshot(self) -> Snapshot:
        """The newest version: a row a part and batch comes to the driver, days or buckets and daily loads."""
        manifests = self._read(_MANIFEST, f"{self.folder}/manifest")
        newest = None if manifests is None else manifests.agg(F.max("version")).first()[0]
        if newest is None:
            return Snapshot()
        rows = manifests.where(F.col("version") == newest).collect()
        return Snapshot(
            newest,
            {r.name: r.held for r in rows if r.kind == "part"},
            frozenset(r.name for r in rows if r.kind == "batch"),
        )

    def read(self, snapshot: Snapshot | None = None, parts: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version, of some parts only if named."""
        snapshot = self.snapshot() if snapshot is None else snapshot
        wanted = snapshot.parts.keys() if parts is None else snapshot.parts.keys() & set(parts)
        paths = [self.part_path(name, snapshot.parts[name]) for name in sorted(wanted)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def part_path(self, name: str, held: str) -> str:
        return f"{self.folder}/data/{held}/part={name}"

    def replace(
        self, before: Snapshot, rows: DataFrame, part: Column, touched: Iterable[str], batch: str | None = None
    ) -> Snapshot:
        """Put ``rows`` in place of the ``touched`` parts of ``before`` and publish the new version.

        ``part`` gives a row's part, a name of letters, digits and hyphens; a touched part without rows is gone
        afterwards.  ``batch`` names the load, so that a repeated one can be told.
        """
        version, touched, held = before.version + 1, set(touched), f"{before.version + 1}-{uuid.uuid4().hex}"
        target = f"{self.folder}/data/{held}"
        rows.withColumn("part", part).repartition("part").write.partitionBy("part").parquet(target)
        written = self._read(f"{self.schema}, part string", target)
        names = set() if written is None else {r.part for r in written.select("part").distinct().collect()}
        if not names <= touched:
            raise ValueError(f"rows outside the touched parts: {sorted(names - touched)[:5]}")
        parts = {n: v for n, v in before.parts.items() if n not in touched} | dict.fromkeys(names, held)
        batches = before.batches | ({batch} if batch is not None else set())
        listed = [("part", n, v) for n, v in sorted(parts.items())] + [("batch", n, None) for n in sorted(batches)]
        manifest = self.spark.createDataFrame(listed or [("none", "", None)], "kind string, name string, held string")
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/manifest/version={version}")
        return Snapshot(version, parts, batches)

    def _read(self, schema: str, path: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
