"""Reading the warehouse tables by logical name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewatch.schemas import TABLES


@dataclass(frozen=True)
class Warehouse:
    """Tables under a path (``<root>/<table>`` parquet) or in a catalog database.

    Paths are read with the declared schema, so no file is opened to infer it and only the
    columns a query uses are read.
    """

    spark: SparkSession
    root: str | None = None
    database: str | None = None

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(f"unknown table {name!r}; known: {', '.join(sorted(TABLES))}")
        if self.root is not None:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        qualified = f"{self.database}.{name}" if self.database else name
        return self.spark.table(qualified)
