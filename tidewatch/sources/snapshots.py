"""Dates and run rows the reports are labelled with."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_date(table: DataFrame, timestamp: str = "ingestion_date") -> DataFrame:
    """One row: the UTC day of the newest row, null when the table is empty."""
    return table.agg(F.to_date(F.max(timestamp)).alias("snapshot_date"))


def assessment_date(table: DataFrame) -> DataFrame:
    """One row: the day of the newest assessment."""
    return snapshot_date(table, "last_assessed")


def latest_day(table: DataFrame, timestamp: str = "ingestion_date") -> dt.date | None:
    """The snapshot day as a Python value (runs a job and brings back that one value).

    The monitors take a plain date, so their day windows are constants the scan can prune on.
    """
    return snapshot_date(table, timestamp).first()["snapshot_date"]


def latest_crawl(feed_ingestion: DataFrame) -> DataFrame:
    """One row: estate size at the newest crawl, zeros when there was none."""
    newest = feed_ingestion.agg(
        F.max(F.struct("ingestion_date", "number_of_datasets", "number_of_feeds")).alias("run")
    )
    return newest.select(
        F.coalesce("run.number_of_datasets", F.lit(0)).alias("datasets"),
        F.coalesce("run.number_of_feeds", F.lit(0)).alias("feeds"),
        F.col("run.ingestion_date").alias("generated_at"),
    )


def latest_insight_run(insight_run_summary: DataFrame) -> DataFrame:
    """One row: the newest insight run and its opportunity total."""
    newest = insight_run_summary.agg(
        F.max(F.struct("run_date", "total_num_future_opportunity_items_narrow")).alias("run")
    )
    return newest.select("run.*")
