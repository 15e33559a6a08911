"""Attaching publisher, dataset and feed names to detected incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import dataset_display_name, feed_display_name, publisher_id


def dataset_names(feeds: DataFrame, feed_quality: DataFrame) -> DataFrame:
    """One row per dataset: smallest publisher name of its feeds, smallest stored name."""
    published = feeds.select(
        F.col("dataset_url").alias("dataset_id"),
        "publisher_name",
        F.lit(None).cast("string").alias("dataset_name"),
    )
    named = feed_quality.select(
        F.col("dataset_url").alias("dataset_id"),
        F.lit(None).cast("string").alias("publisher_name"),
        "dataset_name",
    )
    return (
        published.unionByName(named)
        .where(F.col("dataset_id").isNotNull())
        .groupBy("dataset_id")
        .agg(
            F.min("publisher_name").alias("publisher_name"),
            F.min("dataset_name").alias("dataset_name"),
        )
    )


def feed_names(feeds: DataFrame, feed_quality: DataFrame) -> DataFrame:
    """One row per feed id; of several rows the smallest (url, type, publisher) is kept."""
    described = (
        feeds.where(F.col("id").isNotNull())
        .groupBy(F.col("id").alias("feed_id"))
        .agg(
            F.min(
                F.struct(
                    F.col("url").alias("feed_url"), F.col("type").alias("feed_type"), "publisher_name"
                )
            ).alias("feed")
        )
        .select("feed_id", "feed.*")
    )
    scored = feed_quality.groupBy("feed_id").agg(F.max("score").alias("quality_score"))
    return described.join(scored, "feed_id", "left")


def _identity(publisher_name: Column) -> list[Column]:
    return [
        publisher_id(publisher_name).alias("publisher_id"),
        F.coalesce(publisher_name, F.lit("")).alias("publisher_name"),
    ]


def with_dataset_identity(incidents: DataFrame, names: DataFrame) -> DataFrame:
    """Incidents keyed by ``dataset_id`` gain publisher_id, publisher_name, dataset_name."""
    return incidents.join(names, "dataset_id", "left").select(
        *_identity(F.col("publisher_name")),
        F.col("dataset_id").alias("dataset_url"),
        dataset_display_name(F.col("dataset_id"), F.col("dataset_name")).alias("dataset_name"),
        *[F.col(name) for name in incidents.columns if name != "dataset_id"],
    )


def with_feed_identity(incidents: DataFrame, feeds: DataFrame, datasets: DataFrame) -> DataFrame:
    """Incidents keyed by ``feed_id``; the publisher is the feed's own, not the dataset's."""
    owners = datasets.select("dataset_id", "dataset_name")
    return (
        incidents.join(feeds, "feed_id", "left")
        .join(owners, "dataset_id", "left")
        .select(
            *_identity(F.col("publisher_name")),
            "feed_id",
            feed_display_name(F.col("feed_id"), F.col("feed_url")).alias("feed_name"),
            "feed_type",
            "feed_url",
            F.col("dataset_id").alias("dataset_url"),
            dataset_display_name(F.col("dataset_id"), F.col("dataset_name")).alias("dataset_name"),
            "quality_score",
            *[F.col(name) for name in incidents.columns if name not in ("feed_id", "dataset_id")],
        )
    )


def with_feed_label(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Detail rows keyed by ``feed_id`` gain feed_name and feed_type."""
    return rows.join(feeds.select("feed_id", "feed_url", "feed_type"), "feed_id", "left").select(
        *[F.col(name) for name in rows.columns],
        feed_display_name(F.col("feed_id"), F.col("feed_url")).alias("feed_name"),
        "feed_type",
    )


def incident_columns(monitor_id: str) -> list[Column]:
    """Columns every incident of every monitor carries."""
    return [
        F.lit(monitor_id).alias("monitor_id"),
        F.lit("open").alias("status"),
        F.lit(None).cast("date").alias("last_contacted"),
    ]
