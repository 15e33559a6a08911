"""Feed-quality rows and their summary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import UNKNOWN, dataset_display_name, fold_case, not_blank, publisher_id, strip
from tidewatch.operators.filters import all_of, value_in
from tidewatch.operators.paging import SortKey
from tidewatch.schemas import COMPLETENESS_COLUMNS

BUCKET_WIDTH = 20
BUCKETS = 100 // BUCKET_WIDTH
_SCORE_CELLS = 100  # cells per score point when narrowing down the median
_DATASET_TASKS = 200  # that datasets are dealt out over, at least; up to 200 Spark writes rows out without keeping them


def assessed_feeds(
    feed_quality: DataFrame,
    feeds: DataFrame,
    dataset_urls: Iterable[str] = (),
    publishers: Iterable[str] = (),
) -> DataFrame:
    """Quality rows with the publisher of their dataset (the smallest name of its feeds)."""
    owners = feeds.groupBy("dataset_url").agg(F.min("publisher_name").alias("publisher_name"))
    rows = feed_quality.where(all_of([value_in("dataset_url", dataset_urls)]))
    return rows.join(owners, "dataset_url", "left").where(
        all_of([value_in("publisher_name", publishers)])
    )


#: Best score first.
ROW_KEYS = (SortKey("score", descending=True, nulls_last=True), SortKey("dataset_url"), SortKey("feed_id"))


def row_order() -> list[Column]:
    return [key.order() for key in ROW_KEYS]


def quality_rows(assessed: DataFrame) -> DataFrame:
    """Report rows, best score first."""
    return assessed.select(
        "feed_id", "feed_url", "feed_type", "feed_version", "is_regular", "dataset_url",
        dataset_display_name(F.col("dataset_url"), F.col("dataset_name")).alias("dataset_name"),
        publisher_id(F.col("publisher_name")).alias("publisher_id"),
        F.coalesce("publisher_name", F.lit("")).alias("publisher_name"),
        "status", "grade", "score", "num_future_opportunity_items",
        *COMPLETENESS_COLUMNS,
        "warnings", "errors", "missing_required_fields", "last_assessed",
    ).orderBy(*row_order())


def distinct_ignoring_case(value: Column) -> Column:
    """Distinct non-blank texts, compared without regard to case."""
    return F.count_distinct(F.when(not_blank(value), fold_case(value)))


def median_score(assessed: DataFrame) -> DataFrame:
    """One row: the exact median, without bringing all scores together.

    Scores are counted per value, the values counted per narrow cell (a fixed number of
    them), and only the cells holding the middle ranks are looked into.
    """
    counts = (
        assessed.where(F.col("score").isNotNull())
        .groupBy("score")
        .agg(F.count(F.lit(1)).alias("feeds"))
        .withColumn(
            "cell",
            # Never null, so no null test is pushed below the counts and they are shared.
            F.coalesce(
                F.floor(F.greatest(F.least(F.col("score"), F.lit(101.0)), F.lit(-1.0)) * _SCORE_CELLS),
                F.lit(0),
            ),
        )
    )
    by_cell = Window.partitionBy(F.lit(1)).orderBy("cell")
    everything = Window.partitionBy(F.lit(1))
    cells = (
        counts.groupBy("cell")
        .agg(F.sum("feeds").alias("feeds"))
        .withColumn("total", F.sum("feeds").over(everything))
        .withColumn("before", F.sum("feeds").over(by_cell) - F.col("feeds"))
        .withColumn("low", F.floor((F.col("total") + 1) / 2))
        .withColumn("high", F.floor((F.col("total") + 2) / 2))
    )
    upper = F.col("before") + F.col("feeds")
    middle = cells.where((F.col("before") < F.col("high")) & (upper >= F.col("low"))).select(
        "cell", "before", "low", "high"
    )
    # At most two cells are left, so the broadcast is two rows.
    by_score = Window.partitionBy("cell").orderBy("score")
    ranked = counts.join(F.broadcast(middle), "cell").withColumn(
        "upto", F.col("before") + F.sum("feeds").over(by_score)
    )

    def holds(rank: str) -> Column:
        return (F.col("upto") >= F.col(rank)) & (F.col("upto") - F.col("feeds") < F.col(rank))

    return ranked.agg(
        (
            (F.max(F.when(holds("low"), F.col("score"))) + F.max(F.when(holds("high"), F.col("score")))) / 2
        ).alias("median_score")
    )


def quality_summary(assessed: DataFrame) -> DataFrame:
    """One row of headline figures over all given feeds."""
    status = fold_case(strip(F.col("status")))
    failed = F.coalesce(status == "ERROR", F.lit(False))
    has_future = F.coalesce(F.col("num_future_opportunity_items") > 0, F.lit(False))
    known = F.coalesce(status.isin("OK", "WARNING", "ERROR"), F.lit(False))
    url = F.col("dataset_url")
    return assessed.agg(
        F.count(F.lit(1)).alias("total_feeds"),
        distinct_ignoring_case(url).alias("total_datasets"),
        distinct_ignoring_case(F.col("publisher_name")).alias("total_publishers"),
        F.count_if("is_regular").alias("regular_feeds"),
        F.count_if(~F.col("is_regular")).alias("irregular_feeds"),
        F.count_if(F.col("is_regular").isNull()).alias("regularity_unknown"),
        F.count_if(status == "OK").alias("feeds_ok"),
        F.count_if(status == "WARNING").alias("feeds_with_warnings"),
        F.count_if(failed).alias("feeds_with_errors"),
        F.count_if(~known).alias("feeds_status_unknown"),
        distinct_ignoring_case(F.when(failed, url)).alias("datasets_with_errors"),
        F.count_if(has_future).alias("feeds_with_future_data"),
        distinct_ignoring_case(F.when(has_future, url)).alias("datasets_with_future_data"),
        F.coalesce(F.sum("num_future_opportunity_items"), F.lit(0)).alias("total_future_opportunity_items"),
        F.count("score").alias("feeds_scored"),
        F.avg("score").alias("average_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.min("last_assessed").alias("oldest_assessment"),
        F.max("last_assessed").alias("newest_assessment"),
    ).withColumn("median_score", median_score(assessed).scalar())


def completeness_averages(assessed: DataFrame) -> DataFrame:
    """(field, average, feeds_reporting), one row per completeness column, in their order."""
    totals = assessed.agg(
        *[F.avg(name).alias(f"avg_{name}") for name in COMPLETENESS_COLUMNS],
        *[F.count(name).alias(f"n_{name}") for name in COMPLETENESS_COLUMNS],
    )
    fields = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name.removesuffix("_completeness")).alias("field"),
            F.col(f"avg_{name}").alias("average"),
            F.col(f"n_{name}").alias("feeds_reporting"),
        )
        for position, name in enumerate(COMPLETENESS_COLUMNS)
    ]
    return totals.select(F.inline(F.array(*fields))).orderBy("position")


def score_histogram(assessed: DataFrame) -> DataFrame:
    """Five buckets of twenty points, empty ones included; out-of-range scores join the ends."""
    # Held in range before the cast, which a score far outside would overflow.
    position = F.least(F.greatest(F.col("score") / BUCKET_WIDTH, F.lit(0.0)), F.lit(BUCKETS - 1.0)).cast("int")
    counts = assessed.where(F.col("score").isNotNull()).agg(
        *[F.count_if(position == i).alias(f"bucket_{i}") for i in range(BUCKETS)]
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i * BUCKET_WIDTH).alias("lower"),
                        F.lit((i + 1) * BUCKET_WIDTH).alias("upper"),
                        F.col(f"bucket_{i}").alias("feed_count"),
                    )
                    for i in range(BUCKETS)
                ]
            )
        )
    ).orderBy("lower")


BREAKDOWNS = {
    "status": "status",
    "grade": "grade",
    "feed_type": "feed_type",
    "feed_version": "feed_version",
}


def quality_breakdowns(assessed: DataFrame) -> DataFrame:
    """(breakdown, value, feed_count, dataset_count, share) for the four label columns.

    Labels are grouped without regard to case and shown as first spelled in row order.
    """
    def label(name: str) -> Column:
        return F.when(not_blank(F.col(name)), strip(F.col(name))).otherwise(UNKNOWN)

    # A dataset has few feeds, so grouping before the shuffle would hold nearly all rows and save little: feeds are
    # dealt out by dataset as they are, and each task groups its share of the datasets.
    tasks = max(_DATASET_TASKS, int(assessed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = assessed.select(
        "score", "dataset_url", "feed_id", *BREAKDOWNS.values(), fold_case(F.col("dataset_url")).alias("dataset")
    ).repartition(tasks, "dataset")
    labels = dealt.select(
        "score", "dataset_url", "feed_id", "dataset",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("breakdown"), label(column).alias("label"))
                    for kind, column in BREAKDOWNS.items()
                ]
            )
        ),
    ).withColumn("key", fold_case(F.col("label")))
    seen_first = F.struct(
        F.col("score").isNull().alias("unscored"), (-F.col("score")).alias("order"), "dataset_url", "feed_id"
    )
    # Reduced to one row per (label, dataset) first, so the count of datasets of a label that
    # covers most feeds is spread over its datasets.
    per_dataset = labels.groupBy("breakdown", "key", "dataset").agg(
        F.count(F.lit(1)).alias("feeds"),
        F.min(F.struct(seen_first.alias("seen"), "label")).alias("first"),
    )
    grouped = per_dataset.groupBy("breakdown", "key").agg(
        F.min("first")["label"].alias("value"),
        F.sum("feeds").alias("feed_count"),
        F.count_if(not_blank(F.col("dataset"))).alias("dataset_count"),
    )
    # Every feed has one label in each breakdown, so a breakdown's feeds are all feeds.
    total = assessed.agg(F.count(F.lit(1))).scalar()
    return grouped.select(
        "breakdown", "value", "feed_count", "dataset_count",
        (F.col("feed_count") / total).alias("share"),
    ).orderBy("breakdown", F.desc("feed_count"), fold_case(F.col("value")))
