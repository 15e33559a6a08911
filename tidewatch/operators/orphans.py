"""Child records whose parent is not published by the same dataset.

One scan and one wide shuffle: each record offers the id it publishes and, when it is a
child, the id it refers to; both are grouped by (dataset, id).  Grouping on the id as well
spreads a large dataset over many tasks.  Nearly every id is one of its own, so the rows are
dealt out over ``ID_PARTITIONS`` tasks as they are: no task before the shuffle holds ids, and
one after it holds its share of them once.

The counts by (dataset, id) can be kept between runs (``tidewatch.sources.orphan_store``): records that come, go or
change add and take away from them, so a daily run shuffles its changes instead of all records.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.jsontext import is_empty_json, json_string
from tidewatch.functions.numbers import share
from tidewatch.functions.text import not_blank
from tidewatch.operators.hydrate import incident_columns, with_dataset_identity
from tidewatch.thresholds import OrphanThresholds

MONITOR_ID = "dataset_orphaned_children"
CHILD_KINDS = ("Slot", "ScheduledSession")
EVIDENCE_SIZE = 5


def _parent_reference(column: str) -> Column:
    """The referred id of a string reference; inlined parents and absent ones give null."""
    return F.btrim(json_string(F.col(column)), F.lit('"'))


#: The counts of a (dataset, id): records that publish it, children of each kind that refer to it, and those of
#: them without a location.  Records that go have theirs taken away.
COUNTS = ("published", *(f"{count}_{i}" for i in range(len(CHILD_KINDS)) for count in ("children", "unplaced")))

#: Tasks that ids are dealt out over, at least; up to 200 Spark writes them out without keeping rows in memory.
ID_PARTITIONS = 200


@dataclass(frozen=True)
class OrphanState:
    """Stored counts, (dataset_id, ref_id, *COUNTS)."""

    counts: DataFrame


def edge_counts(opportunities: DataFrame, sign: int = 1) -> DataFrame:
    """(dataset_id, ref_id, *COUNTS) of records, of ones that are gone with ``sign`` -1.

    An id comes once for each record that publishes it or refers to it; ``merged_counts`` adds its rows up.
    """
    is_child = F.col("kind").isin(*CHILD_KINDS)

    def counted(test: Column) -> Column:
        return F.when(test, F.lit(sign)).otherwise(0).cast("bigint")

    def half(ref_id: Column, publishes: bool) -> Column:
        tests = [F.lit(publishes)]
        for kind in CHILD_KINDS:
            of_kind = F.lit(False) if publishes else F.col("kind") == kind
            tests += [of_kind, of_kind & is_empty_json(F.col("location"))]
        return F.struct(ref_id.alias("ref_id"), *[counted(t).alias(name) for name, t in zip(COUNTS, tests)])

    offered = opportunities.where(
        not_blank(F.col("dataset_url")) & (F.col("data_id").isNotNull() | is_child)
    ).select(
        F.col("dataset_url").alias("dataset_id"),
        F.inline(
            F.array(
                F.when(F.col("data_id").isNotNull(), half(F.col("data_id"), True)),
                F.when(is_child, half(_parent_reference("has_superEvent"), False)),
            )
        ),
    )
    # The half a record does not have comes out as a row of nulls.
    return offered.where(F.col("published").isNotNull())


def _summed(*counts: DataFrame) -> DataFrame:
    """(dataset_id, ref_id, named, *COUNTS) of all of them together, grouped once."""
    names = ("dataset_id", "ref_id", *COUNTS)
    united = counts[0].select(*names)
    for other in counts[1:]:
        united = united.unionByName(other.select(*names))
    tasks = max(ID_PARTITIONS, int(united.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return united.repartition(tasks, "dataset_id", "ref_id").groupBy("dataset_id", "ref_id").agg(
        # As an aggregate the test stays above the shuffle, so every user of these edges can
        # share it.
        F.bool_or(F.col("ref_id").isNotNull()).alias("named"),
        *[F.sum(name).alias(name) for name in COUNTS],
    )


def merged_counts(*counts: DataFrame) -> DataFrame:
    """(dataset_id, ref_id, *COUNTS) of all of them together, without the ids of which nothing is left."""
    left = F.col("published") != 0
    for name in COUNTS[1:]:
        left = left | (F.col(name) != 0)
    return _summed(*counts).where(left).drop("named")


def reference_edges(opportunities: DataFrame | OrphanState) -> DataFrame:
    """(dataset_id, ref_id, named, present, kind, children, unplaced) per id and child kind.

    ``children`` counts the kind's child records referring to ``ref_id`` (not ``named``: they
    refer to none), ``unplaced`` those of them without a location, ``present`` tells whether
    the dataset publishes a record with that id.
    """
    if isinstance(opportunities, OrphanState):
        grouped = opportunities.counts.withColumn("named", F.col("ref_id").isNotNull())
    else:
        grouped = _summed(edge_counts(opportunities))
    per_kind = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(f"children_{i}").alias("children"),
                F.col(f"unplaced_{i}").alias("unplaced"),
            )
            for i, kind in enumerate(CHILD_KINDS)
        ]
    )
    present = (F.col("published") > 0).alias("present")
    return grouped.select("dataset_id", "ref_id", "named", present, F.inline(per_kind)).where(F.col("children") > 0)


def _missing() -> Column:
    return F.col("named") & ~F.col("present") & (F.col("unplaced") > 0)


def kind_counts(edges: DataFrame) -> DataFrame:
    """Child, checked, orphan and missing-parent counts per (dataset_id, kind)."""
    return edges.groupBy("dataset_id", "kind").agg(
        F.sum("children").alias("child_count"),
        F.sum(F.when(F.col("named"), F.col("unplaced")).otherwise(0)).alias("checked_count"),
        F.sum(F.when(_missing(), F.col("unplaced")).otherwise(0)).alias("orphan_count"),
        F.count_if(_missing()).alias("missing_parent_count"),
    )


def orphaned_datasets(counts: DataFrame, thresholds: OrphanThresholds = OrphanThresholds()) -> DataFrame:
    """Datasets over both gates, folded over the child kinds."""
    folded = (
        counts.groupBy("dataset_id")
        .agg(*[
            F.sum(name).alias(name)
            for name in ("child_count", "checked_count", "orphan_count", "missing_parent_count")
        ])
        .withColumn("orphan_share", share(F.col("orphan_count"), F.col("child_count")))
    )
    return folded.where(
        (F.col("orphan_count") >= thresholds.min_orphans)
        & (F.col("orphan_share") >= thresholds.share_gate)
    ).withColumn("past_threshold", F.col("orphan_count") >= thresholds.past_orphans)


def orphaned_children(
    opportunities: DataFrame | OrphanState,
    dataset_names: DataFrame,
    thresholds: OrphanThresholds = OrphanThresholds(),
) -> DataFrame:
    """Incidents, one row per dataset, most orphans first."""
    found = orphaned_datasets(kind_counts(reference_edges(opportunities)), thresholds)
    return (
        with_dataset_identity(found, dataset_names)
        .select("*", *incident_columns(MONITOR_ID))
        .orderBy(F.desc("orphan_count"), F.desc("orphan_share"), F.asc("dataset_url"))
    )


def orphaned_children_by_kind(
    opportunities: DataFrame | OrphanState, thresholds: OrphanThresholds = OrphanThresholds()
) -> DataFrame:
    """Counts per child kind of the reported datasets, worst kind first."""
    counts = kind_counts(reference_edges(opportunities))
    # At most one row per (dataset, kind) is left here, so folding by dataset again is small.
    reported = orphaned_datasets(counts, thresholds).select("dataset_id")
    return (
        counts.join(reported, "dataset_id", "left_semi")
        .withColumnRenamed("dataset_id", "dataset_url")
        .orderBy("dataset_url", F.desc("orphan_count"), F.asc("kind"))
    )


def missing_parents(
    opportunities: DataFrame | OrphanState,
    thresholds: OrphanThresholds = OrphanThresholds(),
    evidence_size: int | None = EVIDENCE_SIZE,
) -> DataFrame:
    """The worst missing parents of each reported dataset, ``evidence_size`` a dataset.

    So many are taken per (dataset, kind) first and blank ids dropped after that.  Both
    windows are rank filters, which Spark also applies before the shuffle, so a dataset
    with very many missing parents sends only a few rows per task.  ``None`` gives every
    missing parent, without a position: ranking all of a dataset would bring it together.
    """
    if evidence_size is not None and evidence_size < 1:
        raise ValueError(f"evidence_size must be at least 1, not {evidence_size}")
    edges = reference_edges(opportunities)
    reported = orphaned_datasets(kind_counts(edges), thresholds).select("dataset_id")
    worst_first = [F.desc("unplaced"), F.asc("ref_id")]
    of_kind = Window.partitionBy("dataset_id", "kind").orderBy(*worst_first)
    of_dataset = Window.partitionBy("dataset_id").orderBy(*worst_first, F.asc("kind"))
    if evidence_size is None:
        return edges.where(_missing() & (F.col("ref_id") != "")).join(reported, "dataset_id", "left_semi").select(
            F.col("dataset_id").alias("dataset_url"),
            "kind",
            F.col("ref_id").alias("missing_id"),
            F.col("unplaced").alias("child_count"),
        )
    evidence = (
        edges.where(_missing())
        .withColumn("rank", F.row_number().over(of_kind))
        .where(F.col("rank") <= evidence_size)
        .where(F.col("ref_id") != "")
        .withColumn("position", F.row_number().over(of_dataset))
        .where(F.col("position") <= evidence_size)
    )
    return (
        evidence.join(reported, "dataset_id", "left_semi")
        .select(
            F.col("dataset_id").alias("dataset_url"),
            "position",
            F.col("ref_id").alias("missing_id"),
            F.col("unplaced").alias("child_count"),
        )
        .orderBy("dataset_url", "position")
    )
