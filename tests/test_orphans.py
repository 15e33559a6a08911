import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import table
from tidewatch.operators import orphans
from tidewatch.thresholds import OrphanThresholds

OPEN = OrphanThresholds(min_orphans=1, min_share=0.0, past_threshold_orphans=4)


def child(dataset, parent, kind="Slot", location=None, n=1):
    ref = None if parent is None else f'"{parent}"'
    return [dict(dataset_url=dataset, kind=kind, has_superEvent=ref, location=location)] * n


def parents(dataset, *ids):
    return [dict(dataset_url=dataset, kind="SessionSeries", data_id=i) for i in ids]


def opportunities(spark, rows):
    return table(spark, "opportunities", rows)


def incidents(spark, no_names, rows, th=OPEN):
    return orphans.orphaned_children(opportunities(spark, rows), no_names[1], th).collect()


def test_defaults():
    th = OrphanThresholds()
    assert (th.min_orphans, th.min_share, th.past_threshold_orphans) == (1000, 0.10, 10000)
    assert OrphanThresholds(min_orphans=50_000).past_orphans == 50_000
    assert OrphanThresholds(min_share=math.nan).share_gate == 0
    assert OrphanThresholds(min_share=7).share_gate == 1 and OrphanThresholds(min_share=-1).share_gate == 0
    assert OrphanThresholds(min_orphans=10**12).past_orphans == 10**12
    with pytest.raises(ValueError, match="min_orphans"):
        OrphanThresholds(min_orphans=0)
    assert orphans.CHILD_KINDS == ("Slot", "ScheduledSession")


def test_what_makes_an_orphan(spark):
    rows = (
        child("a", "gone", n=2)
        + child("a", "gone", location='{"latitude":1}')      # placeable by itself
        + child("a", "gone", location="null")
        + child("a", "gone", location="{ }")
        + child("a", "here", n=3)                             # its parent is published
        + child("a", None)                                    # names no parent
        + child("a", "elsewhere")                             # published by another dataset only
        + [dict(dataset_url="a", kind="Slot", has_superEvent='{"id":"inline"}')]
        + [dict(dataset_url="a", kind="Slot", has_superEvent='"\\"here\\""')]   # encoded twice
        + child("a", "")                                      # a blank reference is dangling
        + child("a", "gone", kind="Event")                    # not a child kind
        + child("a", "gone", kind="ScheduledSession")
        + child(None, "gone") + child(" ", "gone")
        + parents("a", "here", "here") + parents("b", "elsewhere")
    )
    counts = orphans.kind_counts(orphans.reference_edges(opportunities(spark, rows))).collect()
    got = {
        (r.dataset_id, r.kind): (r.child_count, r.checked_count, r.orphan_count, r.missing_parent_count)
        for r in counts
    }
    assert got == {("a", "Slot"): (13, 10, 6, 3), ("a", "ScheduledSession"): (1, 1, 1, 1)}


def test_a_child_can_be_a_parent_as_well(spark):
    rows = [
        dict(dataset_url="a", kind="ScheduledSession", data_id="s1", has_superEvent='"gone"'),
        dict(dataset_url="a", kind="Slot", data_id="s2", has_superEvent='"s1"'),
    ]
    counts = orphans.kind_counts(orphans.reference_edges(opportunities(spark, rows))).collect()
    assert {r.kind: r.orphan_count for r in counts} == {"ScheduledSession": 1, "Slot": 0}


def test_gates_folding_and_order(spark, no_names):
    rows = (
        child("a", "x", n=3) + child("a", "y", kind="ScheduledSession", n=1)
        + child("b", "x", n=4) + child("b", "p", n=4) + parents("b", "p")
        + child("c", "x", n=2) + child("d", "x", n=2)
        + child("e", "p", n=5) + parents("e", "p")
    )
    found = incidents(spark, no_names, rows)
    assert [(r.dataset_url, r.orphan_count, r.orphan_share) for r in found] == [
        ("a", 4, 1.0), ("b", 4, 0.5), ("c", 2, 1.0), ("d", 2, 1.0),
    ]
    assert [r.past_threshold for r in found] == [True, True, False, False]
    assert (found[0].child_count, found[0].missing_parent_count, found[0].status) == (4, 2, "open")
    both = OrphanThresholds(min_orphans=3, min_share=0.6, past_threshold_orphans=1)
    assert [(r.dataset_url, r.past_threshold) for r in incidents(spark, no_names, rows, both)] == [("a", True)]
    assert incidents(spark, no_names, rows, OrphanThresholds()) == []
    wholly = OrphanThresholds(min_orphans=1, min_share=7)
    assert [r.dataset_url for r in incidents(spark, no_names, rows, wholly)] == ["a", "c", "d"]

    kinds = orphans.orphaned_children_by_kind(opportunities(spark, rows), both).collect()
    assert [(r.kind, r.orphan_count) for r in kinds] == [("Slot", 3), ("ScheduledSession", 1)]


def test_evidence_is_the_worst_five_with_blanks_dropped_late(spark):
    rows = child("a", "", n=50)
    for i in range(9):
        rows += child("a", f"s{i}", n=20 - i)
        rows += child("a", f"k{i}", kind="ScheduledSession", n=19 - i)
    got = orphans.missing_parents(opportunities(spark, rows), OPEN).collect()
    # The blank id takes one of the five Slot places before it is dropped.
    assert [(r.position, r.missing_id, r.child_count) for r in got] == [
        (1, "s0", 20), (2, "k0", 19), (3, "s1", 19), (4, "k1", 18), (5, "s2", 18),
    ]


    three = orphans.missing_parents(opportunities(spark, rows), OPEN, evidence_size=3).collect()
    assert [r.missing_id for r in three] == ["s0", "k0", "s1"]
    every = orphans.missing_parents(opportunities(spark, rows), OPEN, evidence_size=None).collect()
    assert sorted((r.missing_id, r.child_count) for r in every) == sorted(
        [(f"s{i}", 20 - i) for i in range(9)] + [(f"k{i}", 19 - i) for i in range(9)]
    )
    with pytest.raises(ValueError, match="evidence_size"):
        orphans.missing_parents(opportunities(spark, rows), OPEN, evidence_size=0)


def test_counts_equal_a_plain_evaluation(spark, no_names):
    import random

    rng = random.Random(11)
    rows = []
    for _ in range(3000):
        # A third of all rows belongs to one dataset.
        dataset = "hot" if rng.random() < 0.34 else f"d{rng.randrange(20)}"
        kind = rng.choice(["Slot", "ScheduledSession", "SessionSeries", "Event"])
        rows.append(
            dict(
                dataset_url=dataset, kind=kind, data_id=f"{rng.randrange(400)}",
                has_superEvent=rng.choice([None, '{"id":"1"}', f'"{rng.randrange(800)}"']),
                location=rng.choice([None, "{}", '{"latitude":1}']),
            )
        )
    published = {(r["dataset_url"], r["data_id"]) for r in rows}
    want = {}
    for r in rows:
        if r["kind"] in orphans.CHILD_KINDS:
            ref = r["has_superEvent"]
            parent = ref.strip('"') if ref and ref.startswith('"') else None
            checked = parent is not None and r["location"] in (None, "{}")
            orphan = checked and (r["dataset_url"], parent) not in published
            total = want.setdefault((r["dataset_url"], r["kind"]), [0, 0, 0, set()])
            total[0] += 1
            total[1] += checked
            total[2] += orphan
            if orphan:
                total[3].add(parent)
    got = orphans.kind_counts(orphans.reference_edges(opportunities(spark, rows))).collect()
    assert {
        (r.dataset_id, r.kind): (r.child_count, r.checked_count, r.orphan_count, r.missing_parent_count)
        for r in got
    } == {k: (a, b, c, len(d)) for k, (a, b, c, d) in want.items()}
    for r in got:
        assert r.orphan_count <= r.checked_count <= r.child_count


def test_ids_are_spread_however_few_shuffle_partitions_there_are(spark):
    rows = child("a", "gone") + parents("a", *[f"p{n}" for n in range(2000)])
    frame = opportunities(spark, rows)
    summed = orphans.merged_counts(orphans.edge_counts(frame), orphans.edge_counts(frame, -1), orphans.edge_counts(frame))
    by_task = summed.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in by_task) == 2001 and max(r["count"] for r in by_task) < 60
    before_shuffle = summed._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(before_shuffle) == 2 and "Aggregate" not in before_shuffle[1]
