"""State kept in hash buckets: orphans from changes, notifications merged bucket by bucket."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.conftest import table
from tidewatch.operators import orphans
from tidewatch.sources.notification_store import WRITABLE, NotificationStore, merge_notifications
from tidewatch.sources.orphan_store import OrphanStore
from tidewatch.thresholds import OrphanThresholds

OPEN = OrphanThresholds(min_orphans=1, min_share=0.0, past_threshold_orphans=4)


def record(rng, n):
    kind = rng.choice(["Slot", "ScheduledSession", "SessionSeries", "Event"])
    return dict(
        dataset_url=rng.choice(["a", "b", "c", "", None]), id=str(n), kind=kind,
        data_id=rng.choice([None, f"p{rng.randrange(30)}"]) if kind != "Slot" else None,
        has_superEvent=rng.choice([None, '"p1"', f'"p{rng.randrange(40)}"', '{"id":"x"}', '""']),
        location=rng.choice([None, "{ }", '{"latitude":1}']),
    )


def results(opportunities, names):
    frames = (
        orphans.orphaned_children(opportunities, names, OPEN),
        orphans.orphaned_children_by_kind(opportunities, OPEN),
        orphans.missing_parents(opportunities, OPEN),
        orphans.missing_parents(opportunities, OPEN, evidence_size=None),
    )
    return [sorted(map(repr, frame.collect())) for frame in frames]


def test_orphans_from_changes_equal_the_full_pass(spark, no_names, tmp_path):
    rng = random.Random(11)
    store = OrphanStore(spark, str(tmp_path / "orphans"), buckets=8)
    held = {n: record(rng, n) for n in range(400)}
    assert store.apply("first", added=table(spark, "opportunities", list(held.values())))
    for day in range(3):
        gone = rng.sample(sorted(held), 40)
        changed = [n for n in rng.sample(sorted(held), 60) if n not in gone]
        removed = [held[n] for n in gone + changed]
        for n in gone:
            del held[n]
        added = {n: record(rng, n) for n in [*changed, *range(1000 * (day + 1), 1000 * (day + 1) + 50)]}
        held |= added
        frames = [table(spark, "opportunities", rows) for rows in (list(added.values()), removed)]
        assert store.apply(f"day {day}", *frames)
        assert not store.apply(f"day {day}", *frames)
    want = results(table(spark, "opportunities", list(held.values())), no_names[1])
    assert all(want) and results(store.state(), no_names[1]) == want


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rng = random.Random(3)
    store = OrphanStore(spark, str(tmp_path / "orphans"), buckets=64)
    store.apply("all", added=table(spark, "opportunities", [record(rng, n) for n in range(300)]))
    before = store._store().snapshot()
    one = dict(dataset_url="a", id="x", kind="Slot", has_superEvent='"nobody"')
    store.apply("one", added=table(spark, "opportunities", [one]))
    after = store._store().snapshot()
    assert sum(after.parts[n] != before.parts.get(n) for n in after.parts) == 1
    store.apply("back", removed=table(spark, "opportunities", [one]))
    assert store.state().counts.where("ref_id = 'nobody'").count() == 0


def changes(spark, rows):
    full = [(seq, op, i, *[f"{name} {seq}" if name == "notes" else None for name in WRITABLE]) for seq, op, i in rows]
    current = table(spark, "publisher_notifications", []).schema
    kinds = ", ".join(f"{name} {current[name].dataType.simpleString()}" for name in WRITABLE)
    return spark.createDataFrame(full, f"seq bigint, op string, id string, {kinds}")


def test_notifications_are_merged_bucket_by_bucket(spark, tmp_path):
    store = NotificationStore(spark, str(tmp_path / "notifications"), buckets=32)
    now = F.lit(dt.datetime(2026, 9, 1))
    first = changes(spark, [(n, "insert", f"n{n}") for n in range(200)])
    assert store.merge(first, now, "first").where("outcome = 'applied'").count() == 200
    before, stored = store._store().snapshot(), store.current().collect()
    later = changes(spark, [(1, "update", "n3"), (2, "delete", "n4"), (3, "insert", "n3"), (4, "update", "nobody"), (5, "insert", "new")])
    want = merge_notifications(spark.createDataFrame(stored, store.current().schema), later, now)
    got = store.merge(later, now, "later")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.outcomes.collect()))
    after = store._store().snapshot()
    assert 1 <= sum(after.parts[n] != before.parts.get(n) for n in after.parts) <= 4
    columns = store.current().columns
    assert sorted(map(repr, store.current().collect())) == sorted(map(repr, want.snapshot.select(columns).collect()))
    assert store.merge(later, now, "later").count() == 0 and store.current().count() == 200
