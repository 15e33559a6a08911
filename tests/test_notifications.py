import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import table
from tidewatch.plans import notifications
from tidewatch.sources.notification_store import WRITABLE, merge_notifications, write_snapshot

TODAY = dt.date(2026, 9, 20)
RECENT = dt.date(2026, 9, 16)


def problem(monitor, days, feed_type=None, resolved=None, **extra):
    return dict(monitor_id=monitor, days_open=days, feed_type=feed_type, resolved_on=resolved, **extra)


ALERTS = {
    "uncontacted": (True, dict(date_contacted=None)),
    "closed": (False, dict(date_contacted=None, status="closed")),
    "in-progress": (True, dict(date_contacted=None, status="in_progress")),
    "fresh": (False, dict()),
    "five-days": (False, dict(date_contacted=dt.date(2026, 9, 15))),
    "six-days": (True, dict(date_contacted=dt.date(2026, 9, 14))),
    "dataset": (True, dict(problems=[problem("dataset_stall", 5)])),
    "dataset-text": (True, dict(problems=[problem("dataset_stall", "6")])),
    "dataset-low": (False, dict(problems=[problem("dataset_stall", 4)])),
    "dataset-bad": (False, dict(problems=[problem("dataset_stall", "many")])),
    "single": (True, dict(problems=[problem("single_feed_stall", 10, "Slot")])),
    "single-other": (False, dict(problems=[problem("single_feed_stall", 50, "Event")])),
    "single-none": (False, dict(problems=[problem("single_feed_stall", 50)])),
    "error": (True, dict(problems=[problem("x", 99), problem("feed_ingestion_error", 10)])),
    "error-low": (False, dict(problems=[problem("feed_ingestion_error", 9)])),
    "resolved": (False, dict(problems=[problem("dataset_stall", 90, resolved="2026-09-01")])),
    "resolved-since": (True, dict(problems=[problem("other", 1, resolved="2026-09-17")])),
    "resolved-badly": (False, dict(problems=[problem("dataset_stall", 90, resolved="soon")])),
    "no-array": (False, dict(raw='{"monitor_id":"dataset_stall","days_open":50}')),
    "not-json": (False, dict(raw="[oops")),
    "json-null": (False, dict(raw="null")),
}


def row(id, status="open", date_contacted=RECENT, problems=None, raw=None, **rest):
    return dict(id=id, status=status, date_contacted=date_contacted,
                problems=raw if problems is None else json.dumps(problems), **rest)


def test_alerts(spark):
    frame = table(spark, "publisher_notifications", [row(name, **given) for name, (_, given) in ALERTS.items()])
    got = {r.id: r.alert for r in frame.select("id", notifications.needs_alert(TODAY).alias("alert")).collect()}
    assert got == {name: want for name, (want, _) in ALERTS.items()}
    s = notifications.notification_summary(frame, TODAY).collect()[0]
    assert (s.publishers, s.open, s.in_progress, s.closed) == (len(ALERTS), len(ALERTS) - 2, 1, 1)
    assert (s.never_contacted, s.alerts) == (2, sum(want for want, _ in ALERTS.values()))


def test_list_order(spark):
    frame = table(spark, "publisher_notifications", [
        dict(id="1", publisher_name="b", oldest_days_open=3), dict(id="2", publisher_name="a", oldest_days_open=3),
        dict(id="3", publisher_name="c", oldest_days_open=None), dict(id="4", publisher_name="z", oldest_days_open=9),
    ])
    got = notifications.notification_list(frame).collect()
    assert [r.id for r in got] == ["4", "2", "1", "3"] and got[0].monitors == []


@pytest.fixture
def merged(spark):
    old = dt.datetime(2026, 1, 1)
    current = table(spark, "publisher_notifications", [
        dict(id=i, status="open", notes=f"old {i}", contact="c", created_at=old, updated_at=old) for i in "abcdef"
    ])
    changes = [
        (1, "insert", "a", "taken"), (2, "update", "b", None), (3, "delete", "c", None), (4, "insert", "n", "new"),
        (5, "update", "m", "none"), (6, "delete", "m", None), (7, "delete", "d", None), (8, "insert", "d", "back"),
        (9, "update", "d", "again"), (10, "insert", "e", "taken"), (11, "update", "e", "edited"),
        (12, "insert", "k", "short"), (13, "delete", "k", None), (14, "update", "k", "late"),
    ]
    schema = spark.createDataFrame([], "seq bigint, op string, id string").schema
    for name in WRITABLE:
        schema = schema.add(current.schema[name])
    values = [
        tuple(dict(seq=s, op=op, id=i, notes=notes, status="in_progress").get(f) for f in schema.names)
        for s, op, i, notes in changes
    ]
    now = F.lit(dt.datetime(2026, 9, 1))
    return merge_notifications(current, spark.createDataFrame(values, schema), now)


def test_merge_outcomes(merged):
    got = {r.seq: r.outcome for r in merged.outcomes.collect()}
    assert {s for s, o in got.items() if o == "conflict"} == {1, 10}
    assert {s for s, o in got.items() if o == "not_found"} == {5, 6, 14}
    assert len(got) == 14


def test_merge_snapshot(merged, tmp_path):
    got = {r.id: r for r in merged.snapshot.collect()}
    assert sorted(got) == ["a", "b", "d", "e", "f", "n"]
    old, now = dt.datetime(2026, 1, 1), dt.datetime(2026, 9, 1)
    assert (got["a"].notes, got["a"].updated_at, got["f"].contact) == ("old a", old, "c")
    # An update overwrites every column it can: what it does not name becomes null.
    assert (got["b"].notes, got["b"].contact, got["b"].status) == (None, None, "in_progress")
    assert (got["b"].created_at, got["b"].updated_at) == (old, now)
    assert (got["n"].created_at, got["n"].updated_at) == (now, now)
    assert (got["d"].notes, got["d"].created_at) == ("again", now)
    assert (got["e"].notes, got["e"].created_at) == ("edited", old)
    path = str(tmp_path / "snapshot")
    write_snapshot(merged.snapshot, path)
    assert merged.snapshot.sparkSession.read.parquet(path).count() == 6
    with pytest.raises(Exception, match="exist"):
        write_snapshot(merged.snapshot, path)


def test_a_long_run_of_changes_to_one_id(spark, monkeypatch):
    import random

    from tidewatch.sources import notification_store

    monkeypatch.setattr(notification_store, "STRETCH", 7)
    rng = random.Random(2)
    current = table(spark, "publisher_notifications", [dict(id="hot"), dict(id="x")])
    changes = [
        (seq, rng.choice(["insert", "update", "update", "delete"]), rng.choice(["hot", "hot", "x", "new"]))
        for seq in range(300)
    ]
    stored, want = {"hot", "x"}, {}
    for seq, op, id in changes:
        if op == "insert":
            want[seq] = "conflict" if id in stored else "applied"
            stored.add(id)
        else:
            want[seq] = "applied" if id in stored else "not_found"
            if op == "delete":
                stored.discard(id)
    frame = spark.createDataFrame(changes, "seq bigint, op string, id string").withColumns(
        {name: F.lit(None).cast(current.schema[name].dataType) for name in WRITABLE}
    )
    merged = merge_notifications(current, frame, F.current_timestamp())
    assert {r.seq: r.outcome for r in merged.outcomes.collect()} == want
    assert {r.id for r in merged.snapshot.collect()} == stored
