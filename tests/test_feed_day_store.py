"""The stored feed-day state: monitors over it equal those over the log, after late and repeated runs too."""

import datetime as dt
import random

import pytest

from tests.conftest import AS_OF, at, day, table
from tidewatch.operators import daily, decline, errors, stalls
from tidewatch.plans import estate
from tidewatch.sources import snapshots
from tidewatch.sources.feed_day_store import FeedDayStore, merged_rows, state_of, state_rows
from tidewatch.sources.part_store import PartStore
from tidewatch.thresholds import DeclineThresholds, ErrorThresholds, StallThresholds

STALLS = StallThresholds(lookback_days=20, stall_days=2, trend_days=6)
ERRORS = ErrorThresholds(trend_days=6)
DECLINE = DeclineThresholds(trend_days=6, min_future_opportunities=1)


def runs(seed, days, feeds=12):
    rng = random.Random(seed)
    out = []
    for back in days:
        for feed in range(feeds):
            for _ in range(rng.choice([0, 1, 1, 2])):
                status = rng.choice(["COMPLETE", "COMPLETE", "ERROR", "WARNING", "Complete", None])
                out.append(dict(
                    feed_id=None if rng.random() < 0.03 else f"f{feed}", dataset_id=f"d{(feed + (back > 9)) % 4}",
                    ingestion_date=at(day(back), rng.randrange(24)), status=status,
                    kind=rng.choice(["Slot", "Event", None]), error_code=rng.choice(["401", "403", "500", "X", None]),
                    warning_message=rng.choice(["m", "n", None]), updated=rng.choice([0, 0, 3, None]),
                    actual_deletes=rng.choice([0, 5, None]), total_future_opportunities=rng.choice([None, 100, 90, 60, 20]),
                ))
    return out


def steady(days):
    """A dataset that fell silent, a feed that fails and one whose supply drains."""
    out = []
    for back in days:
        out.append(dict(feed_id="quiet", dataset_id="dq", ingestion_date=at(day(back)), status="COMPLETE", updated=int(back >= 5)))
        out.append(dict(feed_id="broken", dataset_id="d1", ingestion_date=at(day(back)), status="COMPLETE" if back > 2 else "ERROR",
                        error_code="500", warning_message=f"on {back}"))
        out.append(dict(feed_id="drain", dataset_id="dd", ingestion_date=at(day(back)), status="COMPLETE", updated=1,
                        total_future_opportunities=100 * (back + 1), kind="Event"))
    return out


def monitors(history, no_names):
    feed_names, dataset_names = no_names
    return {
        "stalls": stalls.single_feed_stalls(history, feed_names, dataset_names, AS_OF, STALLS),
        "stall trend": stalls.single_feed_stall_trend(history, AS_OF, STALLS),
        "dataset stalls": stalls.dataset_stalls(history, dataset_names, AS_OF, STALLS),
        "dataset stall feeds": stalls.dataset_stall_feeds(history, feed_names, AS_OF, STALLS),
        "dataset stall trend": stalls.dataset_stall_trend(history, AS_OF, STALLS),
        "errors": errors.feed_ingestion_errors(history, feed_names, dataset_names, AS_OF, ERRORS),
        "error trend": errors.feed_ingestion_error_trend(history, AS_OF, ERRORS),
        "declines": decline.dataset_future_decline(history, dataset_names, AS_OF, DECLINE),
        "decline feeds": decline.dataset_future_decline_feeds(history, feed_names, AS_OF, DECLINE),
        "decline trend": decline.dataset_future_decline_trend(history, AS_OF, DECLINE),
        "tiles": estate.history_tiles(history, AS_OF, STALLS, ERRORS, DECLINE),
    }


def rows(frames):
    return {name: sorted((tuple(r) for r in frame.collect()), key=repr) for name, frame in frames.items()}


def test_monitors_over_the_state_equal_those_over_the_log(spark, no_names, tmp_path):
    old, late, new = runs(1, range(30, 0, -1)), runs(2, [3, 7, 14]), runs(3, [0]) + steady([0])
    old += steady(range(20, 0, -1))
    log = table(spark, "opportunity_ingestion", old + late + new).cache()
    want = rows(monitors(log, no_names))
    assert all(want.values()), [name for name, found in want.items() if not found]

    store = FeedDayStore(spark, str(tmp_path / "state"))
    assert store.first_day() is None and store.state().rows.count() == 0
    assert store.add_runs(table(spark, "opportunity_ingestion", old), "day 1")
    before = PartStore(spark, str(tmp_path / "state" / "rows"), "day date").snapshot()
    assert store.add_runs(table(spark, "opportunity_ingestion", late + new), "day 2")
    after = PartStore(spark, str(tmp_path / "state" / "rows"), "day date").snapshot()
    touched = {day(back).isoformat() for back in (0, 3, 7, 14)}
    assert {n for n in after.parts if after.parts[n] != before.parts.get(n)} == touched
    assert rows(monitors(store.state(), no_names)) == want

    assert not store.add_runs(table(spark, "opportunity_ingestion", late + new), "day 2")  # repeated
    store.rebuild_days(log, day(8), day(2))
    assert rows(monitors(store.state(day(29)), no_names)) == want
    assert store.first_day() == day(30) == min(r.ingestion_date for r in log.collect()).date()
    assert store.last_day() == snapshots.latest_day(log)
    log.unpersist()


def test_merging_days_and_parts_gives_the_whole(spark):
    both = [table(spark, "opportunity_ingestion", runs(n, range(4))) for n in (5, 6)]
    whole = state_rows(both[0].unionByName(both[1]))
    assert sorted(map(repr, merged_rows(*map(state_rows, both)).collect())) == sorted(map(repr, whole.collect()))


def test_the_index_spares_the_search_for_the_first_day(spark, tmp_path):
    log = table(spark, "opportunity_ingestion", runs(4, range(3)))
    log.write.parquet(str(tmp_path / "log"))
    stored = spark.read.parquet(str(tmp_path / "log"))
    store = FeedDayStore(spark, str(tmp_path / "state"))
    store.add_runs(stored, "all")
    plan = stalls.single_feed_stall_trend(store.state(), AS_OF, STALLS)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "log") not in plan and "total_future_opportunities" not in plan
    assert daily.first_log_day(store.state()) is not None


def test_an_update_that_lost_the_race_or_failed_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    store = PartStore(spark, str(tmp_path / "t"), "k string, v int")

    def frame(*pairs):
        return spark.createDataFrame(list(pairs), store.schema)

    start = store.snapshot()
    one = store.replace(start, frame(("a", 1), ("b", 2)), F.col("k"), ["a", "b"])
    with pytest.raises(Exception, match="(?i)exists"):
        store.replace(start, frame(("a", 9)), F.col("k"), ["a"])
    with pytest.raises(ValueError, match="outside"):
        store.replace(one, frame(("c", 9)), F.col("k"), ["a"])
    two = store.replace(store.snapshot(), frame(("a", 3)), F.col("k"), ["a"], "second")
    assert store.part_path("b", two.parts["b"]) == store.part_path("b", one.parts["b"])
    three = store.replace(store.snapshot(), frame(), F.col("k"), ["b"])
    assert [tuple(r) for r in store.read().collect()] == [("a", 3)] and store.snapshot() == three
    assert three.batches == {"second"}
    assert [tuple(r) for r in store.read(one, ["b"]).collect()] == [("b", 2)]


def test_an_empty_load(spark, tmp_path):
    store = FeedDayStore(spark, str(tmp_path / "state"))
    empty = table(spark, "opportunity_ingestion", [])
    assert store.add_runs(empty, "nothing") and not store.add_runs(empty, "nothing")
    assert store.state().rows.count() == 0 and store.last_day() is None
    assert state_of(empty).index.count() == 0
    store.rebuild_days(table(spark, "opportunity_ingestion", runs(1, [0, 1])), day(1), day(0))
    assert (store.first_day(), store.last_day()) == (day(1), day(0)) and store.last_day() - store.first_day() == dt.timedelta(1)
