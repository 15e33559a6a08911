import datetime as dt
import random

import pytest

from tests import brute
from tests.conftest import AS_OF, at, day, table
from tidewatch.operators import stalls
from tidewatch.plans import estate
from tidewatch.thresholds import StallThresholds

DEFAULTS = StallThresholds()


def history(spark, feeds):
    """feeds = [(feed, dataset, [(days ago, updated)])]; an old row keeps the first-day rule away."""
    rows = [dict(feed_id="old", dataset_id="old", ingestion_date=at(day(900)), status="COMPLETE", updated=1)]
    for feed, dataset, days in feeds:
        rows += [
            dict(feed_id=feed, dataset_id=dataset, ingestion_date=at(day(back)), status="COMPLETE", updated=n)
            for back, n in days
        ]
    return table(spark, "opportunity_ingestion", rows)


def keepalive(dataset):
    return (f"{dataset}-live", dataset, [(0, 1)])


def single(spark, no_names, feeds, th=DEFAULTS):
    return stalls.single_feed_stalls(history(spark, feeds), *no_names, AS_OF, th).collect()


def whole(spark, no_names, feeds, th=DEFAULTS):
    return stalls.dataset_stalls(history(spark, feeds), no_names[1], AS_OF, th).collect()


def test_defaults():
    assert (DEFAULTS.lookback_days, DEFAULTS.stall_days, DEFAULTS.past_threshold_days) == (120, 5, 7)
    assert (DEFAULTS.trend_days, DEFAULTS.incident_trend_days) == (30, 10)
    assert StallThresholds(stall_days=20).past_days == 20
    assert StallThresholds(lookback_days=9999).incident_history_days == 10_009
    for wrong in (dict(lookback_days=0), dict(stall_days=0), dict(trend_days=-1)):
        with pytest.raises(ValueError, match="at least 1"):
            StallThresholds(**wrong)


def test_single_feed_rules(spark, no_names):
    cases = {
        "today": [(0, 3)],
        "below": [(4, 3)],
        "exact": [(5, 3)],
        "past": [(7, 3)],
        "almost-past": [(6, 3)],
        "edge": [(120, 3)],
        "retired": [(121, 3)],
        "never": [(1, 0), (2, 0)],
        "null-updates": [(0, None), (9, 2), (3, None)],
        "gaps": [(30, 1), (10, 0)],
        "back-again": [(20, 1), (1, 1)],
        "sums-to-zero": [(1, 5), (1, -5), (8, 2)],
    }
    feeds = [(name, f"d-{name}", days) for name, days in cases.items()]
    feeds += [keepalive(f"d-{name}") for name in cases]
    found = single(spark, no_names, feeds)
    assert [(r.feed_id, r.consecutive_days) for r in found] == [
        ("edge", 120), ("gaps", 30), ("null-updates", 9), ("sums-to-zero", 8), ("past", 7),
        ("almost-past", 6), ("exact", 5),
    ]
    by_feed = {r.feed_id: r for r in found}
    assert by_feed["past"].past_threshold and not by_feed["almost-past"].past_threshold
    past = by_feed["past"]
    assert past.first_detected == past.last_published == day(7)
    assert past.days_open == 7 and past.status == "open" and past.last_contacted is None
    assert (past.monitor_id, past.publisher_id, past.publisher_name) == ("single_feed_stall", "pub_unknown", "")
    assert past.feed_name == "past" and past.dataset_name == "d-past"
    # Null where there was no run, zero where a run published nothing.
    assert by_feed["gaps"].trend == [None] * 10
    assert by_feed["null-updates"].trend == [2, None, None, None, None, None, 0, None, None, 0]


def test_dataset_wide_silence_is_left_to_the_other_monitor(spark, no_names):
    feeds = [
        ("a1", "a", [(9, 1)]), ("a2", "a", [(6, 1)]),
        ("b1", "b", [(9, 1)]), ("b2", "b", [(1, 0)]),
        ("c1", "c", [(9, 1)]), ("c2", "c", [(4, 1)]),
        ("d1", "d", [(1, 0)]),
    ]
    assert [r.feed_id for r in single(spark, no_names, feeds)] == ["c1"]
    found = {r.dataset_url: r for r in whole(spark, no_names, feeds)}
    assert set(found) == {"a", "b"}
    assert (found["a"].consecutive_days, found["a"].feed_count, found["a"].past_threshold) == (6, 2, False)
    assert (found["b"].consecutive_days, found["b"].past_threshold) == (9, True)
    assert found["a"].trend == [1, None, None, 1, None, None, None, None, None, None]
    assert found["b"].trend == [1, None, None, None, None, None, None, None, 0, None]

    rows = stalls.dataset_stall_feeds(history(spark, feeds), no_names[0], AS_OF, DEFAULTS).collect()
    assert [(r.dataset_url, r.feed_id, r.consecutive_days) for r in rows] == [
        ("a", "a2", 6), ("a", "a1", 9), ("b", "b1", 9), ("b", "b2", None),
    ]


def test_the_first_day_of_the_log_is_not_read(spark, no_names):
    rows = [
        dict(feed_id="f", dataset_id="d", ingestion_date=at(day(9)), updated=5),
        dict(feed_id="g", dataset_id="d", ingestion_date=at(day(8)), updated=5),
        dict(feed_id="h", dataset_id="d", ingestion_date=at(day(0)), updated=5),
        dict(feed_id=None, dataset_id="d", ingestion_date=at(day(0)), updated=5),
    ]
    log = table(spark, "opportunity_ingestion", rows)
    found = stalls.single_feed_stalls(log, *no_names, AS_OF, DEFAULTS).collect()
    assert [r.feed_id for r in found] == ["g"]


def test_a_moved_feed_belongs_to_its_latest_dataset(spark, no_names):
    moved = [
        dict(feed_id="f", dataset_id="old", ingestion_date=at(day(9)), updated=1),
        dict(feed_id="f", dataset_id="z-new", ingestion_date=at(day(1), 5), updated=0),
        dict(feed_id="f", dataset_id="b-new", ingestion_date=at(day(1), 9), updated=0),
        dict(feed_id="f", dataset_id="a-new", ingestion_date=at(day(1), 9), updated=0),
        dict(feed_id="g", dataset_id="a-new", ingestion_date=at(day(0)), updated=1),
        dict(feed_id="x", dataset_id="x", ingestion_date=at(day(300)), updated=1),
    ]
    log = table(spark, "opportunity_ingestion", moved)
    found = stalls.single_feed_stalls(log, *no_names, AS_OF, DEFAULTS).collect()
    assert [(r.feed_id, r.dataset_url) for r in found] == [("f", "a-new")]


@pytest.mark.parametrize("seed", [1, 2])
def test_trends_equal_a_day_by_day_evaluation(spark, no_names, seed):
    rng = random.Random(seed)
    th = StallThresholds(lookback_days=25, stall_days=3, past_threshold_days=5, trend_days=14)
    feeds = []
    for n in range(40):
        rate = rng.choice([0.03, 0.1, 0.3, 0.8])
        days = [(back, rng.choice([0, 4])) for back in range(60) if rng.random() < rate]
        feeds.append((f"f{n:02}", f"d{rng.randrange(14):02}", days))
    log = history(spark, feeds).cache()
    first = AS_OF - dt.timedelta(days=th.trend_history_days)
    owners = {f: d for f, d, days in feeds if any(day(b) >= first for b, _ in days)}
    published = {f: [day(b) for b, n in days if n > 0 and day(b) >= first] for f, _, days in feeds}

    def points(rule):
        out = []
        for back in range(th.trend_days - 1, -1, -1):
            silent = rule(published, owners, day(back), th).values()
            out.append((day(back), len(silent), sum(s >= th.past_days for s in silent)))
        return out

    feed_points = [tuple(r) for r in stalls.single_feed_stall_trend(log, AS_OF, th).collect()]
    dataset_points = [tuple(r) for r in stalls.dataset_stall_trend(log, AS_OF, th).collect()]
    assert feed_points == points(brute.feed_stalls)
    assert dataset_points == points(brute.dataset_stalls)
    assert all(past <= opened for _, opened, past in feed_points + dataset_points)

    # The last point is the incident list of the same day.
    assert feed_points[-1][1] == stalls.single_feed_stalls(log, *no_names, AS_OF, th).count()
    assert dataset_points[-1][1] == stalls.dataset_stalls(log, no_names[1], AS_OF, th).count()

    both = estate.history_trends(log, AS_OF, th).collect()
    for monitor, points in ((stalls.SINGLE_FEED, feed_points), (stalls.DATASET, dataset_points)):
        assert sorted((r.day, r.open_count, r.past_threshold_count) for r in both if r.monitor_id == monitor) == points
    log.unpersist()


def test_an_empty_log_gives_zero_points(spark, no_names):
    log = table(spark, "opportunity_ingestion", [])
    points = stalls.single_feed_stall_trend(log, AS_OF, StallThresholds(trend_days=3)).collect()
    assert [tuple(p) for p in points] == [(day(2), 0, 0), (day(1), 0, 0), (day(0), 0, 0)]
    assert stalls.single_feed_stalls(log, *no_names, AS_OF).count() == 0
