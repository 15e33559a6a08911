import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests import brute
from tests.conftest import AS_OF, at, day, table
from tidewatch.functions.numbers import percent_drop
from tidewatch.operators import daily, decline
from tidewatch.thresholds import DeclineThresholds

DEFAULTS = DeclineThresholds()


def log(spark, feeds):
    """feeds = {feed: (dataset, [(days ago, level, updated, deletes)])}."""
    rows = []
    for feed, (dataset, days) in feeds.items():
        for back, level, updated, deletes in days:
            rows.append(
                dict(feed_id=feed, dataset_id=dataset, ingestion_date=at(day(back)), status="COMPLETE",
                     kind="Event", updated=updated, actual_deletes=deletes, total_future_opportunities=level)
            )
    return table(spark, "opportunity_ingestion", rows)


def falling(*levels, updated=0, deletes=1, end=0):
    """One observation a day, the last one ``end`` days ago."""
    span = len(levels)
    return [(end + span - 1 - i, level, updated, deletes) for i, level in enumerate(levels)]


def found(spark, feeds, th=DEFAULTS):
    levels = daily.supply_days(log(spark, feeds), day(th.incident_history_days), AS_OF, ())
    return {r.feed_id: r for r in decline.feed_declines(levels, AS_OF, AS_OF, th).collect()}


def test_defaults():
    assert (DEFAULTS.window_days, DEFAULTS.drop_percent, DEFAULTS.qualify_window_days) == (5, 10, 10)
    assert (DEFAULTS.qualify_drop_percent, DEFAULTS.past_threshold_drop_percent) == (10, 25)
    assert DEFAULTS.min_future_opportunities == 50 and DEFAULTS.min_observations == 3
    assert DeclineThresholds(window_days=1).min_observations == 2
    assert DeclineThresholds(window_days=30).qualify_days == 30
    assert DeclineThresholds(drop_percent=60).past_percent == 60
    assert DEFAULTS.trend_history_days == 39


def test_the_worked_example(spark):
    # 640, 616, 592, 568 on four days in a row: 72 of 640 are gone, 11.25 percent, in steps under ten percent.
    days = [(3, 640, 0, 0), (2, 616, 7, 31), (1, 592, 0, 24), (0, 568, 2, 26)]
    got = found(spark, {"f": ("d", days)})["f"]
    assert got.reason == "monotonic_decline"
    assert (got.drop, got.drop_percent, got.delta_in_window) == (72, 11.25, -72)
    assert got.decline_start == day(3) and got.qualify_start_future == 640


def test_rules(spark):
    feeds = {
        "steady": falling(100, 100, 100, 100, 100),
        "growing": falling(100, 110, 120, 130, 140),
        "cliff": falling(1000, 1000, 800, 800, 800),
        "steep": falling(1000, 900, 800, 700, 600),
        "recovering": falling(1000, 700, 800, 850, 900),
        "flat-day": falling(1000, 990, 990, 980, 970),
        "small": falling(49, 40, 30, 20, 10),
        "two-points": [(1, 900, 0, 1), (0, 500, 0, 1)],
        "gappy": [(4, 1000, 0, 1), (2, 950, 0, 1), (0, 900, 0, 1)],
        "adds-more": falling(1000, 995, 990, 985, 980, updated=9),
        "removes-more": falling(1000, 995, 990, 985, 980, updated=1, deletes=2),
        "steep-adding": falling(1000, 900, 800, 700, 600, updated=500),
        "older": falling(1000, 100, 100, 100, 100, end=1) + [(0, 100, 0, 1)],
        "flat-end": falling(1000, 800, 700, 700, 700),
        "from-zero": falling(0, 0, 0, 0, 0),
    }
    got = found(spark, {name: (name, days) for name, days in feeds.items()})
    assert {name: r.reason for name, r in got.items()} == {
        "cliff": "sharp_drop", "steep": "both", "recovering": "sharp_drop", "gappy": "monotonic_decline",
        "removes-more": "monotonic_decline", "steep-adding": "both", "flat-end": "sharp_drop",
    }
    assert got["cliff"].decline_start == day(3)
    assert got["flat-end"].decline_start == day(4)
    assert got["steep"].decline_start == day(4)
    assert got["recovering"].largest_daily_drop_percent == 30.0
    # The drop left the window yesterday: what is left of it is flat.
    assert "older" not in got


def test_the_qualifying_window_is_the_longer_one(spark):
    days = falling(2000, 1000, 995, 990, 985, 980, updated=9)
    got = found(spark, {"f": ("d", days)})
    assert got["f"].qualify_start_future == 2000 and got["f"].qualify_drop_percent == 51.0
    assert found(spark, {"f": ("d", days)}, DeclineThresholds(qualify_window_days=2)) == {}


def test_percentages_are_rounded_half_to_even(spark):
    pairs = [(1, 800), (3, 800), (-5, 100), (5, 0), (1, 3)]
    rows = spark.createDataFrame(pairs, "drop bigint, start bigint")
    got = [r[0] for r in rows.select(percent_drop(F.col("drop"), F.col("start"))).collect()]
    assert got == [0.12, 0.38, 0.0, 0.0, 33.33]


def test_one_day_window_reports_nothing(spark):
    assert found(spark, {"f": ("d", falling(900, 500, 100))}, DeclineThresholds(window_days=1)) == {}


def test_runs_that_do_not_count(spark):
    base = dict(feed_id="f", dataset_id="d", status="COMPLETE", kind="Event", updated=0, actual_deletes=1)
    rows = [
        {**base, "ingestion_date": at(day(back)), "total_future_opportunities": level}
        for back, level in ((4, 1000), (3, 990), (2, 980))
    ] + [
        # The day's last completed run counts; failed runs, null levels and Slots do not.
        {**base, "ingestion_date": at(day(1), 3), "total_future_opportunities": 5},
        {**base, "ingestion_date": at(day(1), 9), "total_future_opportunities": 970},
        {**base, "ingestion_date": at(day(1), 10), "total_future_opportunities": None},
        {**base, "ingestion_date": at(day(1), 11), "status": "ERROR", "total_future_opportunities": 1},
        {**base, "ingestion_date": at(day(1), 12), "kind": "Slot", "total_future_opportunities": 2},
        {**base, "ingestion_date": at(day(0), 9), "kind": None, "total_future_opportunities": 960},
    ]
    levels = daily.supply_days(
        table(spark, "opportunity_ingestion", rows), day(10), AS_OF, decline.IGNORED_KINDS
    )
    got = [(r.day, r.future, r.deletes) for r in levels.orderBy("day").collect()]
    assert got == [(day(4), 1000, 1), (day(3), 990, 1), (day(2), 980, 1), (day(1), 970, 2), (day(0), 960, 1)]
    assert daily.supply_days(table(spark, "opportunity_ingestion", rows), day(0), AS_OF, ()).count() == 1


def test_datasets_fold_their_declining_feeds(spark, no_names):
    feeds = {
        "a1": ("a", falling(1000, 990, 980, 970, 960)),
        "a2": ("a", falling(500, 500, 300, 300, 300)),
        "a3": ("a", falling(700, 700, 700, 700, 700)),
        "b1": ("b", falling(900, 880, 860, 840, 820)),
        "c1": ("c", falling(400, 390, 380, 370, 320)),
    }
    runs = log(spark, feeds)
    rows = decline.dataset_future_decline(runs, no_names[1], AS_OF).collect()
    assert [(r.dataset_url, r.drop, r.feed_count, r.reason) for r in rows] == [
        ("a", 240, 2, "both"), ("c", 80, 1, "both"), ("b", 80, 1, "monotonic_decline"),
    ]
    a = rows[0]
    assert (a.start_total, a.current_total, a.drop_percent, a.past_threshold) == (1500, 1260, 16.0, False)
    assert a.trend == [None] * 5 + [1500, 1490, 1280, 1270, 1260]
    assert a.first_detected == day(4) and a.consecutive_days == a.days_open == 4
    names = decline.dataset_future_decline_feeds(runs, no_names[0], AS_OF).collect()
    assert [(r.dataset_url, r.feed_id) for r in names] == [("a", "a2"), ("a", "a1"), ("b", "b1"), ("c", "c1")]
    strict = decline.dataset_future_decline(
        runs, no_names[1], AS_OF, DeclineThresholds(past_threshold_drop_percent=16)
    ).collect()
    assert [r.past_threshold for r in strict] == [True, True, False]


@pytest.mark.parametrize("seed", [5, 6])
def test_every_day_equals_a_day_by_day_evaluation(spark, no_names, seed):
    rng = random.Random(seed)
    th = DeclineThresholds(trend_days=12, qualify_window_days=7, min_future_opportunities=20)
    feeds = {}
    for n in range(40):
        level, days = rng.randrange(40, 400), []
        for back in range(25, -1, -1):
            level = max(0, level - rng.choice([0, 1, 1, 2, 30, -5]))
            if rng.random() < 0.75:
                days.append((back, level, rng.randrange(4), rng.randrange(4)))
        feeds[f"f{n:02}"] = (f"d{n % 9}", days)
    runs = log(spark, feeds).cache()
    limit = day(th.trend_history_days)
    levels = daily.supply_days(runs, limit, AS_OF, ())
    first = AS_OF - dt.timedelta(days=th.trend_days - 1)
    got = {
        (r.feed_id, r.as_of): (
            r.reason, r.decline_start, r.start_future, r.current_future, r.qualify_start_future,
            r.largest_daily_drop_percent,
        )
        for r in decline.feed_declines(levels, first, AS_OF, th).collect()
    }
    want, open_ = {}, {}
    for back in range(th.trend_days):
        for feed, (dataset, days) in feeds.items():
            history = {day(b): (level, u, x) for b, level, u, x in days if day(b) >= limit}
            result = brute.decline(history, day(back), th)
            if result:
                want[feed, day(back)] = result
                total = open_.setdefault((day(back), dataset), [0, 0])
                total[0] += result[2]
                total[1] += result[3]
    assert got == want and want
    points = [tuple(r) for r in decline.dataset_future_decline_trend(runs, AS_OF, th).collect()]
    for date, opened, past in points:
        totals = [t for (d, _), t in open_.items() if d == date]
        assert opened == len(totals)
        assert past == sum(brute.percent(a - b, a) >= th.past_percent for a, b in totals)
    assert points[-1][1] == decline.dataset_future_decline(runs, no_names[1], AS_OF, th).count()

    # A lower trigger never reports fewer.
    lower = DeclineThresholds(drop_percent=5, qualify_drop_percent=5, qualify_window_days=7, min_future_opportunities=20)
    assert points[-1][1] <= decline.dataset_future_decline(runs, no_names[1], AS_OF, lower).count()
    runs.unpersist()
