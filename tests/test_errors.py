import random

import pytest

from tests import brute
from tests.conftest import AS_OF, at, day, table
from tidewatch.operators import errors
from tidewatch.thresholds import ErrorThresholds

DEFAULTS = ErrorThresholds()


def log(spark, feeds):
    """feeds = {feed: [(days ago, status, code, message, hour)]} with the tail optional."""
    rows = []
    for feed, runs in feeds.items():
        for back, status, *rest in runs:
            code, message, hour = (list(rest) + [None, None, 6])[:3] if len(rest) < 3 else rest
            rows.append(
                dict(feed_id=feed, dataset_id=f"d-{feed}", ingestion_date=at(day(back), hour or 6),
                     status=status, error_code=code, warning_message=message)
            )
    return table(spark, "opportunity_ingestion", rows)


def test_defaults():
    assert (DEFAULTS.success_lookback_days, DEFAULTS.error_days, DEFAULTS.past_threshold_days) == (15, 1, 3)
    assert DEFAULTS.incident_history_days == 15 and DEFAULTS.trend_history_days == 44
    assert ErrorThresholds(error_days=9).past_days == 9


def test_rules(spark, no_names):
    ok, bad = "COMPLETE", "ERROR"
    feeds = {
        "completed": [(1, bad), (0, ok)],
        "fresh": [(1, ok), (0, bad, "500", "boom")],
        "warned": [(1, ok), (0, "WARNING")],
        "absent": [(1, ok)],
        "never": [(2, bad), (0, bad)],
        "too-old": [(16, ok), (0, bad)],
        "edge": [(15, ok), (0, bad)],
        "both-in-a-day": [(1, ok), (0, bad, "500", "x", 5), (0, ok, None, None, 7)],
        "gaps": [(4, ok), (0, bad)],
        "again": [(9, ok), (5, bad), (3, ok), (0, bad)],
        "denied": [(1, ok), (0, bad, "403")],
        "denied-401": [(1, ok), (0, bad, "401")],
        "denied-before": [(2, ok), (1, bad, "401"), (0, bad, "500")],
        "no-code": [(1, ok), (0, bad)],
        "mixed-case": [(2, "Complete"), (0, bad)],
        "warning-last": [(1, ok), (0, bad, "403", "m", 5), (0, "WARNING", None, "w", 8)],
    }
    found = errors.feed_ingestion_errors(log(spark, feeds), *no_names, AS_OF).collect()
    assert [(r.feed_id, r.consecutive_days) for r in found] == [
        ("edge", 15), ("gaps", 4), ("again", 3), ("denied-before", 2), ("mixed-case", 2),
        ("fresh", 1), ("no-code", 1), ("warning-last", 1),
    ]
    by_feed = {r.feed_id: r for r in found}
    fresh = by_feed["fresh"]
    assert (fresh.error_code, fresh.error_message, fresh.last_completed) == ("500", "boom", day(1))
    assert fresh.first_detected == day(0) and not fresh.past_threshold and fresh.trend == [0] * 9 + [1]
    assert by_feed["again"].past_threshold and by_feed["again"].trend == [0, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    # The day's latest run was a warning, so it has no failure detail to exclude it by.
    assert by_feed["warning-last"].error_code is None

    later = errors.feed_ingestion_errors(
        log(spark, feeds), *no_names, AS_OF, ErrorThresholds(error_days=3)
    ).collect()
    assert [r.feed_id for r in later] == ["edge", "gaps", "again"]
    none = errors.feed_ingestion_errors(
        log(spark, feeds), *no_names, AS_OF, ErrorThresholds(error_days=5, success_lookback_days=4)
    )
    assert none.count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_trend_equals_a_day_by_day_evaluation(spark, no_names, seed):
    rng = random.Random(seed)
    th = ErrorThresholds(success_lookback_days=6, error_days=2, past_threshold_days=4, trend_days=20)
    feeds = {}
    for n in range(40):
        feeds[f"f{n:02}"] = [
            (back, rng.choice(["ERROR", "ERROR", "COMPLETE", "WARNING"]), rng.choice([None, "500", "403"]))
            for back in range(40) if rng.random() < 0.7
        ]
    runs = log(spark, feeds).cache()
    limit = day(th.trend_history_days)
    statuses = {
        f: {day(b): (s.lower(), c) for b, s, c in days if day(b) >= limit} for f, days in feeds.items()
    }
    want = []
    for back in range(th.trend_days - 1, -1, -1):
        failing = brute.errors(statuses, day(back), th).values()
        want.append((day(back), len(failing), sum(f >= th.past_days for f in failing)))
    got = [tuple(r) for r in errors.feed_ingestion_error_trend(runs, AS_OF, th).collect()]
    assert got == want
    assert got[-1][1] == errors.feed_ingestion_errors(runs, *no_names, AS_OF, th).count()
    runs.unpersist()
