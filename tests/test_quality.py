import datetime as dt
import random
import statistics

import pytest

from tests.conftest import table
from tidewatch.plans import properties, quality
from tidewatch.schemas import COMPLETENESS_COLUMNS


def assessed(spark, rows, feeds=(), **filters):
    rows = [{"feed_id": f"f{n}", "dataset_url": "d", **row} for n, row in enumerate(rows)]
    return quality.assessed_feeds(
        table(spark, "feed_quality", rows), table(spark, "feeds", list(feeds)), **filters
    )


def summary(spark, rows, feeds=()):
    return quality.quality_summary(assessed(spark, rows, feeds)).collect()[0]


def test_empty_input_is_zeroes_and_nulls(spark):
    s = summary(spark, [])
    assert (s.total_feeds, s.total_datasets, s.feeds_ok, s.total_future_opportunity_items) == (0, 0, 0, 0)
    assert s.average_score is None and s.median_score is None and s.oldest_assessment is None
    nothing = assessed(spark, [])
    assert [r.feed_count for r in quality.score_histogram(nothing).collect()] == [0] * 5
    assert quality.quality_breakdowns(nothing).count() == 0
    assert {r.average for r in quality.completeness_averages(nothing).collect()} == {None}


def test_headline_figures(spark):
    rows = [
        dict(dataset_url="D1", is_regular=True, status="OK", num_future_opportunity_items=3, score=10.0,
             last_assessed=dt.datetime(2026, 1, 2)),
        dict(dataset_url="d1", is_regular=False, status=" ok ", num_future_opportunity_items=0, score=40.0),
        dict(dataset_url="d2", is_regular=None, status="Warning", num_future_opportunity_items=-4,
             last_assessed=dt.datetime(2026, 1, 5)),
        dict(dataset_url="d3", status="ERROR", num_future_opportunity_items=None),
        dict(dataset_url="D3", status="error"),
        dict(dataset_url=" ", status="odd"),
        dict(dataset_url="d9", status=None),
    ]
    feeds = [
        dict(id="1", dataset_url="d1", publisher_name="Zed"), dict(id="2", dataset_url="d1", publisher_name="Amy"),
        dict(id="3", dataset_url="D1", publisher_name="AMY"), dict(id="4", dataset_url="d2", publisher_name=" "),
    ]
    s = summary(spark, rows, feeds)
    assert (s.total_feeds, s.total_datasets, s.total_publishers) == (7, 4, 1)
    assert (s.regular_feeds, s.irregular_feeds, s.regularity_unknown) == (1, 1, 5)
    assert (s.feeds_ok, s.feeds_with_warnings, s.feeds_with_errors, s.feeds_status_unknown) == (2, 1, 2, 2)
    assert s.datasets_with_errors == 1
    assert (s.feeds_with_future_data, s.datasets_with_future_data) == (1, 1)
    assert s.total_future_opportunity_items == -1
    assert (s.feeds_scored, s.average_score, s.median_score, s.min_score, s.max_score) == (2, 25.0, 25.0, 10.0, 40.0)
    assert (s.oldest_assessment, s.newest_assessment) == (dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 5))


@pytest.mark.parametrize("seed", range(6))
def test_the_median_is_exact(spark, seed):
    rng = random.Random(seed)
    scores = [rng.choice([rng.uniform(-30, 130), float(rng.randrange(100)), 50.0, 50.0]) for _ in range(60 + seed)]
    frame = spark.createDataFrame([(s,) for s in scores] + [(None,)], "score double")
    assert quality.median_score(frame).collect()[0][0] == pytest.approx(statistics.median(scores))


def test_score_buckets(spark):
    scores = [-5.0, 0.0, 19.99, 20.0, 40.0, 59.9, 60.0, 80.0, 100.0, 140.0, 1e15, -1e15, None]
    got = quality.score_histogram(assessed(spark, [dict(score=s) for s in scores])).collect()
    assert [(r.lower, r.upper, r.feed_count) for r in got] == [
        (0, 20, 4), (20, 40, 1), (40, 60, 2), (60, 80, 1), (80, 100, 4),
    ]


def test_completeness_averages_reporting_feeds_only(spark):
    rows = [
        dict(location_completeness=100.0, level_completeness=0.0),
        dict(location_completeness=50.0), dict(location_completeness=None),
    ]
    got = {r.field: (r.average, r.feeds_reporting) for r in quality.completeness_averages(assessed(spark, rows)).collect()}
    assert list(got) == [c.removesuffix("_completeness") for c in COMPLETENESS_COLUMNS]
    assert got["location"] == (75.0, 2) and got["level"] == (0.0, 1) and got["activities"] == (None, 0)


def test_breakdowns(spark):
    rows = [
        dict(dataset_url="a", status="warning", score=10.0), dict(dataset_url="A", status=" WARNING ", score=90.0),
        dict(dataset_url="b", status="OK", score=5.0), dict(dataset_url="b", status=" ", score=None),
        dict(dataset_url="c", status=None, score=1.0), dict(dataset_url="c", status="beta"),
    ]
    got = [
        (r.value, r.feed_count, r.dataset_count, round(r.share, 3))
        for r in quality.quality_breakdowns(assessed(spark, rows)).collect() if r.breakdown == "status"
    ]
    assert got == [
        ("unknown", 2, 2, 0.333), ("WARNING", 2, 1, 0.333), ("beta", 1, 1, 0.167), ("OK", 1, 1, 0.167),
    ]
    total = {}
    for r in quality.quality_breakdowns(assessed(spark, rows)).collect():
        total[r.breakdown] = total.get(r.breakdown, 0) + r.feed_count
    assert total == {"status": 6, "grade": 6, "feed_type": 6, "feed_version": 6}


def test_rows_filters_and_order(spark):
    rows = [
        dict(dataset_url="b", score=5.0), dict(dataset_url="a", score=None), dict(dataset_url="c", score=9.0),
        dict(dataset_url="a", score=5.0),
    ]
    feeds = [dict(id="1", dataset_url="a", publisher_name="Pub A"), dict(id="2", dataset_url="b", publisher_name="B")]
    got = quality.quality_rows(assessed(spark, rows, feeds)).collect()
    assert [(r.feed_id, r.publisher_id, r.publisher_name) for r in got] == [
        ("f2", "pub_unknown", ""), ("f3", "pub_pub-a", "Pub A"), ("f0", "pub_b", "B"), ("f1", "pub_pub-a", "Pub A"),
    ]
    assert assessed(spark, rows, feeds, publishers=["Pub A"]).count() == 2
    assert assessed(spark, rows, feeds, dataset_urls=["a", "c", " "], publishers=["B"]).count() == 0
    assert assessed(spark, rows, feeds, dataset_urls=[" "]).count() == 4


def usage(property, namespace=None, entity_type=None, presence_pct=None):
    return (property, namespace, entity_type, presence_pct)


def drift(spark, rows):
    rows = [{"feed_id": f"f{n}", "dataset_url": "d", **row} for n, row in enumerate(rows)]
    return properties.assessed_properties(table(spark, "custom_properties", rows))


def test_property_report(spark):
    frame = drift(spark, [
        dict(dataset_url="A", num_custom_properties=2, num_custom_property_usages=3, publisher_name="P",
             custom_properties=[usage("x", None, "Event", 10.0), usage("beta:y", "beta", None, 90.0),
                                usage("x", " ", " Slot ", None)]),
        dict(dataset_url="a", num_custom_properties=1, num_custom_property_usages=5, publisher_name="p",
             custom_properties=[usage("x", "alpha", "Event", 1.0), usage(" ", "beta", "Event", 1.0), usage("X")]),
        dict(dataset_url="b", num_custom_properties=0, num_custom_property_usages=7,
             custom_properties=[usage("hidden")]),
        dict(dataset_url="c", num_custom_properties=None, custom_properties=None),
        dict(dataset_url="c", feed_id="f0", num_custom_properties=4, custom_properties=None),
        dict(dataset_url="c", feed_id="f0", num_custom_properties=1, custom_properties=[usage("x", None, "Event")]),
    ])
    rows = properties.property_rows(frame).collect()
    assert [(r.dataset_url, r.num_custom_properties) for r in rows] == [("c", 4), ("A", 2), ("a", 1), ("c", 1)]
    assert [(u.property, u.presence_pct) for u in rows[1].custom_properties] == [
        ("beta:y", 90.0), ("x", 10.0), ("x", None),
    ]
    assert rows[0].custom_properties == []
    s = properties.property_summary(frame).collect()[0]
    assert (s.feeds_assessed, s.datasets_assessed, s.feeds_with_custom_properties) == (6, 3, 4)
    assert (s.datasets_with_custom_properties, s.publishers_with_custom_properties) == (2, 1)
    assert (s.distinct_custom_properties, s.total_custom_property_usages) == (3, 8)
    assert s.feed_share == pytest.approx(4 / 6)
    spaces = properties.namespace_breakdown(frame).collect()
    assert [(r.namespace, r.property_count, r.feed_count, r.dataset_count) for r in spaces] == [
        (None, 2, 3, 2), ("alpha", 1, 1, 1), ("beta", 1, 1, 1),
    ]
    types = properties.entity_type_breakdown(frame).collect()
    assert [(r.entity_type, r.property_count, r.feed_count) for r in types] == [
        ("Event", 1, 3), ("unknown", 2, 2), ("Slot", 1, 1),
    ]
    props = properties.property_breakdown(frame).collect()
    assert [(r.property, r.namespace, r.entity_types, r.feed_count, r.dataset_count) for r in props] == [
        ("x", "alpha", ["Event", "Slot"], 3, 2), ("X", None, [], 1, 1), ("beta:y", "beta", [], 1, 1),
    ]


def test_property_summary_of_nothing(spark):
    s = properties.property_summary(drift(spark, [])).collect()[0]
    assert (s.feeds_assessed, s.total_custom_property_usages, s.distinct_custom_properties) == (0, 0, 0)
    assert s.feed_share is None


def test_breakdowns_hold_no_groups_before_feeds_are_dealt_out(spark):
    rows = [dict(dataset_url=f"https://d{n}.example/", feed_id=f"f{n}", status="OK") for n in range(300)]
    found = quality.quality_breakdowns(table(spark, "feed_quality", rows))
    got = {r.breakdown: (r.value, r.feed_count, r.dataset_count, r.share) for r in found.collect()}
    assert got["status"] == ("OK", 300, 300, 1.0) and got["grade"] == ("unknown", 300, 300, 1.0)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("REPARTITION_BY_NUM"):] if "REPARTITION_BY_NUM" in plan else plan
    assert "hashpartitioning(dataset" in plan and "Aggregate" not in below
