import datetime as dt

from tests.conftest import AS_OF, at, day, table
from tidewatch.plans import estate
from tidewatch.sources import snapshots


def trend(spark, points):
    rows = [(m, day(len(p) - 1 - i), o, x) for m, p in points.items() for i, (o, x) in enumerate(p)]
    return spark.createDataFrame(rows, "monitor_id string, day date, open_count bigint, past_threshold_count bigint")


def test_tiles_from_trends(spark):
    tiles = {r.monitor_id: r for r in estate.summarise_trends(trend(spark, {
        "long": [(n, 0) for n in range(10)], "short": [(5, 3), (2, 4)], "single": [(7, 1)],
    })).collect()}
    assert tiles["long"].sparkline == [3, 4, 5, 6, 7, 8, 9] and tiles["long"]["count"] == 9
    assert (tiles["short"].sparkline, tiles["short"].count_delta, tiles["short"].past_threshold_delta) == ([5, 2], -3, 1)
    assert (tiles["single"].sparkline, tiles["single"].count_delta) == ([7], None)
    assert estate.summarise_trends(trend(spark, {})).count() == 0


def test_estate(spark):
    log = table(spark, "opportunity_ingestion", [
        dict(feed_id="x", dataset_id="x", ingestion_date=at(day(400)), status="COMPLETE", updated=1),
        dict(feed_id="f", dataset_id="d", ingestion_date=at(day(1)), status="COMPLETE", updated=1),
        dict(feed_id="f", dataset_id="d", ingestion_date=at(day(0)), status="ERROR"),
        dict(feed_id="g", dataset_id="d", ingestion_date=at(day(0)), status="ERROR"),
        dict(feed_id="h", dataset_id="e", ingestion_date=at(day(5)), status="COMPLETE", updated=2),
    ])
    records = table(spark, "opportunities", [
        dict(dataset_url="a", kind="Slot", has_superEvent='"gone"') for _ in range(1200)
    ])
    crawls = table(spark, "feed_ingestion", [
        dict(ingestion_date=at(day(1)), number_of_datasets=1, number_of_feeds=1),
        dict(ingestion_date=at(day(0)), number_of_datasets=179, number_of_feeds=463),
    ])
    tiles = estate.monitor_tiles(log, records, AS_OF).collect()
    assert [t.monitor_id for t in tiles] == list(estate.MONITOR_ORDER)
    assert [t["count"] for t in tiles] == [0, 1, 1, 0, 1200]
    assert tiles[1].sparkline == [0] * 6 + [1] and tiles[4].sparkline == []
    assert tiles[4].count_delta is None and tiles[4].past_threshold_count == 0
    head = estate.estate_headline(crawls, log, estate.history_tiles(log, AS_OF), AS_OF).collect()[0]
    assert (head.publishers_monitored, head.datasets, head.feeds) == (179, 179, 463)
    assert head.publishers_with_issues == 1 and head.publishers_with_issues_delta == 2
    assert head.open_incidents is None and head.generated_at == at(day(0))


def test_snapshots(spark):
    log = table(spark, "opportunity_ingestion", [dict(ingestion_date=at(day(3))), dict(ingestion_date=at(day(1), 23))])
    assert snapshots.latest_day(log) == day(1)
    empty = table(spark, "opportunity_ingestion", [])
    assert snapshots.latest_day(empty) is None
    crawl = snapshots.latest_crawl(table(spark, "feed_ingestion", [])).collect()[0]
    assert (crawl.datasets, crawl.feeds, crawl.generated_at) == (0, 0, None)
    quality = table(spark, "feed_quality", [dict(last_assessed=dt.datetime(2026, 5, 4, 23, 59))])
    assert snapshots.assessment_date(quality).collect()[0].snapshot_date == dt.date(2026, 5, 4)
