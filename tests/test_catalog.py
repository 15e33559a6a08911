"""Every registered query against its SQL, and the shape of the plans."""

import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.catalog import QUERIES
from checks.compare import difference
from checks.oracle import ORACLE
from tests.conftest import AS_OF, table
from tidewatch.operators import decline, errors, orphans, stalls
from tidewatch.operators.filters import PublicFilter
from tidewatch.plans import estate, growth, public
from tidewatch.sources.warehouse import Warehouse

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys() and ORACLE.keys() <= contract.oracle_sql().keys()


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and "orphan_count" in frame.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    assert difference(spark, SMALL, name) is None


@pytest.mark.parametrize(
    "narrow, whole",
    [
        ("publishers_filtered", "publishers"), ("activities_filtered", "activities"),
        ("organizations_filtered", "organizations"), ("live_records_by_organization", "live_records"),
        ("custom_property_rows_filtered", "custom_property_rows"), ("site_mappings_by_id", "site_mappings"),
    ],
)
def test_filters_leave_some_rows_and_not_all(spark, narrow, whole):
    few, all_rows = (QUERIES[name](spark, SMALL).count() for name in (narrow, whole))
    assert 0 < few < all_rows


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("warehouse")
    for name in ("opportunity_ingestion", "feed_ingestion", "opportunities", "active_opportunities_summary"):
        table(spark, name, []).write.parquet(f"{root}/{name}")
    return Warehouse(spark, root=str(root))


def formatted(frame):
    sql_utils = frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return sql_utils.explainString(frame._jdf.queryExecution(), "formatted")


FORBIDDEN = r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|MapInPandas|FlatMapGroups"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_hold_no_cross_join_and_no_python(spark, name):
    assert not re.search(FORBIDDEN, plan(QUERIES[name](spark, SMALL)))


def test_scans_read_what_they_need(stored, no_names):
    log = stored.table("opportunity_ingestion")
    text = formatted(errors.feed_ingestion_error_trend(log, AS_OF))
    assert "GreaterThanOrEqual(ingestion_date" in text and "LessThan(ingestion_date" in text
    assert "total_future_opportunities" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    text = formatted(decline.dataset_future_decline_trend(log, AS_OF))
    assert "EqualTo(status,COMPLETE)" in text
    text = formatted(public.opportunities(stored.table("active_opportunities_summary"), PublicFilter(district=("D1",))))
    assert "EqualTo(district_code,D1)" in text


def test_the_orphan_evidence_shares_one_scan(spark, stored):
    frame = orphans.missing_parents(stored.table("opportunities"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(frame)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
    # The rank filters work before the shuffle too.
    assert len(re.findall(r"WindowGroupLimit.*Partial", text)) == 2


def test_stalls_read_the_log_once_for_days(spark, stored, no_names):
    frame = stalls.single_feed_stalls(stored.table("opportunity_ingestion"), *no_names, AS_OF)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(frame)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # Feed days and the log's first day: each is scanned for once only.
    assert text.count("FileScan") == 2


def test_history_monitors_scan_the_log_once(spark, stored, no_names):
    """A monitor reads the log once for its days; the four trends of the tiles share that read."""
    log = stored.table("opportunity_ingestion")
    frames = {
        "errors": (errors.feed_ingestion_errors(log, *no_names, AS_OF), 2),  # the texts of one day's failures
        "error trend": (errors.feed_ingestion_error_trend(log, AS_OF), 1),
        "decline": (decline.dataset_future_decline(log, no_names[1], AS_OF), 1),
        "decline trend": (decline.dataset_future_decline_trend(log, AS_OF), 1),
        "stall trend": (stalls.single_feed_stall_trend(log, AS_OF), 2),
        "tiles": (estate.history_tiles(log, AS_OF), 2),  # with the log's first day
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scans = {name: plan(frame).count("FileScan") for name, (frame, _) in frames.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scans == {name: expected for name, (_, expected) in frames.items()}


def test_summaries_areas_and_growth_scan_once(spark, stored, no_names):
    rows = stored.table("active_opportunities_summary")
    log, crawls = stored.table("opportunity_ingestion"), stored.table("feed_ingestion")
    runs = table(spark, "insight_run_summary", [])
    frames = {
        "public summary": (public.public_summary(rows, runs), 1),
        "areas": (public.areas(rows), 1),
        "area tree": (public.area_tree(public.areas(rows, socio_data=table(spark, "socio_data", []))), 1),
        # Each log once for its datasets' months, once for its days alone.
        "growth": (growth.ecosystem_growth(crawls, log, AS_OF), 4),
        "growth datasets": (growth.ecosystem_growth_datasets(crawls, log, no_names[1], AS_OF), 4),
    }
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scans = {name: plan(frame).count("FileScan") for name, (frame, _) in frames.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scans == {name: expected for name, (_, expected) in frames.items()}


def test_the_log_is_not_sorted_before_it_is_reduced(spark, stored, no_names):
    log = stored.table("opportunity_ingestion")
    frames = [
        errors.feed_ingestion_errors(log, *no_names, AS_OF), errors.feed_ingestion_error_trend(log, AS_OF),
        decline.dataset_future_decline(log, no_names[1], AS_OF), decline.dataset_future_decline_trend(log, AS_OF),
    ]
    # As for tables of size: the failed runs at a day's latest instant are found by a shuffled join.
    shuffled = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in shuffled}
    for key, value in shuffled.items():
        spark.conf.set(key, value)
    try:
        texts = [plan(frame).split("\n") for frame in frames]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    for lines in texts:
        scans = [i for i, line in enumerate(lines) if "FileScan" in line]
        assert scans
        for i in scans:
            while "Exchange" not in lines[i]:
                assert "Sort" not in lines[i], lines[i]
                i -= 1


def test_unknown_tables_are_refused(stored):
    with pytest.raises(KeyError, match="unknown table"):
        stored.table("nothing")


def test_the_entry_does_without_what_cannot_be_imported():
    """A package that the training-data operators need is missing: the other queries are still there."""
    code = (
        "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; "
        "q = e.queries(); assert 'orphaned_children' in q and e.oracle_sql().keys() == q.keys(), q.keys()"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stderr == ""
