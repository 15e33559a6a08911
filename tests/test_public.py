import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import table
from tidewatch.operators.filters import PublicFilter
from tidewatch.operators.paging import SortKey, page, page_after, records_page
from tidewatch.plans import public

TODAY = dt.date(2026, 9, 1)


def summary_row(publisher="P", labels=("Yoga",), orgs=("Club",), activity=True, narrow=1, **rest):
    return dict(publisher=publisher, activity_or_facility=json.dumps(list(labels)), is_activity=activity,
                organization_names=json.dumps(list(orgs)), opportunity_count=9, opportunity_count_narrow=narrow, **rest)


@pytest.fixture(scope="module")
def summary(spark):
    return table(spark, "active_opportunities_summary", [
        summary_row("b", ("Yoga", None, {"x": 1}), ("Club",), country_name="England", country_code="E9",
                    region_name="South", region_code="R1", district_name="Dover", district_code="D1",
                    nhstrust_name="Trust", nhstrust_code="T1"),
        summary_row("B", ("Pilates",), ("Gym", "Club"), narrow=4, country_name="England", country_code="E1",
                    region_name="South", region_code="R1", district_name="deal", district_code="D2",
                    nhstrust_name="trust", nhstrust_code=None),
        summary_row("a", ("Pitch", "Yoga"), (), activity=False, narrow=5, country_name="Wales", country_code="W1",
                    region_name=" ", district_name="Cardiff", district_code="D3", nhstrust_name="Trust",
                    nhstrust_code="T2"),
        summary_row("a", ("Pitch",), activity=False, country_name="Wales", country_code="W1",
                    region_name="North", region_code="R2", district_name="Bangor", district_code="D4"),
        summary_row(None, ("Hall",), activity=None, country_name="Wales"),
    ]).cache()


def test_public_summary(spark, summary):
    runs = table(spark, "insight_run_summary", [
        dict(run_date=dt.datetime(2026, 8, 1)), dict(run_date=dt.datetime(2026, 8, 9)),
    ])
    s = public.public_summary(summary, runs).collect()[0]
    assert (s.number_of_opportunities, s.number_of_facilities, s.number_of_publishers) == (12, 6, 3)
    assert (s.number_of_activities, s.number_of_facility_types, s.number_of_activity_providers) == (2, 2, 2)
    assert s.percentage_of_local_authorities == 74 and s.date == dt.datetime(2026, 8, 9)


def test_filters(summary):
    def hits(**where):
        rows = public.opportunities(summary, PublicFilter(**where)).collect()
        return sorted((r.publisher or "", r.district_code or "") for r in rows)

    assert len(hits()) == 5
    assert hits(district=("D1",), region=("R2",)) == [("a", "D4"), ("b", "D1")]
    assert hits(district=("D1",), country=("W1",), publisher=("a",)) == [("a", "D3"), ("a", "D4")]
    assert hits(activity=("Yoga", "nothing")) == [("a", "D3"), ("b", "D1")]
    assert hits(activity=("x",)) == []
    assert hits(organization=("Gym",)) == [("B", "D2")]
    assert hits(nhs_trust=("T1", "T2")) == [("a", "D3"), ("b", "D1")] == hits(nhs_trust=("ALL", "none"))
    assert set(hits(activity=("Yoga",))) <= set(hits(activity=("Yoga", "Pitch")))
    columns = public.opportunities(summary).columns
    assert "opportunity_count" in columns and "opportunity_count_narrow" not in columns
    assert sum(r.opportunity_count for r in public.opportunities(summary).collect()) == 12


def test_lists_ignore_case_in_their_order(summary):
    assert [r.publisher for r in public.publishers(summary).collect()] == ["a", "B", "b"]
    assert [r.activity for r in public.activities(summary).collect()] == ["Hall", "Pilates", "Pitch", "Yoga"]
    assert [tuple(r) for r in public.nhs_trusts(summary).collect()] == [
        ("trust", None), ("Trust", "T1"), ("Trust", "T2"),
    ]
    assert [r.publisher for r in public.publishers(summary, PublicFilter(region=("R1",))).collect()] == ["B", "b"]
    assert [r.activity for r in public.activities(summary, PublicFilter(organization=("Gym",))).collect()] == ["Pilates"]


def test_areas(spark, summary):
    socio = table(spark, "socio_data", [dict(area_code="D1", area_name="Dover", total_population=5)])
    rows = public.areas(summary, socio_data=socio).collect()
    # Wales has a district without a region, so it lists no regions and not their districts either.
    assert [(r.level, r.country_name, r.region_name, r.district_name, r.code) for r in rows] == [
        ("country", "England", None, None, "E1"), ("region", "England", "South", None, "R1"),
        ("district", "England", "South", "deal", "D2"), ("district", "England", "South", "Dover", "D1"),
        ("country", "Wales", None, None, "W1"), ("district", "Wales", None, "Cardiff", "D3"),
    ]
    assert [r.total_population for r in rows] == [None, None, None, 5, None, None]


def test_area_tree(spark, summary):
    socio = table(spark, "socio_data", [dict(area_code="D1", area_name="Dover", total_population=5)])
    england, wales = public.area_tree(public.areas(summary, socio_data=socio)).collect()
    assert (england.country_name, england.country_code, england.districts) == ("England", "E1", None)
    [south] = england.regions
    assert (south.region_name, south.region_code) == ("South", "R1")
    # Nothing is known about D2, so it has no socio at all.
    assert [(d.district_name, d.district_code, d.socio and d.socio.total_population) for d in south.districts] == [
        ("deal", "D2", None), ("Dover", "D1", 5),
    ]
    assert wales.regions is None and [d.district_name for d in wales.districts] == ["Cardiff"]
    plain = public.area_tree(public.areas(summary)).collect()
    assert [r.country_name for r in plain] == ["England", "Wales"] and plain[0].socio is None


def test_areas_of_repeated_and_unmatched_codes(spark, summary):
    socio = table(spark, "socio_data", [
        dict(area_code="E1", area_name="Z", total_population=9), dict(area_code="E1", area_name="A", total_population=7),
        dict(area_code="D1", area_name="Dover"), dict(area_code=None, area_name="nowhere"),
    ])
    rows = public.areas(summary, socio_data=socio).collect()
    assert len(rows) == 6 and [r.total_population for r in rows if r.code == "E1"] == [7]
    england, wales = public.area_tree(public.areas(summary, socio_data=socio)).collect()
    assert (england.socio.area_name, wales.socio) == ("A", None)
    assert [d.socio and d.socio.area_name for d in england.regions[0].districts] == [None, "Dover"]


def test_socio(spark):
    data = table(spark, "socio_data", [dict(area_code=c, area_name=n) for c, n in (("D1", "z"), ("R1", "b"), ("C1", "c"))])
    assert [r.area_code for r in public.socio(data).collect()] == ["R1", "C1", "D1"]
    wanted = PublicFilter(district=("D1",), country=("C1", ""))
    assert [r.area_code for r in public.socio(data, wanted).collect()] == ["C1", "D1"]


def record(id, kind="Event", days=0, publisher="P", district="D", org="Org", activity=None, facility=None, **rest):
    start = dt.datetime(2026, 9, 1) + dt.timedelta(days=days)
    return dict(id=id, feed_id="f", kind=kind, startDate=start, publisher_name=publisher, district_name=district,
                organization_name=org, activity=activity, facility=facility, **rest)


def test_records_and_organizations(spark):
    frame = table(spark, "opportunities", [
        record("3", days=1), record("1"), record("2", kind="Slot", org="slots"), record("4", kind=None, org="kindless"),
        record("5", days=-1, org="past"), record("6", publisher=""), record("7", district=None),
        record("8", days=2, org="", activity='["Yoga"]'), record("9", days=3, org="beta", facility='["Yoga"]'),
    ])
    got = public.opportunity_records(frame, TODAY).collect()
    assert [r.id for r in got] == ["1", "3", "8", "9"] and not got[0].has_more
    two = public.opportunity_records(frame, TODAY, offset=1, limit=2).collect()
    assert [(r.id, r.has_more) for r in two] == [("3", True), ("8", True)]
    assert [r.id for r in public.opportunity_records(frame, TODAY, PublicFilter(activity=("Yoga",))).collect()] == ["8", "9"]
    names = [r.organization for r in public.organizations(frame, TODAY).collect()]
    assert names == ["beta", "kindless", "Org", "slots"]


def test_feed_quality_bridge(spark, summary):
    feeds = table(spark, "feeds", [
        dict(id="1", dataset_url="x", publisher_name="a"), dict(id="2", dataset_url="x", publisher_name="a"),
        dict(id="3", dataset_url="y", publisher_name="b"),
    ])
    rows = table(spark, "feed_quality", [
        dict(feed_id=i, dataset_url=u, dataset_name=n, feed_url=u, last_assessed=dt.datetime(2026, 1, d))
        for i, u, n, d in (("1", "x", "n", 1), ("2", "y", "m", 1), ("3", "z", "k", 2))
    ])

    def urls(where):
        return [r.dataset_url for r in public.feed_quality(rows, feeds, summary, where).collect()]

    assert urls(PublicFilter()) == ["z", "y", "x"]
    assert urls(PublicFilter(nhs_trust=("all",))) == ["z", "y", "x"]
    assert urls(PublicFilter(country=("W1",))) == ["x"]
    assert urls(PublicFilter(activity=("nothing",))) == []


def test_pages(spark):
    numbers = spark.range(2500).select(F.col("id").alias("n"))
    order = [F.asc("n")]
    assert [r.n for r in page(numbers, order, 3, 2).collect()] == [4, 5]
    assert page(numbers, order, 1, 9999).count() == 2500 and page(numbers, order).count() == 500
    assert page(numbers, order, 99).count() == 0
    many = records_page(numbers, order, 5, 999).collect()
    assert len(many) == 999 and many[0].n == 5 and many[0].has_more
    for call in (lambda: page(numbers, order, 0), lambda: page(numbers, order, 1, 0),
                 lambda: records_page(numbers, order, -1), lambda: records_page(numbers, order, 0, 0)):
        with pytest.raises(ValueError, match="at least"):
            call()
    assert [(r.n, r.has_more) for r in records_page(numbers, order, 2499, 1).collect()] == [(2499, False)]


def test_pages_after_a_key_make_up_the_whole_list(spark):
    rows = [(n % 4 if n % 5 else None, f"k{n:03}" if n % 7 else None, n) for n in range(60)]
    frame = spark.createDataFrame(rows, "a int, b string, n int")
    for keys in (
        (SortKey("a", descending=True, nulls_last=True), SortKey("b"), SortKey("n")),
        (SortKey("a"), SortKey("b", descending=True), SortKey("n", nulls_last=True)),
    ):
        whole = [tuple(r) for r in frame.orderBy(*[k.order() for k in keys]).collect()]
        seen, after = [], None
        while got := [tuple(r) for r in page_after(frame, keys, after, 7).collect()]:
            seen += got
            after = got[-1]
        assert seen == whole
    with pytest.raises(ValueError, match="3 values"):
        page_after(frame, keys, (1, "a"))
    late = page_after(frame, keys, whole[50], 7)
    text = late._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7" in text and "Sort " not in text and "Window" not in text
