import pytest
from pyspark.sql import functions as F

from tidewatch.functions.text import strip
from tidewatch.plans.sites import site_mappings
from tidewatch.sources.site_csv import COLUMNS, load_site_mappings, read_headers, site_mappings_from_text


@pytest.fixture
def load(spark, tmp_path):
    def read(text, newline="\n"):
        path = tmp_path / "sites.csv"
        path.write_bytes(text.replace("\n", newline).encode("utf-8"))
        return load_site_mappings(spark, str(path))

    return read


def cell(text):
    return '"' + text.replace('"', '""') + '"'


def test_columns_are_found_by_name(load):
    row = load("match_method,new_column, SITE_ID ,distance_metres,match_method\nname,x,42,7.5,other").collect()[0]
    assert (row.site_id, row.match_method, row.distance_metres) == ("42", "name", 7.5)
    assert row.site_name is None and row.oa_publisher_names == [] and row.spatial_match is False
    assert row.asDict().keys() == COLUMNS.keys()


def test_a_missing_id_column_is_an_error(load):
    with pytest.raises(ValueError, match="site_id"):
        load("match_method,site_lat\nspatial,1.5")


def test_a_folder_of_files_with_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("site_id,match_method,site_lat\n1,name,5\n2,spatial,6\n")
    (tmp_path / "b.csv").write_text("site_lat,SITE_ID,extra\n7,3,x\n")
    (tmp_path / "c.csv").write_text("site_id,match_method,site_lat\n4,postcode,8\n")
    got = load_site_mappings(spark, str(tmp_path)).select("site_id", "match_method", "site_lat").orderBy("site_id")
    assert [tuple(r) for r in got.collect()] == [
        ("1", "name", 5.0), ("2", "spatial", 6.0), ("3", None, 7.0), ("4", "postcode", 8.0),
    ]
    (tmp_path / "d.csv").write_text("match_method\nname\n")
    with pytest.raises(ValueError, match="site_id"):
        load_site_mappings(spark, str(tmp_path))


def test_headers_are_read_from_the_beginning_of_files(spark, tmp_path):
    rows = "".join(f"{n},name,{'x' * 200}\n" for n in range(60_000))
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("\nsite_id,match_method,site_name\n" + rows)
    context = spark.sparkContext
    context.setJobGroup("headers", "headers")
    try:
        headers = read_headers(spark, str(tmp_path))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in tracker.getJobIdsForGroup("headers") for s in tracker.getJobInfo(job).stageIds}
    read = sum(store.lastStageAttempt(s).inputBytes() for s in stages)
    assert len(headers) == 2 and set(headers.values()) == {"site_id,match_method,site_name"}
    assert 0 < read < 0.2 * 2 * len(rows)
    given = {file: header for file, header in headers.items() if file.endswith("a.csv")}
    assert load_site_mappings(spark, str(tmp_path), given).count() == 60_000


def test_blank_cells_are_null_or_empty(load):
    names = list(COLUMNS)
    row = load(",".join(names) + "\n7" + "," * (len(names) - 1)).collect()[0].asDict()
    assert row.pop("site_id") == "7"
    assert all(value in (None, [], False) for value in row.values())
    assert row["site_lat"] is None and row["oa_opportunity_count"] is None and row["oa_kinds"] == []


def test_numbers_and_flags(load):
    text = "site_id,site_lat,ap_facility_count,oa_opportunity_count,spatial_match\n"
    text += "1,-0.5e1, 7 ,5000000000,True\n2,1.5d,7.0,x,true\n3,n/a,99999999999,,yes\n4,.5,+3,-2,False\n"
    got = [tuple(r) for r in load(text).select(
        "site_id", "site_lat", "ap_facility_count", "oa_opportunity_count", "spatial_match"
    ).orderBy("site_id").collect()]
    assert got == [
        ("1", -5.0, 7, 5_000_000_000, True), ("2", None, None, None, True),
        ("3", None, None, None, False), ("4", 0.5, 3, -2, False),
    ]


def test_lists(load):
    first = '{"door":"left|right|both","floor":-2,  "lift":false}'
    second = '{"seats":80}'
    awkward = '{"sign":"say \\"no|yes\\" twice"}'
    text = "site_id,oa_location_names,oa_location_json\n"
    text += f"1,|Velodrome ||  Ice rink,{cell(first + '|' + second)}\n2,|,{cell(awkward)}\n3,,\n"
    got = load(text).orderBy("site_id").collect()
    assert got[0].oa_location_names == ["Velodrome", "Ice rink"]
    assert got[0].oa_location_json == [first, second]
    assert got[1].oa_location_names == [] and got[1].oa_location_json == [awkward]
    assert got[2].oa_location_json == []


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_file_shape(load, newline):
    text = "﻿site_id,oa_location_names,match_method\n"
    text += '1,"Track, north gate\n""Shed"" 9\nring twice",spatial\n\n,no id,name\n2,Pool\n'
    got = load(text, newline).orderBy("site_id").collect()
    assert [r.site_id for r in got] == ["1", "2"]
    assert got[0].oa_location_names[0].replace("\r\n", "\n") == 'Track, north gate\n"Shed" 9\nring twice'
    assert got[0].match_method == "spatial" and got[1].match_method is None


@pytest.mark.parametrize("text", ["", "site_id,match_method", "site_id,match_method\n\n"])
def test_files_without_rows(load, text):
    assert load(text).count() == 0


def test_filters_and_order(load):
    text = "site_id,site_name,local_authority_code,oa_publisher_names,oa_location_json,distance_metres,match_method\n"
    text += "\n".join([
        "2,Beta,E2,Amy|Bob,{2},5,Name", "1,Beta,E1,Bob,{9},,spatial", "1,Beta,e1,Cid,{1},30,NAME",
        "1,Beta,E1,Cid,{0},30,name", "9,,E9,Amy,{5},1,", "5,Alpha,,amy,{1},9,Spatial",
    ])
    pairs = load(text).cache()

    def ids(**filters):
        return [(r.site_id, r.oa_location_json[0]) for r in site_mappings(pairs, **filters).collect()]

    everything = ids()
    assert everything == [("9", "{5}"), ("5", "{1}"), ("1", "{0}"), ("1", "{1}"), ("1", "{9}"), ("2", "{2}")]
    assert ids(publishers=["Amy"]) == [("9", "{5}"), ("2", "{2}")]
    assert ids(publishers=["Amy", "Bob"]) == [("9", "{5}"), ("1", "{9}"), ("2", "{2}")]
    assert ids(local_authority_codes=["e1"]) == [("1", "{0}"), ("1", "{1}"), ("1", "{9}")]
    assert ids(match_methods=["SPATIAL"], site_ids=["1", " "]) == [("1", "{9}")]
    assert ids(site_ids=["01"]) == []
    pairs.unpersist()


def test_pairs_are_read_once_for_the_sort(spark):
    rows = spark.createDataFrame([("1", " Beta ", "Amy | |Bob|")], "site_id string, site_name string, oa_publisher_names string")
    found = site_mappings(site_mappings_from_text(rows))
    assert found.columns == list(COLUMNS)
    assert [(r.site_name, r.oa_publisher_names) for r in found.collect()] == [(" Beta ", ["Amy", "Bob"])]
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    ranges = next(i for i, line in enumerate(lines) if "Exchange rangepartitioning" in line)
    assert "Exchange hashpartitioning" in lines[ranges + 1]


def test_list_items_lose_the_white_space_that_the_pattern_names(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF and c not in (0x22, 0x7C)]
    texts = spark.createDataFrame([(f"{chr(c)} x{chr(c)}y {chr(c)}",) for c in codes], "t string")
    differing = texts.where(strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))
    assert differing.count() == 0
