import pytest
from pyspark.sql import functions as F

from tidewatch.functions import jsontext, text
from tidewatch.operators.filters import PublicFilter, clean_values


def values(spark, inputs, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.x for r in rows.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_slug(spark):
    names = {
        "Rowing (Novice)": "rowing-novice",
        "\tkm/h, max. 30\n": "km-h-max-30",
        "++a++B++": "a-b",
        "Größe ÅÉ ٣": "größe-åé-٣",
        "_under_score_": "under-score",
        None: "unknown", "\n": "unknown", "?": "unknown", "—§—": "unknown",
    }
    assert values(spark, names, text.slug) == list(names.values())
    assert values(spark, [None, "A b"], text.publisher_id) == ["pub_unknown", "pub_a-b"]


def test_blank_covers_unicode_space(spark):
    assert values(spark, [None, "", " \t\n", "  ", " x"], text.not_blank) == [False] * 4 + [True]
    assert values(spark, ["  a b\t"], text.strip) == ["a b"]


def test_display_names(spark):
    rows = spark.createDataFrame(
        [
            ("https://Data.Example.com/x/", "Stored"), ("https://Data.Example.com/x/", " "),
            ("not a url", None), ("https://h.example/", None),
        ],
        "url string, name string",
    )
    shown = rows.select(text.dataset_display_name(F.col("url"), F.col("name"))).collect()
    assert [r[0] for r in shown] == ["Stored", "data.example.com", "not a url", "h.example"]
    feeds = spark.createDataFrame(
        [
            ("a", "https://h.example/feeds/session-series?x=1"), ("b", "https://h.example/feeds/slots/ /"),
            ("c", "https://h.example/"), ("d", None), ("e", "  "), ("f", "feeds/local?x=1"),
        ],
        "id string, url string",
    )
    shown = feeds.select(text.feed_display_name(F.col("id"), F.col("url"))).collect()
    assert [r[0] for r in shown][0] == "session-series"
    assert [r[0] for r in shown][2:] == ["c", "d", "e", "local?x=1"]


def test_json_scalars_keep_only_scalars(spark):
    inputs = ['["a", 1, true, null, {"x": 1}, ["y"], ""]', "[]", " [\"b\"] ", '{"a":1}', "oops", "[1,", None]
    assert values(spark, inputs, jsontext.json_scalars) == [
        ["a", "1", "true", ""], [], ["b"], [], [], [], [],
    ]


def test_json_types_without_parsing(spark):
    inputs = ['"abc"', ' "abc" ', '""', '"a\\"b"', '"\\u0041"', '{"id":"x"}', '["x"]', "null", "12", None]
    assert values(spark, inputs, jsontext.json_string) == [
        "abc", "abc", "", 'a"b', "A", None, None, None, None, None,
    ]
    inputs = [None, "null", " null ", "{}", "{ \n}", '{"a":1}', '"{}"', "[]"]
    assert values(spark, inputs, jsontext.is_empty_json) == [True] * 5 + [False] * 3


def test_safe_casts(spark):
    inputs = ["5", " 7 ", "5.0", "x", "99999999999999999999", None]
    assert values(spark, inputs, jsontext.safe_bigint) == [5, 7, None, None, None, None]
    inputs = ["2026-01-02", "2026-1-2", "2026", "2026-01", "2026-13-01", "2026-01-02T00:00:00", None]
    found = [d and d.isoformat() for d in values(spark, inputs, jsontext.safe_date)]
    assert found == ["2026-01-02", "2026-01-02", None, None, None, None, None]


def test_filter_values():
    assert clean_values([" a ", "a", "", "  ", "b"]) == ["a", "b"]
    assert clean_values(None) == []


@pytest.mark.parametrize(
    "where, binds",
    [
        (PublicFilter(), False),
        (PublicFilter(publisher=(" ",)), False),
        (PublicFilter(district=("D1",)), True),
        (PublicFilter(nhs_trust=("T1",)), True),
        (PublicFilter(nhs_trust=("T1", "All")), False),
        (PublicFilter(nhs_trust=("all",), activity=("Yoga",)), True),
    ],
)
def test_which_filters_bind_values(where, binds):
    assert where.binds_values() is binds


def test_json_strings_must_be_closed(spark):
    cases = {'"a b"': "a b", ' "x" ': "x", '"': None, '"abc': None, '"a" b"': None, '"a\\"b"': 'a"b', '"a\\': None,
             '""': "", "1": None, None: None}
    assert values(spark, cases, jsontext.json_string) == list(cases.values())
