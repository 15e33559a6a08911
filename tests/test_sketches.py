"""Approximate distinct counts: near the exact ones, and the same whether merged from parts or read at once."""

import pytest
from pyspark.sql import functions as F

from checks.catalog import Views
from tidewatch.plans import public, quality, sketches

SMALL = "/root/testdata/sf0.001"


def test_merged_parts_equal_one_pass_and_come_near_the_count(spark):
    rows = spark.range(60_000).select((F.col("id") % 30).alias("day"), F.concat(F.lit("v"), F.col("id") % 20_011).alias("v"))
    days = sketches.value_sketches(rows, {"n": F.col("v")}, ["day"])
    merged = sketches.estimated(sketches.merged_sketches(days, ["n"]), ["n"]).first().n
    assert merged == sketches.estimated(sketches.value_sketches(rows, {"n": F.col("v")}), ["n"]).first().n
    assert merged == pytest.approx(20_011, rel=0.03)
    weeks = sketches.merged_sketches(days.withColumn("week", F.floor(F.col("day") / 7)), ["n"], ["week"])
    assert sketches.estimated(sketches.merged_sketches(weeks, ["n"]), ["n"]).first().n == merged


def test_nothing_and_nulls(spark):
    none = spark.createDataFrame([(None,), (None,)], "v string")
    for rows in (none, none.limit(0)):
        assert sketches.estimated(sketches.value_sketches(rows, {"n": F.col("v")}), ["n"]).first().n == 0


def test_summaries(spark):
    views = Views(spark, SMALL)
    by_area = sketches.summary_sketches(views.summary, ["country_code"])
    got = sketches.estimated(sketches.merged_sketches(by_area, sketches.SUMMARY_LABELS), sketches.SUMMARY_LABELS).first()
    want = public.public_summary(views.summary, views.insight_runs).first()
    for name in sketches.SUMMARY_LABELS:
        assert got[name] == pytest.approx(want[name], rel=0.03) and want[name] > 0
    got = sketches.estimated(sketches.quality_sketches(views.assessed), sketches.QUALITY_LABELS).first()
    want = quality.quality_summary(views.assessed).first()
    for name in sketches.QUALITY_LABELS:
        assert got[name] == pytest.approx(want[name], rel=0.03) and want[name] > 0
