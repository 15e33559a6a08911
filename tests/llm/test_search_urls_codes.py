"""Ranked search, URL templates and vector codes: whole small tables, edges, and the parts of their methods."""

import dataclasses
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tests.llm.conftest import EDGE_TEXTS, listed
from tidewatch.llm import lexical_search, path_templates, queries, vector_codes

SMALL = "/root/testdata/sf0.001"


def same(got, want):
    assert got == sorted(want, key=repr)


def small(spark, table, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(*columns).collect()]


# ranked search

def test_ranked_query(spark):
    same(listed(queries.op11_interval_ranked_search(spark, SMALL), "item_id", "rank", "doc_id", "score"),
         brute.ranked(small(spark, "documents", "doc_id", "text"), small(spark, "benchmark", "item_id", "text")))


DOCS = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "one two"), (None, "one two"), (3, "one"), (99, "one two"), (98, "one two")]
ITEMS = [(1, "One two, three"), (1, "VU \U0001f600"), (2, None), (3, ""), (None, "same words"), (4, "word " * 9), (4, "word"), (5, "unheard")]


@pytest.mark.parametrize("item_bytes", [10**6, 20])
def test_ranked_edges(spark, documents, item_bytes):
    docs = documents(DOCS, "1 as rank;'x' as item;2 as id;3 as score;4 as place;5 as terms;'g' as group")
    items = spark.createDataFrame([(*i, "x", 1) for i in ITEMS], "item_id long, text string, id string, rank int")
    for most in (2, 50):
        got = lexical_search.ranked_documents(docs, items, most=most, item_bytes=item_bytes)
        same(listed(got, "item", "rank", "id", "score"), brute.ranked(DOCS, ITEMS, most))
    assert lexical_search.ranked_documents(docs.limit(0), items, item_bytes=item_bytes).count() == 0
    assert lexical_search.ranked_documents(docs, items.limit(0)).count() == 0


def test_ranked_over_many_blocks_with_ties(documents, spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 40)
    monkeypatch.setattr(lexical_search, "TAKEN", 3)
    rng = np.random.default_rng(5)
    rows = [(int(i), " ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 12)))) for i in rng.permutation(600)]
    rows += [(1000 - i, "w1 w2 w1") for i in range(200)]
    asked = [(k, " ".join(f"w{x}" for x in rng.zipf(1.6, 6))) for k in range(12)]
    got = lexical_search.ranked_documents(documents(rows), spark.createDataFrame(asked, "item_id long, text string"))
    same(listed(got, "item", "rank", "id", "score"), brute.ranked(rows, asked))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.data())
def test_range_maxima(values, data):
    maxima = lexical_search.RangeMaxima(np.array(values, np.int64), len(values))
    start = data.draw(st.integers(0, len(values)))
    stop = data.draw(st.integers(start, len(values)))
    [place], [value] = maxima.largest(np.array([[start]]), np.array([[stop]]))
    own = values[start:stop]
    assert value[0] == max(own, default=0)
    assert not own or place[0] == start + own.index(max(own))


def test_search_scores_few_documents():
    """Where one document stands out, hardly any other is scored."""
    n = 4000
    docs = np.repeat(np.arange(n), 2)
    terms, impacts = np.tile([0, 1], n), np.tile([3, 2], n)
    impacts[2 * 1234:2 * 1234 + 2] = 50
    best = lexical_search.Best(1)
    scored = lexical_search.Block(np.arange(n), docs, terms, impacts).search(np.array([0, 1]), best)
    assert best.ids.tolist() == [1234] and best.scores.tolist() == [100] and scored < 20


def test_impacts_beyond_64_bits():
    value = lexical_search.impacts(np.array([7]), np.array([3]), np.array([10**9]), 10**11, 10**15)
    m = 50 + 50 * 10**9 * 10**11 // 10**15
    assert value.tolist() == [7 * (3_000_000_000 // (3000 + 20 * m))]


# URL filter

def test_url_query(spark):
    same(listed(queries.op12_path_template_filter(spark, SMALL), "page_id", "host", "path", "rule", "verdict", "template"),
         brute.urls(small(spark, "pages", "page_id", "url")))


URLS = [
    None, "", "no host", "://", "http://", "http:///only/path", "HTTP://A.Example.NET/EN/x", "http://example.net/en/",
    "http://net", "http://net/", "http://x.net?q=/", "http://x.net#/", "http://sub.example.com/de/1?x#y", "http://notexample.com/de/1",
    "ftp://u@Org:80/fr/1", "http://org/fr/", "http://org/fr", "http://ÀB.org/fr/é/1", "a://b://c/d://e", "http://net/" + "a/" * 5000,
    "http://spam.example.org/" + "/".join(str(i) for i in range(40)), "http://x.org/deadbeef01/0123456789/abc-12-def/\nline?",
]


def test_url_edges(spark):
    rows = [(i, u) for i, u in enumerate(URLS * 2)] + [(None, "http://x.org/1"), (1, None)]
    rows += [(100 + i, f"http://shop.example.com/{'de' if i % 3 else 'en'}/item-{i}/{i * 7919:016x}") for i in range(60)]
    rows += [(200 + i, f"http://ads.example.org/{'fr' if i % 2 else 'es'}/{i}.html") for i in range(60)]
    pages = spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows], "page_id long, url string, host string, n int, node int").selectExpr(
        "*", "'q' as segments", "3 as label", "true as bad", "'t' as rule")
    same(listed(path_templates.judged_urls(pages), "id", "host", "path", "rule", "verdict", "template"), brute.urls(rows))
    assert path_templates.judged_urls(pages.limit(0)).count() == 0


def test_url_templates_reject_by_purity(spark):
    """Pages of a template follow its labels, whether or not they have one themselves."""
    rows = [(i, f"http://h.org/{'promo' if i % 2 else 'post'}/{i}", i % 2 == 1 if i < 60 else None) for i in range(100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, is_bad boolean")
    found = path_templates.judged_urls(pages, bad_label=pages["is_bad"]).collect()
    assert {(r.template, r.verdict) for r in found} == {("/post/{n}", "allow"), ("/promo/{n}", "block")}
    none = path_templates.judged_urls(pages, bad_label=pages["is_bad"] & False).collect()
    assert {(r.template, r.verdict) for r in none} == {("/(post|promo)/{n}", "allow")}
    with pytest.raises(ValueError):
        path_templates.path_templates(pages, dataclasses.replace(path_templates.TreeSettings(), min_share=0))


# vector codes

def test_code_query(spark):
    same(listed(queries.op13_gnat_vector_codes(spark, SMALL), "vec_id", "code", "error", "label_error", "codebooks_sha256"),
         brute.codes(small(spark, "embeddings", "vec_id", "embedding", "label")))


def vectors(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, id string, v int").repartition(3)


def test_code_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 16) / 4).tolist(), None if i % 3 else i % 2) for i in range(80)]
    rows += [(7, rows[7][1], 0), (None, rows[8][1], None), (None, rows[9][1], 1), (200, None, 1)]
    for odd in (None, math.nan, math.inf, -math.inf):
        rows.append((-5, [odd] + [0.0] * 15, 1))
    columns = ("id", "code", "error", "label_error", "codebooks_sha256")
    same(listed(vector_codes.compressed_vectors(vectors(spark, rows)), *columns), brute.codes(rows))
    few = rows[:5]
    same(listed(vector_codes.compressed_vectors(vectors(spark, few)), *columns), brute.codes(few))
    assert vector_codes.compressed_vectors(vectors(spark, rows).limit(0)).count() == 0
    big = [(i, [float(i % 7) * 1e9] * 8, 1) for i in range(30)]
    same(listed(vector_codes.compressed_vectors(vectors(spark, big)), "id", "code"), [r[:2] for r in brute.codes(big)])
    for bad in ([(1, [0.0] * 9, 1)], [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [1e300] * 8, 1)]):
        with pytest.raises(ValueError):
            vector_codes.compressed_vectors(vectors(spark, bad))


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 4), st.sampled_from([1, 3, 50, 2**40]), st.integers(0, 10**6))
def test_gnat_equals_comparing_with_all(n, width, scale, seed):
    rng = np.random.default_rng(seed)
    entries, asked = rng.integers(-scale, scale + 1, (n, width)), rng.integers(-scale, scale + 1, (50, width))
    if scale > 2**20:
        entries, asked = entries.astype(object), asked.astype(object)
    every = vector_codes.squared_distances(asked, entries)
    index, best, computed = vector_codes.Gnat(entries).nearest(asked)
    assert index.tolist() == every.argmin(axis=1).tolist() and best.tolist() == every.min(axis=1).tolist()
    assert computed <= 50 * n


def test_gnat_drops_subtrees():
    rng = np.random.default_rng(2)
    entries, asked = rng.integers(-1000, 1000, (64, 2)), rng.integers(-1000, 1000, (500, 2))
    assert vector_codes.Gnat(entries).nearest(asked)[2] < 500 * 64 / 2
