"""Language fusion against plain formulas, the sample's bounds, and the whole pipeline on planted cases."""

import collections
import math

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tidewatch.llm import language

LEAN = language.LEAN
WORDS = {
    "aa": "the house near river was old and stood with trees", "bb": "das haus steht nahe dem fluss und war sehr alt",
    "cc": "la maison pres de la riviere etait vieille avec des arbres",
}


def plain_fusion(rows, model):
    """(text, host, domain, suffix, declared) rows to (language, confidence), one by one from all the others."""
    labels, n = model.labels, len(model.labels)
    classes = [*labels, "?"]
    scores = [model.scores(r[0]).tolist() for r in rows]
    said = [None if r[4] is None else r[4] if r[4] in labels else "?" for r in rows]
    live = [i for i, s in enumerate(scores) if s[0] > 0]

    def others(i, test):
        """Number and summed posteriors of the other rows with letters that pass the test."""
        own = [j for j in live if j != i and test(j)]
        return len(own), [sum(scores[j][n + 1 + k] for j in own) for k in range(n)]

    out = []
    for i, (_, host, domain, suffix, _) in enumerate(rows):
        if scores[i][0] == 0:
            out.append(("und", 0.0))
            continue
        count, everything = others(i, lambda j: True)
        logs = []
        for k in range(n):
            base = (everything[k] + LEAN / n) / (count + LEAN)
            m, sums = others(i, lambda j: domain is not None and rows[j][2] == domain)
            prior = (sums[k] + LEAN * base) / (m + LEAN)
            m, sums = others(i, lambda j: host is not None and rows[j][1] == host)
            prior = (sums[k] + LEAN * prior) / (m + LEAN)
            weight = 1.0
            if suffix is not None:
                m, sums = others(i, lambda j: rows[j][3] == suffix)
                weight = (sums[k] + LEAN * base) / (m + LEAN) / base
            if said[i] is not None:
                sums = others(i, lambda j: said[j] == said[i])[1]
                weight *= (sums[k] + LEAN / len(classes)) / (everything[k] + LEAN)
            logs.append(scores[i][k + 1] + math.log(prior) + math.log(weight))
        power = [math.exp(x - max(logs)) for x in logs]
        best = power.index(max(power))
        out.append((labels[best], power[best] / sum(power)))
    return out


def test_fusion_equals_plain_formulas(spark, documents):
    train = documents([(i, WORDS[x] + f" {i}", x, None) for i, x in enumerate(list(WORDS) * 30)])
    model = language.trained(train)
    texts = [w for x in WORDS.values() for w in x.split()[:4]] + ["haus near la", "", None, "12 34", "zzz"]
    rows = [
        (texts[i % len(texts)], (None, "a.x.uk", "b.x.uk", "c.de")[i % 4], (None, "x.uk", "x.uk", "c.de")[i % 4],
         (None, "uk", "de")[i % 3], (None, "aa", "bb", "zz", "aa")[i % 5]) for i in range(70)
    ]
    frame = spark.createDataFrame(
        [(i, *r, "x") for i, r in enumerate(rows)], "n int, text string, h string, d string, s string, said string, language string")
    got = language.identified(
        frame, model, text_col="text", host=F.col("h"), domain=F.col("d"), suffix=F.col("s"), declared=F.col("said"),
        names=("found", "confidence"), keep=("n", "language"))
    assert got.columns == ["n", "language", "found", "confidence"]
    got = {r.n: r for r in got.collect()}
    for i, (label, share) in enumerate(plain_fusion(rows, model)):
        assert got[i].found == label and got[i].confidence == pytest.approx(share, abs=1e-6)


def test_the_sample_has_about_so_many_rows_a_label(spark, documents):
    rows = [(i, f"{WORDS['aa']} {i}", "aa", None) for i in range(3000)] + [(i, f"{WORDS['bb']} {i}", "bb", None) for i in range(7)]
    slim = documents(rows).select(
        F.col("lang").alias("label"), F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("hash"))
    ends = {r.label: r.stop for r in language._sample_ends(slim, 50).collect()}
    taken = collections.Counter(r.label for r in slim.collect() if r["hash"] < ends[r.label])
    assert taken == {"aa": 50, "bb": 7}
    plan = language._sample_ends(slim, 50)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    same = documents([(None, "one text", "aa", None)] * 400 + [(1, "other text", "bb", None)])
    assert language.trained(same, per_label=10).labels == ["aa", "bb"]


def test_page_evidence(spark):
    pages = [
        ("http://a.b.co.uk/x", '<html data-lang="fr" lang="en">', ("a.b.co.uk", "b.co.uk", "co.uk", "en")),
        ("http://www.example.de", '<html data-lang="fr"><meta http-equiv="Content-Language" content="DE-at">', ("www.example.de", "example.de", "de", "de")),
        ("http://1.2.3.4/", "<p lang=xx>", ("1.2.3.4", None, None, None)),
        ("https://co.uk/", "<HTML LANG=es-MX>", ("co.uk", "co.uk", "uk", "es")),
        (None, None, (None, None, None, None)),
    ]
    frame = spark.createDataFrame([p[:2] for p in pages], "url string, html string")
    evidence = language.page_evidence(F.col("url"), F.col("html"))
    got = frame.select(*(c.alias(n) for n, c in evidence.items())).collect()
    assert [tuple(r) for r in got] == [p[2] for p in pages]


def test_the_whole_pipeline(spark, tmp_path):
    """Planted copies and benchmark passages go, clean documents stay, null ids come through all five stages."""
    small = "/root/testdata/sf0.001"
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    item = max((r.text for r in benchmark.collect()), key=len)
    kept_by = {
        name: {r.doc_id for r in stage.collect()} for name, stage in (
            ("language", corpus_pipeline.identify_language(spark, docs, small)),
            ("clean", corpus_pipeline.decontaminate(spark, docs, small)))
    }
    alone = {r[0] for r in brute.groups([(r.doc_id, r.text) for r in docs.collect()], 5) if r[3]}
    clean = sorted(kept_by["language"] & kept_by["clean"] & alone)
    texts = {r.doc_id: r for r in docs.collect()}
    model = next(texts[d] for d in clean if len(texts[d].text.split()) > 80)
    words = model.text.split()
    planted = [
        (900_001, model.text), (900_002, " ".join(words[:-2] + ["changed", "end"])), (900_003, f"{' '.join(words[::-1])} {item}"),
        (900_004, None), (900_005, ""), (None, " ".join(words[1::2] + words[::2])),
    ]
    rows = [tuple(r) for r in docs.collect()] + [(d, t, model.lang, model.source, len(t or "")) for d, t in planted]
    spark.createDataFrame(rows, docs.schema).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    found = collections.Counter(r.doc_id for r in got)
    assert not {900_001, 900_002, 900_003, 900_004, 900_005} & found.keys()
    assert found.keys() - {None} <= kept_by["clean"] and max(found.values()) <= 3
    everything = {**{d: t.text for d, t in texts.items()}, None: planted[-1][1]}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: brute.tokens([(0, t)], tokenizer)[0][2:] for d, t in everything.items() if d in found}
    assert all((r.n_tokens, r.ids_crc32) == want[r.doc_id] for r in got)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens

    # what the mix may take is what the first three stages leave: everything clean, the nulls' text too
    sizes, source = collections.Counter(), {**{d: t.source for d, t in texts.items()}, None: model.source}
    taken = collections.Counter()
    for d in clean:
        sizes[source[d]] += len(brute.WORD.findall(everything[d]))
    sizes[model.source] += len(brute.WORD.findall(everything[None]))
    for r in got:
        taken[source[r.doc_id]] += len(brute.WORD.findall(everything[r.doc_id]))
    for name, target in brute.targets(sizes).items():
        longest = max(len(brute.WORD.findall(everything[d])) for d in [*clean, None] if source[d] == name)
        assert abs(taken[name] - target) <= longest
