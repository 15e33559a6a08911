"""Every query over the whole small tables against its plain version."""

import collections
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import listed
from tidewatch.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    def read(table, *columns):
        return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(*columns).collect()]

    return read


@pytest.fixture(scope="module")
def docs(rows):
    return rows("documents", "doc_id", "text")


def result(spark, name, *columns):
    return listed(queries.QUERIES[name](spark, SMALL), *columns)


def same(got, want):
    assert got == sorted(want, key=repr)


def test_languages(spark, rows):
    got = queries.QUERIES["op1_fused_language_id"](spark, SMALL).collect()
    labels, declared = dict(rows("documents", "doc_id", "lang")), dict(rows("pages", "page_id", "html"))
    assert len(got) == len(labels) + len(declared)
    right = sum(r.language == labels[r.doc_id] for r in got if r.doc_id is not None)
    assert right >= 0.98 * len(labels)
    pages = [r for r in got if r.page_id is not None]
    assert sum(f'lang="{r.language}"' in declared[r.page_id][:60] for r in pages) >= 0.98 * len(pages)
    assert sum(r.kept for r in got) >= 0.98 * len(got)


def test_shards(spark, docs):
    got = queries.QUERIES["op2_sampled_splitter_shards"](spark, SMALL).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= largest


def test_contamination(spark, rows, docs):
    same(result(spark, "op3_benchmark_automaton", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"),
         brute.contamination(docs, rows("benchmark", "item_id", "text")))


def test_tokens(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    same(result(spark, "op4_elias_fano_tokens", "doc_id", "start", "n_tokens", "ids_crc32"), brute.tokens(docs, tokenizer))


def test_conversations(spark, rows):
    own = rows("conversations", "conv_id", "turn", "role", "text")
    own += [(-7, 0, "user", queries.EXTRA_TEXT), (-7, 1, "assistant", queries.EXTRA_TEXT)]
    same(result(spark, "op5_offset_masks", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"),
         brute.conversations(own))


def test_quality(spark, docs):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(result(spark, "op6_line_first_quality", *columns), brute.quality(docs))


def test_near_duplicates(spark, docs):
    same(result(spark, "op7_hyperminhash_dedup", "doc_id", "n_shingles", "component_id", "kept"), brute.groups(docs, 4))


def test_secrets(spark, docs):
    same(result(spark, "op8_secret_blob_ledger", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"),
         brute.secrets(docs))


def test_mix(spark, rows):
    own = rows("documents", "doc_id", "text", "source")
    size = {d: len(brute.WORD.findall(t or "")) for d, t, _ in own}
    source = {d: s for d, _, s in own}
    sums = collections.Counter()
    for d, s in source.items():
        sums[s] += size[d]
    want, taken = brute.targets(sums), collections.Counter()
    got = queries.QUERIES["op9_hash_threshold_mix"](spark, SMALL).collect()
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], sums[source[r.doc_id]])
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    largest = {s: max(size[d] for d in size if source[d] == s) for s in sums}
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 for s in sums)
    again = queries.QUERIES["op9_hash_threshold_mix"](spark, SMALL)
    assert listed(again, "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in got), key=repr)


def test_archive(spark, rows):
    same(result(spark, "op10_warc_archive", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
         brute.archive(rows("pages", "page_id", "html")))
