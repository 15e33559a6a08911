"""Benchmark decontamination with one Aho-Corasick automaton over the windows of test questions and answers.

Texts and items are normalised to lower-case words between single blanks. The automaton holds every window of
an item as " word ... word "; one pass over a normalised text yields all occurrences, overlapping ones too. A
text with hits is looked at again to map word numbers to offsets in the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import shared

WINDOW = 10
#: Bytes of item texts for one automaton: windows overlap, so its memory is some hundred times that.
MAX_ITEM_BYTES = 4_000_000
#: Texts held as Python objects at a time.
SLICE = 512
SPAN = "struct<word_start:bigint,word_end:bigint,char_start:bigint,char_end:bigint>"
ROWS = f"id bigint, n_words bigint, n_hit bigint, spans array<{SPAN}>, items array<string>"

#: ASCII other than digits and letters becomes a blank; bytes of longer code points belong to words.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Automaton:
    """The automaton over the windows of (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        windows: dict[str, tuple[int, set[str]]] = {}
        for item_id, text in items:
            words = folded_words(text)
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                key = (b" " + b" ".join(words[i:i + size]) + b" ").decode("latin-1")
                windows.setdefault(key, (size, set()))[1].add(item_id)
        self.machine = ahocorasick.Automaton()
        for key, value in windows.items():
            self.machine.add_word(key, value)
        self.empty = not windows
        if windows:
            self.machine.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, word ranges under occurrences (merged, in order), items that occur."""
        words = folded_words(text)
        if self.empty or not words:
            return len(words), [], set()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        at = count = 0
        for end, (size, found) in self.machine.iter(line):
            count += line.count(" ", at, end)
            at = end
            items |= found
            start, stop = count - size, count
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, stop))
        return len(words), ranges, items


def _automaton(items, window: int) -> Automaton:
    """Built once for each Python worker and broadcast."""
    return shared.kept("decontamination", (items.id, window), lambda: Automaton(items.value, window))


def _item_batches(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> Iterator[shared.Held]:
    """The items in broadcasts of at most about max_bytes; the whole table in one where it fits."""
    items = benchmark.select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), shared.text_or_empty(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // max_bytes))
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part)
        rows = [(r.item, r.text.encode()) for r in own.distinct().collect()]
        yield shared.Held(benchmark.sparkSession.sparkContext.broadcast(rows))


def _char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    places = [m.span() for m in _WORD.finditer(text.decode())]
    return [{"word_start": a, "word_end": b, "char_start": places[a][0], "char_end": places[b - 1][1]}
            for a, b in ranges]


def _scan_rows(texts: DataFrame, items: shared.Held, window: int) -> DataFrame:
    kind = T.StructType.fromDDL(ROWS)
    kind["id"].dataType = texts.schema["id"].dataType
    keyed = "key" in texts.columns
    if keyed:
        kind.add("key", T.LongType())

    schema = shared.arrow_schema(kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(items, window)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            n_words, n_hit, spans, found = [], [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                text = text or b""
                n, ranges, own = machine.scan(text)
                n_words.append(n)
                n_hit.append(sum(b - a for a, b in ranges))
                spans.append(_char_spans(text, ranges) if ranges else [])
                found.append(sorted(own))
            columns = [batch.column("id"), n_words, n_hit, spans, found] + ([batch.column("key")] if keyed else [])
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)],
                schema=schema)

    return texts.mapInArrow(scan, kind)


def scanned_documents(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                      max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit (words inside an occurrence), spans, items (ids, sorted).

    spans are word ranges merged where they touch, with offsets in code points of the original text. Null texts
    and items have no words; an item shorter than a window is one window; items of equal id count once; a null
    item id is the empty string. Equal rows give equal rows, an empty table none, an empty benchmark no hits.
    A benchmark above max_item_bytes is dealt to several automata, each scanning all texts, and their spans are
    united by (id, hash of the text).
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    batches = _item_batches(benchmark, item_col, item_text_col, max_item_bytes)
    first, second = next(batches), next(batches, None)
    if second is None:
        return _scan_rows(texts, first, window)
    keyed = texts.withColumn("key", F.xxhash64("text"))
    whole = None
    for items in (first, second, *batches):
        part = shared.written(_scan_rows(keyed, items, window).dropDuplicates(["id", "key"]), "scan")
        whole = part if whole is None else whole.unionByName(part)
    united = whole.groupBy("id", "key").agg(
        F.first("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).alias("u")
    merged = F.aggregate("spans", F.array().cast(f"array<{SPAN}>"), _merge_step)
    rows = keyed.select("id", "key").alias("k").join(
        united, F.col("k.id").eqNullSafe(F.col("u.id")) & (F.col("k.key") == F.col("u.key"))).select(
        "k.id", "u.n_words", merged.alias("spans"), "u.items")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["word_end"] - s["word_start"])
    return rows.select("id", "n_words", hit.alias("n_hit"), "spans", "items")


def _merge_step(done, span):
    last = F.element_at(done, -1)
    joined = F.struct(
        last["word_start"].alias("word_start"), F.greatest(last["word_end"], span["word_end"]).alias("word_end"),
        last["char_start"].alias("char_start"), F.greatest(last["char_end"], span["char_end"]).alias("char_end"))
    touches = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["word_end"] >= span["word_start"])
    return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
        F.concat(done, F.array(span)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                    item_text_col: str = "text", window: int = WINDOW,
                    max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns."""
    shared.prepare(docs.sparkSession)
    for items in _item_batches(benchmark, item_col, item_text_col, max_item_bytes):
        docs = docs.where(_is_clean(items, window)(F.col(text_col).cast("string")))
    return docs


def _is_clean(items: shared.Held, window: int):
    @F.arrow_udf(T.BooleanType())
    def is_clean(texts: pa.Array) -> pa.Array:
        machine = _automaton(items, window)
        parts = (texts.slice(at, SLICE).cast(pa.binary()).to_pylist() for at in range(0, len(texts), SLICE))
        return pa.array([not machine.scan(t or b"")[1] for part in parts for t in part], pa.bool_())

    return is_clean
