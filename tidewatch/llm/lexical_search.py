"""Ranked lexical search: range-maximum sparse tables over posting lists, best-first over intervals of documents.

The first pass reads every text once and keeps, for each document, its length and the counts of the terms that
some item asks for; each task also adds up its documents' frequencies. The second takes these in blocks of
documents. A block has one posting list a term, in document order, with the term's contribution to the score
(its impact) in each document, and over each list a sparse table whose entries name the largest impact of every
stretch of 2^k postings, so the largest impact within any interval of documents is found in two look-ups. The sum
of these maxima bounds the score of every document of the interval. An item starts with the block as one
interval; those with the highest bounds are taken first, and an interval is split at the document that holds its
largest single impact: that document is scored, what is left and right of it gets bounds of its own. Intervals
that can no longer reach the item's last held place are dropped, ties by id included, so the result is exact.
Held places carry over from block to block of a task. Intervals are taken many at a time, which only means that
a few more are looked at than one by one would.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import shared
from tidewatch.llm.decontamination import folded_words

#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 16_384, 1_000_000
#: Intervals taken at a time.
TAKEN = 256
#: Bytes of item texts searched for in one reading of the documents; more items are searched in further readings.
ITEM_BYTES = 8_000_000
#: Groups of tasks whose best documents meet before all of an item's do.
GROUPS = 64
FORWARD = "docs bigint, words bigint, id bigint, length bigint, terms array<int>, counts array<bigint>"
_NULL_ID = -(2**63)


class RangeMaxima:
    """Sparse tables over concatenated lists: the place of the first largest value of any stretch of one list."""

    def __init__(self, values: np.ndarray, longest: int) -> None:
        self.values = values
        n = len(values)
        self.levels = max(1, longest.bit_length())
        self.table = np.empty((self.levels, n), np.int32)
        self.table[0] = np.arange(n)
        for k in range(1, self.levels):
            half = 1 << k - 1
            self.table[k] = self.table[k - 1]
            if n > half:
                left, right = self.table[k - 1, :n - half], self.table[k - 1, half:]
                self.table[k, :n - half] = np.where(values[right] > values[left], right, left)
        self.log = np.zeros(longest + 2, np.int32)
        for k in range(1, self.levels + 1):
            self.log[1 << k:] = k
        self.flat = self.table.ravel()

    def largest(self, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the largest in [start, stop); value 0 where a stretch is empty."""
        places, values = np.zeros(start.shape, np.int64), np.zeros(start.shape, np.int64)
        some = np.flatnonzero(start < stop)  # most lists have nothing in a short interval
        at, end = start.ravel()[some], stop.ravel()[some]
        level = self.log[end - at]
        base = level * len(self.values)
        left, right = self.flat[base + at], self.flat[base + end - (1 << level)]
        one, other = self.values[left], self.values[right]
        places.ravel()[some], values.ravel()[some] = np.where(other > one, right, left), np.maximum(one, other)
        return places, values


class Best:
    """The places of one item held so far: highest score first, then the smallest id, null before all."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        own = scores > 0
        if len(self.scores) == self.most:
            own &= scores >= self.scores[-1]
        if own.any():
            scores, ids = np.concatenate([self.scores, scores[own]]), np.concatenate([self.ids, ids[own]])
            order = np.lexsort((ids, -scores))[:self.most]
            self.scores, self.ids = scores[order], ids[order]

    def may_enter(self, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a document of such a score, with such an id or a larger one, could take a place."""
        if len(self.scores) < self.most:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (ids < self.ids[-1]))


class Block:
    """Posting lists over some documents in order of their ids."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        places = place[docs]
        by_term = np.lexsort((places, terms))
        self.places, terms = places[by_term], terms[by_term]
        self.names, starts = np.unique(terms, return_index=True)
        self.bounds = np.append(starts, len(terms))
        self.maxima = RangeMaxima(impacts[by_term], int(np.diff(self.bounds).max(initial=1)))

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Bring best up to date with this block's documents for an item of these terms; the documents scored."""
        at = np.searchsorted(self.names, terms)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == terms)]
        if not len(at):
            return 0
        taken = self._intervals(np.array([0]), np.array([len(self.ids)]), self.bounds[at][None, :], self.bounds[at + 1][None, :], best)
        waiting = [taken] if len(taken[0]) else []
        scored = 0
        while waiting:
            waiting = [w for w in (self._still(w, best) for w in waiting) if len(w[0])]
            if not waiting:
                break
            joined = [np.concatenate(c) for c in zip(*waiting)]
            if len(joined[0]) > TAKEN:
                first = np.argpartition(-joined[4], TAKEN - 1)
                taken, rest = [c[first[:TAKEN]] for c in joined], [c[first[TAKEN:]] for c in joined]
                waiting = [rest]
            else:
                taken, waiting = joined, []
            scored += len(taken[0])
            low, high, start, stop, _, split = taken
            middle = self._rank(start, stop, split)
            there = (middle < stop) & (self.places[np.minimum(middle, len(self.places) - 1)] == split[:, None])
            scores = np.where(there, self.maxima.values[np.minimum(middle, len(self.places) - 1)], 0).sum(axis=1)
            best.add(scores, self.ids[split])
            after = self._intervals(
                np.concatenate([low, split + 1]), np.concatenate([split, high]),
                np.concatenate([start, middle + there]), np.concatenate([middle, stop]), best)
            if len(after[0]):
                waiting.append(after)
        return scored

    def _still(self, intervals: list[np.ndarray], best: Best) -> list[np.ndarray]:
        own = best.may_enter(intervals[4], self.ids[intervals[0]])
        return intervals if own.all() else [c[own] for c in intervals]

    def _intervals(self, low: np.ndarray, high: np.ndarray, start: np.ndarray, stop: np.ndarray, best: Best) -> list[np.ndarray]:
        """low, high, postings (start, stop), bound and document to split at, of those that may still count."""
        some = np.flatnonzero(low < high)
        low, high, start, stop = low[some], high[some], start[some], stop[some]
        places, values = self.maxima.largest(start, stop)
        bound = values.sum(axis=1)
        own = best.may_enter(bound, self.ids[low]) if len(low) else np.zeros(0, bool)
        most = places[np.arange(len(low)), values.argmax(axis=1)]
        return [c[own] for c in (low, high, start, stop, bound, self.places[most])]

    def _rank(self, start: np.ndarray, stop: np.ndarray, split: np.ndarray) -> np.ndarray:
        """The first posting in [start, stop) at or after the document to split at."""
        out = start.copy()
        some = np.flatnonzero(start < stop)
        low, high, last = start.ravel()[some], stop.ravel()[some], len(self.places) - 1
        wanted = split[some // start.shape[1]]
        for _ in range(int((high - low).max(initial=0)).bit_length()):
            middle = (low + high) >> 1
            before = (low < high) & (self.places[np.minimum(middle, last)] < wanted)
            low, high = np.where(before, middle + 1, low), np.where(before, high, middle)
        out.ravel()[some] = low
        return out


def _item_blocks(items: DataFrame, item_col: str, text_col: str, most_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their terms, in blocks of about most_bytes of text; the texts of one id are one item."""
    own = items.select(F.col(item_col).alias("item"), shared.text_or_empty(text_col).alias("text")).distinct()
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // most_bytes))
    for block in range(blocks):
        terms: dict[object, set[bytes]] = {}
        for row in own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect():
            terms.setdefault(row.item, set()).update(folded_words(row.text.encode()))
        if terms:
            yield [(item, sorted(found)) for item, found in terms.items()]


def forward_index(docs: DataFrame, vocabulary: list[bytes], *, id_col: str, text_col: str) -> DataFrame:
    """A row for each document with wanted terms (id, length, terms, counts) and one for each task's sums.

    The latter have docs: documents with a term, words: their terms in all, terms and counts: how many hold each.
    """
    spark = docs.sparkSession
    shared.prepare(spark)
    held = shared.Held(spark.sparkContext.broadcast(vocabulary))
    schema = shared.arrow_schema(FORWARD)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.kept("lexical_search", held.id, lambda: {w: k for k, w in enumerate(held.value)})
        size = len(number)
        frequency, n_docs, n_words = np.zeros(size + 1, np.int64), 0, 0
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            lengths, found = [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = folded_words(text or b"")
                lengths.append(len(words))
                found.append(np.fromiter(map(number.get, words, repeat(size)), np.int64, len(words)))
            length = np.array(lengths, np.int64)
            n_docs, n_words = n_docs + int((length > 0).sum()), n_words + int(length.sum())
            keys, counts = np.unique(
                np.concatenate(found) + np.repeat(np.arange(len(length)), length) * (size + 1), return_counts=True)
            doc, term = np.divmod(keys, size + 1)
            wanted = term < size
            doc, term, counts = doc[wanted], term[wanted], counts[wanted]
            frequency += np.bincount(term, minlength=size + 1)
            rows, sizes = np.unique(doc, return_counts=True)
            if len(rows):
                offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
                none = pa.nulls(len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, none, batch.column("id").take(pa.array(rows)), pa.array(length[rows]),
                     pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], names=schema.names)
        if n_docs:
            seen = np.flatnonzero(frequency)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(
                    ([n_docs], [n_words], [None], [None], [seen], [frequency[seen]]), schema)], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        read, FORWARD)


def term_weights(forward: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms in all, and each term's weight (0 where no document holds it)."""
    sums = forward.where("docs is not null")
    n_docs, n_words = sums.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    weights = np.zeros(n_terms, np.int64)
    pairs = sums.select(F.explode(F.arrays_zip("terms", "counts")).alias("x"))
    for term, df in pairs.groupBy("x.terms").agg(F.sum("x.counts")).collect():  # a row a term of this block of items
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return n_docs, n_words, weights


def impacts(weight: np.ndarray, count: np.ndarray, length: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """What each posting adds to its document's score, by whole numbers."""
    if len(length) and 50 * int(length.max()) * n_docs >= 2**63:
        share = np.array([50 * int(n) * n_docs // n_words for n in length.tolist()], np.int64)
    else:
        share = 50 * length * n_docs // max(1, n_words)
    return weight * ((1_000_000_000 * count) // (1000 * count + 20 * (100 - 50 + share)))


def _best_of_tasks(forward: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_words: int, most: int) -> DataFrame:
    """(item, group, id, score): each task's best documents for each item, by the item's place in items."""
    spark = forward.sparkSession
    held = shared.Held(spark.sparkContext.broadcast((items, weights)))
    kind = "item int, group int, id bigint, score bigint"
    schema = shared.arrow_schema(kind)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight = held.value
        best = [Best(most) for _ in wanted]

        def searched(parts: list[tuple[np.ndarray, ...]]) -> None:
            ids = np.concatenate([p[0] for p in parts])
            docs = np.repeat(np.arange(len(ids)), np.concatenate([p[2] for p in parts]))
            length, terms, counts = (np.concatenate([p[k] for p in parts]) for k in (1, 3, 4))
            value = impacts(weight[terms], counts, length[docs], n_docs, n_words)
            own = value > 0
            if own.any():
                block = Block(ids, docs[own], terms[own], value[own])
                for places, item in zip(best, wanted):
                    block.search(item, places)

        parts, n_rows, n_postings = [], 0, 0
        for batch in batches:
            ids = batch.column("id").fill_null(_NULL_ID).to_numpy()
            lists = batch.column("terms")
            sizes = np.asarray(lists.value_lengths())
            parts.append((ids, batch.column("length").to_numpy(), sizes, np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten())))
            n_rows, n_postings = n_rows + len(ids), n_postings + int(sizes.sum())
            if n_rows >= BLOCK_DOCS or n_postings >= BLOCK_POSTINGS:
                searched(parts)
                parts, n_rows, n_postings = [], 0, 0
        if parts:
            searched(parts)
        group = TaskContext.get().partitionId() % GROUPS
        for k, places in enumerate(best):
            if n := len(places.ids):
                ids = pa.array(places.ids, mask=places.ids == _NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, pa.int32()), pa.array([group] * n, pa.int32()), ids, pa.array(places.scores)], schema=schema)

    return forward.where("docs is null").select("id", "length", "terms", "counts").mapInArrow(search, kind)


def ranked_documents(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", most: int = 50,
                     item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item, rank, id, score): each item's documents of the highest scores above 0, equal ones by ascending id.

    Terms, weights and scores are those of op 11's contract. Null and empty texts have no terms and count for
    nothing; rows of one item id are one item with the terms of all its texts, a null item id is an id; every row
    of docs is a document, so repeated ids rank as often as they come, null ids first among equal scores. Ids of
    documents are whole numbers. An empty table of either kind gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], T.StructType(
        [T.StructField("item", items.schema[item_col].dataType)]).add("rank", "integer").add("id", "long").add("score", "long"))
    for block in _item_blocks(items, item_col, item_text_col, item_bytes):
        vocabulary = sorted(set().union(*(terms for _, terms in block)))
        number = {w: k for k, w in enumerate(vocabulary)}
        forward = shared.written(forward_index(docs, vocabulary, id_col=id_col, text_col=text_col), "forward")
        n_docs, n_words, weights = term_weights(forward, len(vocabulary))
        wanted = [np.array([number[w] for w in terms], np.int64) for _, terms in block]
        best = _best_of_tasks(forward, wanted, weights, n_docs, n_words, most)
        order = (F.desc("score"), F.asc_nulls_first("id"))
        for keys in (("item", "group"), ("item",)):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(
                F.col("rank") <= most)
        names = spark.createDataFrame(
            [(k, item) for k, (item, _) in enumerate(block)],
            T.StructType([T.StructField("place", T.IntegerType()), T.StructField("name", items.schema[item_col].dataType)]))
        found = found.unionByName(best.join(F.broadcast(names), F.col("item") == F.col("place")).select(
            F.col("name").alias("item"), "rank", "id", "score"))
    return found
