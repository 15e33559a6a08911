"""Vector code compression: product codes whose nearest entries are found through a GNAT over each codebook.

A vector becomes whole numbers and is cut into parts; every part position has a codebook of a few entries. Rounds
assign all parts to their nearest entry and move each entry to the floored mean of its parts; a round sends sums
by (part, entry, position) alone, first added up in each task.

A codebook's entries stand in a GNAT: split points, each entry below its nearest one, and for every pair of a
split point and a subtree the least and the largest distance between them. With a query's distance to a split
point known, a subtree whose whole range lies further off than the best entry so far is dropped. Distances are
roots of whole numbers; the bounds take their floor or ceiling so that rounding only ever keeps a subtree, a
subtree at exactly the best distance stays, and what is left is compared by whole squared distances, ties to the
lower index.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import shared

#: Squared distances below this are exact in 64 bits; beyond, a batch is computed with Python's own integers.
_SAFE = 2**62
#: Components of this size or more are refused: the sums of a table would not fit the decimals that carry them.
_LARGEST = 2**62


def _root_floor(squares: np.ndarray) -> np.ndarray:
    """The floors of the square roots of whole numbers."""
    if squares.dtype == object:
        return np.frompyfunc(math.isqrt, 1, 1)(squares)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    root += (root + 1) * (root + 1) <= squares
    return root


def _root_ceiling(squares: np.ndarray) -> np.ndarray:
    root = _root_floor(squares)
    return root + (root * root < squares)


def squared_distances(queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whole squared distances of every query to every entry."""
    off = queries[:, None, :] - entries[None, :, :]
    return (off * off).sum(axis=2) if off.shape[2] else np.zeros(off.shape[:2], off.dtype)


class Gnat:
    """A tree over rows of whole numbers that finds each query's nearest row, the first of equal ones."""

    def __init__(self, entries: np.ndarray, degree: int = 4, members: np.ndarray | None = None) -> None:
        self.entries = entries
        members = np.arange(len(entries)) if members is None else members
        self.split, self.children = members, []
        if len(members) <= degree:
            return
        between = squared_distances(entries[members], entries[members])
        chosen = [0]
        while len(chosen) < degree:  # the row furthest from all split points, the first of equal ones
            off = between[:, chosen].min(axis=1)
            off[chosen] = -1
            chosen.append(int(np.argmax(off)))
        self.split = members[chosen]
        nearest = np.argmin(between[:, chosen], axis=1)
        nearest[chosen] = np.arange(degree)
        self.low = np.empty((degree, degree), entries.dtype)
        self.high = np.empty((degree, degree), entries.dtype)
        for j in range(degree):
            inside = between[np.ix_(chosen, np.flatnonzero(nearest == j))]
            self.low[:, j], self.high[:, j] = _root_floor(inside.min(axis=1)), _root_ceiling(inside.max(axis=1))
            rest = members[(nearest == j) & ~np.isin(np.arange(len(members)), chosen)]
            self.children.append(Gnat(entries, degree, rest) if len(rest) else None)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each query's nearest row; the number of distances computed."""
        far = 1 << 2048 if queries.dtype == object else np.iinfo(np.int64).max
        best, index = np.full(len(queries), far, queries.dtype), np.zeros(len(queries), np.int64)
        computed = self._search(queries, np.arange(len(queries)), index, best)
        return index, best, computed

    def _search(self, queries: np.ndarray, rows: np.ndarray, index: np.ndarray, best: np.ndarray) -> int:
        found = squared_distances(queries[rows], self.entries[self.split])
        for k, entry in enumerate(self.split.tolist()):
            closer = (found[:, k] < best[rows]) | ((found[:, k] == best[rows]) & (entry < index[rows]))
            best[rows[closer]], index[rows[closer]] = found[closer, k], entry
        computed = found.size
        if not self.children:
            return computed
        floor, ceiling = _root_floor(found), _root_ceiling(found)
        for j, child in enumerate(self.children):
            if child is None:
                continue
            radius = _root_ceiling(best[rows])[:, None]
            may = ((floor - self.high[:, j] <= radius) & (self.low[:, j] - ceiling <= radius)).astype(bool).all(axis=1)
            if may.any():
                computed += child._search(queries, rows[may], index, best)
        return computed


def _exact(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are where 64 bits hold all squared distances, else as Python's integers."""
    most = max((int(np.abs(a.astype(object)).max()) if a.dtype == object else max(int(a.max()), -int(a.min()))
                for a in (vectors, books) if a.size), default=0)
    if 4 * most * most * max(1, books.shape[2]) < _SAFE:
        return vectors, books
    return vectors.astype(object), books.astype(object)


class Codebooks:
    """(parts, entries, width) whole numbers."""

    def __init__(self, books: np.ndarray) -> None:
        self.books, self.trees = books, [Gnat(b) for b in _exact(books[:, :0], books)[1]]

    def assigned(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance for each (vector, part)."""
        parts, _, width = self.books.shape
        vectors, books = _exact(vectors, self.books)
        trees = self.trees if books.dtype == self.trees[0].entries.dtype else [Gnat(b) for b in books]
        codes = np.empty((len(vectors), parts), np.int64)
        errors = np.empty((len(vectors), parts), vectors.dtype)
        for p in range(parts):
            codes[:, p], errors[:, p], _ = trees[p].nearest(vectors[:, p * width:(p + 1) * width])
        return codes, errors

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel().tolist()).encode()).hexdigest()


def _whole_numbers(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("v")
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def whole_vectors(rows: DataFrame, *, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """(id, label, v): floor(scale * x) of every component, for the vectors that are whole and finite."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).alias("id"), label.alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * float(scale)).cast("long")).alias("v"))


def _sums(kept: DataFrame, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """By (part, entry) the number of assigned parts and their componentwise sums, exact."""
    parts, entries, width = books.books.shape
    kind = T.StructType.fromDDL("part int, entry int, place int, total decimal(38,0)")
    schema = shared.arrow_schema(kind)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _whole_numbers(batch)
            codes, _ = books.assigned(vectors)
            small = max(int(vectors.max()), -int(vectors.min())) < _SAFE // max(1, len(vectors)) if vectors.size else True
            for p in range(parts):
                own = np.zeros((entries, width), np.int64 if small else object)
                np.add.at(own, codes[:, p], vectors[:, p * width:(p + 1) * width].astype(own.dtype))
                sums[p] += own
                counts[p] += np.bincount(codes[:, p], minlength=entries)
        used = [(p, e) for p in range(parts) for e in range(entries) if counts[p, e]]
        if used:
            rows = [(p, e, k, sums[p, e, k] if k >= 0 else counts[p, e]) for p, e in used for k in range(-1, width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(
                    (*zip(*(r[:3] for r in rows)), [Decimal(int(r[3])) for r in rows]), schema)], schema=schema)

    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    totals = kept.select("v").mapInArrow(add, kind).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"))
    for row in totals.orderBy("part", "entry", "place").collect():  # (width + 1) * entries * parts rows at most
        if row.place < 0:
            found[row.part, row.entry] = (int(row.total), [])
        else:
            found[row.part, row.entry][1].append(int(row.total))
    return found


def fitted_codebooks(kept: DataFrame, *, parts: int, entries: int, rounds: int) -> Codebooks | None:
    """Codebooks that start as the parts of the rows with the smallest ids and move for some rounds; None without rows.

    Ids that are equal are told apart by their vectors, null ids come last. Fewer rows than entries give so many entries.
    """
    first = kept.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        return None
    width = len(first[0].v)
    shape = kept.agg(F.min(F.size("v")), F.max(F.size("v")), F.max(F.greatest(
        F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0))))).first()
    if tuple(shape[:2]) != (width, width) or width % parts:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {shape[0]} to {shape[1]}")
    if shape[2] >= _LARGEST:
        raise ValueError(f"components must be below {_LARGEST} after scaling")
    books = Codebooks(np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        moved = books.books.copy()
        for (p, e), (count, sums) in _sums(kept, books).items():
            moved[p, e] = [s // count for s in sums]
        books = Codebooks(moved)
    return books


def compressed_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                       scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """One row per whole, finite vector: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null or hold null, NaN or infinite components are dropped. error is the squared distance to
    the entries, label_error its sum over the rows of one label, null labels together; either is null where 64 bits
    don't hold it. Equal vectors get equal codes; repeated ids keep their rows; other columns are ignored. Vectors
    of different lengths, or of a length that parts doesn't divide, raise. An empty table gives no rows.
    """
    spark = rows.sparkSession
    shared.prepare(spark)
    kept = shared.written(whole_vectors(
        rows, id_col=id_col, vector_col=vector_col, label=F.col(label_col), scale=scale), "vectors")
    books = fitted_codebooks(kept, parts=parts, entries=entries, rounds=rounds)
    kind = T.StructType([kept.schema["id"], kept.schema["label"]]).add("code", "string").add("error", "long")
    if books is None:
        return spark.createDataFrame([], kind.add("label_error", "long").add("codebooks_sha256", "string"))
    schema = shared.arrow_schema(kind)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = books.assigned(_whole_numbers(batch)) if batch.num_rows else (np.zeros((0, parts), int), np.zeros((0, parts), int))
            digits = codes.astype(np.uint8).tobytes().hex()
            total = [int(e) if e < 2**63 else None for e in errors.sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"),
                 pa.array([digits[2 * parts * i:2 * parts * (i + 1)] for i in range(batch.num_rows)], pa.string()),
                 pa.array(total, pa.int64())], schema=schema)

    coded = shared.written(kept.mapInArrow(encode, kind), "codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    return coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label"))).select(
        "c.id", "c.code", "c.error", "l.label_error", F.lit(books.digest()).alias("codebooks_sha256"))
