"""Near-duplicate documents by HyperMinHash: compressed MinHash registers, banding, estimation, verification.

A register keeps the smallest hash of a document's shingles under its own permutation as the number of leading
zeros (6 bits) and the next bits after the first one (10 bits). Each register sees all shingles: dealing them to
the registers by hash would leave most of a short text's registers empty. Four registers make one band, so a
band's key is 64 bits; with 32 bands, a pair at similarity 0.8 shares none with probability 5e-8.

Documents with equal shingle sets form a class, and only the class's first document goes on. Those that share a
band's key form a bucket; each is sent to the bucket's smallest member, its centre, once for all bands. Every
member is compared with the centre first, in one pass over chunks of the group that each get the centre's text; a
group of near copies is done with that, and its texts have moved once. The members not linked to the centre, if
any, are then compared with one another and with the linked ones: tasks take pairs of blocks with such members on
one side at least, keep the pairs whose estimate is high enough, confirm these on the full shingle sets, and return
the confirmed links that join their parts. Two members linked to the centre are joined already and need no
comparison. No pairs leave a task but links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import shared
from tidewatch.llm.components import components

REGISTERS, BAND, MANTISSA_BITS = 128, 4, 10
#: Standard deviations that an estimate may fall short of the threshold and still be verified.
SLACK = 6.0
#: Documents and shingles of a block.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1_000_000
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PERMUTATIONS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text in UTF-8; of all its words, if they are fewer."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = shared.kept("near_duplicates", "words", _WordHashes)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    n = len(words) - width + 1
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = _mixed(rolled * _STEP + hashed[k:k + n])
    return np.unique(rolled)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each set; no set is empty."""
    out = np.empty((len(sets), REGISTERS), np.uint64)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total + len(sets[last]) <= 32_768):
            total += len(sets[last])
            last += 1
        joined = np.concatenate(sets[first:last])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first:last - 1]])]).astype(np.int64)
        scratch = np.empty_like(joined)
        for j, factor in enumerate(_PERMUTATIONS):
            np.multiply(joined, factor, out=scratch)
            out[first:last, j] = np.minimum.reduceat(scratch, starts)
        first = last
    return compressed(out)


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of each 64-bit value."""
    zeros = np.zeros(least.shape, np.uint64)
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = rest < np.uint64(1 << (64 - step))
        zeros += small * np.uint64(step)
        rest = np.where(small, rest << np.uint64(step), rest)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    return (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)


@lru_cache(maxsize=4096)
def _collision_rate(n_step: int, m_step: int) -> float:
    """Chance that registers of unrelated sets agree; sizes as powers of the fourth root of 2."""
    n, m = 2.0 ** (n_step / 4), 2.0 ** (m_step / 4)
    i = np.arange(1, 64)[:, None]
    j = np.arange(2**MANTISSA_BITS)[None, :]
    low = (2.0**MANTISSA_BITS + j) / 2.0 ** (MANTISSA_BITS + i)
    high = (2.0**MANTISSA_BITS + j + 1) / 2.0 ** (MANTISSA_BITS + i)

    def mass(k: float) -> np.ndarray:
        return np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-16)))

    return float((mass(n) * mass(m)).sum())


def estimates(one: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one document against others, corrected for registers that agree by chance."""
    agree = (others == one).mean(axis=1)
    steps, place = np.unique(np.rint(4 * np.log2(sizes)).astype(int), return_inverse=True)
    own = int(np.rint(4 * np.log2(size)))
    chance = np.array([_collision_rate(min(own, s), max(own, s)) for s in steps.tolist()])[place]
    return (agree - chance) / (1 - chance)


def group_links(ids: list[int], sets: list[np.ndarray], sides: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join the parts of a group; sides: compare only across 0 and 1, unless all are 0."""
    order = sorted(range(len(ids)), key=lambda k: ids[k])
    ids, sets, sides = [ids[k] for k in order], [sets[k] for k in order], sides[order]
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    signs = registers(sets)
    tokens, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    by_token = owner[np.argsort(codes, kind="stable")]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(tokens)))])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    across = bool(sides.any())
    least = percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)
    part = np.arange(n)
    links = []
    for k in range(1, n):
        before = part[:k] != part[k]
        if across:
            before &= sides[:k] != sides[k]
        before &= 100 * np.minimum(sizes[:k], sizes[k]) >= percent * np.maximum(sizes[:k], sizes[k])
        near = np.flatnonzero(before)
        if not len(near):
            continue
        near = near[estimates(signs[k], int(sizes[k]), signs[near], sizes[near]) >= least]
        if not len(near):
            continue
        if len(near) < 8:
            shared_counts = np.array([len(np.intersect1d(sets[k], sets[o], assume_unique=True)) for o in near.tolist()])
        else:
            own = codes[starts[k]:starts[k + 1]]
            lists = [by_token[bounds[c]:bounds[c + 1]] for c in own.tolist()]
            shared_counts = np.bincount(np.concatenate(lists), minlength=n)[near]
        linked = near[100 * shared_counts >= percent * (sizes[near] + sizes[k] - shared_counts)]
        for o in linked.tolist():
            if part[o] != part[k]:
                links.append((ids[k], ids[o]))
                part[part == part[k]] = part[o]
    return links


FEATURES = "id bigint, hash bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, hash and text; id and hash tell the texts of one id apart."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def features(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, hash of the text, n_shingles, a 128-bit digest of the shingle set and the registers, four to a number; nulls without words."""
    shared.prepare(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t or b"", size) for t in raw.slice(at, 512).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                digests = np.zeros((len(sets), 2), np.int64)
                for k in full:
                    digests[k] = np.frombuffer(xxhash.xxh3_128_digest(sets[k].tobytes()), np.int64)
                bands: list = [None] * len(sets)
                if full:
                    keys = registers([sets[k] for k in full]).view(np.int64)
                    for row, k in enumerate(full):
                        bands[k] = keys[row]
                none = np.array([not len(s) for s in sets])
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column("id").slice(at, 512), "hash": batch.column("hash").slice(at, 512), "n_shingles": [len(s) for s in sets],
                    "set_a": pa.array(digests[:, 0], mask=none), "set_b": pa.array(digests[:, 1], mask=none),
                    "bands": pa.array(bands, pa.list_(pa.int64()))})

    return texts.mapInArrow(compute, FEATURES)


def _star_pairs(firsts: DataFrame) -> DataFrame:
    """Distinct (centre, id, hash) of all buckets with two documents or more; the centre is a row of its own group too."""
    keys = firsts.select("id", "hash", F.posexplode("bands").alias("band", "key"))
    centres = keys.groupBy("band", "key").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where(
        "n > 1").drop("n")
    return keys.join(centres, ["band", "key"]).select("centre", "id", "hash").distinct()


def _near_centres(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, id_col: str, text_col: str, size: int,
                  percent: int) -> DataFrame:
    """(centre, id, hash, n_shingles, linked) for each member of a group but the centre's own rows."""
    weighed = pairs.join(firsts.select("id", "hash", "n_shingles"), ["id", "hash"])
    groups = shared.written(weighed.groupBy("centre").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).select(
        "centre", F.ceil(F.greatest(F.col("n") / BLOCK_DOCS, F.col("weight") / BLOCK_SHINGLES)).alias("chunks")), "groups")
    own = F.pmod(F.xxhash64("id", "hash"), F.col("chunks"))
    is_centre = F.col("id") == F.col("centre")
    chunks = F.when(is_centre, F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(F.array(own))
    dealt = shared.written(pairs.join(groups, "centre").select(
        "id", "hash", "centre", (~is_centre).alias("member"), F.explode(chunks).alias("chunk")), "dealt")
    # a merge at every size: the ids to look up grow with the corpus, and the plan should not change with it
    rows = dealt.join(_texts(docs, id_col, text_col).hint("merge"), ["id", "hash"]).repartition(
        "centre", "chunk").sortWithinPartitions("centre", "chunk", "member", "id")
    least = percent / 100 - SLACK * np.sqrt(percent / 100 * (1 - percent / 100) / REGISTERS)

    def judged(runs: list[tuple[list[np.ndarray], list[tuple]]]) -> Iterator[tuple]:
        """Members with their verdicts, by estimate first, then on the full sets; runs: texts of a centre, members."""
        signs = registers([m[3] for _, members in runs for m in members])
        own_signs = registers([c for centres, _ in runs for c in centres])
        at = own_at = 0
        for centres, members in runs:
            sets = [m[3] for m in members]
            sizes, linked, sign = np.array([len(s) for s in sets]), np.zeros(len(sets), bool), signs[at:at + len(sets)]
            for centre in centres:
                may = ~linked & (100 * np.minimum(sizes, len(centre)) >= percent * np.maximum(sizes, len(centre)))
                if may.any():
                    may[may] = estimates(own_signs[own_at], len(centre), sign[may], sizes[may]) >= least
                for k in np.flatnonzero(may).tolist():
                    common = len(np.intersect1d(sets[k], centre, assume_unique=True))
                    linked[k] = 100 * common >= percent * (len(sets[k]) + len(centre) - common)
                own_at += 1
            at += len(sets)
            yield from ((*m[:3], len(m[3]), yes) for m, yes in zip(members, linked.tolist()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centres = None, []
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            columns = [batch.column(c).to_pylist() for c in ("centre", "chunk", "member", "id", "hash")]
            runs: list[tuple[list[np.ndarray], list[tuple]]] = []
            for centre, chunk, member, own_id, own_hash, text in zip(*columns, batch.column("text").cast(pa.binary())):
                own_set = shingle_set(text.as_py() or b"", size)
                if (centre, chunk) != key:
                    key, centres = (centre, chunk), []
                if not len(own_set):
                    continue
                if not member:
                    centres.append(own_set)
                else:
                    if not runs or runs[-1][0] is not centres:
                        runs.append((centres, []))
                    runs[-1][1].append((centre, own_id, own_hash, own_set))
            if runs:
                out = list(judged(runs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), near_schema)], schema=near_schema)

    near_kind = "centre bigint, id bigint, hash bigint, n_shingles bigint, linked boolean"
    near_schema = shared.arrow_schema(near_kind)
    # texts of one id with one hash may come more than once; they are one
    return rows.mapInArrow(compare, near_kind).groupBy("centre", "id", "hash").agg(
        F.max("n_shingles").alias("n_shingles"), F.bool_and("linked").alias("linked"))


def _links(near: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) of the members that are not linked to their centre, within its group."""
    sizes = near.groupBy("centre").agg(*(
        column for name, test in (("far", ~F.col("linked")), ("close", F.col("linked"))) for column in (
            F.count_if(test).alias(f"{name}_n"), F.sum(F.when(test, F.col("n_shingles")).otherwise(0)).alias(f"{name}_w"))))

    def blocks(name: str) -> Column:
        return F.ceil(F.greatest(F.col(f"{name}_n") / BLOCK_DOCS, F.col(f"{name}_w") / BLOCK_SHINGLES)).alias(name)

    groups = shared.written(sizes.where("far_n > 0 and far_n + close_n > 1").select(
        "centre", blocks("far"), blocks("close")), "far")
    none = F.array().cast("array<struct<low:bigint,high:bigint>>")
    spread = F.xxhash64("id", "hash")
    far_own, close_own = F.pmod(spread, F.col("far")), F.col("far") + F.pmod(spread, F.greatest("close", F.lit(1)))
    each_far = F.sequence(F.lit(0).cast("long"), F.col("far") - 1)
    each_close = F.when(F.col("close") > 0, F.sequence(F.col("far"), F.col("far") + F.col("close") - 1)).otherwise(
        F.array().cast("array<bigint>"))

    def keys(others: Column, own: Column) -> Column:
        return F.transform(others, lambda k: F.struct(F.least(own, k).alias("low"), F.greatest(own, k).alias("high")))

    dealt = near.join(groups, "centre").select(
        "id", "hash", "centre", F.when(F.col("linked"), close_own).otherwise(far_own).alias("own"), "far", "close", "linked")
    placed = F.when(F.col("linked"), keys(each_far, F.col("own"))).otherwise(
        F.concat(keys(each_far, F.col("own")), keys(each_close, F.col("own"))))
    dealt = shared.written(dealt.select(
        "id", "hash", "centre", "own", F.inline(F.coalesce(placed, none))), "dealt_far")
    rows = dealt.join(_texts(docs, id_col, text_col).hint("merge"), ["id", "hash"]).drop("hash").repartition(
        "centre", "low", "high").sortWithinPartitions("centre", "low", "high", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> list[tuple[int, int]]:
            ids = [i for i, _ in held]
            sides = np.array([own != key[1] for own, _ in held.values()])
            return group_links(ids, [s for _, s in held.values()], sides, percent) if len(ids) > 1 else []

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

        for batch in batches:
            links: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("id", "centre", "low", "high", "own")]
            for *row, text in zip(*columns, batch.column("text").cast(pa.binary())):
                if tuple(row[1:4]) != key:
                    if held:
                        links += done()
                    key, held = tuple(row[1:4]), {}
                own = shingle_set(text.as_py() or b"", size)
                if len(own):
                    held.setdefault((row[0], xxhash.xxh3_128_digest(own.tobytes())), (row[4], own))
            if links:
                yield batch_of(links)
        if held:
            yield batch_of(done())

    return rows.mapInArrow(compare, "u bigint, v bigint")


def grouped_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                      percent: int = 80) -> DataFrame:
    """One row per row of docs: id, n_shingles, component (smallest id reachable over links), kept.

    Documents are linked where 100 * common shingles >= percent * all shingles of both; a text with fewer words
    than a shingle has one shingle of all of them. Null texts and texts without words have no shingles and no
    links. A null id has no component and is kept. Ids are whole numbers; rows of one id count as one document,
    which has the links of each of their texts. An empty table gives no rows.
    """
    rows = shared.written(features(docs, id_col, text_col, shingle_words), "features")
    known = rows.where("id is not null and set_a is not null")
    classes = shared.written(known.groupBy("set_a", "set_b").agg(F.min("id").alias("first")), "classes")
    firsts = shared.written(
        known.alias("r").join(classes.alias("c"), (F.col("r.set_a") == F.col("c.set_a"))
                              & (F.col("r.set_b") == F.col("c.set_b")) & (F.col("r.id") == F.col("c.first"))).select(
            "r.id", "r.hash", "r.n_shingles", "r.set_a", "r.set_b", "r.bands").dropDuplicates(
            ["id", "set_a", "set_b", "bands"]).drop("set_a", "set_b"), "firsts")
    pairs = shared.written(_star_pairs(firsts), "pairs")
    near = shared.written(_near_centres(pairs, docs, firsts, id_col, text_col, shingle_words, percent), "near")
    links = shared.written(
        near.where("linked and id <> centre").select(F.col("id").alias("u"), F.col("centre").alias("v")).unionByName(
            _links(near, docs, id_col, text_col, shingle_words, percent)), "links")
    several = shared.written(rows.where("id is not null").groupBy("id").agg(
        F.min("set_a").alias("a"), F.max("set_a").alias("c"), F.min("set_b").alias("b"), F.max("set_b").alias("d"),
        F.count(F.lit(1)).alias("n"), F.count("set_a").alias("m")).where("a <> c or b <> d or m < n").select("id"), "several")
    # the classes of one id's texts belong together, and texts without words go with them
    own = known.join(several, "id").join(classes, ["set_a", "set_b"]).select(
        F.col("id").alias("u"), F.col("first").alias("v")).where("u <> v")
    found = components(links.unionByName(own))
    placed = rows.alias("r").join(
        classes.alias("c"), (F.col("r.set_a") == F.col("c.set_a")) & (F.col("r.set_b") == F.col("c.set_b")), "left"
    ).select("r.id", "r.n_shingles", F.coalesce("c.first", "r.id").alias("first"))
    labelled = placed.join(found, placed["first"] == found["node"], "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "first")).alias("component"))
    return labelled.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def first_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80) -> DataFrame:
    """The rows of docs that stay: one of each component, with all their columns; of rows of one id, one."""
    grouped = shared.written(grouped_documents(
        docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words, percent=percent), "grouped")
    own = F.col(id_col).cast("long")
    mark, rank = shared.free_name("dropped_id", docs), shared.free_name("copy_rank", docs)
    dropped = shared.written(grouped.where("not kept").select(F.col("id").alias(mark)).distinct(), "dropped")
    kept = docs.join(dropped, own == F.col(mark), "left_anti")
    again = shared.written(grouped.where("kept and id is not null").groupBy(F.col("id").alias(mark)).count().where(
        "count > 1").drop("count"), "again")
    if again.isEmpty():
        return kept
    from pyspark.sql import Window

    one = kept.join(again, own == F.col(mark), "left_semi").withColumn(
        rank, F.row_number().over(Window.partitionBy(own).orderBy(F.xxhash64(F.col(text_col))))).where(
        F.col(rank) == 1).drop(rank)
    return kept.join(again, own == F.col(mark), "left_anti").unionByName(one)
