"""Sharding by sampled splitters: range partitioning of records into shards of near-equal bytes.

Rows are ordered by (hash of the text, id), so copies of a text lie together. A sample drawn with probability
proportional to size gives the quantile boundaries of many small ranges; exact sums by range show which are
overfull, and those are sampled again and subdivided. Shards are runs of consecutive ranges.
"""

from __future__ import annotations

import json
from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import shared

LOWEST = -(2**63)
#: Splitters to compare with at once; two such steps find a range.
STEP = 64


def _key_columns(id_col: str, id_type: str) -> Column:
    whole = id_type in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)) if whole else F.xxhash64(F.col(id_col))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size (UTF-8 bytes plus 1), text_crc32, and the key (h, d) by which rows are ordered."""
    text = shared.text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"),
        _key_columns(id_col, dict(docs.dtypes)[id_col]).alias("d"))


def _sampled(rows: DataFrame, bytes_each: float, seed: int, *more: str) -> DataFrame:
    """Keys of rows drawn with probability size / bytes_each, the bytes each stands for, and more columns."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h", "d"), 11) / F.lit(float(2**53))
    return rows.where(chance < F.col("size") / bytes_each).select(
        "h", "d", F.greatest(F.col("size").cast("double"), F.lit(bytes_each)).alias("stands_for"), *more)


def _quantiles(sample: DataFrame, bytes_each: float, by: list[str]) -> list[tuple[int, int]]:
    """Sampled keys at every bytes_each of what the sample stands for; by: splits the sample first."""
    upto = Window.partitionBy(*by).orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0)
    step = F.floor(F.sum("stands_for").over(upto) / bytes_each)
    first = sample.withColumn("step", step).groupBy(*by, "step").agg(F.min(F.struct("h", "d")).alias("key"))
    return sorted({(row.key.h, row.key.d) for row in first.where("step > 0").select("key").collect()})


def _whole_groups(splitters: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A splitter inside a text that no neighbour cuts moves to the text's first row: small groups stay whole."""
    kept = set()
    for i, (h, d) in enumerate(splitters):
        near = {splitters[j][0] for j in (i - 1, i + 1) if 0 <= j < len(splitters)}
        kept.add((h, d if h in near else LOWEST))
    return sorted(kept)


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the row's key, found in two steps."""
    if not splitters:
        return F.lit(0)
    blocks = [splitters[i:i + STEP] for i in range(0, len(splitters), STEP)]
    element = "struct<h:bigint,d:bigint>"

    def table(value: object, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(value)), kind)

    def pairs(block: list[tuple[int, int]]) -> list[dict[str, int]]:
        return [{"h": h, "d": d} for h, d in block]

    key = F.struct("h", "d")
    block = F.size(F.filter(table(pairs([b[0] for b in blocks]), f"array<{element}>"), lambda x: x <= key))
    inner = F.element_at(table([pairs(b) for b in blocks], f"array<array<{element}>>"), F.greatest(block, F.lit(1)))
    return F.when(block == 0, 0).otherwise((block - 1) * STEP + F.size(F.filter(inner, lambda x: x <= key)))


def assigned_shards(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text",
                    ranges_per_shard: int = 128, samples_per_range: int = 16, max_range_rows: int = 4_000_000,
                    seed: int = 2) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in its shard).

    The driver holds the splitters and one sum per range: at most about shards * ranges_per_shard, or one for
    each max_range_rows rows where that is more. Equal texts lie in one range unless they are more than about a
    range together; then the range is cut by id. A null text has no bytes and counts 1. Null ids come first;
    equal rows are ordered at random, which changes nothing but which of them has which slot. An empty table
    gives no rows.
    """
    rows = shared.written(keyed_rows(docs, id_col, text_col), "keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    wanted = max(shards * ranges_per_shard, -(-count // max_range_rows))
    share = max(total / wanted, 1.0)
    sampled = _sampled(rows, share / samples_per_range, seed)
    splitters = _whole_groups(_quantiles(sampled, share, []))
    turn = 0
    while True:
        ranged = rows.withColumn("range", _range_of(splitters))
        sums = ranged.groupBy("range").agg(
            F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"),
            F.min(F.struct("h", "d")).alias("low"), F.max(F.struct("h", "d")).alias("high")).collect()
        over = [s["range"] for s in sums if (s["size"] > 2 * share or s.n > max_range_rows) and s.low != s.high]
        turn += 1
        more: set[tuple[int, int]] = set()
        if over:
            fine = _sampled(ranged.where(F.col("range").isin(over)), share / samples_per_range, seed + turn, "range")
            # a cut at a range's own first key would leave it as it is
            more = set(_quantiles(fine, share / 2, ["range"])) - {(s.low.h, s.low.d) for s in sums}
        if not more:
            break
        splitters = sorted({*splitters, *more})
    place = _places({s["range"]: (s["size"], s.n) for s in sums}, shards, total)
    table = F.from_json(F.lit(json.dumps([place.get(r) for r in range(len(splitters) + 1)])),
                        "array<struct<shard:int,base:bigint>>")
    inside = F.row_number().over(Window.partitionBy("range").orderBy("h", "d"))
    return ranged.withColumn("place", F.get(table, F.col("range"))).select(
        "id", "size", "text_crc32", F.col("place.shard").alias("shard"),
        (F.col("place.base") + inside - 1).cast("long").alias("slot"))


def _places(sums: dict[int, tuple[int, int]], shards: int, total: int) -> dict[int, dict[str, int]]:
    """For each range its shard, and how many rows of that shard come before it; cuts lie nearest to even shares."""
    order, upto, ends = sorted(sums), 0, [0]
    for r in order:
        upto += sums[r][0]
        ends.append(upto)
    cuts = [0]
    for k in range(1, shards):
        aim = total * k / shards
        i = bisect_right(ends, aim)
        nearest = min((j for j in (i - 1, i) if 0 <= j < len(ends)), key=lambda j: abs(ends[j] - aim))
        cuts.append(max(nearest, cuts[-1]))
    out, filled = {}, [0] * shards
    for i, r in enumerate(order):
        shard = bisect_right(cuts, i) - 1
        out[r] = {"shard": shard, "base": filled[shard]}
        filled[shard] += sums[r][1]
    return out
