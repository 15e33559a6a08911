"""Mixing sources to target weights by hash-threshold histograms.

Each row has a 63-bit hash. A source whose target is below its size takes the rows whose hash is under the
source's threshold; above it, whole passes come first and the threshold decides on one more. The threshold is
found from token sums by (source, 12 hash bits): the bucket in which the budget ends is refined by the next 12
bits, and only its rows are read for that. The last bucket holds few hashes, which are summed one by one; rows that
are equal share a hash, and of the one in which the budget ends so many copies are taken as fit. Of the rows above
the threshold, the one whose size comes nearest to what is left of the budget is taken too. Nothing is sorted but
the few buckets of each source, and the copies of a hash of which only some are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import shared

LEVEL_BITS = 12
LEVELS = 3
HASH_BITS = 63


def _prefix(hashed: Column, level: int) -> Column:
    return F.shiftright(hashed, HASH_BITS - LEVEL_BITS * level)


def hashed_rows(docs: DataFrame, id_col: str, text_col: str, seed: int) -> Column:
    return shared.positive_hash(F.lit(seed), F.col(id_col), F.col(text_col))


def source_targets(sizes: DataFrame, weights: Sequence[float], max_passes: float) -> DataFrame:
    """(source, source_size) to (source, source_size, target), one row per source.

    Weights repeat along the sources by code point, null last. A target is at most max_passes times its
    source's size; what is cut off goes to the others by weight, until none is above. The common level of
    target per weight is the largest one met when the sources are held back in the order of their limits.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = sizes.select(
        "source", "source_size", (F.col("source_size") * float(max_passes)).alias("most"),
        F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1).alias("weight"),
    )
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        Window.unboundedPreceding, -1)
    onward = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(
        0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight").over(onward)
    leveled = ranked.withColumn("level", level)
    return leveled.select(
        "source", "source_size",
        F.least("most", F.col("weight") * F.max("level").over(everything)).alias("target"))


def thresholds(slim: DataFrame, weights: Sequence[float], max_passes: float) -> DataFrame:
    """(source, size, hashed) to one row per source: source_size, target, passes, cut, extra."""
    hist = shared.written(
        slim.groupBy("source", _prefix(F.col("hashed"), 1).alias("prefix")).agg(F.sum("size").alias("tokens")), "hist")
    sizes = hist.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    targets = source_targets(sizes, weights, max_passes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = shared.written(
        targets.select("source", "source_size", "target", passes.cast("long").alias("passes")).withColumn(
            "budget", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    boundary = _boundary(hist, state.select("source", "budget"))
    for level in range(2, LEVELS + 1):
        boundary = shared.written(boundary, f"boundary{level - 1}")
        inside = slim.withColumn("prefix", _prefix(F.col("hashed"), level - 1)).alias("s").join(
            boundary.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source"))
            & (F.col("s.prefix") == F.col("b.prefix"))).select(
            "s.source", "s.size", _prefix(F.col("s.hashed"), level).alias("prefix"))
        finer = inside.groupBy("source", "prefix").agg(F.sum("size").alias("tokens"))
        boundary = _boundary(finer, boundary.select("source", "budget"))
    boundary = shared.written(boundary, f"boundary{LEVELS}")
    inside = slim.withColumn("prefix", _prefix(F.col("hashed"), LEVELS)).alias("s").join(
        boundary.alias("b"), F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.prefix") == F.col("b.prefix")))
    hashes = inside.groupBy("s.source", F.col("s.hashed").alias("prefix")).agg(
        F.sum("s.size").alias("tokens"), F.count(F.lit(1)).alias("rows"), F.max("s.size").alias("size"))
    last = _boundary(hashes, boundary.select("source", "budget"), "rows", "size")
    copies = F.least(F.col("rows"), F.floor(F.col("budget") / F.col("size")))
    cuts = shared.written(last.select(
        "source", F.col("prefix").alias("cut"), "rows", copies.alias("copies"),
        (F.col("budget") - copies * F.col("size")).alias("left")), "cuts")
    off = F.abs(F.col("s.size") - F.col("c.left"))
    beyond = (F.col("s.hashed") > F.col("c.cut")) | ((F.col("s.hashed") == F.col("c.cut")) & (F.col("c.copies") < F.col("c.rows")))
    filling = shared.written(slim.alias("s").join(
        cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")) & beyond).where(
        off < F.col("c.left")).groupBy("s.source").agg(F.min(F.struct(off.alias("off"), "s.hashed")).alias("best")).select(
        "source", F.col("best.hashed").alias("extra")), "filling")
    alike = slim.alias("s").join(
        filling.alias("f"), F.col("s.source").eqNullSafe(F.col("f.source")) & (F.col("s.hashed") == F.col("f.extra"))).groupBy(
        "s.source").agg(F.count(F.lit(1)).alias("alike"))
    more = (F.col("f.extra") == F.col("c.cut")).cast("long")
    taken = F.coalesce(F.col("c.copies") + F.coalesce(more, F.lit(0)), F.lit(0))
    extra = F.when(F.coalesce(more, F.lit(0)) == 0, F.coalesce("f.extra", F.lit(-1))).otherwise(-1)
    return shared.written(
        state.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").join(
            filling.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")), "left").join(
            alike.alias("a"), F.col("t.source").eqNullSafe(F.col("a.source")), "left").select(
            "t.source", "t.source_size", "t.target", "t.passes", F.coalesce("c.cut", F.lit(0)).alias("cut"),
            taken.alias("copies"), extra.alias("extra"),
            (((taken > 0) & (taken < F.col("c.rows"))) | ((extra >= 0) & (F.col("a.alike") > 1))).alias("counted")), "thresholds")


def _with_times(rows: DataFrame, source: str, hashed: str, times: str, names: dict[str, str], counted: bool) -> DataFrame:
    """rows, joined with the thresholds under names, with the number of times the mix takes each.

    counted: some hash has more rows than are taken of it, so its rows, equal to one another, are numbered.
    """
    passes, cut, copies, extra = (F.col(names[n]) for n in ("passes", "cut", "copies", "extra"))
    own = F.col(hashed)
    ends, fills = (own == cut) & (copies > 0), own == extra
    below = passes + (own < cut).cast("long")
    if not counted:
        return rows.withColumn(times, below + (ends | fills).cast("long"))
    number = F.row_number().over(Window.partitionBy(source, hashed).orderBy(hashed))
    some = rows.where(ends | fills).withColumn(times, number)
    some = some.withColumn(times, passes + (F.col(times) <= F.when(ends, copies).otherwise(1)).cast("long"))
    return rows.where(~(ends | fills)).withColumn(times, below).unionByName(some)


def _boundary(hist: DataFrame, budgets: DataFrame, *more: str) -> DataFrame:
    """Per source the bucket in which its budget ends, its tokens, what of the budget is left for it, and more columns."""
    upto = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    summed = hist.withColumn("upto", F.sum("tokens").over(upto)).alias("h").join(
        budgets.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source")))
    left = F.col("b.budget") - (F.col("h.upto") - F.col("h.tokens"))
    return summed.where((left >= 0) & (F.col("h.upto") > F.col("b.budget")) & (F.col("h.tokens") > 0)).select(
        "h.source", "h.prefix", "h.tokens", left.alias("budget"), *(f"h.{c}" for c in more))


def taken_sizes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = (1, 2, 3), max_passes: int = 3, seed: int = 9) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken (words the mix takes, repeats counted).

    A null text has size 0; a null source is a source of its own, after all others; of rows that are equal in id,
    text and source so many are taken as the budget asks, any of them. Columns beside the three named are ignored. An empty table gives no rows.
    """
    slim = shared.written(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        shared.word_count(shared.text_or_empty(text_col)).alias("size"),
        hashed_rows(docs, id_col, text_col, seed).alias("hashed")), "sizes")
    cuts = thresholds(slim, weights, max_passes)
    joined = slim.alias("s").join(cuts.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source"))).select(
        "s.*", "c.source_size", "c.target", "c.passes", "c.cut", "c.copies", "c.extra")
    names = {n: n for n in ("passes", "cut", "copies", "extra")}
    return _with_times(joined, "source", "hashed", "times", names, not cuts.where("counted").isEmpty()).select(
        "id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: Sequence[float] = (1, 2, 3), max_passes: int = 3, seed: int = 9) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (0 to max_passes times), with the columns of docs.

    Nulls, empty texts and equal rows as in taken_sizes; of equal rows any may stay, whatever their other columns
    hold. Rows of size 0 stay or go with their hash. An empty table gives no rows.
    """
    hashed = hashed_rows(docs, id_col, text_col, seed)
    slim = shared.written(docs.select(
        F.col(source_col).alias("source"), shared.word_count(shared.text_or_empty(text_col)).alias("size"),
        hashed.alias("hashed")), "sizes")
    names = {n: shared.free_name(f"mix_{n}", docs) for n in ("source", "passes", "cut", "copies", "extra", "hash", "copy", "times")}
    cuts = thresholds(slim, weights, max_passes)
    own = cuts.select(*(F.col(n).alias(names[n]) for n in ("source", "passes", "cut", "copies", "extra")))
    rows = docs.withColumn(names["hash"], hashed).join(own, F.col(source_col).eqNullSafe(F.col(names["source"])))
    timed = _with_times(rows, names["source"], names["hash"], names["times"], names, not cuts.where("counted").isEmpty())
    return timed.where(F.col(names["times"]) > 0).withColumn(
        names["copy"], F.explode(F.sequence(F.lit(1).cast("long"), names["times"]))).select(
        *(F.col(f"`{c}`") for c in docs.columns))
