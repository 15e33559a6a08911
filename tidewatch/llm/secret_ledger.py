"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger holds which (blob, rule version) pairs have been
scanned and what was found; a run scans the pairs it has not seen, once for each blob, and joins the findings
back to all paths that hold the blob. Built-in functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import shared


@dataclass(frozen=True)
class Rule:
    """kind; pattern (leftmost matches that do not overlap); group and at_least: code points that group must have."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0


#: The first three, in this order; assign's keyword may have letters in either case.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("prefixed", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,})"),
    Rule("url_login", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]++:[^\s:/@]{3,}+@"),
)
RULES = BASE_RULES + MORE_RULES
#: Matches whose spans are summed up in one array; longer lists are put together from such pieces.
PIECE = 64
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in code points: pieces between matches and the matches give the lengths to sum."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    parts = F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(matches, lambda x: F.length(x)).alias("span"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x)).alias("own"))
    none = F.array().cast(SPANS)
    zero = F.lit(0).cast("long")

    def length(part: Column) -> Column:
        return part["gap"] + F.coalesce(part["span"], F.lit(0))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.coalesce(part["span"], F.lit(0))
        found = F.array(F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        passes = part["own"].isNotNull() & (part["own"] >= rule.at_least)
        return F.struct(end.alias("at"), F.when(passes, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    def place(acc: Column, piece: Column) -> Column:
        size = F.aggregate(piece, zero, lambda n, part: n + length(part))
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def summed(pieces: Column) -> Column:
        starts = F.aggregate(
            pieces, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), place, lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, starts, lambda piece, start: F.aggregate(
            piece, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def cut(every: Column) -> Column:
        # an array that grows copies what it holds, so a text's matches are summed piece by piece
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(every) - 1) / PIECE).cast("int")),
            lambda k: F.slice(every, k * PIECE + 1, F.lit(PIECE)))

    return F.when(text.rlike(rule.pattern), _once(parts, lambda p: _once(cut(p), summed))).otherwise(none)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once although use reads it from within lambdas."""
    return F.transform(F.array(value), use)[0]


def rules_version(rules: tuple[Rule, ...], version: int | None = None) -> int:
    """A number that changes with the rules, so that blobs held in a ledger are scanned again; version where given."""
    return version if version is not None else int.from_bytes(hashlib.sha256(repr(rules).encode()).digest()[:4], "big") >> 1


def scanned(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: int | None = None) -> DataFrame:
    """(blob, text) to (blob, rule_version, spans): spans of all rules by start, then by the order of the rules."""
    found = F.concat(*(_spans(F.col("text"), rule, rank) for rank, rule in enumerate(rules)))
    return blobs.select("blob", F.lit(rules_version(rules, version)).alias("rule_version"), F.sort_array(found).alias("spans"))


def addressed(versions: DataFrame, path_col: str, text_col: str) -> DataFrame:
    """(path, blob) of every version; a null text is the empty blob."""
    return versions.select(F.col(path_col).alias("path"), F.sha2(shared.text_or_empty(text_col), 256).alias("blob"))


def ledger_update(versions: DataFrame, ledger: DataFrame | None, *, path_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES, version: int | None = None) -> DataFrame:
    """Rows to append to the ledger: one for each blob of versions not yet scanned under these rules.

    One row of each unseen blob is chosen by its address and path alone; only those rows' texts are joined and
    scanned, so a text with any number of copies is scanned once.
    """
    chosen = addressed(versions, path_col, text_col).groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        chosen = chosen.join(ledger.where(F.col("rule_version") == rules_version(rules, version)).select("blob"), "blob", "left_anti")
    chosen = shared.written(chosen, "unseen").alias("c")
    text = shared.text_or_empty(text_col)
    texts = versions.select(F.col(path_col).alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob")).alias("v")
    # a path may come again with the same text: those rows are equal, and one is kept by the group
    unseen = texts.join(chosen, (F.col("v.blob") == F.col("c.blob")) & F.col("v.path").eqNullSafe(F.col("c.path"))).select(
        "v.blob", "v.text")
    found = scanned(unseen, rules, version)
    return found.groupBy("blob", "rule_version").agg(F.first("spans").alias("spans"))


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"blob string, rule_version int, spans {SPANS}").parquet(folder)


def findings_by_path(versions: DataFrame, folder: str, *, path_col: str = "doc_id", text_col: str = "text",
                     rules: tuple[Rule, ...] = RULES, version: int | None = None, fresh: bool = False) -> DataFrame:
    """Bring the ledger in folder up to date, then give (path, blob, spans) for every row of versions.

    fresh: the folder does not exist yet. Null and empty texts have no spans; equal rows give equal rows; an
    empty table gives none. Other columns of versions are ignored.
    """
    spark = versions.sparkSession
    ledger = None if fresh else open_ledger(spark, folder)
    ledger_update(versions, ledger, path_col=path_col, text_col=text_col, rules=rules, version=version).write.mode(
        "append").parquet(folder)
    held = open_ledger(spark, folder).where(F.col("rule_version") == rules_version(rules, version))
    found = held.where(F.size("spans") > 0).select("blob", "spans")
    return addressed(versions, path_col, text_col).join(found, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
