"""Line-first cleaning: rules for punctuation, navigation and boilerplate on each line; lines that fail are
removed, and a document that loses too much of its text is rejected. Built-in functions only.

Besides, the base counts of a text: words, symbols, repeated lines, and words in repeated 5-word windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import shared

WINDOW = 5
#: A sentence's end, with closing quotes or brackets after it.
ENDS_WELL = r"""[.!?…:;。！？]["'”’»)\]]*\s*$"""
#: Separators of menus and breadcrumbs between short labels.
MENU_MARK = r"[|›»•·]|\s>\s|\s/\s"
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies"
    r"|enable javascript|click here|sign up|subscribe to|log in|skip to content|share (this|on)|lorem ipsum"
    r"|copyright \(c\)|©)"
)


@dataclass(frozen=True)
class LineLimits:
    """min_words: a line without a sentence's end needs so many words. menu_share: separators a word from which
    a line is a menu. min_kept: share of the characters that a document has to keep."""

    min_words: int = 4
    menu_share: float = 0.3
    min_kept: float = 0.5


def _line_passes(line: Column, limits: LineLimits) -> Column:
    n = shared.word_count(line)
    menu = F.size(F.split(line, MENU_MARK, -1)) - 1
    return (
        (line.rlike(ENDS_WELL) | (n >= limits.min_words))
        & ~((menu >= 2) & (menu >= n * F.lit(limits.menu_share)))
        & ~line.rlike(BOILERPLATE)
    )


def _from(name: str, k: int) -> Column:
    """An array without its first k elements.

    Shifted arrays stand side by side instead of being indexed in a lambda: a filter on the result may move
    the array's own expression there, to be evaluated once for each element.
    """
    return F.slice(name, k + 1, F.greatest(F.size(name), F.lit(0))) if k else F.col(name)


def judged_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                     limits: LineLimits = LineLimits()) -> DataFrame:
    """One row per row of docs: id, cleaned (the text without its failing lines), the counts, the verdicts.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    one), n_repeat_words (words in windows of five that come twice or more in the text), n_lines (with a word),
    n_kept_lines, base_failed, kept. Null texts are as empty ones: no words, hence base_failed. Everything is
    computed within its row; an empty table gives no rows; other columns of docs are ignored.
    """
    text = shared.text_or_empty(text_col)
    split = docs.select(F.col(id_col).alias("id"), text.alias("text"), shared.words(text).alias("words"))
    has_word = r"[^\x20\x09-\x0D]"
    counted = split.select(
        "id", "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.when(F.size("words") >= WINDOW, F.transform(
            F.slice(F.arrays_zip(*(_from("words", k).alias(f"w{k}") for k in range(WINDOW))), 1, F.size("words") - WINDOW + 1),
            lambda row: F.xxhash64(*(row[f"w{k}"] for k in range(WINDOW))),
        )).otherwise(F.array().cast("array<bigint>")).alias("windows"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(has_word)).alias("lines"),
    )
    sorted_windows = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    placed = counted.select(
        "id", "text", "n_words", "word_chars", "lines", sorted_windows.alias("placed"),
        F.filter("lines", lambda x: _line_passes(x, limits)).alias("passing"))
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), "placed")
    neighbours = F.arrays_zip(F.col("placed").alias("own"), before.alias("before"), _from("placed", 1).alias("after"))
    again = F.filter(neighbours, lambda x: (
        (x["before"]["h"] == x["own"]["h"]) | F.coalesce(x["after"]["h"] == x["own"]["h"], F.lit(False))))
    starts = F.sort_array(F.transform(again, lambda x: x["own"]["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    line_chars = F.length(F.array_join("lines", ""))
    kept_chars = F.length(F.array_join("passing", ""))
    rated = placed.select(
        "id", F.array_join("passing", "\n").alias("cleaned"), "n_words", "word_chars",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"), F.size("passing").cast("long").alias("n_kept_lines"),
        (kept_chars >= line_chars * F.lit(limits.min_kept)).alias("keeps_enough"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rated.select(
        "id", "cleaned", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
        "n_kept_lines", failed.alias("base_failed"), (~failed & F.col("keeps_enough")).alias("kept"))
