"""URL filters: fixed rules first, then a tree of path templates per host judged by its smoothed labelled purity.

Every segment of a path first gets its shape: digits become {n}, long hexadecimal names {h}, so a host with any
number of articles has few different shapes. The tree grows level by level over (host, shape path) rows, which
grouped sums have made from the pages. At each node a segment that holds a fair share of the node's pages keeps
a branch of its own; the others fall into one wildcard. Neighbouring branches whose pages are labelled alike, by
a chi-square test over good, bad and unlabelled pages, become one. A template's purity is its share of good
labels after adding some made-up ones; templates below a limit are rejected, with all pages that follow them.
Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm import shared


@dataclass(frozen=True)
class Rule:
    """A rule for a host with all its subdomains and for paths that start with path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TreeSettings:
    """max_depth: levels of the tree, what is deeper counts as part of the last segment; min_pages, min_share: pages
    and share of a node's pages that give a segment a branch of its own; alike: chi-square under which two branches
    are alike (5.991: two degrees of freedom, 5 %); good, bad: labels added to each template's; min_purity."""

    max_depth: int = 6
    min_pages: int = 5
    min_share: float = 0.02
    alike: float = 5.991
    good: int = 4
    bad: int = 1
    min_purity: float = 0.5


#: The rules of op 12's contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
#: Parts of a host's name that label its pages bad, where no rule does.
BAD_NAMES = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "xxx")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILDCARD = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, the first of equally long ones by text; null where none does."""
    texts, verdicts = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        texts = F.when(fits, F.lit(rule.text)).otherwise(texts)
        verdicts = F.when(fits, F.lit(rule.verdict)).otherwise(verdicts)
    return texts, verdicts


def named_bad(host: Column, names: Sequence[str] = BAD_NAMES) -> Column:
    """Whether a part of the host's name, between dots and hyphens, is one of the names."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*(F.lit(n) for n in names)).cast("array<string>"))


def shape_path(path: Column, max_depth: int) -> Column:
    """The segments of a path as shapes, at most max_depth: the last one takes all that is deeper.

    Hexadecimal names of 8 characters or more with a digit, and such names joined by hyphens, become {h}, runs of
    digits elsewhere {n}. What is no path has no segments.
    """
    shaped = F.transform(F.split(F.substring(path, 2, F.length(path)), "/", -1), lambda s: F.when(
        s.rlike(r"^(?=[a-f-]*[0-9])[0-9a-f]{8,}(-[0-9a-f]{4,})*$") & ~s.rlike("^[0-9]+$"), F.lit("{h}")).otherwise(
        F.regexp_replace(s, "[0-9]+", "{n}")))
    tail = F.array_join(F.slice(shaped, max_depth, F.greatest(F.size(shaped) - max_depth + 1, F.lit(0))), "/")
    whole = F.when(F.size(shaped) <= max_depth, shaped).otherwise(
        F.concat(F.slice(shaped, 1, max_depth - 1), F.array(tail)))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(whole)


def _alike(settings: TreeSettings) -> Column:
    """Whether a branch and the one before it are labelled alike; expects n, good, bad and before_n and so on."""
    total = F.col("n") + F.col("before_n")
    terms = []
    for here, there in (
            (F.col("good"), F.col("before_good")), (F.col("bad"), F.col("before_bad")),
            (F.col("n") - F.col("good") - F.col("bad"), F.col("before_n") - F.col("before_good") - F.col("before_bad"))):
        both = (here + there).cast("double")
        for part, size in ((here, F.col("n")), (there, F.col("before_n"))):
            expected = both * size / total
            terms.append(F.when(both > 0, (part - expected) * (part - expected) / expected).otherwise(0.0))
    return sum(terms[1:], terms[0]) < settings.alike


def _grown(rows: DataFrame, level: int, settings: TreeSettings) -> DataFrame:
    """rows with node one level deeper: a kept or joined branch, or the wildcard, for those that go so deep."""
    segment = F.col("segments")[level]
    deep = rows.where(F.size("segments") > level).withColumn("segment", segment)
    sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
    branches = shared.written(deep.groupBy("host", "node", "segment").agg(*sums), "branches")
    totals = branches.groupBy("host", "node").agg(F.sum("n").alias("total"))
    kept = branches.join(totals, ["host", "node"]).where(
        (F.col("n") >= settings.min_pages) & (F.col("n") >= settings.min_share * F.col("total"))).drop("total")
    # a node has at most 1 / min_share such branches, so what follows per node is small whatever the host's size
    in_order = Window.partitionBy("host", "node").orderBy(
        F.col("bad") / F.col("n"), F.col("good") / F.col("n"), "segment")
    ordered = kept.withColumns({f"before_{c}": F.lag(c).over(in_order) for c in ("n", "good", "bad")})
    runs = ordered.withColumn("starts", F.when(F.col("before_n").isNotNull() & _alike(settings), 0).otherwise(1)).withColumn(
        "run", F.sum("starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    names = runs.groupBy("host", "node", "run").agg(F.array_sort(F.collect_list("segment")).alias("segments"))
    branch = F.when(F.size("segments") == 1, F.col("segments")[0]).otherwise(
        F.concat(F.lit("("), F.array_join("segments", "|"), F.lit(")")))
    named = names.select("host", "node", branch.alias("branch"), F.explode("segments").alias("segment"))
    placed = deep.join(named, ["host", "node", "segment"], "left").select(
        "host", "segments", "n", "good", "bad",
        F.concat("node", F.lit("/"), F.coalesce("branch", F.lit(WILDCARD))).alias("node"))
    return placed.unionByName(rows.where(F.size("segments") <= level))


def path_templates(pages: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """(host, segments, bad) rows to (host, segments, template): the template of each shape path of each host.

    bad: true or false for labelled pages, null for others. Rows of an empty host are left out. n, good and bad
    come along, as sums over each shape path.
    """
    if settings.max_depth < 1:
        raise ValueError(f"max_depth must be at least 1, not {settings.max_depth}")
    if not 0 < settings.min_share <= 1:
        raise ValueError(f"min_share must be above 0 and at most 1, not {settings.min_share}")
    rows = shared.written(pages.where("host <> ''").groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("bad")).alias("good"), F.count_if(F.col("bad")).alias("bad")).withColumn(
        "node", F.lit("")), "shapes")
    deepest = rows.agg(F.max(F.size("segments"))).first()[0] or 0
    for level in range(deepest):
        rows = shared.written(_grown(rows, level, settings), "level")
    return rows.withColumnRenamed("node", "template")


def template_purity(templates: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """(host, template, n, good, bad, purity) of path_templates, a row a template."""
    good, bad = F.col("good") + settings.good, F.col("bad") + settings.bad
    return templates.groupBy("host", "template").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "bad"))).withColumn("purity", good / (good + bad))


def judged_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Sequence[Rule] = RULES,
                bad_label: Column | None = None, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """One row per row of pages: id, host, path, rule, verdict, by (rule or template), template purity.

    The longest fitting rule decides; elsewhere pages whose template is rejected are blocked, all others allowed.
    Labels are the rules' verdicts and, where no rule fits, bad_label (true: bad, false: good, null: none), by
    default bad for hosts named_bad. Null urls and those without :// have empty host and path, no template, and
    are allowed. Repeated rows keep their rows and count as pages each; an empty table gives none; other columns
    are ignored but for those that bad_label reads.
    """
    host, path = url_parts(F.col(url_col).cast("string"))
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    named = F.when(named_bad(host), True)
    slim = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), (
        named if bad_label is None else bad_label).alias("label")).withColumns(
        {"rule": text, "ruled": verdict, "segments": shape_path(F.col("path"), settings.max_depth)})
    labelled = slim.select("host", "segments", F.coalesce(F.col("ruled") == "block", "label").alias("bad"))
    templates = shared.written(path_templates(labelled, settings), "templates")
    purity = template_purity(templates, settings)
    known = templates.select("host", "segments", "template").join(
        purity.select("host", "template", "purity"), ["host", "template"])
    judged = slim.join(known, ["host", "segments"], "left")
    by_template = F.when(F.col("purity") < settings.min_purity, "block").otherwise("allow")
    return judged.select(
        "id", "host", "path", "rule", F.coalesce("ruled", by_template).alias("verdict"), "template", "purity")
