"""Language identification by Bayesian fusion of evidence.

The text gives likelihoods from letter trigrams; markup may declare a language, an address has a suffix, and a
host has a prior. Host priors are smoothed along host, domain and all rows, from sums of the text posteriors by
group. How far declarations and suffixes are to be trusted comes from such sums too. Wherever a row meets a sum, its
own posterior is taken out first. Texts are scored once; the scores are written and read by all that follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm import shared

GRAM_BITS = 15
#: Pseudo-counts with which a host leans on its domain, a domain on all rows, and tables on even shares.
LEAN = 5.0
UNDETERMINED = "und"
#: Hash bits of a level of the sample's histogram, and levels.
LEVEL_BITS, LEVELS = 12, 3
#: Texts held as Python objects at a time.
SLICE = 512

_SPACE = np.uint32(32)
_ASCII = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the letters of a text, runs of other ASCII characters being one blank."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes)
    blank = codes == _SPACE
    codes = codes[~(blank & np.concatenate([[True], blank[:-1]]))] if len(codes) else codes
    if not len(codes):
        return np.zeros(0, np.int64)
    codes = np.concatenate([[_SPACE], codes, [_SPACE]]).astype(np.uint32)
    mixed = (codes[:-2] * np.uint32(0x9E3779B1) ^ codes[1:-1] * np.uint32(0x85EBCA77)) + codes[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(32 - GRAM_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """labels; log-likelihoods of each trigram, one row per trigram and one column per label.

    evidence_grams: a text counts as so many independent trigrams at most, since neighbouring ones are not
    independent; its likelihood is the mean over all of its trigrams, raised to that power.
    """

    labels: list[str]
    table: np.ndarray
    evidence_grams: int = 40

    def scores(self, text: str | None) -> np.ndarray:
        """Number of trigrams, log-likelihood of the text under each label, posterior under even priors."""
        grams = trigrams(text or "")
        n = len(self.labels)
        out = np.zeros(1 + 2 * n)
        if len(grams):
            out[0] = len(grams)
            out[1:n + 1] = self.table[grams].mean(axis=0) * min(len(grams), self.evidence_grams)
            power = np.exp(out[1:n + 1] - out[1:n + 1].max())
            out[n + 1:] = power / power.sum()
        return out


def trained(labelled: DataFrame, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id",
            per_label: int = 500, evidence_grams: int = 40) -> Model:
    """A model from about per_label rows of each label, the ones with the smallest hashes; nulls have no label.

    The hash up to which rows are taken comes from counts by (label, hash prefix), of which the bucket that holds
    the per_label-th row is counted again by the next bits; nothing is ranked, and only the sample's texts are
    moved. Rows equal in id, label and text count as one in the model.
    """
    shared.prepare(labelled.sparkSession)
    text = F.col(text_col).cast("string")
    rows = labelled.select(
        F.col(label_col).cast("string").alias("label"),
        shared.positive_hash(F.col(id_col), F.col(label_col), text).alias("hash"), text.alias("text")).where(
        "label is not null and text is not null")
    slim = shared.written(rows.select("label", "hash"), "hashes")
    last = shared.written(_sample_ends(slim, per_label), "sample")
    sample = rows.join(last, "label").where(F.col("hash") < F.col("stop")).groupBy("label", "hash").agg(
        F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                counts = np.bincount(trigrams(text), minlength=2**GRAM_BITS)
                sums[label] = sums[label] + counts if label in sums else counts
            for label, counts in sums.items():
                grams = np.flatnonzero(counts)
                yield pa.RecordBatch.from_pydict(
                    {"label": [label] * len(grams), "gram": grams, "n": counts[grams].astype(np.int64)})

    counted = sample.select("label", "text").mapInArrow(count, "label string, gram bigint, n bigint").groupBy(
        "label", "gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    labels = sorted(set(counted["label"]))
    table = np.full((2**GRAM_BITS, len(labels)), 0.05)
    place = {label: k for k, label in enumerate(labels)}
    np.add.at(table, (np.array(counted["gram"], np.int64), [place[x] for x in counted["label"]]), counted["n"])
    return Model(labels, np.log(table / table.sum(axis=0)).astype(np.float32), evidence_grams)


def _sample_ends(slim: DataFrame, per_label: int) -> DataFrame:
    """(label, hash) to (label, stop): the end of the hash bucket with the label's per_label-th row, all buckets of 36 bits."""
    held = None
    for level in range(1, LEVELS + 1):
        shift = 63 - LEVEL_BITS * level
        rows = slim.withColumn("bucket", F.shiftright("hash", shift))
        if held is not None:
            inside = F.shiftright(F.col("bucket"), LEVEL_BITS) == F.col("held")
            rows = rows.join(held.select("label", F.col("bucket").alias("held"), "left"), "label").where(inside)
        else:
            rows = rows.withColumn("left", F.lit(per_label).cast("long"))
        counts = rows.groupBy("label", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("left").alias("left"))
        # a label has 4096 buckets a level at most
        upto = F.sum("n").over(Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        reached = counts.withColumn("upto", upto).groupBy("label").agg(
            F.min(F.when(F.col("upto") >= F.col("left"), F.struct("bucket", (F.col("left") - F.col("upto") + F.col("n")).alias("left")))).alias("at"),
            F.max("bucket").alias("most"))
        held = shared.written(reached.select(
            "label", F.coalesce("at.bucket", "most").alias("bucket"), F.coalesce("at.left", F.lit(2**62)).alias("left")), "held")
    return held.select("label", F.shiftleft(F.col("bucket") + 1, shift).alias("stop"))


def scoring(model: Model, spark) -> object:
    """An Arrow UDF: text to [trigrams, log-likelihoods, posteriors]."""
    held = shared.Held(spark.sparkContext.broadcast(model))

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pa.Array) -> pa.Array:
        own = shared.kept("language", held.id, lambda: held.value)
        width = 1 + 2 * len(own.labels)
        parts = (texts.slice(at, SLICE).to_pylist() for at in range(0, len(texts), SLICE))
        rows = [own.scores(t) for part in parts for t in part]
        flat = np.concatenate(rows) if rows else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width), pa.int32()), pa.array(flat))

    return score


def identified(rows: DataFrame, model: Model, *, text_col: str, host: Column | None = None,
               domain: Column | None = None, suffix: Column | None = None, declared: Column | None = None,
               names: tuple[str, str] = ("language", "confidence"), keep: Sequence[str] | None = None) -> DataFrame:
    """rows, or the columns of theirs to keep, with two more: the language and its posterior probability.

    host, domain, suffix and declared are expressions over rows; a null is no evidence. Declarations other than
    the model's labels are one class. A text without letters is undetermined ("und", 0.0), whatever its host,
    as is every text under a model without labels. Equal rows get equal results; an empty table gives none.
    """
    spark, labels, n = rows.sparkSession, model.labels, len(model.labels)
    language, confidence = names
    wanted = rows.columns if keep is None else list(keep)
    if not labels:
        return rows.select(*(F.col(f"`{c}`") for c in wanted), F.lit(UNDETERMINED).alias(language), F.lit(0.0).alias(confidence))
    nothing = F.lit(None).cast("string")
    said = nothing if declared is None else F.when(declared.isin(labels), declared).when(declared.isNotNull(), F.lit("?"))
    marks = [shared.free_name(f"tw_{m}", rows) for m in ("score", "host", "domain", "suffix", "declared")]
    score, own_host, own_domain, own_suffix, own_declared = marks
    scored = rows.select(
        *(F.col(f"`{c}`") for c in wanted), scoring(model, spark)(F.col(text_col).cast("string")).alias(score),
        *(((x if x is not None else nothing)).alias(m) for x, m in zip((host, domain, suffix, said), marks[1:])))
    scored = shared.written(scored, "scores")
    posterior = [F.col(score)[n + 1 + k] for k in range(n)]
    evidence = shared.written(
        scored.where(F.col(score)[0] > 0).groupBy(*marks[1:]).agg(
            F.count(F.lit(1)).alias("n"), *(F.sum(p).alias(f"p{k}") for k, p in enumerate(posterior))), "evidence")

    def summed(*by: str) -> DataFrame:
        return evidence.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ["n", *(f"p{k}" for k in range(n))]))

    total = summed().first()
    count = float(total["n"] or 0)
    trust = {r[own_declared]: [r[f"p{k}"] for k in range(n)] for r in summed(own_declared).collect() if r[own_declared]}
    classes = [*labels, "?"]
    suffixes = shared.written(_named(summed(own_suffix), own_suffix, "s", n), "suffixes")
    domains = _named(summed(own_domain), own_domain, "d", n)
    hosts = _named(summed(own_host), own_host, "h", n)
    # a row takes all of its host's evidence and its own domain's; rows of one host may differ in their domain
    key, key_domain = shared.free_name("tw_near_host", rows), shared.free_name("tw_near_domain", rows)
    near = shared.written(
        evidence.select(own_host, own_domain).distinct().join(hosts, own_host).join(domains, own_domain, "left")
        .withColumnRenamed(own_host, key).withColumnRenamed(own_domain, key_domain), "hosts")
    joined = scored.join(near, (F.col(own_host) == F.col(key)) & F.col(own_domain).eqNullSafe(F.col(key_domain)), "left").join(
        suffixes, own_suffix, "left")
    has = F.col(score)[0] > 0
    terms = []
    others = max(count - 1.0, 0.0)
    for k in range(n):
        def less_own(total: Column, k: int = k) -> Column:
            return F.greatest(F.coalesce(total, F.lit(0.0)) - posterior[k], F.lit(0.0))

        def count_of(kind: str) -> Column:
            return F.greatest(F.coalesce(F.col(f"tw_{kind}n"), F.lit(1)) - 1, F.lit(0)).cast("double")

        in_all = less_own(F.lit(float(total[f"p{k}"] or 0.0)))
        base = (in_all + LEAN / n) / (others + LEAN)
        domain_prior = (less_own(F.col(f"tw_d{k}")) + LEAN * base) / (count_of("d") + LEAN)
        host_prior = (less_own(F.col(f"tw_h{k}")) + LEAN * domain_prior) / (count_of("h") + LEAN)
        suffix_weight = F.when(F.col("tw_sn").isNull(), 1.0).otherwise(
            (less_own(F.col(f"tw_s{k}")) + LEAN * base) / (count_of("s") + LEAN) / base)
        declared_weight = F.lit(1.0)
        for d in classes:
            said_so = less_own(F.lit(float((trust.get(d) or [0.0] * n)[k])))
            declared_weight = F.when(
                F.col(own_declared) == d, (said_so + LEAN / len(classes)) / (in_all + LEAN)).otherwise(declared_weight)
        terms.append(F.col(score)[k + 1] + F.log(host_prior) + F.log(suffix_weight) + F.log(declared_weight))
    kept = [F.col(f"`{c}`") for c in wanted]
    logs, shares = shared.free_name("tw_logs", rows), shared.free_name("tw_shares", rows)
    summed_up = joined.select(*kept, has.alias(score), F.array(*terms).alias(logs)).select(
        *kept, score, F.transform(logs, lambda x: F.exp(x - F.array_max(logs))).alias(shares)).select(
        *kept, score, shares, F.array_max(shares).alias(logs))
    best = F.element_at(F.array(*(F.lit(x) for x in labels)), F.array_position(shares, F.col(logs)).cast("int"))
    total_share = F.aggregate(shares, F.lit(0.0), lambda x, y: x + y)
    return summed_up.select(
        *kept, F.when(F.col(score), best).otherwise(UNDETERMINED).alias(language),
        F.when(F.col(score), F.col(logs) / total_share).otherwise(0.0).alias(confidence))


def _named(sums: DataFrame, key: str, kind: str, n: int) -> DataFrame:
    return sums.where(F.col(key).isNotNull()).select(
        key, F.col("n").alias(f"tw_{kind}n"), *(F.col(f"p{k}").alias(f"tw_{kind}{k}") for k in range(n)))


def page_evidence(url: Column, html: Column) -> dict[str, Column]:
    """host, domain, suffix and declared language of a page; null where the page does not say."""
    def found(pattern: str, source: Column, group: int = 1) -> Column:
        got = F.lower(F.regexp_extract(source, pattern, group))
        return F.when(got != "", got)

    host = found(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url)
    named = F.when(host.rlike(r"[a-z]\.?$"), host)
    # under a country's own suffix the registry may have a second label: co.uk, com.au
    suffix = r"(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}|[^.]+)"
    declared = found(r"(?i)<html\b(?:[^>]*?\s)?lang\s*=\s*[\"']?([a-z]{2,3})\b", html)
    meta = found(r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?content-language\b)[^>]*?\bcontent\s*=\s*[\"']?([a-z]{2,3})\b", html)
    return {
        "host": host, "domain": found(rf"([^.]+\.{suffix})\.?$", named), "suffix": found(rf"\.({suffix})\.?$", named),
        "declared": F.coalesce(declared, meta)}


def visible_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments, tags and character references."""
    return F.regexp_replace(
        html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&#?\w{1,32};", " ")


def kept_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                   host_col: str = "source", min_confidence: float = 0.5) -> DataFrame:
    """The rows of docs whose language can be told, with their columns.

    Null and empty texts and texts without letters go; rows without labels train nothing, and without any label all
    rows go. Repeated rows stay repeated; an empty table gives none.
    """
    model = trained(docs, text_col=text_col, label_col=label_col, id_col=id_col)
    names = shared.free_name("tw_language", docs), shared.free_name("tw_confidence", docs)
    judged = identified(docs, model, text_col=text_col, host=F.col(host_col).cast("string"), names=names)
    return judged.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= min_confidence)).select(
        *(F.col(f"`{c}`") for c in docs.columns))
