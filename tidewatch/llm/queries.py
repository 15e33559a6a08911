"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat_masks,
    decontamination,
    language,
    lexical_search,
    line_rules,
    mixing,
    near_duplicates,
    path_templates,
    secret_ledger,
    sharding,
    shared,
    token_files,
    vector_codes,
    warc_archive,
)

#: The conversation that op5 adds to the table: its texts hold another template's control strings.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fused_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents (their source is the host) and all pages; the other kind's id is null."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    evidence = language.page_evidence(F.col("url"), F.col("html"))
    none = F.lit(None).cast("string")
    rows = docs.select(
        "doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.col("source").alias("host"),
        none.alias("domain"), none.alias("suffix"), none.alias("declared")).unionByName(
        pages.select(
            F.lit(None).cast("long").alias("doc_id"), "page_id", language.visible_text(F.col("html")).alias("text"),
            *(column.alias(name) for name, column in evidence.items())))
    found = language.identified(
        rows, language.trained(docs), text_col="text", host=F.col("host"), domain=F.col("domain"),
        suffix=F.col("suffix"), declared=F.col("declared"), keep=("doc_id", "page_id"))
    return found.select(
        "doc_id", "page_id", "language", F.round("confidence", 6).alias("confidence"),
        ((F.col("language") != language.UNDETERMINED) & (F.col("confidence") >= 0.5)).alias("kept"))


def op2_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assigned_shards(_table(spark, sf_dir, "documents"), 8)
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_benchmark_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scanned_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared.shared_folder(spark)}/tokens"
    files = token_files.write_token_files(
        _table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_token_files(files, folder).withColumnRenamed("id", "doc_id")


def op5_offset_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    blocks = chat_masks.formatted_blocks(
        turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
    return chat_masks.conversation_digests(shared.written(blocks, "formatted")).drop("n_tokens", "loss_tokens")


def op6_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judged_documents(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines", "n_kept_lines", F.length("cleaned").cast("long").alias("cleaned_chars"))


def op7_hyperminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.grouped_documents(_table(spark, sf_dir, "documents"), shingle_words=4).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op8_secret_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared.shared_folder(spark)}/ledger"
    docs = _table(spark, sf_dir, "documents")
    secret_ledger.findings_by_path(docs, folder, fresh=True)
    found = secret_ledger.findings_by_path(docs, folder)  # a second run over the ledger: no pair is left to scan

    def count(kind: str):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["rank"] < len(secret_ledger.BASE_RULES))
    return found.select(
        F.col("path").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secret_ledger.joined_spans(base), 256).alias("base_sha256"),
        secret_ledger.joined_spans(F.col("spans")).alias("spans"))


def op9_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_sizes(_table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared.shared_folder(spark)}/warc"
    files = warc_archive.write_archives(_table(spark, sf_dir, "pages"), folder)
    records = warc_archive.read_archives(files, folder, payloads=False)

    def number(name: str):
        return F.regexp_extract(F.coalesce(name, F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")

    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


def op11_interval_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnsRenamed(
        {"item": "item_id", "id": "doc_id"})


def op12_path_template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return path_templates.judged_urls(_table(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "template")


def op13_gnat_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed_vectors(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fused_language_id": op1_fused_language_id,
    "op2_sampled_splitter_shards": op2_sampled_splitter_shards,
    "op3_benchmark_automaton": op3_benchmark_automaton,
    "op4_elias_fano_tokens": op4_elias_fano_tokens,
    "op5_offset_masks": op5_offset_masks,
    "op6_line_first_quality": op6_line_first_quality,
    "op7_hyperminhash_dedup": op7_hyperminhash_dedup,
    "op8_secret_blob_ledger": op8_secret_blob_ledger,
    "op9_hash_threshold_mix": op9_hash_threshold_mix,
    "op10_warc_archive": op10_warc_archive,
    "op11_interval_ranked_search": op11_interval_ranked_search,
    "op12_path_template_filter": op12_path_template_filter,
    "op13_gnat_vector_codes": op13_gnat_vector_codes,
}
