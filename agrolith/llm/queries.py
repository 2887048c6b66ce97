"""Queries that apply the operators of this subpackage to whole tables, with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm import chunked_bpe, decontamination, hard_negatives, language_id, licenses, line_quality, merkle, near_duplicates, pii, quality_rules, secrets, sentencepiece_codec, sharding
from agrolith.llm.common import held_fold
from agrolith.llm.oracles import ORACLES  # noqa: F401  beside QUERIES


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [secrets.count_of(base, k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, sha256_of(secrets.joined(base)).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op2_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes."""
    placed = sharding.minimax_shards(table(spark, sf_dir, "documents", "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through the 32k BPE model and back."""
    import public_tokenizers

    coded = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_of(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the quality rules on every text."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *(F.round(c, 6).alias(c) for c in ("class_distance", "word_distance")))


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, learned from the labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    fold = held_fold(F.col("doc_id"), 3)
    model = line_quality.train(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), fold != 1)
    scored = line_quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that leak into documents."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_signature_join_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_tfidf_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files source/lang/d<n>/<name>; short documents (up to 400 characters) are licence files by name."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    name = F.concat(F.when(F.col("n_chars") <= 400, F.lit("LICENSE.")).otherwise(F.lit("text.")), F.col("doc_id").cast("string"))
    folder = F.concat(F.lit("d"), F.pmod(F.floor(F.col("doc_id") / 10), F.lit(100)).cast("string"))
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", folder, name).alias("path"))
    return licenses.scan(files).drop("path")


def op9_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from the documents outside fold 2 of 4."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = held_fold(F.col("doc_id"), 4)
    found = language_id.identify(docs, language_id.train(docs, fold != 2))
    return found.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text."""
    found = secrets.find_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    counts = [secrets.count_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, sha256_of(secrets.joined(base)).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op11_residual_pq_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, among all vectors."""
    key = F.col("vec_id")
    label = F.when(key % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), label, key % 100 == 0)


def op12_duckdb_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every document, and what tampering with every third one's case makes of it."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.coalesce(held_fold(F.col("doc_id"), 3) == 0, F.lit(False))
    return merkle.merkle_manifest(table(spark, sf_dir, "documents", *fields), fields, "lang", "doc_id", {"text": lower}, tampered)


def op13_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through the 49k BPE tokenizer and back."""
    import public_tokenizers

    coded = chunked_bpe.encode_decode(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_of(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_of(F.col("decoded")).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_minimax_sharding": op2_minimax_sharding,
    "op3_sentencepiece_codec": op3_sentencepiece_codec,
    "op4_divergence_rules": op4_divergence_rules,
    "op5_line_crf_quality": op5_line_crf_quality,
    "op6_latent_decontamination": op6_latent_decontamination,
    "op7_signature_join_minhash": op7_signature_join_minhash,
    "op8_tfidf_licenses": op8_tfidf_licenses,
    "op9_string_kernel_language": op9_string_kernel_language,
    "op10_trigram_secrets": op10_trigram_secrets,
    "op11_residual_pq_negatives": op11_residual_pq_negatives,
    "op12_duckdb_merkle": op12_duckdb_merkle,
    "op13_chunk_reuse_bpe": op13_chunk_reuse_bpe,
}
