"""The opN_* queries: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import bpe, cross_align, decontaminate, filter_audit, labelled, licenses, line_templates, near_dup, pii, quality_rules, quality_zstd, suffix_dedup, token_store, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(df: DataFrame, parts: int, held: int) -> DataFrame:
    held_out = F.coalesce(labelled.fold("doc_id", parts) == held, F.lit(False))
    return df.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null ids are not held out, null and empty texts are scored as texts without words."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(documents, table(spark, sf_dir, "labels"))
    return _scored(toxicity.score_toxicity(documents, model), toxicity.FOLDS, toxicity.HELD)


def op2_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without recurring messages, and n_dropped of every document; null texts stay null, a text may become empty."""
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and benchmark items of every document; null and wordless texts hit nothing, rows that repeat an id stay separate."""
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document; null and empty texts have no tokens."""
    vocabulary = bpe.Vocabulary.from_ranks(ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and both verdicts of every document; null and empty texts have no words and fail the base rule."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the digest of base spans and all spans of every document; null and empty texts have none."""
    return pii.personal_data_report(table(spark, sf_dir, "documents"))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, component and kept of every document, on four-word shingles; documents without words are linked with nothing."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_token_store(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """start, n_tokens and ids_crc32 of every document, as read back from the files; null and empty texts hold the end id alone, null ids come first."""
    path = token_store.new_store(spark, "op8")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), special=True)
    return token_store.token_digests(spark, path)


def op9_quality_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null ids are not held out, null and empty texts score alike."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_zstd.fitted(documents, table(spark, sf_dir, "labels"))
    return _scored(quality_zstd.score_quality(documents, model), quality_zstd.FOLDS, quality_zstd.HELD)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document by place, their number and the best coverage; null and empty texts have none."""
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op11_cross_align(spark: SparkSession, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Tokens, groups and links of both tokenizers in every document, with corpus-wide pair counts; zeros where there are no tokens."""
    path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    return cross_align.align(table(spark, sf_dir, "documents"), path_a, path_b)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and the digest of what remains of every document; null and empty texts have no bytes."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of every part, order of the five filters and step; null texts and parts count as empty."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage of corpus_pipeline, over all documents."""

    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_line_templates, op3_decontaminate, op4_byte_bpe, op5_quality_rules, op6_personal_data, op7_minhash_near_dup, op8_token_store, op9_quality_zstd, op10_license_scan, op11_cross_align, op12_suffix_dedup, op13_filter_audit, pipeline)}
ORACLES: dict[str, str] = {"op5_quality_rules": quality_rules.SQL, "op12_suffix_dedup": suffix_dedup.SQL, "op13_filter_audit": filter_audit.SQL}
