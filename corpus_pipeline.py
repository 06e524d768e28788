"""Corpus cleaning in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and reads it back as the next stage's documents.
All but the last keep the columns of ``documents``; n_chars follows the text.

Null and empty texts pass every stage (the model sees no words in them; they hold no lines or windows, are
linked with nothing) and have no tokens in the last.  Rows that repeat an id stay
separate rows, but near_dup keeps or drops all rows of an id alike; ids must be whole
numbers or null, and rows without one are never dropped as copies.  Ties (equal texts,
equal ids) are settled by the smallest id, never by the order of rows.  An empty table
gives an empty table; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import bpe, decontaminate, line_templates, near_dup, toxicity
from webquarry.llm.queries import table
from webquarry.llm.store import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold; null and empty texts are scored as texts without words."""
    return toxicity.drop_toxic(docs, toxicity.fitted(docs, table(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without messages whose template recurs across documents; null texts stay null, a text may become empty."""
    out = line_templates.drop_recurring_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates: five-word shingles, similarity 0.8 or more;
    documents without words, and rows without an id, all stay."""
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark; null and wordless texts stay, null items match nothing."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token digests of every document left, its ids decoded again; null and empty texts have no tokens."""
    vocabulary = bpe.Vocabulary.from_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip_digests(docs, vocabulary)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("near_dup", drop_near_duplicates), ("decontamination", drop_contaminated), ("byte_bpe", encode)]

#: SQL expresses neither the model nor the tree; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return docs
