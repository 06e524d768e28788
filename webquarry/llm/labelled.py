"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts


def sample(documents: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """At most ``rows`` (text, label) pairs from the folds that are not held out.

    The labelled ids with the smallest hashes are taken, so the sample is the same
    on every run and independent of partitioning.  Null labels are left out; null
    texts count as empty.  Of documents that share an id, the smallest text counts.
    Ids must be whole numbers or null.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label).cast("int").alias("l_y")).filter(F.col("l_y").isNotNull() & F.col("l_id").isNotNull() & (fold("l_id", parts) != held))
    chosen = chosen.orderBy(F.xxhash64("l_id"), "l_id", "l_y").limit(rows)
    texts = documents.select(F.col(f"`{id_col}`").cast("long").alias("d_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    got = texts.join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).groupBy("d_id", "l_y").agg(F.min("text").alias("text")).toArrow()
    rows_by_id = sorted(zip(got["d_id"].to_pylist(), got["l_y"].to_pylist(), got["text"].to_pylist(), strict=True))
    return [(text, y) for _, y, text in rows_by_id]
