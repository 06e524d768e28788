"""Stored intermediate tables, broadcasts of a checked size, and joins whose heavy keys are split."""

from __future__ import annotations

import contextlib
import gc
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.store import discard, shared_folder, stored_at

__all__ = ["discard", "freed", "joined", "shared_folder", "small", "stored"]


#: Rows in an Arrow batch while a stored table is computed: sets and texts are long.
ARROW_ROWS = "1000"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: str = ARROW_ROWS) -> Iterator[None]:
    """A smaller Arrow batch for what runs inside; the session's own setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str, rows: str = ARROW_ROWS) -> tuple[DataFrame, str]:
    """stored_at() with small Arrow batches: df written as Parquet and read again, and its path."""
    with arrow_rows(df.sparkSession, rows):
        return stored_at(df, name)


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that are written by now; its cleaner follows garbage collection."""
    for _ in range(2):  # the first round lets go of plans, the second of the files behind them
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Rows of one long column up to which a broadcast is allowed: at most about 64 MB.
BROADCAST_IDS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_IDS) -> bool:
    """Whether a stored table has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


#: Left rows of one key from which it counts as heavy, and the tasks that such a key is split over.
HEAVY, SPLITS = 50_000, 64


def joined(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner", rows: int = BROADCAST_IDS) -> DataFrame:
    """left joined with a stored right that has at most one row a key, whatever a key's share of left.

    A right of at most ``rows`` rows is broadcast (0 where its rows are long).  Else
    both are shuffled, and keys with HEAVY left rows or more, which are at most one in
    HEAVY of left's rows, are spread over SPLITS tasks by a hash of left's column ``by``,
    which must tell the rows of a key apart: the key itself raises ValueError.
    """
    if by == key:
        raise ValueError(f"{key} cannot spread its own rows")
    if rows and small(right, rows):
        return left.join(F.broadcast(right), key, how)
    heavy, _ = stored(left.groupBy(key).count().filter(F.col("count") >= HEAVY).select(key, F.lit(True).alias("webquarry_heavy")), "heavy")
    heavy = F.broadcast(heavy) if small(heavy) else heavy
    split = F.when(F.col("webquarry_heavy"), F.pmod(F.xxhash64(by), F.lit(SPLITS))).otherwise(0).cast("int")
    copies = F.when(F.col("webquarry_heavy"), F.sequence(F.lit(0), F.lit(SPLITS - 1))).otherwise(F.array(F.lit(0)))
    spread = left.join(heavy, key, "left").withColumn("webquarry_split", split).drop("webquarry_heavy")
    copied = right.join(heavy, key, "left").withColumn("webquarry_split", F.explode(copies)).drop("webquarry_heavy")
    return spread.join(copied, [key, "webquarry_split"], how).drop("webquarry_split")
