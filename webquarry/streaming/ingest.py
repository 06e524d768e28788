"""Captured pages as a stream: each micro-batch appends what it changed to a page-state log."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from webquarry.functions import urls
from webquarry.operators.dedup import first_seen
from webquarry.operators.fingerprints import has_password, page_signature
from webquarry.operators.html import screens
from webquarry.operators.incremental import to_capture
from webquarry.streaming.state_log import Gap, StateLog

STATE = T.StructType([T.StructField("norm_url", T.StringType()), T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("signature", T.StringType()), T.StructField("batch", T.LongType())])


def page_state(pages: DataFrame) -> DataFrame:
    """norm_url, url, title, signature and has_password of captured pages, one row a normal URL."""
    read = screens(pages).withColumn("norm_url", urls.normalize_url(F.col("url")))
    rows = read.select("norm_url", "url", "title", page_signature().alias("signature"), has_password().alias("has_password"))
    return first_seen(rows, ["norm_url"], ["url", "signature"])


def state_log(spark: SparkSession, folder: str) -> StateLog:
    """The page-state log in a folder."""
    return StateLog(spark, folder, STATE, "norm_url")


def refresh(spark: SparkSession, folder: str, batch: DataFrame, number: int) -> DataFrame:
    """Append a batch's added and changed pages to the log as version ``number``; returns them.

    Looks the batch up in the state before it, so versions must come in order: a missing
    one raises Gap.  The stream (``start``) needs no such lookup.
    """
    log = state_log(spark, folder)
    base, after = log.versions()
    last = after[-1] if after else base
    if number > last + 1 or number <= base:
        raise Gap(f"version {number} cannot follow version {last}")
    before = log.read() if number > last else log.read().filter(F.col("batch") < number)
    fresh = to_capture(before, page_state(batch)).select("norm_url", "url", "title", "signature", F.lit(number).cast("long").alias("batch"))
    log.append(fresh, number)
    log.fold()
    return spark.read.schema(STATE).parquet(log._at("delta", number)) if number in log._whole("delta") else log.read().filter(F.col("batch") == number)


def _changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A URL's row of a batch, if its signature is not the one kept (or a password field guards it)."""
    rows = pd.concat(list(frames)).sort_values(["url", "signature"], kind="stable").head(1)
    signature, guarded = rows["signature"].iloc[0], bool(rows["has_password"].iloc[0])
    if not state.exists or state.get[0] != signature or guarded:
        state.update((signature,))
        yield rows[["norm_url", "url", "title", "signature"]]


def start(spark: SparkSession, source: str, folder: str, checkpoint: str, schema: str = "page_id long, url string, html string", files_per_batch: int = 1):
    """A query that reads new Parquet files of pages until none is left.

    Signatures are kept in Spark's keyed state under ``checkpoint``: a batch touches the
    keys that it has, and appends what it changed to the log.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    read = screens(stream).withColumn("norm_url", urls.normalize_url(F.col("url")))
    rows = read.select("norm_url", "url", "title", page_signature().alias("signature"), F.coalesce(has_password(), F.lit(False)).alias("has_password"))
    changed = rows.groupBy("norm_url").applyInPandasWithState(_changed, "norm_url string, url string, title string, signature string", "signature string", "append", "NoTimeout")
    log = state_log(spark, folder)

    def write(df: DataFrame, number: int) -> None:
        log.append(df.withColumn("batch", F.lit(number).cast("long")), number)
        log.fold()

    return changed.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RowLog(logging.Handler):
    """A log handler that gathers rows of level, line and time for a job."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[str, str, float]] = []

    def emit(self, record: logging.LogRecord) -> None:
        self.rows.append((record.levelname.lower(), record.getMessage(), record.created))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame(self.rows, "level string, line string, t double")
        return rows.select("level", "line", F.timestamp_seconds("t").alias("at"))


def by_level(logs: DataFrame, least: str = "info") -> DataFrame:
    """Log rows at a level or above."""
    rank = F.create_map(*[F.lit(x) for pair in (("debug", 10), ("info", 20), ("warn", 30), ("warning", 30), ("error", 40)) for x in pair])
    return logs.filter(rank[F.col("level")] >= rank[F.lit(least)])
