"""Captured pages and snapshots of earlier runs, and writers for both."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webquarry.functions import urls
from webquarry.operators.incremental import Checkpoint
from webquarry.sources.snapshots import Snapshots, Version


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: Parquet with page_id, url, html; any further columns stay."""
    return spark.read.parquet(path)


def accepted(captures: DataFrame) -> DataFrame:
    """Captures to analyse: status below 400 or unknown, and landed where they were asked for.

    captures: url, status, final_url, is_seed, replayed; a seed may land elsewhere, and
    a capture that was reached by replaying its way stands whatever its status.
    """
    replayed = F.coalesce("replayed", F.lit(False))
    status = F.col("status").isNull() | (F.col("status") < 400) | replayed
    landed = F.coalesce("is_seed", F.lit(False)) | F.col("final_url").isNull() | (urls.normalize_url(F.col("final_url")) == urls.normalize_url(F.col("url")))
    return captures.filter(status & landed)


def read_if_present(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The Parquet table at a path, or None if there is none; other errors are raised."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e.getCondition() or e):
            return None
        raise


def write_snapshot(folder: str, checkpoint: Checkpoint, tables: dict[str, DataFrame]) -> Version:
    """Commit a run as the folder's next version: its tables and its settings, all or nothing."""
    store = Snapshots(next(iter(tables.values())).sparkSession, folder)
    return store.commit(tables, asdict(checkpoint), store.version())


def read_checkpoint(spark: SparkSession, folder: str) -> Checkpoint | None:
    """Settings of the run saved last, or None where there is none."""
    version = Snapshots(spark, folder).version()
    return Checkpoint(**version.settings) if version else None


def read_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tables of the run saved last."""
    store = Snapshots(spark, folder)
    version = store.version()
    return {name: store.read(name, version) for name in version.tables} if version else {}


def write_documents(entries: DataFrame, folder: str) -> None:
    """One text file a partition of documents, each under a line with its id."""
    entries.select(F.concat(F.lit("<!-- "), F.col("id"), F.lit(" -->\n"), F.col("markdown")).alias("value")).write.mode("overwrite").text(folder)


def write_json(df: DataFrame, folder: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(folder)


def pretty_row(df: DataFrame) -> str:
    """The single row of an artefact as indented JSON."""
    return json.dumps(json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0]), indent=2, ensure_ascii=False)
