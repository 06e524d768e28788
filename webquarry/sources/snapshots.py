"""Versioned snapshots of several tables with one commit point.

A version is a manifest, one small JSON file; it names for every table the parts that
make it up, and data files are never changed.  Tables are written first, and the
manifest is renamed into place last and never over another: a run that dies before
leaves the version before as it was, and of two runs that start from one version the
second to commit raises Conflict.  The current version is the highest manifest.

A table that a run does not touch is carried forward by reference.  One of which rows
change (``Delta``) keeps its parts: the keys that were replaced or removed become a
small table that readers leave out of older parts, and the new rows a part of their
own.  After COMPACT_PARTS parts a commit writes the table anew.

The folder must be on a file system where rename does not replace a file (HDFS, local).
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

COMPACT_PARTS = 8


class Conflict(RuntimeError):
    """Another run has committed on the same version."""


class Delta(NamedTuple):
    """Changes of a table: rows that are new or replace those of the same key, and keys that go."""

    rows: DataFrame
    removed: DataFrame | None = None
    key: str = "id"


class Version(NamedTuple):
    """A committed version: its number, the settings of its run, and the parts of each table."""

    number: int
    settings: dict
    tables: dict


class Snapshots:
    """The versions in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, number: int) -> str:
        return f"{self.folder}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        """Committed versions in order."""
        at = self._path(f"{self.folder}/versions")
        if not self._fs.exists(at):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """A version, or the current one; None where there is none yet."""
        if number is None:
            found = self.numbers()
            if not found:
                return None
            number = found[-1]
        stream = self._fs.open(self._path(self._manifest(number)))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(number, **json.loads(text))

    def _publish(self, number: int, settings: dict, tables: dict) -> None:
        staged = self._path(f"{self.folder}/versions/.staged-{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps({"settings": settings, "tables": tables}, indent=1).encode()))
        stream.close()
        target = self._path(self._manifest(number))
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise Conflict(f"version {number} of {self.folder} is there already")

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{path}")
        return path

    def read(self, name: str, version: Version | None = None) -> DataFrame | None:
        """A table of a version (the current one by default), or None if the version lacks it."""
        version = version or self.version()
        entry = version.tables.get(name) if version else None
        if entry is None:
            return None
        schema = T.StructType.fromJson(entry["schema"])
        out = None
        for part in entry["parts"]:
            df = self.spark.read.schema(schema).parquet(f"{self.folder}/{part['path']}")
            if part["without"]:
                gone = self.spark.read.parquet(*[f"{self.folder}/{p}" for p in part["without"]])
                df = df.join(gone, entry["key"], "left_anti").select(*schema.names)
            out = df if out is None else out.unionByName(df)
        return out

    def commit(self, changes: dict[str, DataFrame | Delta], settings: dict, base: Version | None = None) -> Version:
        """Write changed tables and publish the next version; tables that ``changes`` lacks are carried forward.

        A DataFrame replaces its table.  base is the version that the run has read.
        """
        number = base.number + 1 if base else 1
        tables = dict(base.tables) if base else {}
        for name, change in changes.items():
            if not isinstance(change, Delta):
                tables[name] = {"schema": change.schema.jsonValue(), "key": None, "parts": [{"path": self._write(change, name), "without": []}]}
                continue
            entry = tables.get(name)
            if entry is None:
                parts = []
            else:
                keys = change.rows.select(change.key)
                keys = keys.unionByName(change.removed.select(change.key)) if change.removed is not None else keys
                gone = self._write(keys.distinct(), f"{name}-gone")
                parts = [{"path": p["path"], "without": [*p["without"], gone]} for p in entry["parts"]]
            parts = [*parts, {"path": self._write(change.rows, name), "without": []}]
            tables[name] = {"schema": change.rows.schema.jsonValue(), "key": change.key, "parts": parts}
            if len(parts) > COMPACT_PARTS:
                whole = self.read(name, Version(number, settings, tables))
                tables[name] = {**tables[name], "parts": [{"path": self._write(whole, name), "without": []}]}
        self._publish(number, settings, tables)
        return Version(number, settings, tables)

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all but the last versions, and data that no version left names; returns what went.

        Not to be run beside a commit, whose tables no manifest names yet.
        """
        numbers = self.numbers()
        stay = [self.version(n) for n in numbers[-keep:]]
        named = {p for v in stay for t in v.tables.values() for x in t["parts"] for p in [x["path"], *x["without"]]}
        for n in numbers[:-keep]:
            self._fs.delete(self._path(self._manifest(n)), False)
        at = self._path(f"{self.folder}/data")
        found = [f"data/{f.getPath().getName()}" for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        gone = sorted(set(found) - named)
        for p in gone:
            self._fs.delete(self._path(f"{self.folder}/{p}"), True)
        return gone
