"""Page state of a stream as a log: one delta a batch, now and then folded into a base.

A batch writes only the rows that it changed, so its cost does not depend on the size
of the state; what changed is told by Spark's own keyed state, or by a lookup.  The
state is, for every key, its row of the highest version.  ``delta/<version>`` and
``base/<version>`` count once they are whole (Spark's _SUCCESS file), and a base stands
for all versions up to its own.  Readers ask for every version after the base: a hole
raises Gap instead of giving an older state.

Every FOLD versions the log is folded.  That reads the state once for FOLD batches; the
old files go after the new base is whole, so a run that dies in between loses nothing.
A batch that is run again writes its version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLD = 32


class Gap(RuntimeError):
    """A version of the log is missing."""


class StateLog:
    """Rows of ``schema`` by ``key``; versions count from 0."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, kind: str, version: int) -> str:
        return f"{self.folder}/{kind}/{version:012d}"

    def _whole(self, kind: str) -> list[int]:
        at = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(at):
            return []
        found = [f.getPath().getName() for f in self._fs.listStatus(at)]
        return sorted(int(n) for n in found if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def versions(self) -> tuple[int, list[int]]:
        """The base (-1: none) and the versions after it; a hole raises Gap."""
        base = max(self._whole("base"), default=-1)
        after = [v for v in self._whole("delta") if v > base]
        missing = sorted(set(range(base + 1, (after[-1] if after else base) + 1)) - set(after))
        if missing:
            raise Gap(f"{self.folder} lacks version {missing[0]}, but has {after[-1]}")
        return base, after

    def append(self, rows: DataFrame, version: int) -> None:
        """Write the rows that a version changed; at most one row a key."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._at("delta", version))

    def delta(self, version: int) -> DataFrame:
        """The rows that a version changed."""
        if version not in self._whole("delta"):
            raise Gap(f"{self.folder} lacks version {version}")
        return self.spark.read.schema(self.schema).parquet(self._at("delta", version))

    def read(self) -> DataFrame:
        """The state after the last version."""
        base, after = self.versions()
        parts = [("base", base)] * (base >= 0) + [("delta", v) for v in after]
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for kind, v in parts:
            df = self.spark.read.schema(self.schema).parquet(self._at(kind, v)).withColumn("log_version", F.lit(v))
            rows = df if rows is None else rows.unionByName(df)
        row = F.struct(*self.schema.names)
        return rows.groupBy(F.col(self.key).alias("log_key")).agg(F.max_by(row, "log_version").alias("row")).select("row.*")

    def fold(self, every: int = FOLD) -> bool:
        """Fold the log into a new base if ``every`` versions or more came after the last; whether it did."""
        base, after = self.versions()
        if len(after) < every:
            return False
        self.read().write.mode("overwrite").parquet(self._at("base", after[-1]))
        self.sweep()
        return True

    def sweep(self) -> None:
        """Delete what the newest whole base stands for."""
        bases = self._whole("base")
        for kind, versions in (("base", bases[:-1]), ("delta", [v for v in self._whole("delta") if bases and v <= bases[-1]])):
            for v in versions:
                self._fs.delete(self._path(self._at(kind, v)), True)
