"""Rows of virtualised grids, gathered over scroll steps.

A step is what was rendered at one scroll position.  Steps are taken until
``max_steps``, the bottom, ``plateau`` steps without a new row, or ``max_rows``
rows; the row limit is looked at after a whole step, so it may be exceeded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webquarry.operators.dedup import first_seen

MAX_STEPS, PLATEAU, MAX_ROWS = 40, 3, 2000


def distinct_rows(rows: DataFrame, table: str = "table_id") -> DataFrame:
    """First occurrence of each row of a table by (step, pos); cells: array of strings."""
    keyed = rows.withColumn("row_key", F.array_join("cells", "\x01", ""))
    return first_seen(keyed, [table, "row_key"], ["step", "pos"]).drop("row_key")


def accumulated(rows: DataFrame, table: str = "table_id", max_steps: int = MAX_STEPS, plateau: int = PLATEAU, max_rows: int = MAX_ROWS) -> DataFrame:
    """Rows that scrolling would have kept: table, step, pos, cells.

    rows: one for each rendered row, with at_bottom of its step.  Windows run over
    the at most ``max_steps`` step counts of a table, not over its rows.
    """
    early = rows.filter(F.col("step") < max_steps)
    new = distinct_rows(early, table)
    per_step = early.groupBy(table, "step").agg(F.max(F.coalesce("at_bottom", F.lit(False))).alias("bottom"))
    fresh = new.groupBy(table, "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy(table).orderBy("step")
    steps = per_step.join(fresh, [table, "step"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # steps since the last one with a new row
    steps = steps.withColumn("last", F.max(F.when(F.col("n") > 0, F.col("step"))).over(w)).withColumn("idle", F.col("step") - F.coalesce("last", F.lit(-1)))
    ends = (F.sum("n").over(w) >= max_rows) | F.col("bottom") | (F.col("idle") >= plateau)
    stop = steps.withColumn("ends", ends).groupBy(table).agg(F.min(F.when(F.col("ends"), F.col("step"))).alias("stop"))
    return new.join(stop, table).filter(F.col("stop").isNull() | (F.col("step") <= F.col("stop"))).drop("stop", "at_bottom")


def deepened(shallow: DataFrame, deep: DataFrame) -> DataFrame:
    """Tables with their deep rows where headers agree or either has none; else as they were.

    Both: table_id, headers, rows.
    """
    d = deep.select("table_id", F.col("headers").alias("dh"), F.col("rows").alias("dr"))
    no_header = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    agree = F.col("dr").isNotNull() & (no_header("dh") | no_header("headers") | (F.array_join("dh", "|") == F.array_join("headers", "|")))
    joined = shallow.join(d, "table_id", "left")
    return joined.select("table_id", F.when(agree & ~no_header("dh"), F.col("dh")).otherwise(F.col("headers")).alias("headers"), F.when(agree, F.col("dr")).otherwise(F.col("rows")).alias("rows"))
