"""First-seen representatives, visited sets and keyed upserts.

Order is always an explicit column, so results do not depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the first in order.

    Rows meet by a minimum over a struct, which is combined before the exchange,
    so a key with a third of all rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    picked = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*[F.col(f"`{c}`") for c in lead])) if lead else F.first(F.struct(*rest))
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(picked.alias("webquarry_first"))
    return out.select(*[F.col(f"`{c}`") if c in keys else F.col("webquarry_first")[c].alias(c) for c in df.columns])


def representatives(df: DataFrame, key: Column, order: list[str], name: str = "is_representative") -> DataFrame:
    """df with a flag on the first row of each key.

    The first rows are found by a partial minimum and joined back; a null key is a
    key like any other.
    """
    keyed = df.withColumn("webquarry_k", key)
    lead = F.struct(*order)
    firsts = keyed.groupBy(F.col("webquarry_k").alias("webquarry_fk")).agg(F.min(lead).alias("webquarry_lead"))
    joined = keyed.join(firsts, F.col("webquarry_k").eqNullSafe(F.col("webquarry_fk")))
    return joined.withColumn(name, F.struct(*order) == F.col("webquarry_lead")).drop("webquarry_k", "webquarry_fk", "webquarry_lead")


def unvisited(frontier: DataFrame, visited: DataFrame, key: str = "norm_url", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """First rows of keys that the visited table does not hold."""
    return first_seen(frontier.join(visited.select(key).distinct(), key, "left_anti"), [key], list(order))


def unvisited_states(screens: DataFrame, visited: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Screens whose (norm_url, fingerprint) is new; seeds always stay."""
    seed = F.col("discovered_via") == "seed"
    fresh = screens.filter(~F.coalesce(seed, F.lit(False))).join(visited.select("norm_url", "fingerprint").distinct(), ["norm_url", "fingerprint"], "left_anti")
    new = first_seen(fresh, ["norm_url", "fingerprint"], list(order))
    seeds = screens.filter(seed)
    taken = seeds.select("norm_url", "fingerprint").distinct()
    return seeds.unionByName(new.join(taken, ["norm_url", "fingerprint"], "left_anti"))


def upserted(base: DataFrame, delta: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """base with delta's rows put in place by key; a replaced row keeps its place in order.

    Where delta repeats a key, its row with the largest order wins.
    """
    columns = base.columns
    tagged = base.withColumn("webquarry_new", F.lit(0)).unionByName(delta.select(*columns).withColumn("webquarry_new", F.lit(1)))
    rest = [c for c in columns if c not in keys and c != order]
    newest = F.max_by(F.struct(*rest), F.struct("webquarry_new", order)).alias("webquarry_row")
    out = tagged.groupBy(*keys).agg(newest, F.min_by(F.col(order), F.struct("webquarry_new", order)).alias(order))
    return out.select(*[F.col(c) if c in keys or c == order else F.col("webquarry_row")[c].alias(c) for c in columns])


def distinct_buttons(buttons: Column) -> Column:
    """Buttons without repeats of text and locator, in first-seen order."""
    return F.array_distinct(buttons)


def distinct_columns(tables: Column) -> Column:
    """Column names across tables, in first-seen order."""
    return F.array_distinct(F.flatten(F.transform(tables, lambda t: t["headers"])))


def distinct_labels(candidates: Column) -> Column:
    return F.array_distinct(F.transform(candidates, lambda c: c["label"]))


def revealed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of after whose keys before does not hold."""
    return after.join(before.select(*keys).distinct(), keys, "left_anti")


def first_per_group(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, the first in order (a feature: budgets and caps)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("webquarry_n", F.row_number().over(w)).filter(F.col("webquarry_n") <= limit).drop("webquarry_n")
