"""Refresh against an earlier run: what is new, changed, unchanged or gone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.functions import urls
from webquarry.operators.dedup import first_seen, upserted
from webquarry.operators.graph import edge_set, without_outgoing


@dataclass(frozen=True)
class Checkpoint:
    """Settings of a saved run."""

    version: int
    start_url: str
    max_depth: int
    same_site: bool


def usable_checkpoint(saved: Checkpoint | None, start_url: str, max_depth: int, same_site: bool) -> bool:
    """Whether a saved run can be refreshed; settings that differ ask for a fresh run.

    A saved run of another version or start raises ValueError.
    """
    if saved is None:
        return False
    if saved.version != 1 or urls.normalize(saved.start_url) != urls.normalize(start_url):
        raise ValueError(f"the saved run starts at {saved.start_url} (format {saved.version}), not at {start_url}")
    return saved.max_depth == max_depth and saved.same_site == same_site


def classified(old: DataFrame, new: DataFrame) -> DataFrame:
    """norm_url and status (added, changed, unchanged, missing) from tables of norm_url, signature.

    A page with a password field (has_password in new) is never unchanged.
    """
    o = old.select("norm_url", F.col("signature").alias("old_signature"), F.lit(True).alias("was"))
    guarded = F.col("has_password") if "has_password" in new.columns else F.lit(False)
    n = new.select("norm_url", F.col("signature").alias("new_signature"), guarded.alias("guarded"), F.lit(True).alias("is"))
    same = F.col("old_signature").eqNullSafe(F.col("new_signature")) & ~F.coalesce("guarded", F.lit(False))
    status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(same, "unchanged").otherwise("changed")
    return o.join(n, "norm_url", "full_outer").select("norm_url", status.alias("status"))


def to_capture(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that are added or changed."""
    keep = classified(old, new).filter(F.col("status").isin("added", "changed")).select("norm_url")
    return new.join(keep, "norm_url", "left_semi")


def merged_state(old: DataFrame, captured: DataFrame, kept_urls: DataFrame) -> DataFrame:
    """Page state after a run: captured rows replace old ones; pages that left the graph go."""
    fresh = first_seen(captured.select(*old.columns), ["norm_url"], ["url"])
    stale = old.join(fresh.select("norm_url"), "norm_url", "left_anti")
    return stale.unionByName(fresh).join(kept_urls.select("norm_url").distinct(), "norm_url", "left_semi")


def merged_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graph after a run: nodes by id in first-insert order; links of changed pages replaced."""
    return upserted(nodes, new_nodes, ["id"]), edge_set(without_outgoing(edges, changed).unionByName(new_edges.select("from", "to", "label")))


def cascade(ids: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """Tables without rows whose key column is no longer among ids."""
    kept = ids.select("id").distinct()
    return {name: df.join(kept, df[key] == kept["id"], "left_semi") for name, (df, key) in tables.items()}


def carried_forward(baseline: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """Baseline rows that delta does not replace, and delta."""
    return baseline.join(delta.select(key).distinct(), key, "left_anti").unionByName(delta)
