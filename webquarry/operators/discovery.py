"""Discoveries given as rows: states, dialogs and URLs that clicks on a screen led to.

A probe row (schema PROBE) has the screen it was made on, the path of actions and
what came of it.  States and dialogs become screens with synthetic URLs; URLs
become frontier rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import text, urls
from webquarry.operators.dedup import first_seen


def _path_key(path: Column) -> Column:
    return F.to_json(F.transform(path, lambda s: F.array(s["key"], s["label"])))


def state_screens(probes: DataFrame, max_depth: int) -> DataFrame:
    """Screens of the states within depth: id, url, title, depth, label, path, screen_id, seq."""
    url = urls.state_url(F.col("page_url"), F.col("signature"))
    rows = probes.filter((F.col("type") == "state") & (F.col("page_depth") + F.col("depth") <= max_depth)).withColumn("state_url", url)
    return rows.select(F.concat(text.slug(F.col("state_url")), F.lit("-"), text.short_id(F.col("state_url"))).alias("id"), F.col("state_url").alias("url"), "title", (F.col("page_depth") + F.col("depth")).alias("depth"), "label", "path", "screen_id", "seq")


def with_parents(probes: DataFrame, states: DataFrame) -> DataFrame:
    """Probe rows with parent_id: the state of the longest proper prefix of the path, else the screen."""
    known = first_seen(states.select("screen_id", _path_key(F.col("path")).alias("prefix"), "id", "seq"), ["screen_id", "prefix"], ["seq", "id"]).select("screen_id", "prefix", F.col("id").alias("state_id"))
    numbered = probes.withColumn("steps", F.coalesce(F.size("path"), F.lit(0)))
    lengths = F.when(F.col("steps") > 1, F.sequence(F.lit(1), F.col("steps") - 1)).otherwise(F.array().cast("array<int>"))
    each = numbered.select("screen_id", "seq", "path", F.explode(lengths).alias("n")).select("screen_id", "seq", "n", _path_key(F.slice("path", F.lit(1), F.col("n"))).alias("prefix"))
    best = each.join(known, ["screen_id", "prefix"]).groupBy("screen_id", "seq").agg(F.max_by("state_id", "n").alias("state_id"))
    return numbered.join(best, ["screen_id", "seq"], "left").withColumn("parent_id", F.coalesce("state_id", "screen_id")).drop("steps", "state_id")


def captured(probes: DataFrame, start_url: str, max_depth: int, scope: str = "site") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, frontier) of all probe results.

    Dialogs have no depth limit of their own and lie one level below their page; a
    URL's depth is its page's plus the length of the path, again without a limit.
    """
    states = state_screens(probes, max_depth)
    placed = with_parents(probes, states)
    click = F.concat(F.lit('click: "'), F.col("label"), F.lit('"'))
    dialog_via = F.concat(F.lit('modal: "'), F.col("label"), F.lit('"'))
    state_id = F.concat(text.slug(F.col("u")), F.lit("-"), text.short_id(F.col("u")))
    in_depth = placed.filter((F.col("type") == "state") & (F.col("page_depth") + F.col("depth") <= max_depth)).withColumn("u", urls.state_url(F.col("page_url"), F.col("signature")))
    state_edges = in_depth.select(F.col("parent_id").alias("from"), state_id.alias("to"), click.alias("label"))
    dialogs = placed.filter(F.col("type") == "modal").withColumn("u", text.modal_url(F.col("page_url"), F.col("label"), F.col("key")))
    dialog_edges = dialogs.select(F.col("parent_id").alias("from"), state_id.alias("to"), dialog_via.alias("label"))
    state_nodes = first_seen(states.select("id", "url", "title", "depth", "seq"), ["id"], ["seq"])
    dialog_nodes = first_seen(dialogs.select(state_id.alias("id"), F.col("u").alias("url"), "title", (F.col("page_depth") + 1).alias("depth"), "seq"), ["id"], ["seq"])
    found = placed.filter(F.col("type") == "url").withColumn("norm_url", urls.normalize_url(F.col("url")))
    found = found.filter((F.col("norm_url") != urls.normalize_url(F.col("page_url"))) & urls.in_scope(F.col("url"), F.lit(start_url), scope) & urls.is_navigable(F.col("norm_url")))
    depth = F.col("page_depth") + F.greatest(F.coalesce(F.size("path"), F.lit(0)), F.lit(1))
    frontier = first_seen(found.select("norm_url", "url", depth.alias("depth"), click.alias("discovered_via"), F.col("parent_id").alias("parent_screen_id"), F.col("page_url").alias("from_url"), F.col("path").alias("action_path"), "seq"), ["norm_url"], ["seq"])
    return state_nodes.unionByName(dialog_nodes), state_edges.unionByName(dialog_edges).distinct(), frontier


def form_targets(screens: DataFrame, max_forms: int = 10) -> DataFrame:
    """URLs that the first GET forms of each screen lead to: id, form_pos, url.

    ``max_forms`` is the probing budget of a page.
    """
    rows = screens.select("id", F.posexplode(F.slice("form_queries", 1, max_forms)).alias("form_pos", "url"))
    return rows.filter("url is not null")
