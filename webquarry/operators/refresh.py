"""A crawl and its refresh as one run over a versioned snapshot.

A run compares the signatures of the captured pages with those of the version before.
Only pages that are new or changed are read in full; the links, documents and app-map
entries of the others are taken from the snapshot.  The traversal runs over link rows,
old and new together, so pages that appear, move or lose their last way from the start
come out as in a fresh crawl.  Links of changed pages replace their old ones, rows of
pages that are no longer reached go from every table, and all tables become one version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import text, urls
from webquarry.operators import fingerprints, graph, html, traversal
from webquarry.operators.dedup import first_seen
from webquarry.operators.incremental import Checkpoint, classified, usable_checkpoint
from webquarry.plans import artifacts, documents
from webquarry.schema import META
from webquarry.sources.snapshots import Delta, Snapshots, Version
from webquarry.store import discard, stored_at

#: Facets that signatures need, and those of full reading.
SIGNED = ("title", "visible_text", "links", "forms")


def signatures(pages: DataFrame) -> DataFrame:
    """norm_url, url, title, signature, has_password and links of captured pages, one row a normal URL."""
    read = html.screens(pages, facets=SIGNED).withColumn("norm_url", urls.normalize_url(F.col("url")))
    rows = read.select("norm_url", "url", "title", fingerprints.page_signature().alias("signature"), fingerprints.has_password().alias("has_password"), "links")
    return first_seen(rows, ["norm_url"], ["url", "signature"])


def saved_checkpoint(version: Version | None) -> Checkpoint | None:
    """Settings of a version's run."""
    return Checkpoint(**version.settings) if version else None


def run(
    spark: SparkSession,
    folder: str,
    pages: DataFrame,
    start_url: str,
    max_depth: int = 5,
    max_pages: int | None = None,
    same_site: bool = True,
    at: str = "1970-01-01 00:00:00",
) -> tuple[Version, DataFrame]:
    """Crawl captured pages (url, html, optionally status) into the snapshot at ``folder``.

    Returns the new version and norm_url, status (added, changed, unchanged, missing) of
    every page.  Tables: state (norm_url, url, title, signature), links (norm_url,
    link_pos, link_text, href, target), nodes, edges, app_map, modules and meta (columns
    META; crawled_at is ``at`` of the run that read the screen).  A version of another
    start raises ValueError; one of other settings is written anew.
    """
    store = Snapshots(spark, folder)
    base = store.version()
    fresh = not usable_checkpoint(saved_checkpoint(base), start_url, max_depth, same_site)
    if "status" not in pages.columns:
        pages = pages.withColumn("status", F.lit(None).cast("int"))
    else:
        pages = pages.filter(F.col("status").isNull() | (F.col("status") < 400))
    now, now_at = stored_at(signatures(pages), "signed")
    empty = spark.createDataFrame([], "norm_url string, url string, title string, signature string")
    old = empty if fresh else store.read("state", base)
    status, status_at = stored_at(classified(old, now), "status")
    read, read_at = stored_at(status.filter("status IN ('added', 'changed')").select("norm_url"), "to-read")
    gone, gone_at = stored_at(status.filter("status IN ('changed', 'missing')").select("norm_url"), "replaced")

    # link rows: those of pages read now, and those the snapshot has of the others
    rows = now.join(read, "norm_url", "left_semi").select("norm_url", F.posexplode("links").alias("link_pos", "link"))
    new_links = rows.select("norm_url", "link_pos", F.col("link.text").alias("link_text"), F.col("link.href").alias("href")).withColumn("target", urls.normalize_url(F.col("href")))
    new_links, new_links_at = stored_at(new_links, "new-links")
    links = new_links if fresh else store.read("links", base).join(gone, "norm_url", "left_anti").unionByName(new_links)
    corpus = now.select("norm_url", F.col("url").alias("page_url"), "title")
    nodes, edges = graph.crawl_links(corpus, links, start_url, max_depth, max_pages, "site" if same_site else "any")
    nodes, nodes_at = stored_at(nodes, "run-nodes")
    edges, edges_at = stored_at(edges, "run-edges")

    # documents: of reached pages that are read now, or were not reached before, or are reached otherwise
    kept = nodes.select("id", "norm_url", F.col("url").alias("reached_as"), "discovered_via", "depth")
    if fresh:
        write, known = kept, None
    else:
        known = store.read("nodes", base)
        before = known.select("id", F.col("discovered_via").alias("was_via"), F.col("url").alias("was_url"), F.col("depth").alias("was_depth"))
        same = F.col("was_depth").eqNullSafe(F.col("depth")) & F.col("was_via").eqNullSafe(F.col("discovered_via")) & F.col("was_url").eqNullSafe(F.col("reached_as"))
        write = kept.join(before, "id", "left").join(read.withColumn("is_read", F.lit(True)), "norm_url", "left")
        write = write.filter(F.col("is_read") | ~F.coalesce(same, F.lit(False))).select(*kept.columns)
    write, write_at = stored_at(write, "to-write")
    source = first_seen(pages.select("url", "html", "status").withColumn("norm_url", urls.normalize_url(F.col("url"))), ["norm_url"], ["url"])
    chosen = source.drop("url").join(write, "norm_url").select(F.col("reached_as").alias("url"), "html", F.col("id").alias("screen_id"), "discovered_via", "norm_url", "depth", "status")
    screens, screens_at = stored_at(html.screens(chosen), "read-screens")
    entries, texts = artifacts.app_map(screens), artifacts.modules(screens)
    meta = screens.select("screen_id", "url", F.col("norm_url").alias("normalized_url"), "depth", "discovered_via", "title", F.col("status").cast("int").alias("http_status"), F.lit(at).cast("timestamp").alias("crawled_at"))
    meta = meta.select(*META.names)
    left = None if known is None else known.join(nodes, "id", "left_anti").select("id")

    def change(rows: DataFrame, key: str):
        return rows if fresh else Delta(rows, left.select(F.col("id").alias(key)), key)

    state = now.select("norm_url", "url", "title", "signature")
    if fresh:
        tables = {"state": state, "links": new_links}
    else:
        lost = gone.join(read, "norm_url", "left_anti")
        tables = {"state": Delta(state.join(read, "norm_url", "left_semi"), lost, "norm_url"), "links": Delta(new_links, gone, "norm_url")}
    tables |= {"nodes": nodes, "edges": edges, "app_map": change(entries, "slug"), "modules": change(texts, "id"), "meta": change(meta, "screen_id")}
    settings = {"version": 1, "start_url": start_url, "max_depth": max_depth, "same_site": same_site}
    version = store.commit(tables, settings, base)
    discard(spark, now_at, read_at, gone_at, new_links_at, nodes_at, edges_at, write_at, screens_at)
    return version, status


def publish(spark: SparkSession, folder: str, target: str, generated_at: str, number: int | None = None) -> str:
    """Write the documents of a version under ``target`` and return their folder.

    index and knowledge_base are text in part files, graph_nodes, graph_edges, app_map
    and manifest JSON lines.  The manifest is written last: a folder that has a whole one
    is whole.  Publishing a version again gives the same documents.
    """
    store = Snapshots(spark, folder)
    version = store.version(number)
    out = f"{target.rstrip('/')}/{version.number:012d}"
    start = version.settings["start_url"]
    nodes, edges, entries = (store.read(n, version) for n in ("nodes", "edges", "app_map"))
    # the order of capture: by depth, then the link places along the way
    order = traversal.numbered(nodes.select("id", "depth", F.col("seq").alias("way")), ["depth", "way"]).select("id", F.col("place").alias("seq"))
    order, order_at = stored_at(order, "capture-order")
    listed = nodes.drop("seq").join(order, "id")
    documents.write_parts(documents.index_lines(listed, edges, start, generated_at), f"{out}/index")
    texts = store.read("modules", version).join(order, "id")
    documents.write_parts(documents.knowledge_base_lines(texts, start, generated_at), f"{out}/knowledge_base")
    for name, df in (("graph_nodes", listed.select("id", "url", "title", "depth")), ("graph_edges", edges), ("app_map", entries)):
        df.write.mode("overwrite").json(f"{out}/{name}")
    count = nodes.count()
    artifacts.manifest(entries, start, generated_at, count, None, version.settings["max_depth"]).write.mode("overwrite").json(f"{out}/manifest")
    discard(spark, order_at)
    return out
