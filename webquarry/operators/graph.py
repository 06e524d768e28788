"""Navigation graph: edges from links, breadth-first capture, closure, pruning.

Traversals advance one level at a time.  Every level is stored in the shared
folder (spark.checkpoint.dir), so lineage stays short and a lost executor costs
one level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.functions import text, urls
from webquarry.operators.dedup import first_seen
from webquarry.store import discard, stored_at


#: Levels after which what was reached is stored as one table.
FOLD = 8


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back."""
    return stored_at(df, name)[0]


def link_rows(screens: DataFrame, source: str = "id") -> DataFrame:
    """A row for each link: source id, link_pos, link_text, href and its normal form."""
    out = screens.select(F.col(source).alias("from"), F.posexplode("links").alias("link_pos", "link"))
    return out.select("from", "link_pos", F.col("link.text").alias("link_text"), F.col("link.href").alias("href")).withColumn("norm_url", urls.normalize_url(F.col("href")))


def followed(links: DataFrame, start_url: str, scope: str = "site") -> DataFrame:
    """Links in scope that may be screens."""
    return links.filter(urls.in_scope(F.col("href"), F.lit(start_url), scope) & urls.is_navigable(F.col("norm_url")))


def first_by_url(nodes: DataFrame) -> DataFrame:
    """The node first inserted for each normal URL: norm_url, id."""
    keyed = nodes.withColumn("norm_url", urls.normalize_url(F.col("url")))
    return first_seen(keyed.select("norm_url", "id", "seq"), ["norm_url"], ["seq", "id"]).select("norm_url", "id")


def known_edges(links: DataFrame, nodes: DataFrame, prefix: str = "link") -> DataFrame:
    """Edges of links that lead to nodes, without repeats; ``from`` is never null."""
    known = first_by_url(nodes).withColumnRenamed("id", "to")
    label = F.concat(F.lit(f'{prefix}: "'), F.col("link_text"), F.lit('"'))
    return edge_set(links.join(known, "norm_url").select("from", "to", label.alias("label")))


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("from").isNotNull() & (F.col("from") != "")).select("from", "to", "label").distinct()


def without_outgoing(edges: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Edges that do not begin at a changed screen."""
    gone = changed.select(F.col(key).alias("from")).distinct()
    return edges.join(gone, "from", "left_anti")


def levels(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes that roots (id) reach, with the least number of steps: id, depth.

    Levels are stored one by one; every FOLD levels, what was reached becomes one
    table, so that a level reads few files however deep the graph is.
    """
    spark = edges.sparkSession
    steps, steps_at = stored_at(edges.select(F.col("from").alias("id"), F.col("to")).distinct(), "steps")
    frontier, at = stored_at(roots.select("id").filter("id is not null").distinct().withColumn("depth", F.lit(0)), "level")
    reached, parts = frontier, [at]
    depth = 0
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        ahead = steps.join(frontier, "id").select(F.col("to").alias("id")).filter("id is not null").distinct()
        frontier, at = stored_at(ahead.join(reached, "id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        reached, parts = reached.unionByName(frontier), [*parts, at]
        if len(parts) > FOLD:
            reached, folded = stored_at(reached, "reached")
            discard(spark, *parts[:-1])
            gone, parts = parts[-1], [folded]
            frontier = reached.filter(F.col("depth") == depth)
            discard(spark, gone)
    discard(spark, steps_at)
    return reached


def retained(nodes: DataFrame, edges: DataFrame, root_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a root reaches."""
    root = nodes.sparkSession.range(1).select(F.lit(root_id).alias("id"))
    keep = stored(levels(edges, root).select("id"), "kept")
    starts, ends = keep.withColumnRenamed("id", "from"), keep.withColumnRenamed("id", "to")
    return nodes.join(keep, "id", "left_semi"), edges.join(starts, "from", "left_semi").join(ends, "to", "left_semi").select("from", "to", "label")


def crawl(pages: DataFrame, start_url: str, max_depth: int = 5, max_pages: int | None = 50, scope: str = "site", visited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first capture over a corpus of captured screens.

    pages: url, status (nullable), title, links, is_ready, one row a page and the
    columns of operators.html.screens.  Returns (nodes, edges): nodes have id, url,
    norm_url, title, depth, discovered_via, parent_id, seq (order within a depth); edges have from, to,
    label, is_discovery.  A page is captured if its status is below 400 and it is
    ready, within depth and page budget, in order of (depth, parent, link place).
    All links between captured screens are edges, not only those known when found.
    """
    usable = pages.filter((F.col("status").isNull() | (F.col("status") < 400)) & F.coalesce(F.col("is_ready"), F.lit(True)))
    corpus = first_seen(usable.withColumn("norm_url", urls.normalize_url(F.col("url"))).select("norm_url", "url", "title", "links"), ["norm_url"], ["url"])
    corpus, corpus_at = stored_at(corpus.withColumnRenamed("url", "page_url"), "corpus")
    links = link_rows(corpus, "norm_url").select(F.col("from").alias("norm_url"), "link_pos", "link_text", "href", F.col("norm_url").alias("target"))
    found = crawl_links(corpus.drop("links"), links, start_url, max_depth, max_pages, scope, visited)
    discard(pages.sparkSession, corpus_at)
    return found


def crawl_links(corpus: DataFrame, links: DataFrame, start_url: str, max_depth: int = 5, max_pages: int | None = 50, scope: str = "site", visited: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """crawl() over link rows, however they were read.

    corpus: norm_url (unique), page_url, title; links: norm_url, link_pos, link_text,
    href, target (the normal form of href).  A level reads link rows and names of
    screens, not their content, and adds to what was reached; every FOLD levels, parts
    become one table.
    """
    spark: SparkSession = corpus.sparkSession
    names, names_at = stored_at(corpus.select("norm_url", "title"), "names")
    ahead_of, links_at = stored_at(links.filter(urls.in_scope(F.col("href"), F.lit(start_url), scope) & urls.is_navigable(F.col("target"))).select(F.col("norm_url").alias("source"), "link_pos", "link_text", "href", "target"), "followed")
    start = urls.normalize(start_url)
    frontier = spark.createDataFrame([(start_url, start, "seed", None, [0])], "url string, norm_url string, discovered_via string, parent_id string, rank array<int>")
    seen = spark.createDataFrame([(start,)], "norm_url string")
    if visited is not None:
        seen = seen.unionByName(visited.select("norm_url").filter(F.col("norm_url") != start)).distinct()
    nodes: DataFrame | None = None
    parts: list[str] = []
    used: list[str] = [names_at, links_at]
    count, depth = 0, 0
    while True:
        # a node's place in its level: the link places along its path, which sort without gathering the level in one task
        level = frontier.join(names, "norm_url").select(text.screen_id(F.col("url"), F.col("norm_url")).alias("id"), "url", "norm_url", "title", F.lit(depth).alias("depth"), "discovered_via", "parent_id", F.col("rank").alias("seq"))
        if max_pages is not None:
            level = level.orderBy("seq").limit(max(0, max_pages - count))
        level, at = stored_at(level, "capture")
        taken = level.count()
        nodes, parts = level if nodes is None else nodes.unionByName(level), [*parts, at]
        count += taken
        if len(parts) > FOLD:
            nodes, folded = stored_at(nodes, "captures")
            used, parts, level = [*used, *parts], [folded], nodes.filter(F.col("depth") == depth)
        if not taken or depth >= max_depth or (max_pages is not None and count >= max_pages):
            break
        ahead = level.select(F.col("norm_url").alias("source"), F.col("id").alias("from"), F.col("seq").alias("parent_seq")).join(ahead_of, "source").withColumnRenamed("target", "norm_url")
        fresh = ahead.join(seen, "norm_url", "left_anti").withColumn("order", F.struct("parent_seq", "link_pos"))
        fresh = first_seen(fresh.select("norm_url", "href", "link_text", "from", "order"), ["norm_url"], ["order", "from"])
        rank = F.concat(F.col("order.parent_seq"), F.array("order.link_pos"))
        frontier, at = stored_at(fresh.select(F.col("href").alias("url"), "norm_url", F.concat(F.lit('link: "'), F.col("link_text"), F.lit('"')).alias("discovered_via"), F.col("from").alias("parent_id"), rank.alias("rank")), "frontier")
        used.append(at)
        seen = seen.unionByName(frontier.select("norm_url"))
        if depth % FOLD == FOLD - 1:
            seen, at = stored_at(seen, "seen")
            used.append(at)
        depth += 1
    nodes = stored(nodes, "crawled")
    starts = nodes.filter(F.col("depth") < max_depth).select(F.col("norm_url").alias("source"), F.col("id").alias("from"))
    edges = known_edges(starts.join(ahead_of, "source").select("from", "link_text", F.col("target").alias("norm_url")), nodes)
    discovery = nodes.filter("parent_id is not null").select(F.col("parent_id").alias("from"), F.col("id").alias("to"), F.col("discovered_via").alias("label"))
    flagged = edges.unionByName(discovery).distinct().join(discovery.distinct().withColumn("is_discovery", F.lit(True)), ["from", "to", "label"], "left")
    edges = stored(flagged.withColumn("is_discovery", F.coalesce("is_discovery", F.lit(False))), "crawl-edges")
    discard(spark, *used, *parts)
    return nodes, edges


def first_found_depths(links: list[tuple[str, str]], root: str, max_depth: int = 5, max_pages: int = 50) -> list[tuple[str, int]]:
    """Captured nodes in last-in-first-out order with the depth at which each was first queued.

    For small graphs on the driver: the order of a single depth-first worker.
    """
    ahead: dict[str, list[str]] = {}
    for a, b in links:
        ahead.setdefault(a, []).append(b)
    seen, stack, out = {root}, [(root, 0)], []
    while stack and len(out) < max_pages:
        node, depth = stack.pop()
        out.append((node, depth))
        if depth < max_depth:
            for b in ahead.get(node, []):
                if b not in seen:
                    seen.add(b)
                    stack.append((b, depth + 1))
    return out
