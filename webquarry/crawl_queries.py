"""Crawl queries over one site that the tables make up, and DuckDB statements for them.

Every row of ``pages`` is a screen at https://corpus.test/page/<page_id>; the links are
those of its HTML, in their places and with their texts, but each leads to the screen
that the hash of its target picks, so that the corpus hangs together.  Turns of
``conversations`` are what clicks on a screen (conv_id modulo the number of screens)
revealed: every third a state, a dialog or a URL, each reached by the turns before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquarry.operators import actions, fingerprints, html, traversal
from webquarry.store import stored_at

PREFIX = "https://corpus.test/page/"
START = PREFIX + "0"
DEPTH = 4
#: Captures that ``crawl_within_budget`` may take.
BUDGET = 60
#: Words of a turn that can be clicked, and clicks that may precede one.
CANDIDATES, NESTED = 4, 3


def _screen(number: Column) -> Column:
    return F.concat(F.lit(PREFIX), number.cast("string"))


def _picked(text: Column, screens: int) -> Column:
    """The screen that a text's hash picks."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long"), F.lit(screens))


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Captures and probe results of the site; the HTML is read once."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    screens = (pages.agg(F.max("page_id")).first()[0] or 0) + 1
    read = html.screens(pages, facets=("title", "headings", "links", "buttons", "forms"))
    links = F.transform("links", lambda x: F.struct(x["text"].alias("text"), _screen(_picked(x["href"], screens)).alias("href")))
    url = _screen(F.col("page_id"))
    captures = read.select(url.alias("url"), url.alias("norm_url"), "title", links.alias("links"), fingerprints.probe_fingerprint().alias("probe_fingerprint"))
    captures, _ = stored_at(captures, "site")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("said", F.coalesce("text", F.lit("")))
    key = F.concat_ws(":", "conv_id", "turn")
    path = F.collect_list(F.struct(key.alias("key"), F.col("role").alias("label"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    target = _screen(_picked(F.col("said"), screens))
    kind = F.element_at(F.array(F.lit("state"), F.lit("modal"), F.lit("url")), (F.col("turn") % 3 + 1).cast("int"))
    probes = turns.withColumn("path", path).select(
        _screen(F.col("conv_id") % screens).alias("norm_url"), (F.floor(F.col("conv_id") / screens) * 1024 + F.col("turn")).cast("int").alias("seq"), kind.alias("type"), F.col("role").alias("label"),
        key.alias("key"), "path", F.size("path").alias("depth"), F.md5("said").alias("signature"), F.col("role").alias("title"), target.alias("url"),
        F.array(F.struct(F.col("role").alias("text"), target.alias("href"))).alias("links"),
    )
    return captures, probes


def _crawl(spark: SparkSession, sf_dir: str, max_pages: int | None = None) -> traversal.Crawl:
    captures, probes = _site(spark, sf_dir)
    return traversal.typed_crawl(captures, START, probes, max_depth=DEPTH, max_pages=max_pages)


def typed_crawl_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screens, states and dialogs within four levels, depth first, with place, parent and how they were found."""
    return _crawl(spark, sf_dir).nodes.select("place", "kind", "id", "url", "title", "depth", "discovered_via", "parent_id")


def typed_crawl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the same crawl: how screens were found, and what led to screens captured by then."""
    return _crawl(spark, sf_dir).edges


def crawl_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first captures of the same crawl: screens, states and dialogs share the budget."""
    return _crawl(spark, sf_dir, BUDGET).nodes.select("place", "kind", "id", "depth")


def _app(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as pages whose states are their turns: a turn's first words are its candidates, and the hash of a
    word picks what a click on it does: show a turn, lead to a URL, or open a dialog."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    url = F.concat(F.lit("https://corpus.test/talk/"), F.col("conv_id").cast("string"))
    state = F.concat(F.lit("t"), F.col("turn").cast("string"))
    words = turns.select(url.alias("norm_url"), state.alias("state"), "conv_id", F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, CANDIDATES)).alias("pos", "key"))
    views = words.select("norm_url", "state", "pos", "key", F.col("key").alias("label"), F.lit(False).alias("is_link"))
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    digest = F.md5(F.concat_ws(":", "conv_id", "key"))
    number = lambda at, length: F.conv(F.substring(digest, at, length), 16, 10).cast("long")
    picked = words.select("norm_url", "state", "conv_id", "key").distinct().join(size, "conv_id").withColumn("to", F.pmod(number(1, 7), F.col("n") + 2))
    clicks = picked.select(
        "norm_url", "state", "key", F.col("key").alias("label"), (number(8, 1) % 3 == 0).alias("disclosure"), F.when(F.col("to") == F.col("n"), F.concat("norm_url", F.lit("/more"))).alias("to_url"),
        F.when(F.col("to") == F.col("n") + 1, F.col("key")).alias("modal_title"), F.when(F.col("to") < F.col("n"), F.concat(F.lit("t"), F.col("to").cast("string"))).alias("to_state"),
    )
    return views, clicks, turns.filter("turn = 0").select(url.alias("norm_url"), state.alias("state"))


def click_discoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clicks along paths of up to four actions reveal on every page of that kind, in order."""
    found = actions.discoveries(*_app(spark, sf_dir), max_nested=NESTED)
    return found.select("norm_url", "seq", "type", "key", F.array_join(F.transform("path", lambda p: p["key"]), " > ").alias("path"), "depth", "signature", "title", "url")


QUERIES = {f.__name__: f for f in (typed_crawl_nodes, typed_crawl_edges, crawl_within_budget, click_discoveries)}


def oracles(links: str, name: str, headings: str, slug) -> dict[str, str]:
    """Statements, given those for links (page_id, pos, target, and texts), titles, headings and slugs of the other queries."""
    pick = lambda c: f"(('0x' || substr(md5({c}), 1, 7))::BIGINT % (SELECT n FROM size))"
    url = lambda c: f"('{PREFIX}' || {c})"
    ident = lambda c: f"({slug(c)} || '-' || substr(sha1({c}), 1, 10))"
    walk = f"""
WITH RECURSIVE size AS (SELECT max(page_id) + 1 AS n FROM pages),
links AS MATERIALIZED (SELECT page_id, pos, text, {pick('target')} AS target FROM {links}),
prints AS MATERIALIZED (
  SELECT page_id, {name} AS title,
         {name} || '::' || array_to_string({headings}, '|') || '::' || len(regexp_extract_all(html, '<a href=')) || ':0:0' AS print
  FROM pages
), clicks AS MATERIALIZED (
  SELECT conv_id % (SELECT n FROM size) AS page_id, conv_id, turn, role,
         conv_id // (SELECT n FROM size) * 1024 + turn AS seq,
         ['state', 'modal', 'url'][turn % 3 + 1] AS kind,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS deep,
         md5(coalesce(text, '')) AS signature, {pick("coalesce(text, '')")} AS target
  FROM conversations
), shown AS (
  SELECT *, CASE WHEN kind = 'state' THEN min(deep) OVER (PARTITION BY page_id, kind, signature ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS unless
  FROM clicks
), steps AS (
  SELECT page_id, 0 AS class, 0 AS seq, pos, target, 1 AS inc, 0 AS needs, NULL AS unless, false AS probed FROM links
  UNION ALL SELECT page_id, 1, seq, 0, target, deep + 1, deep, unless, true FROM shown WHERE kind = 'state'
  UNION ALL SELECT page_id, 1, seq, 0, target, 2, 1, NULL, true FROM shown WHERE kind = 'modal'
  UNION ALL SELECT page_id, 1, seq, 0, target, deep, 0, NULL, true FROM shown WHERE kind = 'url' AND target <> page_id
), ahead AS MATERIALIZED (
  SELECT page_id, list({{'class': class, 'seq': seq, 'pos': pos, 'target': target, 'inc': inc, 'needs': needs, 'unless': unless, 'probed': probed}}
         ORDER BY class, seq, pos) AS steps
  FROM steps GROUP BY page_id
), walk AS (
  SELECT 0::BIGINT AS i, 0::BIGINT AS page_id, 0::BIGINT AS depth, NULL::BIGINT AS source, NULL::BIGINT AS class, NULL::BIGINT AS seq, NULL::BIGINT AS pos,
         []::STRUCT(page_id BIGINT, depth BIGINT, source BIGINT, class BIGINT, seq BIGINT, pos BIGINT)[] AS stack,
         [0]::BIGINT[] AS marked, []::VARCHAR[] AS probed
  UNION ALL
  SELECT i + 1, top.page_id, top.depth, top.source, top.class, top.seq, top.pos, stack[:-2], marked, probed
  FROM (
    SELECT *, stack[-1] AS top FROM (
      SELECT i, list_concat(marked, list_transform(fresh, lambda x: x.target)) AS marked, probed,
             list_concat(stack, list_transform(fresh, lambda x: {{'page_id': x.target, 'depth': depth + x.inc, 'source': page_id, 'class': x.class, 'seq': x.seq, 'pos': x.pos}})) AS stack
      FROM (
        SELECT *, list_filter(open, lambda x, k: list_position(list_transform(open, lambda y: y.target), x.target) = k) AS fresh FROM (
          SELECT w.i, w.page_id, w.depth, w.stack, w.marked,
                 CASE WHEN w.depth < {DEPTH} AND NOT list_contains(w.probed, p.print) THEN list_append(w.probed, p.print) ELSE w.probed END AS probed,
                 list_filter(coalesce(a.steps, []), lambda x: w.depth + x.needs < {DEPTH} AND (x.unless IS NULL OR w.depth + x.unless > {DEPTH})
                   AND (NOT x.probed OR NOT list_contains(w.probed, p.print)) AND NOT list_contains(w.marked, x.target)) AS open
          FROM walk w JOIN prints p USING (page_id) LEFT JOIN ahead a USING (page_id)
        )
      )
    ) WHERE len(stack) > 0
  )
), pages_taken AS (
  SELECT w.*, title, depth < {DEPTH} AND i = min(i) FILTER (depth < {DEPTH}) OVER (PARTITION BY print) AS probes FROM walk w JOIN prints USING (page_id)
), clicked AS (
  SELECT c.*, t.i, t.depth, t.page_id AS at, CASE kind WHEN 'state' THEN {url('c.page_id')} || '#state:' || substr(sha1(signature), 1, 10)
         ELSE {url('c.page_id')} || '#modal:' || {slug('role')} || '-' || substr(sha1(conv_id || ':' || turn), 1, 10) END AS own
  FROM clicks c JOIN pages_taken t ON c.page_id = t.page_id AND t.probes
  WHERE kind <> 'state' OR t.depth + deep <= {DEPTH}
), placed AS (
  SELECT c.*, coalesce(arg_max({ident('s.own')}, s.turn), {ident(url('any_value(c.page_id)'))}) AS parent
  FROM clicked c LEFT JOIN clicked s ON s.kind = 'state' AND s.conv_id = c.conv_id AND s.turn < c.turn
  GROUP BY ALL
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, kind, own ORDER BY seq) = 1 AS is_first FROM placed
), screens AS (
  SELECT t.i, -1 AS seq, 'page' AS kind, {url('t.page_id')} AS url, t.title, t.depth,
         CASE WHEN t.source IS NULL THEN 'seed' WHEN t.class = 0 THEN 'link: "' || l.text || '"'
              WHEN c.kind = 'state' THEN 'link: "' || c.role || '"' WHEN c.kind = 'modal' THEN 'modal link: "' || c.role || '"' ELSE 'click: "' || c.role || '"' END AS discovered_via,
         CASE WHEN t.source IS NULL THEN NULL WHEN t.class = 0 THEN {ident(url('t.source'))} WHEN c.kind = 'url' THEN c.parent ELSE {ident('c.own')} END AS parent_id
  FROM pages_taken t LEFT JOIN links l ON t.class = 0 AND l.page_id = t.source AND l.pos = t.pos
  LEFT JOIN placed c ON t.class = 1 AND c.page_id = t.source AND c.seq = t.seq
  UNION ALL
  SELECT i, seq, kind, own, role, CASE kind WHEN 'state' THEN depth + deep ELSE depth + 1 END,
         CASE kind WHEN 'state' THEN 'click: "' ELSE 'modal: "' END || role || '"', parent
  FROM firsts WHERE kind <> 'url' AND is_first
), nodes AS (
  SELECT row_number() OVER (ORDER BY i, seq) - 1 AS place, kind, {ident('url')} AS id, url, title, depth::INT AS depth, discovered_via, parent_id FROM screens
)"""
    reached = lambda source: f"JOIN pages_taken v ON v.page_id = {source}.target AND v.i <= {source}.i"
    to = ident(url("v.page_id"))
    clicks = f"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ')[1:{CANDIDATES}] AS words, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
views AS (SELECT conv_id, turn, n, unnest(words) AS key, unnest(range(len(words))) AS pos FROM turns),
done AS (
  SELECT *, CASE WHEN h < n THEN h END AS after, ('0x' || substr(d, 8, 1))::BIGINT % 3 = 0 AS disclosure FROM (
    SELECT DISTINCT conv_id, turn, n, key, md5(conv_id || ':' || key) AS d, ('0x' || substr(md5(conv_id || ':' || key), 1, 7))::BIGINT % (n + 2) AS h FROM views)
), ahead AS MATERIALIZED (
  SELECT c.conv_id, c.turn, c.key, list({{'turn': v.turn, 'key': v.key, 'pos': v.pos}} ORDER BY v.pos DESC) AS ways
  FROM done c JOIN views v ON v.conv_id = c.conv_id AND v.turn = c.after
  LEFT JOIN (SELECT DISTINCT conv_id, turn, key FROM views) b ON b.conv_id = c.conv_id AND b.turn = c.turn AND b.key = v.key
  WHERE b.key IS NULL OR (NOT c.disclosure AND c.after <> c.turn)
  GROUP BY ALL
), walk AS (
  SELECT conv_id, 0 AS i, NULL::BIGINT AS turn, NULL::VARCHAR AS key, NULL::VARCHAR[] AS path, []::VARCHAR[] AS seen,
         list({{'turn': turn, 'key': key, 'path': [key]}} ORDER BY pos DESC) AS stack
  FROM views WHERE turn = 0 GROUP BY conv_id
  UNION ALL
  SELECT t.conv_id, t.i + 1, CASE WHEN fresh THEN top.turn END, CASE WHEN fresh THEN top.key END, CASE WHEN fresh THEN top.path END,
         CASE WHEN fresh THEN list_append(seen, top.turn || '|' || top.key) ELSE seen END,
         list_concat(stack[:-2], CASE WHEN fresh AND len(top.path) <= {NESTED}
           THEN list_transform(coalesce(a.ways, []), lambda w: {{'turn': w.turn, 'key': w.key, 'path': list_append(top.path, w.key)}}) ELSE [] END)
  FROM (SELECT *, stack[-1] AS top, NOT list_contains(seen, stack[-1].turn || '|' || stack[-1].key) AS fresh FROM walk WHERE len(stack) > 0) t
  LEFT JOIN ahead a ON a.conv_id = t.conv_id AND a.turn = t.top.turn AND a.key = t.top.key
), results AS (
  SELECT w.conv_id, w.i, w.key, w.path, d.h, d.n, d.after, CASE WHEN h = n THEN 'url' WHEN h = n + 1 THEN 'modal' WHEN NOT disclosure AND after <> w.turn THEN 'state' END AS type
  FROM walk w JOIN done d USING (conv_id, turn, key)
)
SELECT 'https://corpus.test/talk/' || conv_id AS norm_url, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INT AS seq, type, key,
       array_to_string(path, ' > ') AS path, len(path)::INT AS depth, CASE WHEN type = 'state' THEN 't' || after END AS signature,
       CASE WHEN type = 'modal' THEN key END AS title, CASE WHEN type = 'url' THEN 'https://corpus.test/talk/' || conv_id || '/more' END AS url
FROM results WHERE type IS NOT NULL"""
    return {
        "click_discoveries": clicks,
        "typed_crawl_nodes": walk + " SELECT * FROM nodes",
        "crawl_within_budget": walk + f" SELECT place, kind, id, depth FROM nodes WHERE place < {BUDGET}",
        "typed_crawl_edges": walk + f"""
SELECT parent_id AS "from", id AS "to", discovered_via AS label FROM nodes WHERE parent_id IS NOT NULL
UNION SELECT parent, {ident('own')}, CASE kind WHEN 'state' THEN 'click: "' ELSE 'modal: "' END || role || '"' FROM placed WHERE kind <> 'url'
UNION SELECT {ident(url('u.page_id'))}, {to}, 'link: "' || u.text || '"'
  FROM (SELECT l.*, t.i FROM links l JOIN pages_taken t ON t.page_id = l.page_id AND t.depth < {DEPTH}) u {reached('u')}
UNION SELECT {ident('s.own')}, {to}, 'link: "' || s.role || '"' FROM (SELECT * FROM firsts WHERE kind = 'state' AND is_first AND depth + deep < {DEPTH}) s {reached('s')}
UNION SELECT c.parent, {to}, 'click: "' || c.role || '"' FROM (SELECT * FROM placed WHERE kind = 'url' AND target <> page_id) c {reached('c')}""",
    }
