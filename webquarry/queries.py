"""Registered queries over the driver's tables, and DuckDB statements for them.

A query is here if the tables have rows for its operators; forms, dialogs, states
and the like are covered by tests on small sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry import crawl_queries
from webquarry.functions import markup, text, urls
from webquarry.operators import dedup, fingerprints, graph, grid, html, incremental
from webquarry.plans import artifacts, documents
from webquarry.streaming import ingest
from webquarry.store import stored_at

#: Start URL that pages are compared with.
SEED = "https://www.ththre.example.com/"
CAP = 3
#: Facets that an app-map entry has.
ENTRY_FACETS = ("title", "headings", "forms", "buttons")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages")


def _normal(pages: DataFrame) -> DataFrame:
    return pages.withColumn("norm_url", urls.normalize_url(F.col("url")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, pos, target of every link that a page shows."""
    rows = html.screens(_pages(spark, sf_dir), facets=("links",))
    return rows.select("page_id", "url", F.posexplode("links").alias("pos", "link")).select("page_id", "url", "pos", F.col("link.href").alias("target"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their title instead of their HTML."""
    return html.screens(_pages(spark, sf_dir), facets=("title",))


def entry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages by site of the page: pages, links and distinct targets."""
    rows = _links(spark, sf_dir).select(urls.registrable_domain(urls.host(F.col("url"))).alias("site"), "page_id", urls.normalize_url(F.col("target")).alias("target"))
    return rows.groupBy("site").agg(F.count_distinct("page_id").alias("pages"), F.count("*").alias("links"), F.count_distinct("target").alias("targets"))


def url_normalize(spark, d):
    return _normal(_pages(spark, d)).select("page_id", "norm_url")


def url_normalize_strip_query(spark, d):
    return _pages(spark, d).select("page_id", urls.normalize_url(F.col("url"), strip_query=True).alias("norm_url"))


def url_parts(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.registrable_domain(urls.host(u)).alias("site"))


def site_rollup(spark, d):
    h = urls.host(F.col("url"))
    return _pages(spark, d).groupBy(urls.registrable_domain(h).alias("site")).agg(F.count("*").alias("pages"), F.count_distinct(h).alias("hosts"))


def same_site_seed(spark, d):
    return _pages(spark, d).select("page_id", urls.same_site(F.col("url"), F.lit(SEED)).alias("same_site"), urls.same_origin(F.col("url"), F.lit(SEED)).alias("same_origin"))


def navigable_links(spark, d):
    return _links(spark, d).select("page_id", "pos", urls.is_navigable(F.col("target")).alias("navigable"), urls.looks_like_login(F.col("target")).alias("login"))


def target_guard(spark, d):
    scheme = F.element_at(F.array(F.lit("https://"), F.lit("ftp://"), F.lit("http://10.0.0."), F.lit("")), (F.col("page_id") % 4 + 1).cast("int"))
    target = F.concat(scheme, F.when(F.col("page_id") % 4 == 2, (F.col("page_id") % 200).cast("string")).otherwise(F.regexp_replace("url", "^https?://", "")))
    return _pages(spark, d).select("page_id", F.coalesce(urls.target_problem(target), F.lit("none")).alias("problem"))


def slug_and_id(spark, d):
    return _normal(_pages(spark, d)).select("page_id", text.slug(F.col("url")).alias("slug"), text.screen_id(F.col("url"), F.col("norm_url")).alias("screen_id"))


def synthetic_urls(spark, d):
    state = urls.state_url(F.col("url"), F.col("html"))
    pages = _pages(spark, d).select("page_id", "url", state.alias("state_url"), "html")
    modal = text.modal_url(F.col("url"), F.col("title"), F.col("url"))
    return html.screens(pages, facets=("title",)).select("page_id", "state_url", modal.alias("modal_url"))


def slug_titles(spark, d):
    return _titled(spark, d).select("page_id", text.anchor(F.col("title")).alias("anchor"))


def part_slug(spark, d):
    return _table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.quoted(F.col("p_name")).alias("quoted"), text.mermaid_label(F.col("p_type")).alias("label"), text.mermaid_id(F.col("p_brand")).alias("ident"))


def clamp_ints(spark, d):
    raw = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit("px"))
    return _table(spark, d, "part").select("p_partkey", text.clamp_int(raw, 5, 40, 7).alias("clamped"), text.clamp_int(F.col("p_name"), 1, 9, 4).alias("otherwise"))


def page_title(spark, d):
    return _titled(spark, d).select("page_id", "title")


def page_headings(spark, d):
    rows = html.screens(_pages(spark, d), facets=("headings",)).select("page_id", F.posexplode("headings").alias("pos", "h"))
    return rows.select("page_id", F.col("pos").cast("int").alias("pos"), F.col("h.level").alias("level"), F.col("h.text").alias("text"))


def page_links(spark, d):
    rows = html.screens(_pages(spark, d), facets=("links",)).select("page_id", F.posexplode("links").alias("pos", "x"))
    return rows.select("page_id", "pos", F.col("x.text").alias("text"), F.col("x.href").alias("href"))


def link_distinct(spark, d):
    rows = _links(spark, d).select("target", "page_id", "pos")
    return dedup.first_seen(rows, ["target"], ["page_id", "pos"])


def link_cap(spark, d):
    return dedup.first_per_group(_links(spark, d).select("page_id", "pos", "target"), ["page_id"], ["pos"], CAP)


def body_text(spark, d):
    t = F.col("body_text")
    return html.screens(_pages(spark, d), facets=("body_text",)).select("page_id", "body_text", F.sha1(t).alias("text_sha1"), text.short_id(t).alias("short_id"))


def doc_text_dedup(spark, d):
    key = F.sha1(F.trim(F.regexp_replace("text", "[ \t\n\r]+", " ")))
    docs = _table(spark, d, "documents").select(key.alias("content"), "doc_id")
    return docs.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def state_fingerprint(spark, d):
    return html.screens(_pages(spark, d), facets=("title", "headings", "body_text", "links", "buttons", "forms", "tables")).select("page_id", fingerprints.state_fingerprint().alias("fingerprint"))


def page_signature(spark, d):
    return html.screens(_pages(spark, d), facets=("title", "visible_text", "links", "forms")).select("page_id", fingerprints.page_signature().alias("signature"))


def probe_fingerprint(spark, d):
    return html.screens(_pages(spark, d), facets=("title", "headings", "links", "buttons", "forms")).select("page_id", fingerprints.probe_fingerprint().alias("fingerprint"))


def probe_representative(spark, d):
    return dedup.representatives(_titled(spark, d).select("page_id", "title"), F.col("title"), ["page_id"]).select("page_id", "is_representative")


def edges_page_target(spark, d):
    rows = _links(spark, d)
    return rows.select(F.col("page_id").alias("from"), urls.normalize_url(F.col("target")).alias("to")).distinct()


def graph_degree(spark, d):
    return edges_page_target(spark, d).groupBy("from").agg(F.count("*").alias("out_degree"))


def _derived(spark, d) -> DataFrame:
    """A graph of our own over the corpus, with cycles: site -> host -> page -> target and back to the site.

    Stored, as what is built on it reads it several times: the HTML is read once.
    """
    p = _pages(spark, d).select("page_id", urls.registrable_domain(urls.host(F.col("url"))).alias("site"), urls.host(F.col("url")).alias("host"))
    node = lambda kind, c: F.concat(F.lit(kind + ":"), c.cast("string"))
    page = node("page", F.col("page_id"))
    to_target = edges_page_target(spark, d).select(node("page", F.col("from")).alias("from"), node("url", F.col("to")).alias("to"))
    parts = [p.select(node("site", F.col("site")).alias("from"), node("host", F.col("host")).alias("to")), p.select(node("host", F.col("host")).alias("from"), page.alias("to")), p.select(page.alias("from"), node("site", F.col("site")).alias("to"))]
    out = to_target
    for part in parts:
        out = out.unionByName(part)
    return stored_at(out.withColumn("label", F.lit("link")).distinct(), "derived-graph")[0]


def _root(spark) -> DataFrame:
    return spark.range(1).select(F.lit("site:example.com").alias("id"))


def frontier_bfs(spark, d):
    return graph.levels(_derived(spark, d), _root(spark), max_depth=2)


def reachable_derived(spark, d):
    return graph.levels(_derived(spark, d), _root(spark)).groupBy("depth").agg(F.count("*").alias("nodes"))


def graph_gc(spark, d):
    edges = _derived(spark, d)
    nodes = edges.select(F.col("from").alias("id")).unionByName(edges.select(F.col("to").alias("id"))).distinct()
    kept, inside = graph.retained(nodes, edges, "site:example.com")
    return kept.agg(F.count("*").alias("n")).select(F.lit("nodes").alias("what"), "n").unionByName(inside.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


def _shop(spark, d) -> DataFrame:
    """A site over the star schema, as captured screens: start -> regions -> nations -> suppliers, each linking to the start."""
    at = lambda kind, key: F.concat(F.lit(f"https://shop.test/{kind}/"), key.cast("string"))
    region, nation, supplier = (_table(spark, d, n) for n in ("region", "nation", "supplier"))
    home = F.array(F.struct(F.lit("home").alias("text"), F.lit("https://shop.test/").alias("href")))
    ahead = lambda df, up, kind, key: df.groupBy(up).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k")))).alias("ks")).select(up, F.transform("ks", lambda x: F.struct(F.lit(kind).alias("text"), at(kind, x["k"]).alias("href"))).alias("ahead"))
    page = lambda url, title, links: [url.alias("url"), F.lit(None).cast("int").alias("status"), title.alias("title"), links.alias("links"), F.lit(True).alias("is_ready")]
    with_home = lambda c: F.concat(F.coalesce(c, F.array().cast("array<struct<text: string, href: string>>")), home)
    start = ahead(region.withColumn("up", F.lit(0)), "up", "region", "r_regionkey").select(*page(F.lit("https://shop.test/"), F.lit("start"), F.col("ahead")))
    regions = region.join(ahead(nation, "n_regionkey", "nation", "n_nationkey"), F.col("r_regionkey") == F.col("n_regionkey"), "left").select(*page(at("region", F.col("r_regionkey")), F.col("r_name"), with_home(F.col("ahead"))))
    nations = nation.join(ahead(supplier, "s_nationkey", "supplier", "s_suppkey"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select(*page(at("nation", F.col("n_nationkey")), F.col("n_name"), with_home(F.col("ahead"))))
    suppliers = supplier.select(*page(at("supplier", F.col("s_suppkey")), F.col("s_name"), home))
    return start.unionByName(regions).unionByName(nations).unionByName(suppliers)


def crawl_nodes(spark, d):
    """The crawl of a site with cycles, to its end: screens with depth and the way they were found."""
    nodes, _ = graph.crawl(_shop(spark, d), "https://shop.test/", max_depth=5, max_pages=None)
    return nodes.select("url", "title", "depth", "discovered_via")


def crawl_edges(spark, d):
    """Edges of the same crawl, by kind of source and whether a screen was found by them."""
    _, edges = graph.crawl(_shop(spark, d), "https://shop.test/", max_depth=5, max_pages=None)
    kind = F.regexp_extract(F.col("from"), "shop-test-([a-z]+)", 1)
    return edges.groupBy(kind.alias("kind"), "is_discovery").agg(F.count("*").alias("edges"))


def crawl_budget(spark, d):
    """The first 20 screens within two levels: budgets cut in the order of links."""
    nodes, _ = graph.crawl(_shop(spark, d), "https://shop.test/", max_depth=2, max_pages=20)
    return nodes.select("url", "depth")


def known_node_lookup(spark, d):
    nodes = _pages(spark, d).select(F.col("page_id").cast("string").alias("id"), "url", F.col("page_id").alias("seq"))
    return graph.first_by_url(nodes)


def visited_anti(spark, d):
    p = _normal(_pages(spark, d)).select("norm_url", "page_id")
    fresh = p.filter("page_id % 2 = 1").withColumnRenamed("page_id", "seq")
    return dedup.unvisited(fresh, p.filter("page_id % 2 = 0"))


def budget_limit(spark, d):
    p = _normal(_pages(spark, d)).select("page_id", F.length("norm_url").alias("depth"))
    return p.orderBy("depth", "page_id").limit(50)


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    """Two versions of the corpus: the old lacks every fifth page and has other text on every third; the new lacks every
    seventh of those that the old has. Every page is in one of them."""
    p = _normal(_pages(spark, d))
    sign = F.sha1(markup.plain_text(F.col("html")))
    one = dedup.first_seen(p.select("norm_url", "page_id", sign.alias("signature")), ["norm_url"], ["page_id"])
    old = one.filter("page_id % 5 <> 0").withColumn("signature", F.when(F.col("page_id") % 3 == 0, F.sha1("signature")).otherwise(F.col("signature")))
    return old, one.filter("page_id % 7 <> 0 OR page_id % 5 = 0")


def incremental_diff(spark, d):
    old, new = _versions(spark, d)
    return incremental.classified(old, new)


def page_state_merge(spark, d):
    old, new = _versions(spark, d)
    fresh = incremental.to_capture(old, new)
    return incremental.merged_state(old.withColumnRenamed("page_id", "url"), fresh.withColumnRenamed("page_id", "url"), new).withColumnRenamed("url", "page_id")


def clear_outgoing(spark, d):
    edges = edges_page_target(spark, d)
    changed = _pages(spark, d).filter("page_id % 3 = 0").select(F.col("page_id").alias("id"))
    return graph.without_outgoing(edges, changed).groupBy("from").agg(F.count("*").alias("edges"))


def upsert_nodes(spark, d):
    p = _normal(_pages(spark, d)).select(text.short_id(F.col("norm_url")).alias("id"), "url", F.col("page_id").alias("seq"))
    base = dedup.first_seen(p, ["id"], ["seq"])
    delta = p.filter("seq % 3 = 0").withColumn("url", F.upper("url"))
    return dedup.upserted(base, delta, ["id"])


def _with_ids(spark, d, **options) -> DataFrame:
    read = _normal(html.screens(_pages(spark, d), **options))
    return read.withColumn("screen_id", text.screen_id(F.col("url"), F.col("norm_url"))).withColumn("discovered_via", F.lit("seed"))


def app_map(spark, d):
    entries = artifacts.app_map(_with_ids(spark, d, facets=ENTRY_FACETS))
    return entries.select("slug", "url", "name", F.array_join("headings", " | ").alias("headings"), F.size("fields").cast("long").alias("n_fields"), F.size("buttons").cast("long").alias("n_buttons"))


def manifest_counts(spark, d):
    return artifacts.manifest_counts(artifacts.app_map(_with_ids(spark, d, facets=ENTRY_FACETS)), 0)


def index_md(spark, d):
    """The index of all pages, by piece, with the characters before each."""
    p = stored_at(_titled(spark, d).select("page_id", "url", "title"), "titles")[0]
    nodes = p.select(F.col("page_id").cast("string").alias("id"), "url", "title", (F.col("page_id") % 3).cast("int").alias("depth"), F.col("page_id").alias("seq"))
    edges = p.select(F.lit("0").alias("from"), F.col("page_id").cast("string").alias("to"), F.lit("link").alias("label")).filter("to <> '0'")
    return documents.placed(documents.index_lines(nodes, edges, SEED, "-")).select("section", "offset", "text")


def screen_markdown(spark, d):
    return artifacts.modules(_with_ids(spark, d)).select("id", "title", F.sha1("markdown").alias("markdown_sha1"))


def markdown_parse_back(spark, d):
    read = _with_ids(spark, d)
    parsed = read.select("page_id", artifacts.parsed_sections(artifacts.screen_markdown()).alias("s"))
    return parsed.select("page_id", F.array_join("s.headings", " | ").alias("headings"), F.size("s.links").cast("long").alias("n_links"))


def knowledge_base(spark, d):
    """The knowledge base of all pages (title and text), by piece, with the characters before each."""
    read = html.screens(_pages(spark, d), facets=("title", "body_text"))
    rows = stored_at(read.select("title", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.col("body_text")).alias("markdown"), F.col("page_id").alias("seq")), "texts")[0]
    return documents.placed(documents.knowledge_base_lines(rows, SEED, "-")).select("section", "offset", "text")


def mermaid_graph(spark, d):
    edges = _derived(spark, d)
    nodes = edges.select(F.col("from").alias("id")).unionByName(edges.select(F.col("to").alias("id"))).distinct()
    return artifacts.mermaid(nodes.select("id", F.col("id").alias("title"), F.lit(1).alias("depth"), F.lit(False).alias("is_modal")), edges).select("section", "line")


def log_levels(spark, d):
    """Events as log rows of four levels: those of a warning or above, by level."""
    level = F.element_at(F.array(*[F.lit(x) for x in ("debug", "info", "warn", "error")]), (F.col("event_id") % 4 + 1).cast("int"))
    logs = _table(spark, d, "events").select(level.alias("level"), F.col("event_type").alias("line"), F.col("ts").alias("at"))
    return ingest.by_level(logs, "warn").groupBy("level").agg(F.count("*").alias("lines"), F.min("at").alias("first_at"))


def login_wall(spark, d):
    """Pages that look like a login: by their URL, or by a password field in a form."""
    read = html.screens(_pages(spark, d), facets=("forms",))
    return read.select("page_id", fingerprints.is_login_wall(F.col("url")).alias("login_wall"))


def destructive_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.coalesce(text.is_destructive(F.col("text")), F.lit(False)).alias("destructive"))


def grid_accumulate(spark, d):
    """Line items as rows of a grid per order, one step a line number: distinct cells, first seen."""
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("pos"), F.array("l_returnflag", "l_linestatus").alias("cells"))
    return grid.distinct_rows(rows).select("table_id", "step", "pos", F.array_join("cells", "|").alias("cells"))


QUERIES = {f.__name__: f for f in (
    url_normalize, url_normalize_strip_query, url_parts, site_rollup, same_site_seed, navigable_links, target_guard, slug_and_id, synthetic_urls, slug_titles, part_slug, clamp_ints, page_title, page_headings, page_links, link_distinct, link_cap, body_text, doc_text_dedup,
    state_fingerprint, page_signature, probe_fingerprint, probe_representative, edges_page_target, graph_degree, frontier_bfs, reachable_derived, graph_gc, crawl_nodes, crawl_edges, crawl_budget, known_node_lookup, visited_anti, budget_limit, incremental_diff, page_state_merge, clear_outgoing, upsert_nodes,
    app_map, manifest_counts, index_md, screen_markdown, markdown_parse_back, knowledge_base, mermaid_graph, log_levels, login_wall, destructive_text, grid_accumulate,
)} | {"site_links": entry_query} | crawl_queries.QUERIES

# --- DuckDB statements -----------------------------------------------------------

_T = "|".join(urls.TRACKING)


def _norm(u: str, query: bool = True) -> str:
    part = lambda i: f"regexp_extract({u}, '^(https?://[^/?#]+)([^?#]*)([?][^#]*)?(#.*)?$', {i})"
    pairs = f"list_sort(list_filter(string_split(substr({part(3)}, 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^({_T})(=|$)')))"
    q = f" || CASE WHEN len({pairs}) = 0 THEN '' ELSE '?' || array_to_string({pairs}, '&') END" if query else ""
    path = f"CASE WHEN {part(2)} = '' THEN '/' WHEN length({part(2)}) > 1 THEN regexp_replace({part(2)}, '/$', '') ELSE {part(2)} END"
    return f"({part(1)} || {path}{q} || CASE WHEN regexp_matches({part(4)}, '^#[/!]') THEN {part(4)} ELSE '' END)"


_HOST = "lower(regexp_extract(url, '^https?://([^/?#:]*)', 1))"
_SITE = f"regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1)"
_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1, 's')"
_DECODED = "replace({}, '&amp;', '&')"
_NAME = f"trim({_DECODED.format(_TITLE)})"
_ENCODED = "'/' || replace(replace(url_encode(substr(h, 2)), '%2C', ','), '%2F', '/')"
_LINKS = f"(SELECT page_id, url, (i - 1)::INT AS pos, hs[i] AS h, regexp_extract(url, '^(https?://[^/?#]+)', 1) || {_ENCODED.replace('h, 2', 'hs[i], 2')} AS target FROM (SELECT page_id, url, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hs, unnest(range(1, len(hs) + 1)) AS i FROM pages))"
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"
_UNSEEN = "|".join(["<!--.*?-->", *(f"<{t}[ >].*?</{t}>" for t in ("head", "script", "style", "noscript", "svg"))])
_WORDS = f"regexp_replace(regexp_replace(html, '{_UNSEEN}', '', 'gs'), '<[^>]*>', '', 'g')"
_UNESCAPED = _DECODED.format(f"replace(replace(replace({_WORDS}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34))")
_BODY = f"trim(regexp_replace({_UNESCAPED}, '\n\n\n+', '\n\n', 'g'), ' \t\n\r')"
_DASH = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


def _slug(u: str) -> str:
    cut = f"substr({_DASH.format(f'''regexp_replace(lower({u}), 'https?://', '')''')}, 1, 60)"
    return f"CASE WHEN {cut} = '' THEN 'page' ELSE {cut} END"


_EDGES = f"(SELECT DISTINCT page_id AS \"from\", {_norm('target')} AS \"to\" FROM {_LINKS})"
_GRAPH = f"""(SELECT 'page:' || "from" AS a, 'url:' || "to" AS b FROM {_EDGES} UNION SELECT 'site:' || {_SITE}, 'host:' || {_HOST} FROM pages
  UNION SELECT 'host:' || {_HOST}, 'page:' || page_id FROM pages UNION SELECT 'page:' || page_id, 'site:' || {_SITE} FROM pages)"""
_REACH = "WITH RECURSIVE g AS MATERIALIZED (SELECT * FROM {g}), r AS (SELECT 'site:example.com' AS id, 0 AS depth UNION SELECT g.b, r.depth + 1 FROM r JOIN g ON g.a = r.id WHERE r.depth < {n})"
_FIRST = f"(SELECT norm_url, min(page_id) AS page_id, arg_min(signature, page_id) AS signature FROM (SELECT page_id, {_norm('url')} AS norm_url, sha1({_PLAIN}) AS signature FROM pages) GROUP BY norm_url)"
_OLD = f"(SELECT norm_url, page_id, CASE WHEN page_id % 3 = 0 THEN sha1(signature) ELSE signature END AS signature FROM {_FIRST} WHERE page_id % 5 <> 0)"
_NEW = f"(SELECT * FROM {_FIRST} WHERE page_id % 7 <> 0 OR page_id % 5 = 0)"
_STATUS = f"(SELECT coalesce(o.norm_url, n.norm_url) AS norm_url, CASE WHEN n.norm_url IS NULL THEN 'missing' WHEN o.norm_url IS NULL THEN 'added' WHEN o.signature = n.signature THEN 'unchanged' ELSE 'changed' END AS status FROM {_OLD} o FULL JOIN {_NEW} n ON o.norm_url = n.norm_url)"
_H1 = "list_transform(regexp_extract_all(html, '<h1>(.*?)</h1>', 1, 's'), lambda x: trim(" + _DECODED.format("x") + "))"
_LABEL = "trim(regexp_replace(regexp_replace({}, '[\"\\[\\]{{}}()\\\\]', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))"

ORACLES = {
    "site_links": f"SELECT {_SITE} AS site, count(DISTINCT page_id) AS pages, count(*) AS links, count(DISTINCT {_norm('target')}) AS targets FROM {_LINKS} GROUP BY 1",
    "url_normalize": f"SELECT page_id, {_norm('url')} AS norm_url FROM pages",
    "url_normalize_strip_query": f"SELECT page_id, {_norm('url', False)} AS norm_url FROM pages",
    "url_parts": f"SELECT page_id, regexp_extract(url, '^(https?)', 1) AS scheme, {_HOST} AS host, {_SITE} AS site FROM pages",
    "site_rollup": f"SELECT {_SITE} AS site, count(*) AS pages, count(DISTINCT {_HOST}) AS hosts FROM pages GROUP BY 1",
    "same_site_seed": f"SELECT page_id, (url LIKE 'https:%' AND {_SITE} = 'example.com') AS same_site, (url LIKE 'https:%' AND {_HOST} = 'www.ththre.example.com') AS same_origin FROM pages",
    "navigable_links": rf"SELECT page_id, pos, NOT regexp_matches(target, '{urls.FILE_ENDINGS}', 'i') AS navigable, regexp_matches(target, '{urls.LOGIN_PATH}', 'i') AS login FROM {_LINKS}",
    "target_guard": r"""SELECT page_id, CASE WHEN NOT regexp_matches(t, '^[a-z]+:') THEN 'malformed' WHEN NOT regexp_matches(t, '^https?:') THEN 'scheme'
      WHEN regexp_matches(t, '^https?://(10|127|0)[.]') THEN 'private_address' ELSE 'none' END AS problem
      FROM (SELECT page_id, ['https://', 'ftp://', 'http://10.0.0.', ''][page_id % 4 + 1] || CASE WHEN page_id % 4 = 2 THEN (page_id % 200)::VARCHAR ELSE regexp_replace(url, '^https?://', '') END AS t FROM pages)""",
    "slug_and_id": f"SELECT page_id, {_slug('url')} AS slug, ({_slug('url')}) || '-' || substr(sha1({_norm('url')}), 1, 10) AS screen_id FROM pages",
    "synthetic_urls": f"SELECT page_id, url || '#state:' || substr(sha1(html), 1, 10) AS state_url, url || '#modal:' || ({_slug(_NAME)}) || '-' || substr(sha1(url), 1, 10) AS modal_url FROM pages",
    "slug_titles": f"SELECT page_id, {_DASH.format(_NAME)} AS anchor FROM pages",
    "part_slug": f"SELECT p_partkey, {_slug('p_name')} AS slug, replace(replace(p_name, chr(92), chr(92) || chr(92)), '''', chr(92) || '''') AS quoted, substr({_LABEL.format('p_type')}, 1, 60) AS label, 'n_' || regexp_replace(p_brand, '[^a-zA-Z0-9]', '_', 'g') AS ident FROM part",
    "clamp_ints": "SELECT p_partkey, greatest(5, least(40, p_size)) AS clamped, 4 AS otherwise FROM part",
    "page_title": f"SELECT page_id, {_NAME} AS title FROM pages",
    "page_headings": f"SELECT page_id, (i - 1)::INT AS pos, 'h1' AS level, hs[i] AS text FROM (SELECT page_id, {_H1} AS hs, unnest(range(1, len(hs) + 1)) AS i FROM pages)",
    "page_links": f"SELECT l.page_id, l.pos, {_DECODED.format('t.ts[l.pos + 1]')} AS text, target AS href FROM {_LINKS} l JOIN (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">(.*?)</a>', 1) AS ts FROM pages) t ON l.page_id = t.page_id",
    "link_distinct": f"SELECT target, page_id, pos FROM {_LINKS} QUALIFY row_number() OVER (PARTITION BY target ORDER BY page_id, pos) = 1",
    "link_cap": f"SELECT page_id, pos, target FROM {_LINKS} WHERE pos < {CAP}",
    "body_text": f"SELECT page_id, t AS body_text, sha1(t) AS text_sha1, substr(sha1(t), 1, 10) AS short_id FROM (SELECT page_id, substr({_BODY}, 1, {html.BODY_CAP}) AS t FROM pages)",
    "doc_text_dedup": "SELECT content, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT sha1(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS content, doc_id FROM documents) GROUP BY content",
    "probe_fingerprint": f"SELECT page_id, {_NAME} || '::' || array_to_string({_H1}, '|') || '::' || len(regexp_extract_all(html, '<a href=')) || ':0:0' AS fingerprint FROM pages",
    "probe_representative": f"SELECT page_id, page_id = min(page_id) OVER (PARTITION BY {_NAME}) AS is_representative FROM pages",
    "edges_page_target": f"SELECT * FROM {_EDGES}",
    "graph_degree": f'SELECT "from", count(*) AS out_degree FROM {_EDGES} GROUP BY 1',
    "frontier_bfs": _REACH.format(g=_GRAPH, n=2) + " SELECT id, min(depth)::INT AS depth FROM r GROUP BY id",
    "reachable_derived": _REACH.format(g=_GRAPH, n=4) + " SELECT depth, count(*) AS nodes FROM (SELECT id, min(depth)::INT AS depth FROM r GROUP BY id) GROUP BY depth",
    "graph_gc": _REACH.format(g=_GRAPH, n=4) + " SELECT 'nodes' AS what, count(DISTINCT id) AS n FROM r UNION ALL SELECT 'edges', count(*) FROM g WHERE a IN (SELECT id FROM r) AND b IN (SELECT id FROM r)",
    "crawl_nodes": """SELECT 'https://shop.test/' AS url, 'start' AS title, 0 AS depth, 'seed' AS discovered_via
      UNION ALL SELECT 'https://shop.test/region/' || r_regionkey, r_name, 1, 'link: "region"' FROM region
      UNION ALL SELECT 'https://shop.test/nation/' || n_nationkey, n_name, 2, 'link: "nation"' FROM nation
      UNION ALL SELECT 'https://shop.test/supplier/' || s_suppkey, s_name, 3, 'link: "supplier"' FROM supplier""",
    "crawl_edges": """SELECT '' AS kind, true AS is_discovery, count(*) AS edges FROM region
      UNION ALL SELECT 'region', true, count(*) FROM nation UNION ALL SELECT 'nation', true, count(*) FROM supplier
      UNION ALL SELECT 'region', false, count(*) FROM region UNION ALL SELECT 'nation', false, count(*) FROM nation UNION ALL SELECT 'supplier', false, count(*) FROM supplier""",
    "crawl_budget": """SELECT url, depth FROM (SELECT 'https://shop.test/' AS url, 0 AS depth, 0 AS a, 0 AS b
      UNION ALL SELECT 'https://shop.test/region/' || r_regionkey, 1, r_regionkey, 0 FROM region
      UNION ALL SELECT 'https://shop.test/nation/' || n_nationkey, 2, n_regionkey, n_nationkey FROM nation) ORDER BY depth, a, b LIMIT 20""",
    "known_node_lookup": f"SELECT {_norm('url')} AS norm_url, min(page_id)::VARCHAR AS id FROM pages GROUP BY 1",
    "visited_anti": f"WITH p AS (SELECT page_id, {_norm('url')} AS norm_url FROM pages) SELECT norm_url, min(page_id) AS seq FROM p WHERE page_id % 2 = 1 AND norm_url NOT IN (SELECT norm_url FROM p WHERE page_id % 2 = 0) GROUP BY norm_url",
    "budget_limit": f"SELECT page_id, length({_norm('url')})::INT AS depth FROM pages ORDER BY 2, 1 LIMIT 50",
    "incremental_diff": f"SELECT * FROM {_STATUS}",
    "page_state_merge": f"SELECT norm_url, page_id, signature FROM {_NEW} WHERE norm_url IN (SELECT norm_url FROM {_STATUS} WHERE status IN ('added', 'changed')) UNION ALL SELECT norm_url, page_id, signature FROM {_OLD} WHERE norm_url IN (SELECT norm_url FROM {_STATUS} WHERE status = 'unchanged')",
    "clear_outgoing": f'SELECT "from", count(*) AS edges FROM {_EDGES} WHERE "from" % 3 <> 0 GROUP BY 1',
    "upsert_nodes": f"WITH p AS (SELECT substr(sha1({_norm('url')}), 1, 10) AS id, url, page_id FROM pages), t AS (SELECT id, url, page_id, 0 AS new FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY page_id) = 1 UNION ALL SELECT id, upper(url), page_id, 1 FROM p WHERE page_id % 3 = 0) SELECT id, arg_max(url, row(new, page_id)) AS url, arg_min(page_id, row(new, page_id)) AS seq FROM t GROUP BY id",
    "app_map": f"SELECT ({_slug('url')}) || '-' || substr(sha1({_norm('url')}), 1, 10) AS slug, url, {_NAME} AS name, array_to_string(list_transform({_H1}, lambda x: 'H1: ' || x), ' | ') AS headings, 0::BIGINT AS n_fields, 0::BIGINT AS n_buttons FROM pages",
    "manifest_counts": "SELECT count(*) AS screens, 0::BIGINT AS modals, count(*) AS total_screens, 0::BIGINT AS pages_visited, 0::BIGINT AS forms_captured_on, 0::BIGINT AS fields, 0::BIGINT AS buttons FROM pages",
    "markdown_parse_back": f"SELECT page_id, array_to_string(list_transform({_H1}, lambda x: 'H1: ' || x), ' | ') AS headings, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links FROM pages",
    "mermaid_graph": f"""WITH e AS (SELECT DISTINCT * FROM {_GRAPH}), n AS (SELECT DISTINCT id FROM (SELECT a AS id FROM e UNION SELECT b FROM e))
      SELECT 0 AS section, 'flowchart LR' AS line UNION ALL SELECT 1, '  n_' || regexp_replace(id, '[^a-zA-Z0-9]', '_', 'g') || '["' || substr({_LABEL.format("id || ' (d1)'")}, 1, 60) || '"]' FROM n
      UNION ALL SELECT 2, '  n_' || regexp_replace(a, '[^a-zA-Z0-9]', '_', 'g') || ' -->|link| n_' || regexp_replace(b, '[^a-zA-Z0-9]', '_', 'g') FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n)""",
    "log_levels": "SELECT ['debug', 'info', 'warn', 'error'][event_id % 4 + 1] AS level, count(*) AS lines, min(ts) AS first_at FROM events WHERE event_id % 4 >= 2 GROUP BY 1",
    "login_wall": rf"SELECT page_id, regexp_matches(url, '{urls.LOGIN_PATH}', 'i') OR regexp_matches(html, '<input[^>]*type=.?password', 'i') AS login_wall FROM pages",
    "destructive_text": f"SELECT doc_id, coalesce(regexp_matches(text, '{text.DESTRUCTIVE}', 'i'), false) AS destructive FROM documents",
    "grid_accumulate": "SELECT l_orderkey AS table_id, l_linenumber AS step, l_partkey AS pos, l_returnflag || '|' || l_linestatus AS cells FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus ORDER BY l_linenumber, l_partkey) = 1",
}
_TEXTS = f"(SELECT l.page_id, l.pos, {_DECODED.format('t.ts[l.pos + 1]')} AS text, target FROM {_LINKS} l JOIN (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">(.*?)</a>', 1) AS ts FROM pages) t ON l.page_id = t.page_id)"
ORACLES |= crawl_queries.oracles(_TEXTS, _NAME, _H1, _slug)
_PLACED = "SELECT section, (sum(length(text) + 1) OVER (ORDER BY section, major, minor, name) - length(text) - 1)::BIGINT AS \"offset\", text FROM pieces"
_N = "chr(10)"
ORACLES |= {
    "index_md": f"""WITH p AS (SELECT page_id, url, {_NAME} AS t FROM pages), pieces AS (
      SELECT 0 AS section, 0 AS major, 0 AS minor, '' AS name, '# Screens of {SEED}' || {_N} || {_N} || 'Made -; screens: ' || count(*) || '.' || {_N} AS text FROM p
      UNION ALL SELECT 1, page_id % 3, page_id, page_id::VARCHAR, '- **' || CASE WHEN t = '' THEN '(untitled)' ELSE t END || '**, depth ' || page_id % 3 || ': `' || url || '`, document `' || page_id || '`' FROM p
      UNION ALL SELECT 2, 0, 0, '', {_N} || '## Ways between screens' || {_N} || {_N} || 'Edges: ' || count(*) || '.' || {_N} FROM p WHERE page_id <> 0
      UNION ALL SELECT 3, 0, 0, '0' || chr(1) || page_id || chr(1) || 'link', '- `0` --(link)--> `' || page_id || '`' FROM p WHERE page_id <> 0) {_PLACED}""",
    "knowledge_base": f"""WITH p AS (SELECT page_id, {_NAME} AS t, {_DASH.format(_NAME)} AS a, substr({_BODY}, 1, {html.BODY_CAP}) AS b FROM pages), pieces AS (
      SELECT 0 AS section, 0 AS major, 0 AS minor, '' AS name, '# All screens of {SEED}' || {_N} || {_N} || 'Made -; screens: ' || count(*) || '.' || {_N} || {_N} || '## Contents' || {_N} AS text FROM p
      UNION ALL SELECT 1, page_id, 0, '', '- [' || t || '](#' || a || ')' FROM p UNION ALL SELECT 2, 0, 0, '', ''
      UNION ALL SELECT 3, page_id, 0, '', '<a id="' || a || '"></a>' || {_N} || {_N} || '## ' || t || {_N} || {_N} || regexp_replace(b, '(^|\n)(#{{1,5}}) ', '\\1#\\2 ', 'g') || {_N} || '---' || {_N} FROM p) {_PLACED}""",
}
