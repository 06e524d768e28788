import pytest
from pyspark.sql import functions as F

from webquarry.operators import dedup, discovery, graph, grid, incremental
from webquarry.operators.fingerprints import page_signature
from webquarry.operators.html import screens
from webquarry.functions import urls

HOST = "http://library.test"


def site(spark, pages: dict[str, str], **status):
    rows = [(HOST + p, status.get(p), h) for p, h in pages.items()]
    return screens(spark.createDataFrame(rows, "url string, status int, html string"))


def links(*paths):
    return "<p>text</p>" + "".join(f'<a href="{p}">{p}</a>' for p in paths)


def test_star_site_is_captured_once(spark):
    nodes, edges = graph.crawl(site(spark, {"/": links("/a", "/b", "/c", "/d")} | {p: links("/") for p in ("/a", "/b", "/c", "/d")}), HOST + "/")
    assert sorted((r["url"], r["depth"]) for r in nodes.collect()) == [(HOST + "/", 0), *((HOST + p, 1) for p in ("/a", "/b", "/c", "/d"))]
    rows = edges.collect()
    assert sum(r["is_discovery"] for r in rows) == 4 and len(rows) == 8


def test_depth_budget_scope_and_status(spark):
    pages = {"/": links("/a", "/bad", "/f.pdf", "http://other.test/"), "/a": links("/a/b"), "/a/b": links("/a/b/c"), "/a/b/c": "<h1>x</h1>", "/bad": "<h1>x</h1>"}
    nodes, _ = graph.crawl(site(spark, pages, **{"/bad": 404}), HOST + "/", max_depth=2)
    assert {r["url"] for r in nodes.collect()} == {HOST + p for p in ("/", "/a", "/a/b")}
    nodes, _ = graph.crawl(site(spark, pages), HOST + "/", max_pages=2)
    assert {r["url"] for r in nodes.collect()} == {HOST + "/", HOST + "/a"}


def test_table_links(spark):
    nodes, _ = graph.crawl(site(spark, {"/": '<table><tr><td><a href="/one">first</a><td><a href="/two">second</a></table>', "/one": "<h1>1</h1>", "/two": "<h1>2</h1>"}), HOST + "/")
    assert nodes.count() == 3


def test_closure_with_cycles_and_pruning(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "b", "x"), ("c", "a", "x"), ("b", "d", "x")], "from string, to string, label string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    kept, inside = graph.retained(nodes, edges, "a")
    assert {r["id"] for r in kept.collect()} == set("abd")
    assert inside.count() == 4
    again, same = graph.retained(kept, inside, "a")
    assert again.count() == 3 and same.count() == 4


def test_depth_first_replay():
    assert graph.first_found_depths([("r", "a"), ("r", "b"), ("b", "c"), ("c", "a")], "r") == [("r", 0), ("b", 1), ("c", 2), ("a", 1)]


def test_first_seen_and_upsert(spark):
    df = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), (None, 5, "null")], "key string, seq long, v string")
    assert {(r["key"], r["v"]) for r in dedup.first_seen(df, ["key"], ["seq"]).collect()} == {("k", "early"), (None, "null")}
    base = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "id string, v string, seq long")
    delta = spark.createDataFrame([("a", "new", 9), ("c", "new", 10)], "id string, v string, seq long")
    assert {(r["id"], r["v"], r["seq"]) for r in dedup.upserted(base, delta, ["id"]).collect()} == {("a", "new", 1), ("b", "old", 2), ("c", "new", 10)}


def test_probe_representatives_and_states(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, None)], "seq long, fp string")
    assert [r["is_representative"] for r in dedup.representatives(df, F.col("fp"), ["seq"]).orderBy("seq").collect()] == [True, False, True, True]
    rows = spark.createDataFrame([(1, "u", "f", "seed"), (2, "u", "f", "link"), (3, "u", "g", "link"), (4, "u", "g", "link")], "seq long, norm_url string, fingerprint string, discovered_via string")
    assert {r["seq"] for r in dedup.unvisited_states(rows, rows.limit(0)).collect()} == {1, 3}


def test_incremental_sequence(spark):
    home, shelves, shelf = links("/shelves"), links("/shelves/poetry"), "<h1>Poetry</h1>"
    state = lambda pages: site(spark, pages).select(urls.normalize_url(F.col("url")).alias("norm_url"), page_signature().alias("signature"))
    one = state({"/": home, "/shelves": "<h1>Shelves</h1>"})
    two = state({"/": home, "/shelves": shelves, "/shelves/poetry": shelf})
    status = lambda a, b: {r["norm_url"].removeprefix(HOST): r["status"] for r in incremental.classified(a, b).collect()}
    assert set(status(one.limit(0), one).values()) == {"added"}
    assert status(one, two) == {"/": "unchanged", "/shelves": "changed", "/shelves/poetry": "added"}
    assert set(status(two, two).values()) == {"unchanged"} and incremental.to_capture(two, two).count() == 0
    assert status(two, one) == {"/": "unchanged", "/shelves": "changed", "/shelves/poetry": "missing"}


def test_checkpoint_rules():
    saved = incremental.Checkpoint(1, HOST + "/?utm_source=post", 5, True)
    assert incremental.usable_checkpoint(saved, HOST + "/", 5, True)
    assert not incremental.usable_checkpoint(saved, HOST + "/", 4, True)
    assert not incremental.usable_checkpoint(None, HOST + "/", 4, True)
    with pytest.raises(ValueError):
        incremental.usable_checkpoint(saved, HOST + "/else", 5, True)


def test_nested_states(spark):
    step = lambda i: (f"k{i}", f"go {i}")
    rows = [("s", HOST + "/", 0, "state", f"go {i}", f"k{i}", [step(j) for j in range(1, i + 1)], None, f"sig{i}", i, "t", i) for i in range(1, 7)]
    rows.append(("s", HOST + "/", 0, "modal", "Menu", "km", [step(1), ("km", "Menu")], None, None, None, "dialog", 7))
    rows.append(("s", HOST + "/", 0, "url", "go", "ku", [("ku", "go")], HOST + "/next", None, None, None, 8))
    probes = spark.createDataFrame(rows, "screen_id string, page_url string, page_depth int, type string, label string, key string, path array<struct<key: string, label: string>>, url string, signature string, depth int, title string, seq long")
    nodes, edges, frontier = discovery.captured(probes, HOST + "/", 6)
    states = [r for r in nodes.collect() if "#state:" in r["url"]]
    assert sorted(r["depth"] for r in states) == [1, 2, 3, 4, 5, 6]
    by_label = {r["label"]: r["from"] for r in edges.collect()}
    ids = {r["depth"]: r["id"] for r in states}
    assert by_label['click: "go 1"'] == "s" and by_label['click: "go 3"'] == ids[2] and by_label['modal: "Menu"'] == ids[1]
    assert [(r["norm_url"], r["depth"]) for r in frontier.collect()] == [(HOST + "/next", 1)]
    shallow, _, _ = discovery.captured(probes, HOST + "/", 2)
    assert shallow.filter("url like '%#state:%'").count() == 2


def test_grid_overshoot_plateau_and_bottom(spark):
    rows = [("t", s, p, [str(s * 10 + p)], False) for s in range(5) for p in range(10)]
    df = spark.createDataFrame(rows, "table_id string, step int, pos int, cells array<string>, at_bottom boolean")
    assert grid.accumulated(df, max_rows=15).count() == 20
    assert grid.accumulated(df.withColumn("at_bottom", F.col("step") == 1)).count() == 20
    still = spark.createDataFrame([("t", s, 0, ["a" if s < 6 else "b"], False) for s in range(8)], df.schema)
    assert grid.accumulated(still).count() == 1


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"), F.col("id").cast("string").alias("v"))
    assert {tuple(r) for r in dedup.first_seen(df.repartition(1), ["k"], ["seq"]).collect()} == {tuple(r) for r in dedup.first_seen(df.repartition(8), ["k"], ["seq"]).collect()}
