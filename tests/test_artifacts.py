import json

from pyspark.sql import functions as F
from pyspark.sql import types as T
import pytest

from webquarry import config
from webquarry.operators import html
from webquarry.plans import artifacts, documents
from webquarry.sources import corpus
from webquarry.operators.incremental import Checkpoint
from webquarry.streaming import ingest
from webquarry.streaming.state_log import Gap, StateLog

PAGE = """<title>Users</title><h1>All</h1><h2>Active</h2><button>Add</button><button>Add</button><div role=tab>Tab</div>
<form><label for=n>Name|x</label><input id=n name=n placeholder=p></form><table><thead><tr><th>A<th>B</thead><tbody><tr><td>1|2<td>3</tbody></table><a href=/x>X</a>"""


def screen(spark, url="http://a.test/u", page=PAGE, ident="s1"):
    df = spark.createDataFrame([(url, page, ident, 'link: "u"')], "url string, html string, screen_id string, discovered_via string")
    return html.screens(df)


def test_markdown_layout_and_reading_back(spark):
    row = screen(spark).select(artifacts.screen_markdown().alias("m")).select("m", artifacts.parsed_sections(F.col("m")).alias("s")).first()
    m, s = row["m"], row["s"]
    order = ["# Users", "- **URL:** `http://a.test/u`", '- **Reached via:** link: "u"', "- **Page heading(s):** H1: All | H2: Active", "- **Screen ID:** s1", "## Sub-navigation", "## Form fields", "## Buttons", "## Table / grid columns", "### Table data", "| 1\\|2 | 3 |", "## Links on this screen", "- [X](http://a.test/x)", "## Page text"]
    places = [m.index(x) for x in order]
    assert places == sorted(places)
    assert m.count("- Add — ") == 1
    assert s["headings"] == ["H1: All", "H2: Active"] and s["navigation"] == ["Add", "Tab"] and s["columns"] == ["A", "B"]
    assert [(a["text"], a["locator"]) for a in s["actions"]] == [("Add", "getByRole('button', { name: 'Add' })")]
    assert s["links"] == ["[X](http://a.test/x)"] and s["aria"] is None
    # the bar in the label is not escaped, so the cells move: lossy by design
    assert s["fields"][0]["label"] == "Name" and s["fields"][0]["tag"] == "x"


def test_row_and_link_caps(spark):
    rows = "".join(f"<tr><td>{i}</td></tr>" for i in range(300))
    many = screen(spark, page=f"<table><tbody>{rows}</tbody></table>" + "".join(f"<a href=/{i}>l</a>" for i in range(250)))
    m = many.select(artifacts.screen_markdown().alias("m")).first()["m"]
    assert m.count("](http://a.test/") == 200
    deep = many.withColumn("tables", F.array(F.struct(F.array(F.lit("A")).alias("headers"), F.transform(F.sequence(F.lit(1), F.lit(205)), lambda i: F.array(i.cast("string"))).alias("rows"))))
    assert "_...5 more row(s) captured but omitted here for size._" in deep.select(artifacts.screen_markdown().alias("m")).first()["m"]


def test_manifest_modal_and_state(spark):
    entries = artifacts.app_map(screen(spark).unionByName(screen(spark, "http://a.test/u#modal:x-1", ident="m")).unionByName(screen(spark, "http://a.test/u#state:1", page="<p>x", ident="t")))
    c = artifacts.manifest_counts(entries, 3).first()
    assert (c["screens"], c["modals"], c["total_screens"], c["pages_visited"], c["forms_captured_on"], c["fields"], c["buttons"]) == (2, 1, 3, 3, 2, 2, 4)
    assert entries.filter("slug = 't'").first()["name"] == "t"
    whole = json.loads(corpus.pretty_row(artifacts.manifest(entries, "http://a.test/", "-", 3, 50, None)))
    assert whole["config"] == {"max_pages": 50, "max_depth": None} and whole["counts"]["modals"] == 1


def test_views_and_chart(spark):
    nodes = spark.createDataFrame([("a", "http://a.test/", "Home", 0, 0), ("b", "http://a.test/#modal:x", None, 1, 1)], "id string, url string, title string, depth int, seq long")
    edges = spark.createDataFrame([("a", "b", 'modal: "x"'), ("a", "gone", "link")], "from string, to string, label string")
    meta = spark.createDataFrame([("a", 200)], "screen_id string, http_status int")
    content = screen(spark).select(F.lit("a").alias("id"), artifacts.screen_markdown().alias("markdown"))
    views = {r["id"]: r for r in artifacts.screen_views(nodes, meta, content, edges).collect()}
    assert views["b"]["is_modal"] and views["b"]["sections"]["headings"] == [] and views["a"]["http_status"] == 200
    result = artifacts.job_result(content, edges.withColumn("to", F.lit("a"))).first()
    assert (result["modal_count"], result["action_count"], result["form_count"]) == (1, 1, 1)
    lines = [r["line"] for r in artifacts.mermaid(nodes.withColumn("is_modal", F.col("id") == "b"), edges).orderBy("section", "key").collect()]
    assert lines == ["flowchart LR", '  n_a["Home d0"]', '  n_b("untitled d1")', "  n_a -->|modal: x| n_b"]


def whole(folder):
    """A document from its part files, in the order of their names."""
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_documents_in_parts(spark, tmp_path):
    rows = [(f"id{i:03d}", f"http://a.test/{i}", f"Title {i}" if i % 7 else None, i % 3, i) for i in range(200)]
    nodes = spark.createDataFrame(rows, "id string, url string, title string, depth int, seq long").repartition(5)
    edges = spark.createDataFrame([(f"id{i:03d}", f"id{i * 3 % 200:03d}", "link") for i in range(100)], "from string, to string, label string")
    lines = documents.index_lines(nodes, edges, "http://a.test/", "now")
    pieces = documents.placed(lines).orderBy("offset").collect()
    document = "".join(p["text"] + "\n" for p in pieces)
    assert all(document[p["offset"] : p["offset"] + p["size"]] == p["text"] + "\n" for p in pieces)
    documents.write_parts(lines, str(tmp_path / "index"))
    assert whole(tmp_path / "index") == document and len(list((tmp_path / "index").glob("part-*"))) > 1
    entries = [line for line in document.split("\n") if line.startswith("- **")]
    assert entries == [f"- **{t or '(untitled)'}**, depth {d}: `{u}`, document `{n}`" for n, u, t, d, i in sorted(rows, key=lambda r: (r[3], r[4]))]
    assert document.count("--(link)-->") == 100 and "screens: 200." in document
    parts = {r["section"]: (r["pieces"], r["offset"], r["size"]) for r in documents.contents(documents.placed(lines)).collect()}
    assert parts[documents.ENTRIES][0] == 200 and sum(x[2] for x in parts.values()) == len(document)
    modules = spark.createDataFrame([("Home", "# Home\n", 0), ("Home", "# Two", 1)], "title string, markdown string, seq long")
    documents.write_parts(documents.knowledge_base_lines(modules, "u", "-"), str(tmp_path / "base"))
    base = whole(tmp_path / "base")
    assert base.count("- [Home](#home)") == 2 and base.index("## Home") < base.index("## Two") and "screens: 2." in base
    documents.write_parts(documents.index_lines(nodes.limit(0), edges.limit(0), "u", "-"), str(tmp_path / "none"))
    assert "screens: 0." in whole(tmp_path / "none")


def test_config_precedence(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# c\nSITE_URL='http://a.test/'\nMAX_PAGES=7\nHEADLESS=False\nWORKERS=99\nbad\n")
    env = config.load_env_file(str(file), {"MAX_PAGES": "9"})
    c = config.load_config(["--max-depth", "2", "--what", "--allow-cross-origin"], env)
    assert (c.start_url, c.max_pages, c.max_depth, c.headless, c.concurrency, c.same_site, c.out_dir) == ("http://a.test/", 9, 2, False, 8, False, "./knowledge-base")
    with pytest.raises(config.ConfigError):
        config.load_config([], {})


def test_snapshot_round_trip(spark, tmp_path):
    state = spark.createDataFrame([("n", "u", 0, None, None, None, "s")], "norm_url string, url string, depth int, discovered_via string, parent_screen_id string, from_url string, signature string")
    saved = Checkpoint(1, "http://a.test/", 5, True)
    assert corpus.read_checkpoint(spark, str(tmp_path / "none")) is None and corpus.read_snapshot(spark, str(tmp_path / "none")) == {}
    corpus.write_snapshot(str(tmp_path / "run"), saved, {"state": state})
    assert corpus.read_checkpoint(spark, str(tmp_path / "run")) == saved
    assert corpus.read_snapshot(spark, str(tmp_path / "run"))["state"].collect() == state.collect()


def test_accepted_captures(spark):
    rows = [("http://a.test/1", 200, "http://a.test/1#x", False, False), ("http://a.test/2", 404, None, False, False), ("http://a.test/3", 404, None, False, True), ("http://a.test/4", None, "http://a.test/", False, False), ("http://a.test/5", 200, "http://a.test/", True, False)]
    df = spark.createDataFrame(rows, "url string, status int, final_url string, is_seed boolean, replayed boolean")
    assert {r["url"][-1] for r in corpus.accepted(df).collect()} == {"1", "3", "5"}


def test_stream_equals_batches(spark, tmp_path):
    page = lambda i, body: (i, f"http://a.test/{i % 3}?utm_source={i}", f"<title>{i % 3}</title><p>{body}</p>")
    first, second = [page(0, "a"), page(1, "b")], [page(3, "a"), page(4, "changed"), page(2, "c")]
    for name, rows in (("1", first), ("2", second)):
        spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = ingest.start(spark, str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "check"))
    query.awaitTermination(180)
    state = lambda name: {(r["norm_url"], r["signature"]) for r in ingest.state_log(spark, str(tmp_path / name)).read().collect()}
    frame = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string")
    ingest.refresh(spark, str(tmp_path / "batch"), frame(first), 0)
    changed = ingest.refresh(spark, str(tmp_path / "batch"), frame(second), 1)
    assert {r["norm_url"] for r in changed.collect()} == {"http://a.test/1", "http://a.test/2"}
    assert state("state") == state("batch") and len(state("batch")) == 3
    assert ingest.state_log(spark, str(tmp_path / "state")).delta(1).count() == 2  # only what the batch changed
    with pytest.raises(Gap):
        ingest.refresh(spark, str(tmp_path / "batch"), frame(second), 5)


def test_state_log_folds_and_finds_holes(spark, tmp_path, monkeypatch):
    log = StateLog(spark, str(tmp_path), T._parse_datatype_string("k string, v int"), "k")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    now = lambda: sorted(map(tuple, log.read().collect()))
    assert now() == [] and log.versions() == (-1, [])
    for n in range(5):
        monkeypatch.setattr(StateLog, "read", None)  # appending reads no state
        log.append(rows(("a", n), (f"b{n}", n)), n)
        monkeypatch.undo()
    want = sorted([("a", 4)] + [(f"b{n}", n) for n in range(5)])
    assert now() == want and not log.fold(every=6) and log.fold(every=5)
    assert log.versions() == (4, []) and now() == want
    log.append(rows(("a", 50)), 5)
    log.append(rows(("a", 6)), 6)
    log.append(rows(("a", 5)), 5)  # a batch that runs again
    assert dict(now())["a"] == 6
    log.append(rows(("a", 8)), 8)
    for ask in (log.read, log.versions, log.fold, lambda: log.delta(7)):
        with pytest.raises(Gap):
            ask()


def test_a_fold_that_dies_loses_nothing(spark, tmp_path, monkeypatch):
    log = StateLog(spark, str(tmp_path), T._parse_datatype_string("k string, v int"), "k")
    for n in range(3):
        log.append(spark.createDataFrame([(f"k{n}", n)], "k string, v int"), n)
    monkeypatch.setattr(StateLog, "sweep", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        log.fold(every=1)
    monkeypatch.undo()
    assert log.read().count() == 3 and log.versions() == (2, [])  # the base is whole, the deltas only take room
    log.sweep()
    assert log.read().count() == 3 and log._whole("delta") == []


def test_log_rows(spark):
    import logging

    handler = ingest.RowLog()
    logger = logging.getLogger("webquarry.test")
    logger.setLevel(logging.DEBUG)
    logger.addHandler(handler)
    logger.debug("x")
    logger.warning("y %s", 1)
    rows = ingest.by_level(handler.frame(spark), "warn").collect()
    assert [(r["level"], r["line"]) for r in rows] == [("warning", "y 1")]
