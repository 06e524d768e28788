"""Snapshots, and refresh runs against fresh crawls."""

import random

import pytest

from webquarry.operators import refresh
from webquarry.sources.snapshots import COMPACT_PARTS, Conflict, Delta, Snapshots

HOST = "https://site.test/"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "id string, n int")


def content(store, name, version=None):
    df = store.read(name, version)
    return None if df is None else sorted(tuple(r) for r in df.collect())


def test_versions_and_deltas(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    assert store.version() is None and store.read("t") is None
    one = store.commit({"t": rows(spark, ("a", 1), ("b", 2), ("c", 3)), "u": rows(spark, ("x", 0))}, {"k": 1})
    delta = Delta(rows(spark, ("b", 20), ("d", 4)), rows(spark, ("c", 0)).select("id"))
    two = store.commit({"t": delta}, {"k": 2}, one)
    assert content(store, "t") == [("a", 1), ("b", 20), ("d", 4)] and content(store, "u") == [("x", 0)]
    assert content(store, "t", store.version(1)) == [("a", 1), ("b", 2), ("c", 3)]
    assert two.tables["u"] == one.tables["u"]  # carried by reference
    assert two.tables["t"]["parts"][0]["path"] == one.tables["t"]["parts"][0]["path"]
    assert store.version(2).settings == {"k": 2} and store.numbers() == [1, 2]
    # a key that comes back is there once
    three = store.commit({"t": Delta(rows(spark, ("c", 33)))}, {}, two)
    assert content(store, "t") == [("a", 1), ("b", 20), ("c", 33), ("d", 4)]
    assert content(store, "t", two) == [("a", 1), ("b", 20), ("d", 4)]
    with pytest.raises(Conflict):
        store.commit({"t": rows(spark)}, {}, two)
    assert content(store, "t") == content(store, "t", three)


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = Snapshots(spark, str(tmp_path))
    one = store.commit({"t": rows(spark, ("a", 1)), "u": rows(spark, ("x", 0))}, {})
    write, calls = Snapshots._write, []

    def dies(self, df, name):
        calls.append(name)
        if len(calls) == 2:
            raise RuntimeError("killed between tables")
        return write(self, df, name)

    monkeypatch.setattr(Snapshots, "_write", dies)
    with pytest.raises(RuntimeError):
        store.commit({"t": rows(spark, ("a", 2)), "u": rows(spark, ("x", 5))}, {}, one)
    monkeypatch.undo()
    again = Snapshots(spark, str(tmp_path))
    assert again.version() == one and content(again, "t") == [("a", 1)] and content(again, "u") == [("x", 0)]
    assert len(again.expire()) == 1  # what the dead run had written
    two = again.commit({"t": rows(spark, ("a", 2))}, {}, one)
    assert two.number == 2 and content(again, "t") == [("a", 2)]


def test_parts_are_compacted_and_old_versions_expire(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path))
    version = store.commit({"t": rows(spark, *[(str(i), 0) for i in range(20)])}, {})
    for k in range(COMPACT_PARTS + 1):
        version = store.commit({"t": Delta(rows(spark, (str(k), k + 1)))}, {}, version)
        assert len(version.tables["t"]["parts"]) <= COMPACT_PARTS
    want = sorted((str(i), i + 1 if i <= COMPACT_PARTS else 0) for i in range(20))
    assert content(store, "t") == want
    assert store.expire(keep=1) and store.numbers() == [version.number]
    assert content(store, "t") == want and store.expire(keep=1) == []


def page(title, links, text):
    anchors = "".join(f'<a href="{h}">{t}</a>' for t, h in links)
    return f"<html><head><title>{title}</title></head><body><h1>{title}</h1><p>{text}</p>{anchors}</body></html>"


def some_site(r, names):
    site = {}
    for n in names:
        links = [(f"to {m}", m) for m in r.sample(names, min(3, len(names)))]
        site[n] = (f"Title {r.randrange(5)}", links, f"text {r.randrange(1000)}")
    return site


def edited(r, site):
    """Some pages gone, some new, some with other text or links."""
    new = {n: v for n, v in site.items() if n == HOST or r.random() > 0.1}
    for n in list(new):
        title, links, text = new[n]
        if r.random() < 0.15:
            new[n] = (title, links[1:] + [("new", r.choice(list(site)))], text)
        elif r.random() < 0.1:
            new[n] = (title, links, text + " edited")
    for k in range(r.randrange(3)):
        name = f"{HOST}new{r.randrange(1000)}"
        new[name] = ("New", [("home", HOST)], "fresh")
        some = r.choice([n for n in new if n != name])
        new[some] = (new[some][0], [*new[some][1], ("newest", name)], new[some][2])
    return new


def pages(spark, site):
    return spark.createDataFrame([(n, page(*v)) for n, v in site.items()], "url string, html string").repartition(2)


def tables(spark, folder):
    store = Snapshots(spark, folder)
    out = {}
    for name, drop in (("nodes", []), ("edges", []), ("app_map", []), ("modules", []), ("state", []), ("links", []), ("meta", [])):
        out[name] = sorted(str(r) for r in store.read(name).collect())
    return out


@pytest.mark.parametrize("seed, depth", [(2, 3)])
def test_refresh_equals_a_fresh_crawl(spark, tmp_path, seed, depth):
    r = random.Random(seed)
    site = some_site(r, [HOST] + [f"{HOST}p{i}" for i in range(25)])
    folder = f"{tmp_path}/kept"
    refresh.run(spark, folder, pages(spark, site), HOST, depth)
    for k in range(2):
        after = edited(r, site)
        version, status = refresh.run(spark, folder, pages(spark, after), HOST, depth)
        told = {x["norm_url"]: x["status"] for x in status.collect()}
        want = {n: "missing" if n not in after else "added" if n not in site else "unchanged" if site[n] == after[n] else "changed" for n in {*site, *after}}
        assert told == want
        refresh.run(spark, f"{tmp_path}/fresh{k}", pages(spark, after), HOST, depth)
        assert tables(spark, folder) == tables(spark, f"{tmp_path}/fresh{k}")
        site = after
    # nothing changed: nothing is written for documents
    version, status = refresh.run(spark, folder, pages(spark, site), HOST, depth)
    last = version.tables["modules"]["parts"][-1]["path"]
    assert spark.read.parquet(f"{folder}/{last}").count() == 0 and {x["status"] for x in status.collect()} == {"unchanged"}


def test_other_starts_and_settings(spark, tmp_path):
    site = {HOST: ("Home", [("a", HOST + "a")], "x"), HOST + "a": ("A", [("b", HOST + "b")], "y"), HOST + "b": ("B", [], "z")}
    folder = str(tmp_path)
    refresh.run(spark, folder, pages(spark, site), HOST, 1)
    assert Snapshots(spark, folder).read("nodes").count() == 2
    with pytest.raises(ValueError):
        refresh.run(spark, folder, pages(spark, site), HOST + "a", 1)
    version, status = refresh.run(spark, folder, pages(spark, site), HOST, 5)  # written anew
    assert Snapshots(spark, folder).read("nodes").count() == 3 and {r["status"] for r in status.collect()} == {"added"}
    assert version.number == 2 and all(len(t["parts"]) == 1 for t in version.tables.values())


def test_published_documents(spark, tmp_path):
    import json

    site = {HOST: ("Home", [("a", HOST + "a"), ("b", HOST + "b")], "x"), HOST + "a": ("A", [("b", HOST + "b")], "y"), HOST + "b": ("B", [], "z"), HOST + "lost": ("Lost", [], "")}
    folder = f"{tmp_path}/kept"
    refresh.run(spark, folder, pages(spark, site), HOST, 3, at="2020-01-01 00:00:00")
    site[HOST + "b"] = ("B", [], "edited")
    version, _ = refresh.run(spark, folder, pages(spark, site), HOST, 3, at="2021-01-01 00:00:00")
    out = refresh.publish(spark, folder, f"{tmp_path}/out", "now")
    read = lambda name: "".join(p.read_text() for p in sorted((tmp_path / "out" / out.rsplit("/", 1)[1] / name).glob("part-*")))
    index, base = read("index"), read("knowledge_base")
    assert [line.split("**")[1] for line in index.splitlines() if line.startswith("- **")] == ["Home", "A", "B"] and "Lost" not in base
    assert base.index("## Home") < base.index("## A") < base.index("## B") and "edited" in base and "screens: 3." in base
    manifest = json.loads(read("manifest"))
    assert manifest["counts"]["total_screens"] == 3 and manifest["config"]["max_depth"] == 3
    assert len(read("graph_edges").splitlines()) == 3 and len(read("app_map").splitlines()) == 3
    # only the edited page was read again
    when = {r["url"]: r["crawled_at"].year for r in Snapshots(spark, folder).read("meta").collect()}
    assert when == {HOST: 2020, HOST + "a": 2020, HOST + "b": 2021}
    old = refresh.publish(spark, folder, f"{tmp_path}/out", "now", version.number - 1)
    assert old != out and "edited" not in "".join(p.read_text() for p in (tmp_path / "out" / old.rsplit("/", 1)[1] / "knowledge_base").glob("part-*"))
