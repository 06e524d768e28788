"""The depth-first crawl against one worker with a stack, in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from webquarry.operators import traversal

HOST = "https://site.test/"
LINKS = "array<struct<text: string, href: string>>"


def short(x):
    return hashlib.sha1(x.encode()).hexdigest()[:10]


def slug(x):
    cut = re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", x.lower().replace("https://", "", 1)))[:60]
    return cut or "page"


def worker(pages, probes, forms, max_depth, max_pages):
    """(nodes in order, edges) that a single worker makes; all URLs are in scope and normal."""
    stack, marked, done, edges, nodes, probed = [(HOST, 0, "seed", None)], {HOST}, {}, set(), {}, set()
    count = 0

    def push(url, depth, via, parent):
        if url not in marked:
            marked.add(url)
            stack.append((url, depth, via, parent))

    while stack and count < max_pages:
        url, depth, via, parent = stack.pop()
        if url not in pages:
            continue
        title, links, fingerprint = pages[url]
        me = f"{slug(url)}-{short(url)}"
        nodes[me] = ("page", url, title, depth, via, parent)
        done[url] = me
        if parent:
            edges.add((parent, me, via))
        count += 1
        if depth >= max_depth:
            continue
        for label, href in links:
            if href in done:
                edges.add((me, done[href], f'link: "{label}"'))
            push(href, depth + 1, f'link: "{label}"', me)
        if fingerprint in probed:
            continue
        probed.add(fingerprint)
        states = {}
        for kind, label, key, path, deep, signature, title, target, inner in probes.get(url, []):
            above = next((states[tuple(path[:n])] for n in range(len(path) - 1, 0, -1) if tuple(path[:n]) in states), me)
            if kind == "state":
                if depth + deep > max_depth or count >= max_pages:
                    continue
                own = f"{url}#state:{short(signature)}"
                sid = f"{slug(own)}-{short(own)}"
                states[tuple(path)] = sid
                edges.add((above, sid, f'click: "{label}"'))
                if sid in nodes:
                    continue
                nodes[sid] = ("state", own, title, depth + deep, f'click: "{label}"', above)
                count += 1
                if depth + deep < max_depth:
                    for text, href in inner:
                        if href in done:
                            edges.add((sid, done[href], f'link: "{text}"'))
                        push(href, depth + deep + 1, f'link: "{text}"', sid)
            elif kind == "modal":
                if count >= max_pages:
                    continue
                own = f"{url}#modal:{slug(label)}-{short(key)}"
                mid = f"{slug(own)}-{short(own)}"
                nodes[mid] = ("modal", own, title, depth + 1, f'modal: "{label}"', above)
                edges.add((above, mid, f'modal: "{label}"'))
                count += 1
                if depth + 1 < max_depth:
                    for text, href in inner:
                        push(href, depth + 2, f'modal link: "{text}"', mid)
            elif target != url:
                if target in done:
                    edges.add((above, done[target], f'click: "{label}"'))
                push(target, depth + max(len(path), 1), f'click: "{label}"', above)
        for action, target in forms.get(url, []):
            if target is None or target == url:
                continue
            if target in done:
                edges.add((me, done[target], f'form: "{action}"'))
            push(target, depth + 1, f'form: "{action}"', me)
    return nodes, edges


def some_site(seed, size=30, clicks=True):
    r = random.Random(seed)
    urls = [HOST] + [f"{HOST}p{i}" for i in range(1, size)]
    missing = set(r.sample(urls[1:], size // 10))
    pick = lambda n: [(f"t{r.randrange(4)}", r.choice(urls)) for _ in range(r.randrange(n))]
    pages = {u: (f"title {u[-2:]}", pick(5), f"print{r.randrange(size)}") for u in urls if u not in missing}
    probes, forms = {}, {}
    for u in pages if clicks else ():
        rows, path = [], []
        for _ in range(r.randrange(5)):
            step = (f"k{r.randrange(3)}", f"l{r.randrange(2)}")
            path = [*path, step] if path and r.random() < 0.6 else [step]
            kind = r.choice(["state", "modal", "url"])
            row = (kind, step[1], step[0], path, len(path), f"s{r.randrange(3)}", f"d{r.randrange(9)}", r.choice(urls), pick(3))
            if kind == "state":  # what a state shows follows from its signature
                row = (*row[:8], [("in", urls[(len(u) * 7 + int(row[5][1])) % size])])
            rows.append(row)
        probes[u] = rows
        forms[u] = [(f"a{k}", r.choice([*urls, None])) for k in range(r.randrange(2))]
    return pages, probes, forms


def tables(spark, pages, probes, forms):
    captures = [(u, u, t, [{"text": a, "href": b} for a, b in ls], f, f"s-{f}") for u, (t, ls, f) in pages.items()]
    captures = spark.createDataFrame(captures, traversal.CAPTURE + ", state_fingerprint string").repartition(3)
    rows = [
        (u, i, kind, label, key, [{"key": a, "label": b} for a, b in path], deep, sign, title, target, [{"text": a, "href": b} for a, b in inner])
        for u, own in probes.items()
        for i, (kind, label, key, path, deep, sign, title, target, inner) in enumerate(own)
    ]
    sent = [(u, i, a, t) for u, own in forms.items() for i, (a, t) in enumerate(own)]
    return captures, spark.createDataFrame(rows, traversal.PROBES).repartition(3), spark.createDataFrame(sent, "norm_url string, form_pos int, action string, url string")


def crawled(result):
    nodes = {r["id"]: (r["kind"], r["url"], r["title"], r["depth"], r["discovered_via"], r["parent_id"]) for r in result.nodes.orderBy("place").collect()}
    return nodes, {tuple(r) for r in result.edges.select("from", "to", "label").collect()}


@pytest.mark.parametrize("seed, depth, budget", [(1, 4, 1000), (3, 5, 25), (4, 3, 14), (6, 4, 31)])
def test_equals_one_worker(spark, seed, depth, budget):
    site = some_site(seed)
    want_nodes, want_edges = worker(*site, depth, budget)
    captures, probes, forms = tables(spark, *site)
    nodes, edges = crawled(traversal.typed_crawl(captures, HOST, probes, forms, depth, budget))
    assert nodes == want_nodes
    assert edges == want_edges
    assert list(nodes) == list(want_nodes)  # in the order of capture


def test_links_alone_and_budgets_are_prefixes(spark):
    pages, _, _ = some_site(11, 40, clicks=False)
    captures, _, _ = tables(spark, pages, {}, {})
    whole = crawled(traversal.typed_crawl(captures, HOST, max_depth=4, max_pages=None))[0]
    assert list(whole) == list(worker(pages, {}, {}, 4, 10_000)[0]) and len(whole) > 12
    for budget in (1, 12):
        cut = crawled(traversal.typed_crawl(captures, HOST, max_depth=4, max_pages=budget))[0]
        assert list(cut) == list(whole)[:budget]


def test_visited_states_are_not_expanded(spark):
    """Pages whose content was visited are skipped with what only they lead to; the start is exempt."""
    chain = {HOST: ("home", [("a", HOST + "p1"), ("b", HOST + "p2")], "f0"), HOST + "p1": ("one", [("c", HOST + "p3")], "f1"), HOST + "p2": ("two", [], "f2"), HOST + "p3": ("three", [], "f3")}
    captures, _, _ = tables(spark, chain, {}, {})
    seen = spark.createDataFrame([(HOST, "s-f0"), (HOST + "p1", "s-f1"), (HOST + "p2", "s-other")], "norm_url string, state_fingerprint string")
    nodes, _ = crawled(traversal.typed_crawl(captures, HOST, max_depth=4, visited_states=seen))
    assert [n[1] for n in nodes.values()] == [HOST, HOST + "p2"]


def test_pages_that_look_alike_are_probed_once(spark):
    pages = {HOST: ("home", [("a", HOST + "p1"), ("b", HOST + "p2")], "f0"), HOST + "p1": ("one", [], "same"), HOST + "p2": ("two", [], "same")}
    dialog = lambda name: [("modal", name, "k", [("k", name)], 1, None, name, None, [])]
    captures, probes, _ = tables(spark, pages, {HOST + "p1": dialog("x"), HOST + "p2": dialog("y")}, {})
    nodes, _ = crawled(traversal.typed_crawl(captures, HOST, probes, max_depth=4))
    assert [n[2] for n in nodes.values()] == ["home", "two", "y", "one"]  # the last link is followed first


def test_dialog_links_lie_two_levels_below(spark):
    pages = {HOST: ("home", [], "f0"), HOST + "p1": ("one", [], "f1")}
    rows = {HOST: [("modal", "Users", "k", [("k", "Users")], 1, None, "dialog", None, [("row", HOST + "p1")])]}
    captures, probes, _ = tables(spark, pages, rows, {})
    deep = crawled(traversal.typed_crawl(captures, HOST, probes, max_depth=2))[0]
    assert [(n[0], n[3]) for n in deep.values()] == [("page", 0), ("modal", 1), ("page", 2)]
    flat = crawled(traversal.typed_crawl(captures, HOST, probes, max_depth=1))[0]
    assert [(n[0], n[3]) for n in flat.values()] == [("page", 0), ("modal", 1)]


def test_unusable_pages_and_empty_tables(spark):
    pages = {HOST: ("home", [("a", HOST + "p1"), ("b", HOST + "p2")], "f0"), HOST + "p1": ("one", [], "f1"), HOST + "p2": ("two", [], "f2")}
    captures, probes, forms = tables(spark, pages, {}, {})
    broken = captures.withColumn("status", F.when(F.col("url").endswith("p1"), 404)).withColumn("is_ready", ~F.col("url").endswith("p2"))
    assert len(crawled(traversal.typed_crawl(broken, HOST, probes, forms))[0]) == 1
    assert crawled(traversal.typed_crawl(captures.limit(0), HOST, probes, forms)) == ({}, set())
    assert crawled(traversal.typed_crawl(captures, HOST + "nowhere")) == ({}, set())


def test_numbers_over_all_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).cast("int").alias("w")).repartition(7)
    plain = {r["k"]: r["place"] for r in traversal.numbered(rows, ["k"]).collect()}
    assert plain == {k: k for k in range(1000)}
    weight = {r["k"]: r["w"] for r in rows.collect()}
    before, total = {}, 0
    for k in range(1000):
        before[k] = total
        total += weight[k]
    assert {r["k"]: r["place"] for r in traversal.numbered(rows, ["k"], "w").collect()} == before
