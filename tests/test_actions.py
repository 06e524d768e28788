"""Exploration of click paths against a recursive walk in plain Python."""

import random

import pytest

from webquarry.operators import actions

PAGE = "https://site.test/"


def walk(views, clicks, start, max_nested):
    """Results of one page in order: (type, label, key, path, signature, title, url)."""
    seen, out = set(), []

    def visit(key, label, path, state):
        if (state, key, label) in seen:
            return
        seen.add((state, key, label))
        path = [*path, (key, label)]
        if (state, key, label) not in clicks:
            return
        disclosure, url, modal, after = clicks[state, key, label]
        if url is not None:
            out.append(("url", label, key, path, None, None, url))
            return
        if modal is not None:
            out.append(("modal", label, key, path, None, modal, None))
            return
        if not disclosure and after != state:
            out.append(("state", label, key, path, after, None, None))
        if len(path) > max_nested:
            return
        before = {(k, t) for k, t, _ in views.get(state, [])}
        for k, t, _ in views.get(after, []):
            if (k, t) not in before or (not disclosure and after != state):
                visit(k, t, path, after)

    for key, label, link in views.get(start, []):
        if not link:
            visit(key, label, [], start)
    return out


def some_app(seed):
    r = random.Random(seed)
    states = [f"s{i}" for i in range(6)]
    names = [(f"k{i}", f"l{i % 3}") for i in range(7)]
    views = {s: [(*c, r.random() < 0.2) for c in r.sample(names, r.randrange(1, 5))] for s in states}
    clicks = {}
    for s, own in views.items():
        for k, t, _ in own:
            kind = r.random()
            if kind < 0.9:
                clicks[s, k, t] = (r.random() < 0.3, f"https://site.test/{k}" if kind < 0.1 else None, f"dialog {k}" if 0.1 <= kind < 0.2 else None, r.choice(states))
    return views, clicks


def tables(spark, apps):
    views = [(u, s, i, k, t, link) for u, (v, _) in apps.items() for s, own in v.items() for i, (k, t, link) in enumerate(own)]
    clicks = [(u, s, k, t, d, url, modal, after) for u, (_, c) in apps.items() for (s, k, t), (d, url, modal, after) in c.items()]
    starts = [(u, "s0") for u in apps]
    return spark.createDataFrame(views, actions.VIEWS).repartition(3), spark.createDataFrame(clicks, actions.CLICKS).repartition(3), spark.createDataFrame(starts, "norm_url string, state string")


@pytest.mark.parametrize("max_nested", [0, 2, 5])
def test_equals_a_recursive_walk(spark, max_nested):
    apps = {f"{PAGE}{i}": some_app(i) for i in range(25)}
    rows = actions.discoveries(*tables(spark, apps), max_nested).collect()
    for url, (views, clicks) in apps.items():
        own = sorted((r for r in rows if r["norm_url"] == url), key=lambda r: r["seq"])
        got = [(r["type"], r["label"], r["key"], [(p["key"], p["label"]) for p in r["path"]], r["signature"], r["title"], r["url"]) for r in own]
        assert got == walk(views, clicks, "s0", max_nested), url
        assert [r["seq"] for r in own] == list(range(len(own))) and all(r["depth"] == len(r["path"]) for r in own)


def test_menus_are_no_states_and_same_labels_stay_apart(spark):
    views = {"s0": [("menu", "More", False)], "s1": [("menu", "More", False), ("a", "Open", False), ("b", "Open", False), ("c", "Link", True)]}
    clicks = {("s0", "menu", "More"): (True, None, None, "s1"), ("s1", "a", "Open"): (True, None, "One", None), ("s1", "b", "Open"): (True, None, "Two", None), ("s1", "c", "Link"): (True, PAGE + "x", None, None)}
    rows = actions.discoveries(*tables(spark, {PAGE: (views, clicks)})).orderBy("seq").collect()
    assert [(r["type"], r["title"], r["url"], r["depth"]) for r in rows] == [("modal", "One", None, 2), ("modal", "Two", None, 2), ("url", None, PAGE + "x", 2)]


def test_empty_tables(spark):
    assert actions.discoveries(*tables(spark, {})).count() == 0


def test_a_page_is_walked_in_one_job(spark):
    """A chain of 40 actions in which each way depends on the one before; no round of jobs is run for it."""
    n = 40
    views = spark.createDataFrame([(PAGE, f"s{i}", i, f"k{i}", "l", False) for i in range(n)], actions.VIEWS)
    clicks = spark.createDataFrame([(PAGE, f"s{i}", f"k{i}", "l", False, None, None, f"s{i + 1}") for i in range(n)], actions.CLICKS)
    starts = spark.createDataFrame([(PAGE, f"s{i}") for i in range(n)], "norm_url string, state string")
    spark.sparkContext.setJobGroup("one page", "")
    try:
        found = actions.discoveries(views, clicks, starts, 1)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("one page")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows = found.orderBy("seq").collect()
    assert [[p["key"] for p in r["path"]] for r in rows] == [[f"k{j}" for j in range(i - i % 2, i + 1)] for i in range(n)]
