"""Filter interaction audit against a plain count over every order."""

import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from webquarry.llm import filter_audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "doc_id long, text string, source string, part string, mask int, id string"


def brute(docs, labels):
    flags = {}
    for i, q, t in labels:
        g = flags.setdefault(i, [False, False])
        g[0] |= q == 1
        g[1] |= t == 1
    judged = []
    for i, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        key = (i is not None, i or 0)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": any((j is not None, j or 0) < key for j, other, *_ in docs if (other or "") == text),
        }
        judged.append((source or "", fails, *(flags.get(i, (False, False)) if i is not None else (False, False))))
    out = {}
    for part in {j[0] for j in judged}:
        rows = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if r[1][f]]
                kept = [r for r in left if not r[1][f]]
                failing = sum(r[1][f] for r in rows)
                only = sum(r[1][f] and sum(r[1].values()) == 1 for r in rows)
                good, toxic = sum(r[2] for r in gone), sum(r[3] for r in gone)
                out[part, "".join(order), k + 1] = [len(kept), len(gone), failing - len(gone), only, good, toxic]
                shapley[f] += len(gone)
                left = kept
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def audited(spark, docs, labels, parts=3):
    table = spark.createDataFrame(docs, SCHEMA).repartition(parts)
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(table, flags).collect()
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in rows}


def wide(n, seed=0):
    return " ".join(f"w{seed}x{i}" for i in range(n))


def test_every_order_of_every_part(spark):
    texts = [None, "", "  \n", "a b c", "A $ " * 150, wide(250), wide(250), wide(250), wide(199, 1), wide(200, 2)]
    texts += ["same words " * 300, wide(300, 3) + " ONE TWO", "É日本 " * 210, wide(201, 4) + "\x1c|", "Word " * 40_000]
    texts += ["a b c"] * 40 + [wide(400, 5) + " #"] * 30
    docs = [(i, t, (None, "", "web", "books")[i % 4], "x", 7, "y") for i, t in enumerate(texts)]
    docs += [(3, "a b c", "web", "x", 7, "y"), (None, "a b c", "web", "x", 7, "y"), (None, "a b c", "web", "x", 7, "y")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, len(texts), 2)]
    labels = [(a, b, int(c)) for a, b, c in labels] + [(4, None, None), (4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_copies_over_many_tasks(spark):
    """One text in nine rows of ten: its run is cut by most task boundaries, and only the smallest id passes."""
    texts = ["hot"] * 900 + [f"cold {i}" for i in range(100)]
    docs = [(7919 * i % 1000, t, "s", "", 0, "") for i, t in enumerate(texts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        masks = filter_audit.failure_masks(spark.createDataFrame(docs, SCHEMA))
        rows = {r["id"]: r["mask"] for r in masks.collect()}
        spread = masks.filter(F.col("mask").bitwiseAND(16) > 0).select(F.shiftright("row", 33)).distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    hot = {d[0] for d in docs if d[1] == "hot"}
    assert {i for i, m in rows.items() if m & 16} == hot - {min(hot)}
    assert len(rows) == 1000 and spread > 8


def test_texts_with_one_fingerprint(spark, monkeypatch):
    """If all fingerprints collided, the full text would still tell copies from others."""
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: F.lit(5).cast("long"))
    docs = [(i, f"text {i % 7}", "s", "", 0, "") for i in range(100)]
    rows = filter_audit.failure_masks(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    assert sorted(r["id"] for r in rows if not r["mask"] & 16) == list(range(7))


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    docs = [(1, "a", "s", "", 0, "")]
    assert audited(spark, docs, []) == brute(docs, [])


def test_counters_add_up(spark):
    docs = [(i, "a $" if i % 2 else wide(220), "s", "", 0, "") for i in range(6)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    masks = filter_audit.failure_masks(spark.createDataFrame(docs, SCHEMA))
    whole = filter_audit.part_counters(masks, labels)
    halves = [filter_audit.part_counters(masks.filter(F.col("id") % 2 == k), labels) for k in (0, 1)]
    both = halves[0].union(halves[1]).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, whole.collect()))


def test_statement_agrees(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    texts = [None, "", "a b", "A $ " * 150, wide(250), wide(250), "É日本 " * 210, "same words " * 300]
    docs = [(i, t, (None, "web")[i % 2], "x", 7, "y") for i, t in enumerate(texts)]
    labels = [(0, 1, 0), (3, 1, 1), (5, 1, 1), (5, 0, 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels")
    for name in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    rows = duckdb.sql(filter_audit.SQL).fetchall()
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in rows} == brute(docs, labels)
