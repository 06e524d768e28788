"""Removal of repeats against a plain search for 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from webquarry.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, n_bytes int, kept string"


def brute(docs):
    """(n_bytes, kept bytes, spans) of each row, by its place."""
    low = {}
    raw = [((i is not None, i or 0), (t or "").encode()) for i, t in docs]
    for key, b in raw:
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            low[s] = min(low.get(s, key), key)
    out = []
    for key, b in raw:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - 49):
            if low[b[p : p + 50]] < key:
                gone[p : p + 50] = True
        gone = gone[: len(b)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        spans = [(int(a), int(e)) for a, e in zip(edges[::2], edges[1::2])]
        out.append((len(b), bytes(np.frombuffer(b, np.uint8)[~gone]), spans))
    return out


def removed(spark, docs, parts=4):
    table = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], SCHEMA).repartition(parts)
    rows = sd.remove_repeats(table).collect()
    return sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], bytes(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in rows)


def expected(docs):
    return sorted((i is not None, i or 0, *b) for (i, _), b in zip(docs, brute(docs)))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(r.randrange(30)) for _ in range(n))


def test_against_plain_search(spark, monkeypatch):
    monkeypatch.setattr(sd, "CHUNK_BYTES", 6000)  # many chunks
    monkeypatch.setattr(sd, "SLOT_BYTES", 3000)
    passage, long = prose(30, 1), prose(300, 2)
    texts = [None, "", "x", "é日本" * 40, "é日本" * 40 + "!", prose(9, 3), "z" * 49, "z" * 50, "z" * 51, "z" * 400, "ab" * 200]
    texts += [prose(40, 10 + i) + passage[i % 9 :] + prose(20, 90 + i) for i in range(30)]
    texts += [long, long, long[:700] + "~" + long[700:], long[100:], prose(5, 7) + long[40:-40]]
    texts += [long[300:349], long[300:350], long[300:351], prose(400, 11) * 2, "word " * 500]
    docs = list(enumerate(texts))
    random.Random(5).shuffle(docs)
    docs = [(i, t) for i, t in docs] + [(3, texts[3]), (35, long), (None, long[5:200]), (None, long[5:200]), (36, passage)]
    assert removed(spark, docs) == expected(docs)


def test_random_texts_of_few_letters(spark):
    r = random.Random(8)
    base = "".join(r.choice("ab") for _ in range(900))
    docs = []
    for i in range(60):
        a = r.randrange(800)
        docs.append((r.randrange(40), "".join(r.choice("ab") for _ in range(r.randrange(80))) + base[a : a + r.randrange(30, 100)] + "b" * r.randrange(70)))
    assert removed(spark, docs) == expected(docs)


def test_parts_of_a_chunk(monkeypatch):
    """Anchors do not depend on where a chunk is cut into parts for ranking."""
    text = np.frombuffer((prose(3000, 4) + "a" * 300 + prose(50, 5)).encode(), dtype=np.uint8)
    off = np.array([7, 7, 5000, 5030, len(text)])
    windows = lambda a: sorted((int(f), int(t), int(q)) for f0, l0, q0, r0 in zip(a.first, a.last, a.at, a.rank) for f, t, q in [(f, q0, r0) for f in range(f0, l0 + 1)])
    whole = windows(sd.window_anchors(text, off))
    monkeypatch.setattr(sd, "PART_BYTES", 333)
    assert windows(sd.window_anchors(text, off)) == whole
    ends = {p for a, b in zip([0, *off[:-1]], off) for p in range(a, b - 49)}
    assert {w[0] for w in whole} == ends and len(whole) == len(ends)
    assert all(f <= q <= f + sd.LENGTH - sd.SHORT for f, q, _ in whole)


def test_hot_passage_and_empty_tables(spark):
    passage = prose(20, 1)
    docs = [(i, passage + f" own{i}" * 3) for i in range(2000)]
    got = removed(spark, docs, 13)
    assert all(r[2] - len(r[3]) >= len(passage) for r in got if r[1]) and got[0][3].decode() == docs[0][1]
    assert removed(spark, []) == [] and removed(spark, [(1, None)], 1) == [(True, 1, 0, b"", [])]


def test_query_digests(spark, tmp_path):
    queries = pytest.importorskip("webquarry.llm.queries")
    long = prose(60, 2)
    docs = [(i, t) for i, t in enumerate([None, long, "q " + long, "own text"])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op12_suffix_dedup(spark, str(tmp_path)).collect()}
    for (i, _), (n, kept, spans) in zip(docs, brute(docs)):
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"]) == (n, n - len(kept), len(spans))
        assert rows[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
