"""Cross-tokenizer alignment against both libraries and all pairs of overlapping ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from webquarry.llm import cross_align as ca

tokenizers = pytest.importorskip("public_tokenizers")
A, B = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a int, groups string, chunk string"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(texts, libraries):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of each text."""
    a, b = libraries
    byte_of = {v: k for k, v in _characters().items()}
    aligned, counts = [], Counter()
    for t in texts:
        found = None
        if t:
            want = (" " + t).encode()
            one = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + t, add_special_tokens=False).ids]
            two = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(t)]
            if b"".join(x for _, x in one) == want == b"".join(x for _, x in two):
                found = _ranges(one), _ranges(two)
        links, groups = [], []
        if found:
            one, two = found
            j = 0
            for i, lo, hi in one:
                while two[j][2] <= lo:
                    j += 1
                k = j
                while k < len(two) and two[k][1] < hi:
                    links.append((i, two[k][0]))
                    k += 1
            cuts = sorted({e for *_, e in one} & {e for *_, e in two})
            start = 0
            for c in cuts:
                sides = [",".join(str(i) for i, lo, hi in side if start <= lo and hi <= c) for side in (one, two)]
                groups.append("|".join(sides))
                start = c
        aligned.append((found, links, groups))
        counts.update(links)
    best = defaultdict(int)
    for (_, i), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for found, links, groups in aligned:
        n_a, n_b = (len(found[0]), len(found[1])) if found else (0, 0)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups)))
    return out


def _characters():
    """Character of each byte, by the published rule of byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, n = {}, 0
    for b in range(256):
        out[b] = chr(b) if b in plain else chr(256 + n)
        n += b not in plain
    return out


def _ranges(tokens):
    out, at = [], 0
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def aligned(spark, texts, parts=3, **options):
    table = spark.createDataFrame([(i, t, 0, "x", "y") for i, t in enumerate(texts)], SCHEMA).repartition(parts)
    name = "groups" if options.get("groups") else "groups_sha256"
    rows = {r["doc_id"]: r for r in ca.align(table, A, B, **options).collect()}
    return [tuple(rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", name)) for i in range(len(texts))]


def some_texts(n=60, seed=3):
    r = random.Random(seed)
    words = "the tokenizers of a corpus, antidisestablishmentarianism  naïve 日本語テキスト \n\n\tdef f(x): return 3.14159 Straße 🎉🎊 don't <s> </s> <|endoftext|> <0x41> und 000123".split(" ")
    return [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(n)]


def test_against_libraries(spark, libraries):
    texts = [None, "", " ", "  two", "x", "▁", "a▁b", "\0", "a\r\n b", " leading", "trailing  ", "é" * 50, "𝒳𝒴", "  nbsp", "ﬁ ligature", "á"]
    texts += some_texts() + ["the word " * 3000] + some_texts(5, 3)
    want = brute(texts, libraries)
    assert aligned(spark, texts, groups=True) == want
    digests = [(*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in want]
    assert aligned(spark, texts) == digests
    assert want[5][0] == 0 and want[4][0] > 0


def test_split_keys_and_many_chunks(spark, libraries, monkeypatch):
    """Every B id is split over keys, and counts come in several batches."""
    monkeypatch.setattr(ca, "KEY_POSTINGS", 3)
    monkeypatch.setattr(ca, "CHUNK_BYTES", 200)
    monkeypatch.setattr(ca, "GATHER", 50)
    texts = [t + " the the same" for t in some_texts(80, 9)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(ca, "stored", lambda df, name, rows="1000": _stored(df, name, "7"))
    assert aligned(spark, texts, groups=True) == brute(texts, libraries)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def _stored(df, name, rows):
    from webquarry.llm.store import stored

    return stored(df, name, rows)


def test_stretches_as_whole_texts(libraries):
    """Encoding by stretches equals the library on whole texts."""
    pieces = ca.CachedPieces(B)
    texts = some_texts(50, 4) + ["a  b   c ", "　 wide", "x" * 300]
    ids, counts = pieces([" " + t for t in texts])
    assert pieces.apart
    assert counts.tolist() == [len(libraries[1].encode(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in libraries[1].encode(t)]
    pieces.apart = False
    assert pieces([" " + t for t in texts])[0].tolist() == ids.tolist()


def test_repeated_rows_and_empty_tables(spark, libraries):
    table = spark.createDataFrame([(1, "the cat", 0, "", ""), (1, "the cat", 0, "", ""), (None, "a dog", 0, "", "")], SCHEMA)
    want = brute(["the cat", "the cat", "a dog"], libraries)
    rows = sorted(ca.align(table, A, B, groups=True).collect(), key=lambda r: r["doc_id"] is None)
    assert [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in rows] == want
    assert [r["doc_id"] for r in rows] == [1, 1, None]
    assert aligned(spark, []) == []
    assert aligned(spark, [None, ""]) == [(0, 0, 0, 0, 0, 0, "")] * 2
