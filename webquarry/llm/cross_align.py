"""Alignment of two tokenizers' tokens, and how consistent it is over a corpus.

A is a byte-level BPE of the tokenizers library (asked for " " + text), B a
sentencepiece model (which adds the space itself).  Where both spell out the same
bytes, the offsets at which tokens of both end cut a text into groups; tokens whose
byte ranges overlap are linked.  Inside a group the cut points of both sides split the
bytes into pieces, and each piece is one link, so links are counted from two bit maps
over bytes.

Over the corpus, a pair's count is the number of its links.  Postings (B id, document,
A id, multiplicity in the document) are shuffled by B id and meet the pair counts of
that id as one sorted stream: first the counts, from which the task takes the highest,
then the postings.  A task holds the counts of one B id at a time, at most one for each
A id; Spark's sort spills the rest.  B ids with many postings are split over several
keys, each of which gets the id's counts.  Contributions are summed by document.

Nulls, empty texts, and texts that either side does not spell out byte for byte (a
literal U+2581, say) have no tokens: zeros and an empty string.  Rows that share an id
stay separate; a null id stays null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.store import freed, stored
from webquarry.llm.token_store import CachedEncoder
from webquarry.llm.udf import resident, trim

#: Bytes and documents of a chunk; postings for one key at least, and contributions that a task gathers.
CHUNK_BYTES, CHUNK_DOCS, KEY_POSTINGS, GATHER = 1 << 21, 1 << 15, 20_000, 1 << 20
SPLIT_BITS = 24
#: Distinct stretches that a worker keeps for each tokenizer (some 100 MB).
CACHE = 1 << 19

_STATS = ("n_a", "n_b", "n_groups", "n_links")
_LINKS = ("links_b", "links_n", "links_a", "links_doc", "links_m")


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves, the other bytes in ascending
    order for the characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _numbered(n: int, separator: bytes) -> np.ndarray:
    """Each id below n in decimal, then the separator, in rows padded with zero bytes."""
    data = b"".join((str(i).encode() + separator).ljust(6, b"\0") for i in range(n))
    return np.frombuffer(data, dtype=np.uint8).reshape(n, 6)


class CachedPieces(CachedEncoder):
    """The sentencepiece library, asked once for each distinct stretch of spaces and what follows them.

    Exact for models of which no piece has a space after another character, as then
    no piece spans such stretches; other models are asked for whole texts.
    """

    cut = staticmethod(re.compile(" +[^ ]*").findall)

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.added = []
        # two spaces must stay two, and a stretch must come out as it does inside a text
        self.apart = not any("▁" in n.lstrip("▁") for n in self.names) and self.model.encode("a  b c") == [
            i for part in ("a", " b", "c") for i in self.model.encode(part)
        ]
        self.clear()

    def learn(self, new: list[str]) -> None:
        got = self.model.encode([p[1:] for p in new], num_threads=1)  # the library adds the first space
        if " " in new:  # but to an empty text
            got[new.index(" ")] = self.model.encode("a ")[len(self.model.encode("a")) :]
        counts = np.array([len(x) for x in got], dtype=np.int64)
        self._keep(new, np.fromiter((i for x in got for i in x), dtype=np.uint32, count=int(counts.sum())), counts)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that begin with the added space."""
        if self.apart:
            return self.pieces(texts)
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        counts = np.array([len(x) for x in got], dtype=np.int64)
        return np.fromiter((i for x in got for i in x), dtype=np.uint32, count=int(counts.sum())), counts


def _spelled(sizes: np.ndarray, flat: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bytes of tokens one after another; ``flat`` holds those of all tokens in the order of their ids."""
    start = np.cumsum(sizes) - sizes
    n = sizes[ids]
    before = np.cumsum(n) - n
    return flat[np.repeat(start[ids] - before, n) + np.arange(int(n.sum()))]


class Aligner:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = CachedEncoder(path_a), CachedPieces(path_b)
        self.a.limit = self.b.limit = CACHE
        decoded = byte_of()
        vocabulary = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(decoded[c] for c in token if c in decoded)
        self.bytes_b = [
            bytes([int(p[3:-1], 16)]) if self.b.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(self.b.names)
        ]
        self.size_a = np.array([len(x) for x in self.bytes_a])
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), dtype=np.uint8) for x in (self.bytes_a, self.bytes_b))
        # rows of the second half end the group's side
        self.text_a = np.concatenate([_numbered(len(self.size_a), s) for s in (b",", b"|")])
        self.text_b = np.concatenate([_numbered(len(self.size_b), s) for s in (b",", b";")])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, how many each text has, B ids, how many, and the bytes that both spell out, by text.

        Texts that either side does not spell out have none of them.
        """
        spaced = [" " + t if t else "" for t in texts]
        a, n_a = self.a(spaced)
        b, n_b = self.b(spaced)
        a, b = a.astype(np.int64), b.astype(np.int64)
        raw = [t.encode() for t in spaced]
        size = np.array([len(r) for r in raw], dtype=np.int64)
        sides = (self.size_a, self.flat_a, a, n_a), (self.size_b, self.flat_b, b, n_b)
        spelt = np.ones(len(texts), dtype=bool)
        for sizes, _, ids, counts in sides:
            total = np.concatenate([[0], np.cumsum(sizes[ids])])
            end = np.cumsum(counts)
            spelt &= total[end] - total[end - counts] == size
        whole = np.frombuffer(b"".join(r for r, same in zip(raw, spelt.tolist(), strict=True) if same), dtype=np.uint8)
        edge = np.concatenate([[0], np.cumsum(np.where(spelt, size, 0))])
        for sizes, flat, ids, counts in sides:
            differs = np.flatnonzero(_spelled(sizes, flat, ids[np.repeat(spelt, counts)]) != whole)
            spelt = spelt & ~(np.diff(np.searchsorted(differs, edge)) > 0) if len(differs) else spelt
            if len(differs):  # what is left of the bytes must belong to the texts that are left
                whole = np.frombuffer(b"".join(r for r, same in zip(raw, spelt.tolist(), strict=True) if same), dtype=np.uint8)
                edge = np.concatenate([[0], np.cumsum(np.where(spelt, size, 0))])
        keep = lambda n: np.where(spelt, n, 0)
        return a[np.repeat(spelt, n_a)], keep(n_a), b[np.repeat(spelt, n_b)], keep(n_b), keep(size)

    def __call__(self, texts: list[str]) -> dict:
        """Counts and group strings of each text, and the links: doc, a and b, one after another."""
        a, n_a, b, n_b, size = self.encode(texts)
        edge = np.concatenate([[0], np.cumsum(size)])
        ends_a, ends_b = np.zeros(edge[-1] + 1, dtype=bool), np.zeros(edge[-1] + 1, dtype=bool)
        ends_a[np.cumsum(self.size_a[a])] = True
        ends_b[np.cumsum(self.size_b[b])] = True
        both = ends_a & ends_b
        # links: one for each stretch between two ends of either side
        cut = np.flatnonzero(ends_a | ends_b)
        link_a, link_b = (np.cumsum(e[cut]) - e[cut] for e in (ends_a, ends_b))
        n_links = np.diff(np.searchsorted(cut, edge, side="right"))
        n_groups = np.diff(np.searchsorted(np.flatnonzero(both), edge, side="right"))
        doc = np.repeat(np.arange(len(texts)), n_links)
        found = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}
        return found | {"groups": self._groups(a, n_a, b, n_b, ends_a, ends_b, both), "doc": doc, "a": a[link_a], "b": b[link_b]}

    def _groups(self, a, n_a, b, n_b, ends_a, ends_b, both) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        at = np.flatnonzero(both)
        last_a, last_b = np.cumsum(ends_a)[at], np.cumsum(ends_b)[at]  # tokens up to each group's end
        count_a, count_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
        row = np.zeros((len(a) + len(b), 6), dtype=np.uint8)
        closing_a, closing_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        closing_a[last_a - 1] = len(self.size_a)
        closing_b[last_b - 1] = len(self.size_b)
        row[np.arange(len(a)) + np.repeat(last_b - count_b, count_a)] = self.text_a[a + closing_a]
        row[np.arange(len(b)) + np.repeat(last_a, count_b)] = self.text_b[b + closing_b]
        length = np.concatenate([[0], np.cumsum(np.count_nonzero(row, axis=1))])
        text = row[row != 0].tobytes()
        stop = length[np.cumsum(n_a) + np.cumsum(n_b)]
        start = np.concatenate([[0], stop[:-1]])
        return [text[i : j - 1] if j > i else b"" for i, j in zip(start.tolist(), stop.tolist(), strict=True)]


def multiplicities(b: np.ndarray, doc: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (b, doc, a) in order, and how often each occurs."""
    key, m = np.unique(b << 47 | doc << 16 | a, return_counts=True)
    return key >> 47, key >> 16 & 0x7FFFFFFF, key & 0xFFFF, m


def _planes(chunk: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype=t) for x, t in zip(chunk, ("<u2", "<u4", "<u2", "<u2", "<u4"), strict=True)]


def _aligned(path_a: str, path_b: str, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = resident(f"align:{path_a}:{path_b}", lambda: Aligner(path_a, path_b))
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            base = 0
            for piece in scan.chunks(batch.column("text"), CHUNK_BYTES):
                for lo in range(0, len(piece), CHUNK_DOCS):
                    texts = piece.slice(lo, CHUNK_DOCS)
                    got = align(texts.to_pylist())
                    b, doc, a, m = multiplicities(got["b"], got["doc"], got["a"])
                    kinds, first = np.unique(b, return_index=True)
                    counts = np.diff(np.append(first, len(b)))
                    links = [x.astype(t).tobytes() for x, t in ((kinds, "<u2"), (counts, "<u4"), (a, "<u2"), (doc, "<u2"), (m, "<u4"))]
                    groups = [g.decode() for g in got["groups"]]
                    if not keep_groups:
                        groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    columns = [pa.array([(task << 33) + n], pa.int64()), pa.array([batch.column("id").slice(base + lo, len(texts)).to_pylist()], pa.list_(pa.int64()))]
                    columns += [pa.array([got[c]], pa.list_(pa.int64())) for c in _STATS]
                    columns += [pa.array([groups], pa.list_(pa.string())), *[pa.array([x], pa.binary()) for x in links]]
                    yield pa.RecordBatch.from_arrays(columns, names=["chunk", "ids", *_STATS, "groups", *_LINKS])
                    n += 1
                base += len(piece)
            trim()

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links and postings of each pair, as far as a task has seen them."""
    held: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 3

    def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        key, links, postings = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        return [key[head], *[np.add.reduceat(x[order], head) if len(head) else x for x in (links, postings)]]

    def rows() -> pa.RecordBatch:
        columns = [pa.array((held[0] >> 16).astype(np.int32)), pa.array((held[0] & 0xFFFF).astype(np.int32)), pa.array(held[1]), pa.array(held[2])]
        return pa.RecordBatch.from_arrays(columns, names=["b", "a", "links", "postings"])

    for batch in batches:
        for i in range(batch.num_rows):
            kinds, counts, a, _, m = _planes([batch.column(c)[i] for c in _LINKS])
            key = np.repeat(kinds.astype(np.int64), counts) << 16 | a
            held = merged([held, [key, m.astype(np.int64), np.ones(len(key), dtype=np.int64)]])
            if len(held[0]) > GATHER:
                yield rows()
                held = [x[:0] for x in held]
    yield rows()


_STREAM = "key long, kind int, a int, links long, chunk long, data_a binary, data_doc binary, data_m binary"


def _postings(splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each B id of each chunk."""
        split_of = splits.value
        for batch in batches:
            for i in range(batch.num_rows):
                kinds, counts, *planes = _planes([batch.column(c)[i] for c in _LINKS])
                chunk = batch.column("chunk")[i].as_py()
                n = len(kinds)
                split = scan.mix(np.full(n, chunk, dtype=np.uint64)) % split_of[kinds].astype(np.uint64)
                key = kinds.astype(np.int64) << SPLIT_BITS | split.astype(np.int64)
                end = np.cumsum(counts, dtype=np.int64)
                none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())
                columns = [pa.array(key), pa.array(np.ones(n, dtype=np.int32)), *none, pa.array(np.full(n, chunk, dtype=np.int64))]
                for p in planes:
                    offsets = np.concatenate([[0], end]) * p.itemsize
                    columns.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(p.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, names=["key", "kind", "a", "links", "chunk", "data_a", "data_doc", "data_m"])

    return run


def _contributed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document's postings: rows sorted by key, its counts (kind 0, by A id) before its postings."""
    known, links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)  # key and A id of the counts at hand
    held: list[list[np.ndarray]] = []
    size = 0

    def rows() -> pa.RecordBatch:
        """A row for each chunk: its documents, and both sums of each."""
        chunk, doc, best, total = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, chunk))
        chunk, doc = chunk[order], doc[order]
        head = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])])
        sums = [np.add.reduceat(x[order], head) for x in (best, total)]
        chunk, doc = chunk[head], doc[head].astype("<u4")
        edge = np.append(np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(chunk))
        columns = [pa.array(chunk[edge[:-1]])]
        columns += [pa.array([x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()) for x in (doc, *sums)]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc", "best", "total"])

    for batch in batches:
        key = batch.column("key").to_numpy()
        count = batch.column("kind").to_numpy() == 0
        if count.any():
            last = known >> 16 == key[0]  # only the key that goes on is still needed
            chosen = pa.array(count)
            a, n = (batch.column(c).filter(chosen).to_numpy().astype(np.int64) for c in ("a", "links"))
            known, links = np.concatenate([known[last], key[count] << 16 | a]), np.concatenate([links[last], n])
        posting = batch.filter(pa.array(~count))
        if posting.num_rows:
            bytes_of = lambda c, t: np.frombuffer(b"".join(posting.column(c).to_pylist()), dtype=t)
            a, doc, m = (bytes_of(c, t).astype(np.int64) for c, t in (("data_a", "<u2"), ("data_doc", "<u2"), ("data_m", "<u4")))
            each = np.array([len(x) for x in posting.column("data_a").to_pylist()]) // 2
            chunk = np.repeat(posting.column("chunk").to_numpy(), each)
            place = np.searchsorted(known, np.repeat(key[~count], each) << 16 | a)
            head = np.flatnonzero(np.diff(known >> 16, prepend=-1))
            highest = np.repeat(np.maximum.reduceat(links, head), np.diff(np.append(head, len(known))))
            held.append([chunk, doc, np.where(links[place] == highest[place], m, 0), m * links[place]])
            size += len(a)
        if size > GATHER:
            yield rows()
            held, size = [], 0
    if held:
        yield rows()


def _summed(chunk: pa.Table) -> pa.Table:
    """Both sums of a chunk's documents, by their place in it."""
    doc, best, total = (np.frombuffer(b"".join(chunk[c].to_pylist()), dtype=t) for c, t in (("doc", "<u4"), ("best", "<i8"), ("total", "<i8")))
    sums = [np.zeros(int(doc.max()) + 1, dtype=np.int64) for _ in range(2)]
    for x, part in zip(sums, (best, total), strict=True):
        np.add.at(x, doc, part)
    return pa.table({"chunk": pa.array([chunk["chunk"][0].as_py()], pa.int64()), "best": pa.array([sums[0]], pa.list_(pa.int64())), "total": pa.array([sums[1]], pa.list_(pa.int64()))})


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = False) -> DataFrame:
    """id_col, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    With ``groups``, the groups themselves (``a1,a2|b1;a3|b2,b3``) instead of their digest.
    """
    spark = df.sparkSession
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    stats = ", ".join(f"{c} array<long>" for c in _STATS)
    binary = ", ".join(f"{c} binary" for c in _LINKS)
    chunks, _ = stored(base.mapInArrow(_aligned(path_a, path_b, groups), f"chunk long, ids array<long>, {stats}, groups array<string>, {binary}"), "align-chunks")
    links = chunks.select("chunk", *_LINKS)
    pairs, _ = stored(links.mapInArrow(_pair_counts, "b int, a int, links long, postings long").groupBy("b", "a").agg(F.sum("links").alias("links"), F.sum("postings").alias("postings")), "align-pairs", "8")
    # one row for each B id of the vocabulary
    load = pairs.groupBy("b").agg(F.sum("postings").alias("n")).toArrow()
    heavy = np.zeros(1 << 16, dtype=np.int64)
    heavy[load["b"].to_numpy()] = load["n"].to_numpy()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit = max(KEY_POSTINGS, int(heavy.sum()) // (4 * tasks))
    splits = np.minimum(np.maximum(-(-heavy // unit), 1), (1 << SPLIT_BITS) - 1)
    sent = spark.sparkContext.broadcast(splits)
    n_splits = F.greatest(F.lit(1), F.ceil(F.sum("postings").over(Window.partitionBy("b")) / F.lit(unit))).cast("long")
    counts = (
        pairs.withColumn("n", F.least(n_splits, F.lit((1 << SPLIT_BITS) - 1)))
        .withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select((F.shiftleft(F.col("b").cast("long"), SPLIT_BITS) + F.col("split")).alias("key"), F.lit(0).alias("kind"), "a", "links")
    )
    stream = counts.unionByName(links.mapInArrow(_postings(sent), _STREAM), allowMissingColumns=True)
    sorted_stream = stream.repartition(tasks, "key").sortWithinPartitions("key", "kind", "a")
    parts, _ = stored(sorted_stream.mapInArrow(_contributed, "chunk long, doc binary, best binary, total binary"), "align-parts", "10000")
    freed(spark)
    sums = parts.groupBy("chunk").applyInArrow(_summed, "chunk long, best array<long>, total array<long>")
    rows = chunks.select("chunk", "ids", *_STATS, "groups").join(sums, "chunk", "left")
    rows = rows.select("best", "total", F.posexplode(F.arrays_zip("ids", *_STATS, "groups")).alias("doc", "x"))
    own = lambda c, name: F.coalesce(F.get(c, "doc"), F.lit(0).cast("long")).alias(name)
    return rows.select(
        F.col("x.ids").alias(id_col), *[F.col(f"x.{c}") for c in _STATS], own("best", "n_best"), own("total", "count_sum"),
        F.col("x.groups").alias("groups" if groups else "groups_sha256"),
    )
