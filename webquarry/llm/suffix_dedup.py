"""Removal of long repeats by distributed prefix doubling over sampled positions.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with
a smaller id.  Ranks of positions are refined from SHORT to LENGTH bytes; in each
round Spark shuffles (rank, position) entries into slots of the rank space, each slot
is sorted, and positions whose rank one document alone holds take no further part.

Not every position enters the first round.  For each window of LENGTH bytes the
position with the smallest rank among its LENGTH - SHORT + 1 stands for it (the first,
if several are equal).  The choice depends on the window's bytes only, so equal
windows are stood for by equal strings at equal places, and none is missed; about one
position in 13 is enough.

Round 1: ranks of SHORT bytes at these positions.  Round 2: for the positions left,
all windows they stand for, ranked by LENGTH bytes (the SHORT bytes at offset 0 and
those at offset LENGTH - SHORT); the smallest id of each rank decides.

Documents are packed into chunks first, and entries of one chunk and slot travel as
one row.  Within a chunk equal strings are one entry, so a passage that a third of all
documents share is one entry a chunk in one slot.  Slots follow the table's size.

Ranks are 64-bit polynomial hashes.  A collision in round 1 only keeps a position
longer; in round 2 strings are also told apart by the rank of round 1, so that over
10^14 bytes a wrong byte is expected with odds under 10^-3.

A null text is empty, a null id is smaller than every other id; rows that share an id
remove nothing from each other.  Ids must be whole numbers.  Memory is a few times a
chunk, or one text where a text is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.filter_audit import NO_ID
from webquarry.llm.store import freed, stored
from webquarry.llm.udf import release, trim

LENGTH = 50
SHORT = 26
#: Bytes of a chunk (compressed, a row of it stays small for the JVM), of the part of it that is ranked at a
#: time, and of text for one slot of ranks.
CHUNK_BYTES, PART_BYTES, SLOT_BYTES = 1 << 20, 1 << 19, 4 << 20
#: Chunks in an Arrow batch.
CHUNK_ROWS = "8"

U = np.uint64
_CHUNK = "chunk long, ids array<long>, sizes array<long>, data binary"


class Anchors(NamedTuple):
    """Positions that stand for windows: the windows begin at first to last; all in bytes of the chunk."""

    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rank: np.ndarray
    context: np.ndarray  # hash of all bytes of the windows, and of the place in them


def window_anchors(buf: np.ndarray, off: np.ndarray) -> Anchors:
    """Anchors of all windows of LENGTH bytes inside documents; ``off`` are the documents' ends, from 0."""
    parts = []
    for lo in range(0, max(len(buf) - LENGTH + 1, 0), PART_BYTES):
        begins = min(PART_BYTES, len(buf) - LENGTH + 1 - lo)
        text = buf[lo : lo + begins + LENGTH - 1]
        total, inverse = scan.running(text)
        rank = scan.mix((total[SHORT:] - total[:-SHORT]) * inverse[: len(text) - SHORT + 1])
        # the smallest rank, then the first place: the place fills the low bits
        low = U((1 << int(len(rank)).bit_length()) - 1)
        best = (rank & ~low) | np.arange(len(rank), dtype=U)
        width, wanted = 1, LENGTH - SHORT + 1
        while width < wanted:
            step = min(width, wanted - width)
            best = np.minimum(best[:-step], best[step:])
            width += step
        at = (best & low).astype(np.int64)
        begin = np.arange(begins)
        doc = np.searchsorted(off, begin + lo, side="right")
        inside = np.flatnonzero(begin + lo + LENGTH <= off[np.minimum(doc, len(off) - 1)])
        if not len(inside):
            continue
        at, doc = at[inside], doc[inside]
        new = np.ones(len(inside), dtype=bool)
        new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(inside)) - 1
        first, last, at = inside[head], inside[tail], at[head]
        shape = ((last - first) * 64 + at - first).astype(U)
        context = scan.mix((total[last + LENGTH] - total[first]) * inverse[first] + shape * U(0x9E3779B97F4A7C15))
        # the smallest of many ranks is a small number: mixed again, ranks fill their space evenly
        parts.append((at + lo, first + lo, last + lo, scan.mix(rank[at] ^ U(0x9E3779B97F4A7C15)), context))
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none, none, none.astype(U), none.astype(U))
    return Anchors(*map(np.concatenate, zip(*parts, strict=True)))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks."""
    release()
    task, n, squeeze = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
    ids: list[np.ndarray] = []
    texts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def chunk() -> pa.RecordBatch:
        data = squeeze.compress(np.concatenate(texts).tobytes())
        columns = [pa.array([(task << 33) + n], pa.int64())]
        columns += [pa.array([np.concatenate(x)], pa.list_(pa.int64())) for x in (ids, sizes)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([data], pa.binary())], names=["chunk", "ids", "sizes", "data"])

    for batch in batches:
        base = 0
        for piece in scan.chunks(batch.column("text"), PART_BYTES):
            buf, off = scan.raw(piece)
            if held and held + len(buf) > CHUNK_BYTES:
                yield chunk()
                ids, texts, sizes, held, n = [], [], [], 0, n + 1
            ids.append(batch.column("id").slice(base, len(piece)).to_numpy().copy())
            sizes.append(np.diff(off))
            texts.append(buf.copy())
            held += len(buf) + 16 * len(piece)
            base += len(piece)
    if ids:
        yield chunk()


class Chunk:
    """A chunk of documents with its anchors, and what the rounds have said about them."""

    def __init__(self, row: dict, bits: int):
        self.ids = np.array(row["ids"], dtype=np.int64)
        self.off = np.concatenate([[0], np.cumsum(np.array(row["sizes"], dtype=np.int64))])
        size = int(self.off[-1])
        plain = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(size, 1))
        self.buf = np.frombuffer(plain, dtype=np.uint8)
        self.bits = bits
        self.anchors = window_anchors(self.buf, self.off[1:])
        self.owner = self.ids[np.searchsorted(self.off[1:], self.anchors.at, side="right")]

    def names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct 48-bit ranks in order, the slot of each, and each anchor's place among them."""
        names, place = np.unique(self.anchors.rank >> U(16), return_inverse=True)
        return names, (names >> U(48 - self.bits)).astype(np.int64), place

    def first_round(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Ranks for each slot (6 bytes each), and bits that say which of them two documents here share."""
        names, slot, place = self.names()
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(low, place, self.owner)
        np.maximum.at(high, place, self.owner)
        for a, b in _runs(slot):
            data = names[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
            yield int(slot[a]), data, np.packbits(low[a:b] < high[a:b]).tobytes()

    def survive(self, answers: list[tuple[int, bytes]]) -> None:
        """Keep the anchors that the first round's answers name; then ``entries`` are distinct strings."""
        names, slot, place = self.names()
        kept = np.zeros(len(names), dtype=bool)
        for s, bits in answers:
            a, b = np.searchsorted(slot, [s, s + 1])
            kept[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a)
        chosen = np.flatnonzero(kept[place])
        self.anchors = Anchors(*(x[chosen] for x in self.anchors))
        self.owner = self.owner[chosen]
        order = np.lexsort((self.owner, self.anchors.context, self.anchors.rank))
        rank, context = self.anchors.rank[order], self.anchors.context[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (rank[1:] != rank[:-1]) | (context[1:] != context[:-1])
        self.entry = np.empty(len(order), dtype=np.int64)  # of each anchor
        self.entry[order] = np.cumsum(new) - 1
        self.entries = order[new]  # an anchor with the smallest id, for each entry
        self.entry_slot = (rank[new] >> U(64 - self.bits)).astype(np.int64)

    def second_round(self) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
        """Rank, id, number of windows and bytes of the entries of each slot."""
        a = self.anchors
        for lo, hi in _runs(self.entry_slot):
            e = self.entries[lo:hi]
            windows = a.last[e] - a.first[e] + 1
            take = np.repeat(a.first[e], windows + LENGTH - 1) + _counting(windows + LENGTH - 1)
            data = self.buf[take].tobytes()
            yield int(self.entry_slot[lo]), a.rank[e].tobytes(), self.owner[e].tobytes(), windows.astype(np.uint8).tobytes(), data

    def removed(self, answers: list[tuple[int, bytes]]) -> np.ndarray:
        """Which bytes go; an answer has a bit for each window of each entry."""
        mask = np.zeros(len(self.entries), dtype=np.uint32)
        for s, data in answers:
            lo, hi = np.searchsorted(self.entry_slot, [s, s + 1])
            mask[lo:hi] = np.frombuffer(data, dtype="<u4")
        # a document here with a smaller id has the whole string
        again = self.owner > self.owner[self.entries[self.entry]] if len(self.entry) else np.zeros(0, dtype=bool)
        mine = np.where(again, np.uint32(0xFFFFFFFF), mask[self.entry]) if len(self.entry) else mask
        windows = self.anchors.last - self.anchors.first + 1
        k = _counting(windows)
        gone = (np.repeat(mine, windows) >> k.astype(np.uint32)) & np.uint32(1) == 1
        begin = (np.repeat(self.anchors.first, windows) + k)[gone]
        delta = np.zeros(len(self.buf) + 1, dtype=np.int64)
        np.add.at(delta, begin, 1)
        np.add.at(delta, begin + LENGTH, -1)
        return np.cumsum(delta[:-1]) > 0

    def results(self, gone: np.ndarray) -> pa.RecordBatch:
        """id, n_bytes, kept bytes and removed spans of each document."""
        edge = np.zeros(len(gone) + 1, dtype=bool)
        edge[self.off] = True
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
        start = np.flatnonzero(gone & (~before | edge[:-1]))
        end = np.flatnonzero(gone & (~after | edge[1:])) + 1
        first = np.searchsorted(start, self.off)
        shift = np.repeat(self.off[:-1], np.diff(first))
        kept = np.concatenate([[0], np.cumsum(~gone)])[self.off]
        spans = pa.StructArray.from_arrays([pa.array(start - shift), pa.array(end - shift)], names=["start", "end"])
        columns = [pa.array(self.ids), pa.array(np.diff(self.off))]
        offsets = pa.py_buffer(kept.astype(np.int32))
        columns.append(pa.Array.from_buffers(pa.binary(), len(self.ids), [None, offsets, pa.py_buffer(self.buf[~gone].tobytes())]))
        columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans))
        return pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "kept", "spans"])


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    cut = np.flatnonzero(np.diff(values)) + 1
    edges = [0, *cut.tolist(), len(values)]
    return zip(edges[:-1], edges[1:], strict=True) if len(values) else iter(())


def _counting(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after another."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _joined(column: pa.Array | pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and how many each row has."""
    data = column.to_pylist()
    return np.frombuffer(b"".join(data), dtype=kind), np.array([len(d) for d in data]) // np.dtype(kind).itemsize


def _first(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                got = list(Chunk(row, bits).first_round())
                slots, names, shared = zip(*got, strict=True) if got else ((), (), ())
                columns = [pa.array(slots, pa.int32()), pa.array([row["chunk"]] * len(got), pa.int64())]
                columns += [pa.array(names, pa.binary()), pa.array(shared, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "chunk", "names", "shared"])
                trim()

    return run


def _recurring(slot: pa.Table) -> pa.Table:
    """Which ranks of a slot two documents hold: bits for each chunk, in the order of its ranks."""
    raw, count = _joined(slot["names"], "u1")
    count = count // 6
    names = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    names[:, :6] = raw.reshape(-1, 6)
    names = names.view("<u8").ravel()
    twice = np.zeros(len(names), dtype=bool)
    at = 0
    for n, bits in zip(count, slot["shared"].to_pylist(), strict=True):
        twice[at : at + n] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=int(n))
        at += n
    order = np.argsort(names, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = names[order[1:]] != names[order[:-1]]
    head = np.flatnonzero(new)
    kept = np.logical_or.reduceat(twice[order], head) | (np.diff(np.append(head, len(order))) > 1)
    twice[order] = np.repeat(kept, np.diff(np.append(head, len(order))))
    return _answers(slot, count, twice, lambda part: np.packbits(part).tobytes())


def _answers(slot: pa.Table, count: np.ndarray, values: np.ndarray, pack) -> pa.Table:
    """A row for each chunk that any value concerns."""
    end = np.cumsum(count)
    rows = [(c, s, pack(values[e - n : e])) for c, s, n, e in zip(slot["chunk"].to_pylist(), slot["slot"].to_pylist(), count, end, strict=True) if values[e - n : e].any()]
    chunks, slots, data = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "slot": pa.array(slots, pa.int32()), "data": pa.array(data, pa.binary())})


def _pairs(row: dict, name: str) -> list[tuple[int, bytes]]:
    return [(x["slot"], x["data"]) for x in row[name] or []]


def _second(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, bits)
                chunk.survive(_pairs(row, "ranks"))
                got = list(chunk.second_round())
                slots, *rest = zip(*got, strict=True) if got else ((),) * 5
                columns = [pa.array(slots, pa.int32()), pa.array([row["chunk"]] * len(got), pa.int64())]
                columns += [pa.array(x, pa.binary()) for x in rest]
                yield pa.RecordBatch.from_arrays(columns, names=["slot", "chunk", "names", "owners", "windows", "data"])
                trim()

    return run


def _decided(slot: pa.Table) -> pa.Table:
    """A bit for each window of each entry: whether a smaller id has its LENGTH bytes."""
    rank, count = _joined(slot["names"], "<u8")
    owner, _ = _joined(slot["owners"], "<i8")
    windows = _joined(slot["windows"], "u1")[0].astype(np.int64)
    text, _ = _joined(slot["data"], "u1")
    size = windows + LENGTH - 1
    end = np.cumsum(size)
    entry, k = np.repeat(np.arange(len(rank)), windows), _counting(windows)
    at = (end - size)[entry] + k
    name = np.zeros(len(at), dtype=U)
    for lo, hi in _runs(end // PART_BYTES):  # entries whose bytes are ranked together
        base = end[lo] - size[lo]
        total, inverse = scan.running(text[base : end[hi - 1]])
        a, b = np.searchsorted(entry, [lo, hi])
        here = at[a:b] - base
        name[a:b] = scan.mix((total[here + LENGTH] - total[here]) * inverse[here])
    order = np.lexsort((owner[entry], rank[entry], name))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (name[order[1:]] != name[order[:-1]]) | (rank[entry[order[1:]]] != rank[entry[order[:-1]]])
    head = np.flatnonzero(new)
    lowest = np.repeat(owner[entry[order[head]]], np.diff(np.append(head, len(order))))
    gone = np.zeros(len(order), dtype=bool)
    gone[order] = lowest < owner[entry[order]]
    mask = np.zeros(len(rank), dtype=np.uint32)
    np.bitwise_or.at(mask, entry[gone], np.uint32(1) << k[gone].astype(np.uint32))
    return _answers(slot, count, mask, lambda part: part.astype("<u4").tobytes())


def _finish(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, bits)
                chunk.survive(_pairs(row, "ranks"))
                yield chunk.results(chunk.removed(_pairs(row, "decided")))
                trim()

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, kept (the bytes that remain) and spans (start, end in bytes) of every document."""
    spark = df.sparkSession
    base = df.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    chunks, _ = stored(base.mapInArrow(_pack, _CHUNK), "suffix-chunks")
    size = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    slots = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLOT_BYTES))
    bits = min(int(slots - 1).bit_length(), 30)
    answer = "chunk long, slot int, data binary"

    def by_chunk(answers: DataFrame, name: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("slot", "data")).alias(name))

    ranks = chunks.mapInArrow(_first(bits), "slot int, chunk long, names binary, shared binary")
    ranks, _ = stored(by_chunk(ranks.groupBy("slot").applyInArrow(_recurring, answer), "ranks"), "suffix-ranks", CHUNK_ROWS)
    freed(spark)
    left = chunks.join(ranks, "chunk").mapInArrow(_second(bits), "slot int, chunk long, names binary, owners binary, windows binary, data binary")
    decided, _ = stored(by_chunk(left.groupBy("slot").applyInArrow(_decided, answer), "decided"), "suffix-decided", CHUNK_ROWS)
    freed(spark)
    whole = chunks.join(ranks, "chunk", "left").join(decided, "chunk", "left")
    out = whole.mapInArrow(_finish(bits), "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), "n_bytes", "kept", "spans")


#: For small tables: a row for each byte.
SQL = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), parts AS (
  -- 500 bytes, and the 49 that windows go on for: taking a piece of a long text is slow
  SELECT doc_id, 500 * k AS base, substr(h, 1000 * k + 1, 1098) AS h, least(500, length(h) // 2 - 500 * k) AS n
  FROM texts, unnest(range(length(h) // 1000 + 1)) AS r(k)
), bytes AS (
  SELECT doc_id, base + i AS i, substr(h, 2 * i + 1, 2) AS b,
         CASE WHEN length(h) >= 2 * i + 100 THEN substr(h, 2 * i + 1, 100) END AS s
  FROM parts, unnest(range(n)) AS r(i)
), starts AS (
  SELECT doc_id, i, b, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS hit FROM bytes
), covered AS (
  SELECT doc_id, i, b, coalesce(i - max(i) FILTER (hit) OVER (PARTITION BY doc_id ORDER BY i) < 50, false) AS gone
  FROM starts
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered
), judged AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
         coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept
  FROM edges GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM texts LEFT JOIN judged USING (doc_id)
"""
