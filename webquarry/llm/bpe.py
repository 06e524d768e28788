"""Byte-level BPE in two tiers: a minimal perfect hash, then a heap over linked bytes.

A pre-token that is itself in the vocabulary is found by the minimal perfect hash
(hash and displace: one displacement a bucket, one slot an entry, the entry's
bytes compared).  Any other pre-token starts as linked single bytes; a heap of
adjacent pairs by rank, then place, gives the next merge.  The heaps of a chunk's
new pre-tokens (up to WIDE bytes; longer ones go alone) are rows of one array, and
each step pops, links and pushes in all of them at once.

Pre-tokens never span a change from visible characters to white space, so texts
are first cut there and each distinct piece is encoded once while a worker's
bounded cache holds it.

Nulls count as empty texts and give no ids.  Texts are encoded whole; decoding is
exact for any text.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.udf import resident, text_udf, with_struct, working

U = np.uint64
#: Unicode white space, as the pattern's \s has it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A run of visible characters with at most one space before it, or white space.
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The pattern of GPT-2, and pieces of which it makes at most two pre-tokens: letters, then marks but apostrophes.
GPT2 = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ſ]+)([!-&(-/:-@\[-`{-~]*)")
#: Distinct pieces and pre-tokens that a worker's caches hold (some 60 MB); when one is full, those that came again stay.
CACHE, TOKEN_CACHE = 1 << 16, 1 << 17
#: Bytes of pre-tokens whose heaps are popped together, by the width of their rows.
WIDTHS = (8, 16, 32)
WIDE = WIDTHS[-1]
#: Fewer of a width go one by one.
FEW = 64
#: An empty place of a heap.
_FREE = np.iinfo(np.int64).max


def explicit(pattern: str) -> str:
    r"""The pattern with \s and \S spelled out, the same in every engine."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i -= 1
        i += 2
    return "".join(out)


def _hash(tokens: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, none empty."""
    buf = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in tokens])
    s = scan.Scan.__new__(scan.Scan)
    s.text, s._sum = buf, None
    return s.hashes(ends - np.array([len(t) for t in tokens]), ends)


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys in n slots."""

    def __init__(self, keys: list[bytes], load: int = 4):
        h = _hash(keys)
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // load))
        bucket = self._bucket(h)
        self.shift = np.zeros(self.buckets, dtype=np.uint32)
        self.slots = np.full(self.n, -1, dtype=np.int32)
        order = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        for b in np.argsort(-np.diff(edge), kind="stable"):
            own = order[edge[b] : edge[b + 1]]
            if not len(own):
                break
            first = 0
            while True:
                tries = np.arange(first, first + 256, dtype=U)
                at = self._slot(h[own][None, :], tries[:, None])
                free = (self.slots[at] < 0).all(axis=1)
                if len(own) > 1:
                    free &= (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1)
                if free.any():
                    k = int(free.argmax())
                    self.shift[b] = first + k
                    self.slots[at[k]] = own
                    break
                first += 256

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (((h >> U(32)) * U(self.buckets)) >> U(32)).astype(np.int64)

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (scan.mix(h ^ scan.mix(shift + U(1))) % U(self.n)).astype(np.int64)

    def slots_of(self, tokens: list[bytes]) -> np.ndarray:
        """Index of the only key that each token can be."""
        h = _hash(tokens)
        return self.slots[self._slot(h, self.shift[self._bucket(h)].astype(U))]


class PairRanks:
    """Rank of the token that two tokens make side by side, for all pairs that make one."""

    def __init__(self, rank: dict[bytes, int]):
        self.above = max(rank.values(), default=0) + 1
        found = [(a * self.above + b, r) for token, r in rank.items() for i in range(1, len(token)) if (a := rank.get(token[:i])) is not None and (b := rank.get(token[i:])) is not None]
        keys, ranks = np.array(found, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), np.append(ranks[order], -1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; -1 for what is no token."""
        key = a * self.above + b
        place = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[place] == key, self.ranks[place], -1)


class Heaps:
    """One binary heap a row, all in one array; each call pops or pushes in many rows."""

    def __init__(self, entries: np.ndarray, more: int):
        n, size = entries.shape
        self.levels = int(size + more).bit_length()
        self.width = (1 << self.levels) - 1
        self.flat = np.full((n, self.width), _FREE)
        self.flat[:, :size] = np.sort(entries, axis=1)  # rows in order are heaps
        self.flat = self.flat.ravel()
        self.size = np.full(n, size)

    def pop(self, rows: np.ndarray) -> np.ndarray:
        """Take the tops; the place that each leaves free at the bottom."""
        flat, base, hole = self.flat, rows * self.width, np.zeros(len(rows), dtype=np.int64)
        for _ in range(self.levels - 1):
            child = 2 * hole + 1
            left, right = flat[base + child], flat[base + child + 1]
            flat[base + hole] = np.minimum(left, right)
            hole = child + (right < left)
        flat[base + hole] = _FREE
        return hole

    def push(self, rows: np.ndarray, entries: np.ndarray, at: np.ndarray) -> None:
        """Put an entry into each row from the free place ``at`` upwards."""
        flat, base = self.flat, rows * self.width
        flat[base + at] = entries
        while len(at):
            up = (at - 1) >> 1
            over = flat[base + np.maximum(up, 0)]
            rises = np.flatnonzero((at > 0) & (entries < over))
            base, at, up, entries = base[rises], at[rises], up[rises], entries[rises]
            flat[base + at] = over[rises]
            flat[base + up] = entries
            at = up


@dataclass
class Vocabulary:
    """Byte strings by id; merges follow the order of the ranks."""

    tokens: list[bytes]
    ids: list[int]
    pattern: str
    table: PerfectHash
    pairs: PairRanks
    token: str = field(default_factory=lambda: uuid.uuid4().hex)  # names the vocabulary in a worker

    @staticmethod
    def from_ranks(path: str, pattern: str) -> Vocabulary:
        """A vocabulary from a file of base64 tokens and ranks."""
        with open(path, "rb") as f:
            pairs = [(base64.b64decode(a), int(b)) for a, b in (line.split() for line in f if line.strip())]
        return Vocabulary([t for t, _ in pairs], [i for _, i in pairs], explicit(pattern), PerfectHash([t for t, _ in pairs]), PairRanks(dict(pairs)))


class Codec:
    """Encoder and decoder of one Python worker, with its caches."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.rank = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
        self.bytes_of = dict(zip(vocabulary.ids, vocabulary.tokens, strict=True))
        self.pair = [self.rank.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]  # ranks of two bytes
        self.byte = [self.rank.get(bytes((b,)), -1) for b in range(256)]
        self.pair_array, self.byte_array = np.array(self.pair), np.array(self.byte)
        self.split = regex.compile(vocabulary.pattern).findall
        self.decimal = {i: str(i) for i in vocabulary.ids}
        self.bytes_of_decimal = {self.decimal[i]: t for i, t in self.bytes_of.items()}
        self.plain = PLAIN.fullmatch if vocabulary.pattern == explicit(GPT2) else None
        # ids in decimal, joined by commas: shorter in memory than numbers, and what the digests are of
        self.cache: dict[str, str] = {}  # by piece
        self.tokens: dict[str, str] = {}  # by pre-token
        self.again: set[str] = set()  # pieces that came again since they are kept
        self.tokens_again: set[str] = set()

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token by merging linked bytes, the lowest rank first.

        A heap entry is one integer: rank, begin of the pair, end of the pair.
        """
        n = len(piece)
        get = self.rank.get
        bits = n.bit_length()
        shift, low = 2 * bits, (1 << bits) - 1
        ids = [self.byte[b] for b in piece]  # id of the token that begins here
        end = list(range(1, n + 1))  # end of the token that begins here; n where it was swallowed
        end.append(0)  # no pair goes beyond the end
        back = list(range(-1, n))  # begin of the token that ends here
        pair = self.pair
        heap = [(((r << bits) | i) << bits) | (i + 2) for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pair[a << 8 | b]) >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            stop = entry & low
            i = (entry >> bits) & low
            j = end[i]
            if end[j] != stop:
                continue  # one of the pair has merged since
            end[i] = stop
            end[j] = n
            back[stop] = i
            ids[i] = entry >> shift
            if stop < n and (r := get(piece[i : end[stop]])) is not None:
                heappush(heap, (((r << bits) | i) << bits) | end[stop])
            if i and (r := get(piece[back[i] : stop])) is not None:
                heappush(heap, (((r << bits) | back[i]) << bits) | stop)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = end[i]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """merge() of many pre-tokens."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        alone = np.flatnonzero(size > WIDE).tolist()
        for low, high in zip((0, *WIDTHS), WIDTHS):
            own = np.flatnonzero((size > low) & (size <= high)).tolist()
            if len(own) < FEW:
                alone += own
            else:
                ids, count = self._merge_rows([pieces[k] for k in own], size[own], high)
                ids, stop = ids.tolist(), np.cumsum(count).tolist()
                for k, a, b in zip(own, [0, *stop], stop):
                    out[k] = ids[a:b]
        for k in alone:
            out[k] = self.merge(pieces[k])
        return out

    def _merge_rows(self, pieces: list[bytes], n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens of at most ``width`` bytes one after another, and how many each has. Steps and entries are those of merge()."""
        rows, bits = len(pieces), width.bit_length()
        shift, low = 2 * bits, (1 << bits) - 1
        text = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(rows, width)
        place = np.arange(width + 1)
        alive = place < n[:, None]  # where a token begins
        ids = np.zeros((rows, width + 1), dtype=np.int64)
        ids[:, :width] = self.byte_array[text]
        end = np.broadcast_to(place + 1, alive.shape).copy()
        end[np.arange(rows), n] = 0
        back = np.broadcast_to(place - 1, alive.shape).copy()
        rank = self.pair_array[text[:, :-1].astype(np.int64) << 8 | text[:, 1:]]
        first = ((rank << bits | place[: width - 1]) << bits) | (place[: width - 1] + 2)
        heaps = Heaps(np.where((rank >= 0) & alive[:, 1:width], first, _FREE), width - 1)
        shape, flat = alive.shape, heaps.flat
        alive, ids, end, back = alive.ravel(), ids.ravel(), end.ravel(), back.ravel()
        row = np.arange(rows)
        while True:
            top = flat[row * heaps.width]
            some = np.flatnonzero(top != _FREE)
            if not len(some):
                break
            row, top = row[some], top[some]
            hole = heaps.pop(row)
            base, i, stop = row * (width + 1), (top >> bits) & low, top & low
            j = end[base + i]
            fresh = np.flatnonzero(end[base + j] == stop)  # of the others, one of the pair has merged since
            r, base, i, j, stop, hole, new = row[fresh], base[fresh], i[fresh], j[fresh], stop[fresh], hole[fresh], top[fresh] >> shift
            last = n[r]
            end[base + i], end[base + j], back[base + stop], ids[base + i], alive[base + j] = stop, last, i, new, False
            after = np.flatnonzero(stop < last)
            at = base[after] + stop[after]
            pair = self.vocabulary.pairs.of(new[after], ids[at])
            makes = np.flatnonzero(pair >= 0)
            one = after[makes]
            heaps.push(r[one], (((pair[makes] << bits) | i[one]) << bits) | end[at[makes]], hole[one])
            hole[one] = heaps.size[r[one]]  # a second entry goes to the row's end
            heaps.size[r[one]] += 1
            before = np.flatnonzero(i > 0)
            begin = back[base[before] + i[before]]
            pair = self.vocabulary.pairs.of(ids[base[before] + begin], new[before])
            makes = np.flatnonzero(pair >= 0)
            one = before[makes]
            heaps.push(r[one], (((pair[makes] << bits) | begin[makes]) << bits) | stop[one], hole[one])
        return ids[alive], alive.reshape(shape).sum(axis=1)

    @staticmethod
    def _missing(seen: set[str], held: dict, again: set[str], limit: int) -> set[str]:
        """What of seen is not held. A full cache keeps what came again, half of the limit at most."""
        new = seen.difference(held)
        again.update(seen.difference(new))
        if len(held) + len(new) <= limit:
            return new
        kept = {name: held[name] for name in islice((n for n in held if n in again), limit // 2)}
        held.clear()
        again.clear()
        if len(kept) + len(new) <= limit:
            held.update(kept)
        return seen.difference(held)

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the cache."""
        names = list(pieces)
        # a piece that is one pre-token is held by both caches, so they share its string
        parts = [self.cut(p) for p in names]
        distinct = list(self._missing(set(chain.from_iterable(parts)), self.tokens, self.tokens_again, TOKEN_CACHE))
        ids = self.tokens
        if distinct:
            data = [t.encode() for t in distinct]
            known, tokens, decimal = self.vocabulary.ids, self.vocabulary.tokens, self.decimal
            slots = self.vocabulary.table.slots_of(data).tolist()
            ids.update((name, decimal[known[slot]]) for name, token, slot in zip(distinct, data, slots, strict=True) if tokens[slot] == token)
            other = [k for k, (token, slot) in enumerate(zip(data, slots, strict=True)) if tokens[slot] != token]
            for k, own in zip(other, self.merge_all([data[k] for k in other]), strict=True):
                ids[distinct[k]] = ",".join([decimal[i] for i in own])
        for name, part in zip(names, parts, strict=True):
            self.cache[name] = ids[part[0]] if len(part) == 1 else ",".join([ids[t] for t in part])

    def cut(self, piece: str) -> tuple[str, ...] | list[str]:
        """The pre-tokens of a piece."""
        found = self.plain(piece) if self.plain else None
        if found:
            return found.groups() if found[2] else (piece,)
        part = self.split(piece)
        return part if len(part) > 1 else (piece,)

    def pieces(self, chunk: pa.Array) -> list[list[str]]:
        """Texts cut into pieces, all of them in the cache."""
        cut = [PIECES.findall(t) for t in chunk.to_pylist()]
        self.learn(self._missing(set(chain.from_iterable(cut)), self.cache, self.again, CACHE))
        return cut

    def decimal_chunk(self, chunk: pa.Array) -> list[str]:
        """Ids of each text in decimal, joined by commas."""
        cut = self.pieces(chunk)
        get = self.cache.__getitem__
        return [",".join(map(get, pieces)) for pieces in cut]

    def encode_chunk(self, chunk: pa.Array) -> list[list[int]]:
        return [list(map(int, row.split(","))) if row else [] for row in self.decimal_chunk(chunk)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_decimal(self, row: str) -> bytes:
        """The bytes of ids in decimal, joined by commas."""
        return b"".join(map(self.bytes_of_decimal.__getitem__, row.split(","))) if row else b""


def codec_of(sent) -> Codec:
    """The worker's codec for a broadcast vocabulary; kept with its caches from task to task while these follow each other."""
    return resident("bpe:" + sent.value.token, lambda: Codec(sent.value))


def encode(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """df plus ids (array of int); a clashing column is replaced."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        codec = codec_of(sent)
        return lambda chunk: {"ids": codec.encode_chunk(chunk)}

    return with_struct(df, text_udf("ids array<int>", start, "bpe:")(F.col(f"`{text_col}`").cast("string")), ["ids"])


def decode(df: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """df plus decoded (binary) from arrays of ids; null ids give null."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        with working("bpe:"):
            codec = codec_of(sent)
            for batch in batches:
                yield pa.array([None if x is None else codec.decode(x) for x in batch.to_pylist()], type=pa.binary())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn("decoded", F.arrow_udf(run, returnType="binary")(F.col(f"`{ids_col}`")))


def round_trip_digests(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256: ids encoded, then decoded, in one pass."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def start():
        codec = codec_of(sent)
        digest = lambda data: hashlib.sha256(data).hexdigest()

        def one(chunk: pa.Array) -> dict:
            rows = codec.decimal_chunk(chunk)
            return {"n_tokens": [r.count(",") + 1 if r else 0 for r in rows], "ids_sha256": [digest(r.encode()) for r in rows], "decoded_sha256": [digest(codec.decode_decimal(r)) for r in rows]}

        return one

    base = df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return with_struct(base, text_udf("n_tokens long, ids_sha256 string, decoded_sha256 string", start, "bpe:")(F.col("text")), ["n_tokens", "ids_sha256", "decoded_sha256"]).drop("text")
