"""Token ids in files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are ranked by how often the whole table uses them (ties: smaller id first).
A block holds the ranks of consecutive documents in ascending id order: control
bytes, each with the byte lengths (1 to 4) of four ranks in two bits apiece, then
the ranks' bytes, little-endian.  Decoding takes the lengths of a control byte
from a 256-row table and gathers all ranks of a block at once.

Layout of a store, in folders under one path: ``ranks`` (rank, id) and ``blocks``
(part, block, start, doc_ids, counts, control, data); both are written by Spark's
committed writers, so a lost executor leaves no partial block.  ``start`` counts
the ids of all documents before the block.

Null texts count as empty.  Null ids sort first; rows that share an id are sorted
by text.  Blocks are cut at BLOCK_CHARS characters, or after one longer text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webquarry.llm import scan
from webquarry.llm.bpe import PIECES
from webquarry.llm.store import discard, shared_folder, stored
from webquarry.llm.udf import resident

BLOCK_CHARS = 1 << 20
#: Distinct pieces that a worker's cache holds (some 210 MB); when full, the often used ones stay.
CACHE = 1 << 20
#: Marks but the apostrophe, which begins contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters for one sorted partition.
PART_CHARS = 128 << 20

_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], dtype=np.int64)
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned integers below 2**32."""
    values = np.asarray(values, dtype="<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    codes[: len(values)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.empty(int(at[-1]) + int(size[-1]) if len(size) else 0, dtype=np.uint8)
    data[at] = values & 0xFF
    for k in (1, 2, 3):  # of ever fewer values
        more = np.flatnonzero(size > k)
        values, at, size = values[more], at[more], size[more]
        data[at + k] = values >> (8 * k) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n integers of pack()."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    end = np.cumsum(size)
    padded = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    at = end - size
    value = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        if len(size) and size.max() > k:
            value |= padded[at + k].astype(np.uint32) << np.uint32(8 * k)
    return value & _MASKS[size]


class CachedEncoder:
    """The tokenizers library, asked once for each distinct piece while the cache holds it.

    Exact for byte-level BPE whose pre-tokens do not span a change from visible
    characters to white space.  New pieces go to the library as one text, in which
    each begins with white space as it did where it came from (or with a line break
    of its own); the byte lengths of the tokens give the pieces' ids back.  Special
    tokens in a text are ordinary text, or with ``special`` their own ids: then texts
    that hold one go to the library whole.
    """

    #: Pieces of a text that are encoded apart, and how many distinct ones are kept.
    cut = staticmethod(PIECES.findall)
    limit = CACHE

    def __init__(self, path: str, special: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)  # bytes of each token
        for token, i in vocabulary.items():
            self.size[i] = len(token)  # one character stands for one byte
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}  # place of a piece in begin and count
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.begin, self.count = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        self.used = 0
        self.uses = np.zeros(1 << 16, dtype=np.int64)  # how often a piece occurred since it is kept

    def evict(self) -> None:
        """Keep the pieces that occur again and again, at most half of the cache."""
        names, uses = list(self.cache), self.uses[: len(self.cache)]
        often = np.flatnonzero(uses > 2)
        often = np.sort(often[np.argsort(-uses[often], kind="stable")[: self.limit // 2]])
        ids, counts = self._gather(often), self.count[often]
        self.clear()
        self._keep([names[i] for i in often], ids, counts)

    def _keep(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        have = len(self.cache)
        while have + len(pieces) > len(self.begin):
            self.begin, self.count, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.count, self.uses))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, self.ids])
        self.ids[self.used : self.used + len(ids)] = ids
        self.count[have : have + len(pieces)] = counts
        self.begin[have : have + len(pieces)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.cache.update(zip(pieces, range(have, have + len(pieces)), strict=True))

    def learn(self, new: list[str]) -> None:
        alone = [p for p in new if p.isspace()]
        for p in alone:
            ids = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype=np.uint32)
            self._keep([p], ids, np.array([len(ids)]))
        known = set(alone)
        # marks after a letter are a pre-token of their own: such pieces take their stem's ids
        stems = [p.rstrip(MARKS) for p in new]
        marked = [(p, s, p[len(s) :]) for p, s in zip(new, stems, strict=True) if len(s) < len(p) and s and s[-1].isalpha()]
        known.update(p for p, _, _ in marked)
        whole = {p for p in new if p not in known}
        whole.update({s for _, s, _ in marked}.union(t for _, _, t in marked).difference(self.cache))
        rest = list(whole)
        for lo in range(0, len(rest), 4096):
            part = rest[lo : lo + 4096]
            led = [p if p[0] == " " else "\n" + p for p in part]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(led)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            end = np.cumsum(self.size[ids])
            stop = np.cumsum([len(p.encode()) for p in led])
            at = np.searchsorted(end, stop, side="left") + 1  # tokens up to each piece's end
            lead = np.array([p[0] != " " for p in part])
            first = np.concatenate([[0], at[:-1]]) + lead
            keep = np.ones(len(ids), dtype=bool)
            keep[first[lead] - 1] = False
            self._keep(part, ids[keep], at - first)
        if marked:
            stem = np.fromiter((self.cache[s] for _, s, _ in marked), dtype=np.int64)
            tail = np.fromiter((self.cache[t] for _, _, t in marked), dtype=np.int64)
            both = np.stack([stem, tail], axis=1).ravel()
            self._keep([p for p, _, _ in marked], self._gather(both), self.count[stem] + self.count[tail])

    def _gather(self, place: np.ndarray) -> np.ndarray:
        """Ids of pieces one after another."""
        count = self.count[place]
        before = np.cumsum(count) - count
        return self.ids[np.repeat(self.begin[place] - before, count) + np.arange(count.sum())]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self.pieces(texts)
        self.tokenizer.encode_special_tokens = False
        alone = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32) for i in whole}
        self.tokenizer.encode_special_tokens = True
        ids, counts = self.pieces(["" if i in alone else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        parts = [alone.get(i, part) for i, part in enumerate(parts)]
        return np.concatenate(parts), np.array([len(part) for part in parts], dtype=np.int64)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by pieces, for texts without added tokens."""
        cut = [self.cut(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        place = np.fromiter(map(self.cache.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        open_at = np.flatnonzero(place < 0).tolist()
        new = {flat[i] for i in open_at}
        if new and len(self.cache) + len(new) > self.limit:
            self.evict()  # which renumbers what it keeps
            open_at = range(len(flat))
            new = set(flat).difference(self.cache)
        self.learn(list(new))
        if open_at:
            place[open_at] = [self.cache[flat[i]] for i in open_at]
        uses = np.bincount(place, minlength=1)
        self.uses[: len(uses)] += uses
        total = np.concatenate([[0], np.cumsum(self.count[place])])
        edge = np.concatenate([[0], np.cumsum([len(p) for p in cut])]).astype(np.int64)
        return self._gather(place), total[edge[1:]] - total[edge[:-1]]


def encoder_of(path: str, special: bool) -> CachedEncoder:
    """The worker's encoder for a tokenizer file; kept from task to task with its cache."""
    return resident(f"tokens:{special}:{path}", lambda: CachedEncoder(path, special))


_RAW = "part int, block int, start long, doc_ids array<long>, counts array<int>, ids binary"


def _encode(path: str, end_id: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = encoder_of(path, special), zstandard.ZstdCompressor(level=1)
        part, block, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            base = 0
            for chunk in scan.chunks(batch.column("text"), BLOCK_CHARS):
                plain, counts = encoder(chunk.to_pylist())
                ids = np.insert(plain, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                # bytes of equal weight side by side compress better
                planes = ids.view(np.uint8).reshape(-1, 4).T.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([start], pa.int64()), pa.array([batch.column("id").slice(base, len(chunk)).to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int32())), pa.array([squeeze.compress(planes)], pa.binary())], names=["part", "block", "start", "doc_ids", "counts", "ids"])
                base, block, start = base + len(chunk), block + 1, start + len(ids)

    return run


def _plain(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=4 * n), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, dtype=np.int64)
    for batch in batches:
        for counts, data in zip(batch.column("counts").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            got = np.bincount(_plain(data, sum(counts)))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


def _rank(sent, starts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, before = sent.value, starts.value
        for batch in batches:
            packed = [pack(rank[_plain(d, sum(c))]) for c, d in zip(batch.column("counts").to_pylist(), batch.column("ids").to_pylist(), strict=True)]
            start = [before[p] + s for p, s in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("block"), pa.array(start, pa.int64()), batch.column("doc_ids"), batch.column("counts"), pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary())], names=["part", "block", "start", "doc_ids", "counts", "control", "data"])

    return run


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> None:
    """Encode all texts with a tokenizer file and write a store at ``path``.

    Strings of added tokens in a text are ordinary text, or with ``special`` those
    tokens, as the library has it by default.

    One range exchange of the texts orders them; ids are written once in between,
    counted over the whole table, and ranked.  The driver holds the vocabulary's
    ranks and one number for each sorted partition.
    """
    spark = df.sparkSession
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chars = base.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    ordered = base.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    plain, plain_at = stored(ordered.mapInArrow(_encode(tokenizer, end_id, special), _RAW), "ids")
    counted = plain.select("counts", "ids").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counted["id"].to_numpy(), counted["n"].to_numpy()
    by_rank = ids[np.lexsort((ids, -n))]
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, dtype=np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    sums = plain.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, total = {}, 0
    for row in sums:
        before[row["part"]] = total
        total += row["n"]
    context = spark.sparkContext
    blocks = plain.mapInArrow(_rank(context.broadcast(rank), context.broadcast(before)), "part int, block int, start long, doc_ids array<long>, counts array<int>, control binary, data binary")
    blocks.write.parquet(f"{path}/blocks")
    spark.createDataFrame(pa.table({"rank": pa.array(np.arange(len(by_rank)), pa.int64()), "id": pa.array(by_rank, pa.int64())})).coalesce(1).write.parquet(f"{path}/ranks")
    discard(spark, plain_at)


def _ids_by_rank(spark: SparkSession, path: str) -> np.ndarray:
    """The ids of a store by rank: at most one for each vocabulary entry."""
    got = spark.read.parquet(f"{path}/ranks").toArrow()
    ids = np.zeros(len(got), dtype="<u4")
    ids[got["rank"].to_numpy()] = got["id"].to_numpy()
    return ids


def _read(sent, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], dtype=np.int64)
                ids = ids_of[unpack(row["control"], row["data"], int(counts.sum()))]
                end = np.cumsum(counts)
                cut = list(zip(end - counts, end, strict=True))
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + end - counts, pa.int64()), pa.array(counts, pa.int64())]
                if digest:
                    columns.append(pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in cut], pa.int64()))
                else:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], end]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "x"])

    return run


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """A row for each document of a store: id_col, start, n_tokens, ids."""
    sent = spark.sparkContext.broadcast(_ids_by_rank(spark, path))
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_read(sent, False), "id long, start long, n_tokens long, x array<int>").toDF(id_col, "start", "n_tokens", "ids")


def token_digests(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """As read_tokens, with ids_crc32 (of little-endian unsigned 32-bit ids) for the ids."""
    sent = spark.sparkContext.broadcast(_ids_by_rank(spark, path))
    return spark.read.parquet(f"{path}/blocks").mapInArrow(_read(sent, True), "id long, start long, n_tokens long, x long").toDF(id_col, "start", "n_tokens", "ids_crc32")


def new_store(spark: SparkSession, name: str) -> str:
    """A path for a store in the shared folder; it does not exist yet."""
    return f"{shared_folder(spark)}/webquarry/{re.sub(r'[^a-z0-9]+', '-', name.lower())}-{np.random.default_rng().integers(1 << 62):x}"
