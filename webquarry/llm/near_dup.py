"""Near-duplicate documents: one-permutation MinHash, bands, star candidates.

1. Each text becomes its set of distinct word shingles (64-bit hashes).  Equal
   sets are one class; only the smallest id of a class goes on.
2. One permutation fills ``bands * rows`` bins; an empty bin copies the bin that
   a fixed hash sequence reaches first (optimal densification).
3. Each band is a bucket key.  Every bucket yields a star: its members against
   its smallest id, so a bucket of n gives n - 1 pairs.
4. Pairs are confirmed on the full sets, and links joined to components.
5. A star can miss a link between two members that both differ from the centre.
   Members of buckets that still lie in several components are compared in blocks:
   first by set size and the bytes of their signatures, which marks the members
   that may have a link across components; then, in blocks bounded by shingles, on
   the full sets.  Only true links are emitted.

With 32 bands of 5 rows, a pair at similarity 0.8 shares no bucket with a
probability of 3e-6; of those that share one, the bytes of the signatures turn
away one in 1e8 (six standard deviations); every other pair is decided exactly.

Joins on ids and labels that many rows share (the centre of a large star, the
label of a large component, a set that a third of all texts have) are broadcast
or split, see store.joined.

Nulls, empty and blank texts have no shingles and are linked with nothing.  Texts
of fewer words than a shingle are one shingle.  Rows that share an id count as
one document.  A null id gets a null component and is kept.  Other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.store import HEAVY, SPLITS, discard, joined, small, stored
from webquarry.llm.udf import text_udf, tidy, trim

U = np.uint64
#: Documents in one block of the comparison of signatures within a bucket.
BLOCK = 1000
#: Rows of a key of 16 bytes and an id up to which they are broadcast: at most about 64 MB.
KEYS = 500_000
#: Blocks in one Arrow batch.
GROUPS = "16"
#: Shingles in one block of the comparison of sets within a bucket, or one longer set.
BLOCK_SHINGLES = 400_000


def shingle_sets(chunk: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    s = scan.Scan(chunk)
    words = s.words()
    h, at = scan.windows(words, s.first, size)
    cut = np.searchsorted(at, s.first)
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[cut[:-1][cut[:-1] < len(h)]] = True  # a text's first shingle is new to it
    edge = np.concatenate([[0], np.cumsum(fresh)])[cut].tolist()
    h = h[fresh]
    weight = scan.stream(11, size) | U(1)
    n_words = np.diff(s.first)
    out = [h[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    for d in np.flatnonzero((n_words > 0) & (n_words < size)):
        w = words[s.first[d] : s.first[d + 1]]
        out[d] = scan.mix((w * weight[: len(w)]).sum(keepdims=True, dtype=U) + U(len(w)))
    return out


@functools.lru_cache(maxsize=16)
def _detours(bins: int, turns: int) -> np.ndarray:
    """Bin that an empty bin looks at in each turn (turns, bins)."""
    turn = (np.arange(1, turns + 1, dtype=object) * 0x632BE59BD9B4E019 % (1 << 64)).astype(U)
    return (scan.mix(np.arange(bins, dtype=U)[None, :] * U(0x9E3779B97F4A7C15) + turn[:, None]) % U(bins)).astype(np.int64)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification; a row for each set, none empty."""
    n = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    place = np.repeat(np.arange(len(sets)), n) * bins + (((h >> U(32)) * U(bins)) >> U(32)).astype(np.int64)
    begins = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # sets are sorted, so bins are too
    flat = np.zeros(len(sets) * bins, dtype=U)
    filled = np.zeros(len(sets) * bins, dtype=bool)
    flat[place[begins]] = np.minimum.reduceat(scan.mix(h ^ U(0x1234567)), begins)
    filled[place[begins]] = True
    source = np.arange(len(flat))
    empty = np.flatnonzero(~filled)
    done, ahead = 0, 1
    while len(empty):  # several turns at a time: few texts, those of few shingles, need many
        ahead = min(2 * ahead, max(1, (1 << 18) // len(empty)))
        table = _detours(bins, 1 << (done + ahead).bit_length())[done : done + ahead]
        at = (empty - empty % bins)[None, :] + table[:, empty % bins]
        good = filled[at]
        hit = good.any(axis=0)
        first = good.argmax(axis=0)
        source[empty[hit]] = at[first[hit], np.flatnonzero(hit)]
        empty = empty[~hit]
        done += ahead
    return flat[source].reshape(len(sets), bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys, one of each band; the band's number is part of its key."""
    keys = np.repeat(scan.stream(23, bands)[None, :], len(signature), axis=0)
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        keys = scan.mix(keys * U(0x100000001B3) + parts[:, :, r])
    return keys.view(np.int64)


def _sketch(size: int, bands: int, rows: int):
    """n: set size; key: digest of the set; bands: bucket keys; sig: a byte of each bin."""

    def start():
        def one(chunk: pa.Array) -> dict:
            sets = shingle_sets(chunk, size)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            if full:
                signature = signatures([sets[i] for i in full], bands * rows)
                low = (signature & U(0xFF)).astype(np.uint8)
                for i, k, b in zip(full, band_keys(signature, bands, rows), low, strict=True):
                    keys[i], sigs[i] = k, b.tobytes()
            return {"n": [len(s) for s in sets], "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], "bands": keys, "sig": sigs}

        return one

    return text_udf("n long, key binary, bands array<long>, sig binary", start)


def _set_column(size: int):
    def start():
        return lambda chunk: {"hashes": [s.tobytes() for s in shingle_sets(chunk, size)]}

    return text_udf("hashes binary", start)


def _linked(a: np.ndarray, b: np.ndarray, parts: int, of: int) -> bool:
    if of * min(len(a), len(b)) < parts * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return of * both >= parts * (len(a) + len(b) - both)


def _confirm(parts: int, of: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("x_set"), batch.column("y_set")
            keep = [_linked(np.frombuffer(p.as_buffer(), dtype=U), np.frombuffer(q.as_buffer(), dtype=U), parts, of) for p, q in zip(a, b, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, type=pa.bool_()))
        trim()

    return run


def block_links(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray | None, parts: int, of: int) -> list[tuple[int, int]]:
    """Linked pairs of different components; with ``side``, only pairs across it.

    Intersections come from one product of the incidence of shingles that two or
    more sets share, in slices of bounded width.
    """
    n = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    take = shared[column]
    row, column = row[take], number[column[take]]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = 4096
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        hit = np.zeros((len(sets), width), dtype=np.float32)
        hit[row[a:b], column[a:b] - lo] = 1
        both += hit @ hit.T
    good = (of * both >= parts * (n[:, None] + n[None, :] - both)) & (component[:, None] != component[None, :])
    if side is not None:
        good &= side[:, None] != side[None, :]
    return [(int(i), int(j)) for i, j in np.argwhere(np.triu(good, 1))]


def may_link(sig: np.ndarray, n: np.ndarray, parts: int, of: int) -> np.ndarray:
    """Matrix of the pairs that set sizes and signature bytes (documents, bins) do not rule out.

    Two bits of each bin are compared; where the bins differ, they agree by chance, so
    the product of their signs estimates the similarity.
    """
    bins = sig.shape[1]
    signs = np.concatenate([(sig >> k & 1).astype(np.float32) for k in (0, 1)], axis=1) * 2 - 1
    estimate = signs @ signs.T / np.float32(2 * bins)
    drawn = bins * (1 - np.exp(-n / bins))  # bins that a set of this size fills by itself
    p = parts / of
    least = (p - 6 * np.sqrt((p * (1 - p) + (1 - p) / 2) / np.maximum(drawn, 1))).astype(np.float32)
    size = np.log(n).astype(np.float32)
    near = np.abs(size[:, None] - size[None, :]) <= np.float32(-np.log(p) + 1e-5)
    return near & (estimate >= np.minimum(least[:, None], least[None, :]))


def _groups(column: pa.ListArray) -> Iterator[tuple[slice, pa.StructArray]]:
    """Rows of each list of a column of structs, and all of them."""
    rows = column.flatten()
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield slice(int(a), int(b)), rows


def _candidates(parts: int, of: int):
    """Members of blocks that may have a link to another component (and, across two halves, to the other half)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, (at, rows) in zip(batch.column("bucket").to_pylist(), _groups(batch.column("rows")), strict=True):
                own = rows.slice(at.start, at.stop - at.start)
                component, half, n = (own.field(f).to_numpy() for f in ("component", "half", "n"))
                good = may_link(np.stack([np.frombuffer(x, dtype=np.uint8) for x in own.field("sig").to_pylist()]), n, parts, of) & (component[:, None] != component[None, :])
                if (half != half[0]).any():
                    good &= half[:, None] != half[None, :]
                took = np.flatnonzero(good.any(axis=1))
                if len(took):
                    out.append((np.full(len(took), bucket), own.field("id").to_numpy()[took], n[took], component[took]))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["bucket", "id", "n", "component"])
        trim()

    return run


def may_have_partner(sets: list[np.ndarray], parts: int, of: int) -> np.ndarray:
    """Places of the sets of which enough shingles are in another set too; found again until none falls out."""
    left = np.arange(len(sets))
    while len(left) > 1:
        n = np.array([len(sets[i]) for i in left])
        _, which, count = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True, return_counts=True)
        shared = np.add.reduceat((count[which] > 1).astype(np.int64), np.cumsum(n) - n)
        stay = of * shared >= parts * n
        if stay.all():
            return left
        left = left[stay]
    return left[:0]


def _in_blocks(parts: int, of: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = [], []
            for at, rows in _groups(batch.column("rows")):
                own = rows.slice(at.start, at.stop - at.start)
                sets = [np.frombuffer(h, dtype=U) for h in own.field("hashes").to_pylist()]
                left = may_have_partner(sets, parts, of)
                if len(left) < 2:
                    continue
                ids, half, component = (own.field(f).to_numpy()[left] for f in ("id", "half", "component"))
                side = half if (half != half[0]).any() else None
                for i, j in block_links([sets[k] for k in left], component, side, parts, of):
                    x.append(ids[i])
                    y.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])
        trim()

    return run


def _paired_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """A row of members for each pair of blocks of its bucket that its own block (half) is in: plus half, lo, hi."""
    columns = members.columns
    own = members.withColumn("blocks", blocks.cast("int")).withColumn("half", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int"))
    each = own.select(*columns, "half", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    # a pair (b, b) is only of use where b is the bucket's one block or holds two members itself
    return each.select(*columns, "half", F.least("half", "o").alias("lo"), F.greatest("half", "o").alias("hi"))


def components(links: DataFrame) -> DataFrame:
    """Smallest id reachable from each end of the links (x, y): columns id, component.

    Labels go to neighbours and jump to their label's label until none changes;
    each round is stored, so lineage stays short.
    """
    spark = links.sparkSession
    both, edges_at = stored(links.select("x", "y").union(links.select("y", "x").toDF("x", "y")).distinct(), "edges")
    now, at = stored(both.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("id"), F.least("x", "y").alias("component")), "labels")
    while True:
        near = joined(both, now.withColumnRenamed("id", "y"), "y", "x").groupBy("x").agg(F.min("component").alias("near"))
        least, least_at = stored(now.join(near, F.col("id") == F.col("x")).select("id", "component", F.least("component", "near").alias("low")), "least")
        # the label of a label: one row for each label in use
        labels = least.select("low").distinct().join(least.select(F.col("id").alias("low"), F.col("low").alias("t_low")), "low")
        labels, labels_at = stored(labels, "label-labels")
        jumped = joined(least, labels, "low", "id", "left").select("id", F.col("component").alias("was"), F.least("low", "t_low").alias("component"))
        after, new_at = stored(jumped, "labels")
        discard(spark, at, least_at, labels_at)
        now, at = after.select("id", "component"), new_at
        if after.filter("component <> was").isEmpty():
            discard(spark, edges_at)
            return now


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similar: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 5, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, only: DataFrame | None = None) -> DataFrame:
    """A row for each row of df: id_col (long), n_shingles, component_id, kept.

    Texts are linked where ``similar[1] * intersection >= similar[0] * union`` of
    their shingle sets; component_id is the smallest id reachable, and kept marks
    the document with that id.  Ids are integers or their text; other ids raise.
    With ``only`` (a stored table of ids in a column named like ``id_col``), rows of
    other ids are left out as if df did not hold them.
    """
    spark = df.sparkSession
    parts, of = similar
    base = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    few = only is not None and small(only)
    if few:
        base = base.join(F.broadcast(only.toDF("id")), "id", "left_semi")
    sketch = base.select("id", _sketch(shingle, bands, rows)(F.col("text")).alias("s")).select("id", "s.n", "s.key", "s.bands", "s.sig")
    if only is not None and not few:  # sketches are shorter than texts
        sketch = sketch.join(only.toDF("id"), "id", "left_semi")
    sketch, sketch_at = stored(sketch, "sketch")
    # equal sets have equal bands and signatures, so any row of a class has them
    same = [F.first(c).alias(c) for c in ("n", "bands", "sig")]
    classes, _ = stored(sketch.filter("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("id"), *same), "classes")
    # beyond the classes, only ids and keys are needed
    sketch, _ = stored(sketch.select("id", "n", "key"), "sketch-keys")
    discard(spark, sketch_at)
    own = classes.select("id", F.explode("bands").alias("bucket"))
    stars = own.groupBy("bucket").agg(F.min("id").alias("centre"), F.count("*").alias("size")).filter("size > 1")
    # a bucket's many members are split over tasks as its star is
    split = F.explode(F.sequence(F.lit(0), F.least(F.floor(F.col("size") / HEAVY), F.lit(SPLITS - 1)).cast("int")))
    stars, stars_at = stored(stars.withColumn("split", split), "stars")
    heavy, heavy_at = stored(stars.filter(f"size >= {HEAVY} and split = 0").select("bucket", F.least(F.floor(F.col("size") / HEAVY) + 1, F.lit(SPLITS)).alias("splits")), "heavy")
    dealt = own.join(F.broadcast(heavy) if small(heavy) else heavy, "bucket", "left").withColumn("split", F.coalesce(F.pmod(F.xxhash64("id"), F.col("splits")), F.lit(0)).cast("int")).drop("splits")
    members, members_at = stored(dealt.join(F.broadcast(stars) if small(stars, KEYS) else stars, ["bucket", "split"]).filter("id <> centre").select("bucket", "size", "centre", "id"), "members")
    discard(spark, stars_at, heavy_at)
    pairs = members.select(F.col("centre").alias("x"), F.col("id").alias("y")).distinct()
    pairs, pairs_at = stored(pairs, "pairs")
    wanted, wanted_at = stored(pairs.select("x").union(pairs.select("y")).toDF("id").distinct(), "wanted")
    hint = F.broadcast(wanted) if small(wanted) else wanted
    sets, sets_at = stored(base.join(hint, "id", "left_semi").select("id", _set_column(shingle)(F.col("text")).alias("s")).select("id", "s.hashes"), "sets")
    held = lambda name: sets.select(F.col("id").alias(name), F.col("hashes").alias(f"{name}_set"))
    links = joined(pairs.join(held("y"), "y"), held("x"), "x", "y", rows=0)
    links, links_at = stored(links.select("x", "y", "x_set", "y_set").mapInArrow(_confirm(parts, of), "x long, y long"), "links")
    found = components(links)
    # What the stars left open: buckets whose other members lie in several components.
    member, member_at = stored(members.join(found, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")), "open")
    open_buckets = member.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size")).filter("a <> b").select("bucket", "size")
    open_rows = member.join(open_buckets, "bucket").join(classes.select("id", "n", "sig"), "id")
    in_block = lambda df, *columns: df.groupBy("bucket", "lo", "hi").agg(F.collect_list(F.struct(*columns)).alias("rows")).select("bucket", "rows")
    marked = in_block(_paired_blocks(open_rows, F.ceil(F.col("size") / F.lit(block))), "id", "n", "component", "half", "sig").mapInArrow(_candidates(parts, of), "bucket long, id long, n long, component long")
    marked, marked_at = stored(marked.distinct(), "marked", GROUPS)
    weight = marked.groupBy("bucket").agg(F.ceil(F.sum("n") / F.lit(block_shingles)).alias("by_shingles"), F.ceil(F.count("*") / F.lit(block)).alias("by_rows"))
    dense = _paired_blocks(marked.join(weight, "bucket").withColumn("pieces", F.greatest("by_shingles", "by_rows")), F.col("pieces")).select("bucket", "id", "component", "half", "lo", "hi")
    more = in_block(dense.join(sets, "id"), "id", "component", "half", "hashes").mapInArrow(_in_blocks(parts, of), "x long, y long").distinct()
    more, more_at = stored(more, "more", GROUPS)
    if not more.isEmpty():
        found = components(links.union(more))
    discard(spark, members_at, pairs_at, wanted_at, sets_at, links_at, member_at, marked_at, more_at)
    lowest, _ = stored(classes.join(found, "id", "left").select("key", F.coalesce("component", "id").alias("low")), "lowest")
    out = joined(sketch.select("id", "n", "key"), lowest, "key", "id", "left", rows=KEYS)
    component = F.when(F.col("id").isNotNull(), F.coalesce("low", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df without the documents that near_duplicates does not keep; all columns stay."""
    gone, _ = stored(near_duplicates(df, id_col, text_col, **options).filter(~F.col("kept")).select(F.col(id_col).alias("webquarry_gone_id")).distinct(), "gone")
    return df.join(F.broadcast(gone) if small(gone) else gone, F.col(f"`{id_col}`").cast("long") == F.col("webquarry_gone_id"), "left_anti")
