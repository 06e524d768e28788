"""Benchmark decontamination: word windows of a benchmark in a broadcast hash set.

Words are runs of digits, ASCII letters (lower-cased) and non-ASCII characters.  A
benchmark item gives all its windows of ``size`` words, or itself as one window if
it has fewer words but some.  Windows of every text are looked up by hash, and a
hit is confirmed word by word.  The set is broadcast while the benchmark has at most
BROADCAST_CHARS characters.  Beyond, a map of 2**28 bits (32 MB whatever the
benchmark's size) is broadcast instead, and the document windows that it lets
through are joined with the benchmark's windows on their words.  Both ways give the
same rows.

Null texts have no words.  Items without words, and items with a null id, match
nothing; rows that share an item id count as one item.  Empty tables give no
hits.  All input columns stay; the result columns replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.store import discard, joined, stored
from webquarry.llm.udf import text_udf, with_struct

#: Characters of benchmark text up to which its windows are broadcast: about 200 MB with their index at most.
BROADCAST_CHARS = 5_000_000
#: Bits of the map of window hashes, and of one of its blocks.
MAP_BITS, BLOCK_BITS = 28, 19


def _words(text: str) -> list[bytes]:
    s = scan.Scan(scan.as_strings(pa.array([text])), word=scan.ALNUM_LOWER)
    data = s.text.tobytes()
    return [data[a:b] for a, b in zip(s.start, s.end, strict=True)]


class WindowIndex:
    """Windows of benchmark items by length, then by hash."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        by_length: dict[int, dict[bytes, set[str]]] = {}
        for item, words in items:
            n = min(size, len(words))
            for k in range(len(words) - n + 1):
                by_length.setdefault(n, {}).setdefault(b" ".join(words[k : k + n]), set()).add(item)
        self.tables = {}
        for n, windows in by_length.items():
            named = sorted(windows)
            s = scan.Scan(pa.array([w.decode() for w in named]), word=scan.ALNUM_LOWER)
            h, _ = scan.windows(s.words(), s.first, n)
            known: dict[int, list[tuple[bytes, tuple[str, ...]]]] = {}
            for key, w in zip(h.tolist(), named, strict=True):
                known.setdefault(key, []).append((w, tuple(sorted(windows[w]))))
            self.tables[n] = (scan.Lookup(h), known)

    def hits(self, chunk: pa.Array) -> tuple[scan.Scan, list[tuple[int, int, tuple[str, ...]]]]:
        """The chunk's words, and (first word, length, items) of each confirmed window."""
        s = scan.Scan(chunk, word=scan.ALNUM_LOWER)
        h = s.words()
        found = []
        for n, (lookup, known) in self.tables.items():
            keys, at = scan.windows(h, s.first, n)
            for i in lookup.find(keys)[0]:
                a = int(at[i])
                words = b" ".join(s.text[s.start[w] : s.end[w]].tobytes() for w in range(a, a + n))
                for text, items in known[int(keys[i])]:
                    if text == words:
                        found.append((a, n, items))
        return s, found


def _item_rows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, text of the items that can match."""
    return benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("t")).filter("item is not null and t is not null")


def _item_windows(size: int):
    """Windows of items: w (words set apart by spaces) and the low bits of its hash."""

    def start():
        def one(chunk: pa.Array) -> dict:
            out = []
            for t in chunk.to_pylist():
                words = _words(t)
                n = min(size, len(words))
                named = sorted({b" ".join(words[k : k + n]).decode() for k in range(len(words) - n + 1)}) if n else []
                s = scan.Scan(pa.array(named, type=pa.string()), word=scan.ALNUM_LOWER)
                h, _ = scan.windows(s.words(), s.first, max(n, 1))
                out.append([{"w": w, "n": n, "place": int(x) & ((1 << MAP_BITS) - 1)} for w, x in zip(named, h, strict=True)])
            return {"windows": out}

        return one

    return text_udf("windows array<struct<w: string, n: int, place: int>>", start)


def _bit_map(windows: DataFrame) -> np.ndarray:
    """The map of the windows' hashes; at most 2**MAP_BITS bits reach the driver, in packed blocks."""
    rows = windows.select(F.shiftright("place", BLOCK_BITS).alias("block"), F.col("place").bitwiseAND((1 << BLOCK_BITS) - 1).alias("bit")).distinct()

    def pack(bits: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
        flags[bits["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [int(bits["block"].iloc[0])], "bits": [np.packbits(flags).tobytes()]})

    out = np.zeros((1 << MAP_BITS - BLOCK_BITS, 1 << BLOCK_BITS - 3), dtype=np.uint8)
    for row in rows.groupBy("block").applyInPandas(pack, "block int, bits binary").toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out.ravel()


def _candidates(sent, lengths: list[int]):
    """n_words, and the windows of a text whose bit in the map is set: first word, length, words."""

    def start():
        bits = sent.value

        def one(chunk: pa.Array) -> dict:
            s = scan.Scan(chunk, word=scan.ALNUM_LOWER)
            h, data = s.words(), s.text.tobytes()
            out: list[list[dict]] = [[] for _ in range(s.n_docs)]
            for n in lengths:
                keys, at = scan.windows(h, s.first, n)
                place = (keys & np.uint64((1 << MAP_BITS) - 1)).astype(np.int64)
                for i in np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1):
                    a = int(at[i])
                    d = int(s.doc[a])
                    words = b" ".join(data[s.start[w] : s.end[w]] for w in range(a, a + n))
                    out[d].append({"first": a - int(s.first[d]), "n": n, "w": words.decode()})
            return {"n_words": np.diff(s.first), "windows": out}

        return one

    return text_udf("n_words long, windows array<struct<first: long, n: int, w: string>>", start)


def _by_join(df: DataFrame, items: DataFrame, size: int, text_col: str, names: list[str]) -> DataFrame:
    """find_contamination for a benchmark of any size; a text's hits are found once however often it occurs."""
    spark = df.sparkSession
    windows, windows_at = stored(items.select("item", F.explode(_item_windows(size)(F.col("t"))["windows"]).alias("x")).select("item", "x.*"), "windows")
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``size``
    # windows that the same items hold share one list, which hits name by its hash
    known, known_at = stored(windows.groupBy("w").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("holders", F.xxhash64("items")), "known-windows")
    lists, lists_at = stored(known.groupBy("holders").agg(F.first("items").alias("items")), "known-items")
    sent = spark.sparkContext.broadcast(_bit_map(windows))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    tag = "key_of_" + "_".join(df.columns)[:120]
    keyed = df.withColumn(tag, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text)).alias("b")))
    texts = keyed.select(F.col(tag).alias("key"), text.alias("t"), _candidates(sent, lengths)(text).alias("c"))
    texts, texts_at = stored(texts.select("key", F.col("c.n_words").alias("n_words"), F.col("c.windows").alias("windows")), "candidates")
    near = texts.filter(F.size("windows") > 0).select("key", F.explode("windows").alias("x")).select("key", "x.*").distinct()
    found, found_at = stored(joined(near, known.select("w", "holders"), "w", "key", rows=0), "hits")
    hits = found.groupBy("key").agg(F.array_sort(F.collect_set(F.struct(F.col("first"), (F.col("first") + F.col("n") - 1).alias("last")))).alias("raw"))
    named = joined(found.select("key", "holders").distinct(), lists, "holders", "key", rows=0).groupBy("key")
    named = named.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    hits = hits.join(named, "key")
    counted = texts.groupBy("key").agg(F.first("n_words").alias("n_words"))
    each, each_at = stored(counted.join(hits, "key", "left"), "hits-of-texts")
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def merge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([merge_spans([row or []]) for row in batch.to_pylist()], type=spans_type)

    merge.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    spans = F.arrow_udf(merge, returnType="array<struct<first: long, last: long>>")(F.col("raw"))
    ready, _ = stored(each.select(F.col("key").alias(tag), F.struct("n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).alias("hits_of_key")), "contamination")
    discard(spark, windows_at, known_at, lists_at, texts_at, found_at, each_at)
    # many rows may share a text, so a row's number spreads them
    numbered = keyed.withColumn(f"row_{tag}", F.monotonically_increasing_id())
    return with_struct(joined(numbered, ready, tag, f"row_{tag}", "left", rows=0), F.col("hits_of_key"), names).drop(tag, f"row_{tag}", "hits_of_key")


def _scan_udf(sent):
    def start():
        index = sent.value

        def one(chunk: pa.Array) -> dict:
            s, found = index.hits(chunk)
            items: list[set[str]] = [set() for _ in range(s.n_docs)]
            hit = np.zeros(len(s.start), dtype=bool)
            for a, n, names in found:
                hit[a : a + n] = True
                items[s.doc[a]].update(names)
            spans: list[list[dict]] = [[] for _ in range(s.n_docs)]
            step = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True):
                for d in range(s.doc[a], s.doc[b - 1] + 1):  # a run may go on into the next text
                    lo, hi = max(a, s.first[d]), min(b, s.first[d + 1])
                    if lo < hi:
                        spans[d].append({"first": int(lo - s.first[d]), "last": int(hi - 1 - s.first[d])})
            return {"n_words": np.diff(s.first), "spans": spans, "items": [sorted(x) for x in items]}

        return one

    return text_udf("n_words long, spans array<struct<first: long, last: long>>, items array<string>", start)


def merge_spans(many: list[list[dict]]) -> list[dict]:
    """Union of inclusive word ranges."""
    out: list[dict] = []
    for s in sorted((x for spans in many for x in spans), key=lambda x: x["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append({"first": s["first"], "last": s["last"]})
    return out


def find_contamination(df: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """df plus n_words, spans (word ranges inside benchmark windows) and items (ids as sorted strings)."""
    names = ["n_words", "spans", "items"]
    items = _item_rows(benchmark, item_id, item_text)
    if (items.agg(F.sum(F.length("t"))).first()[0] or 0) > BROADCAST_CHARS:
        return _by_join(df, items, size, text_col, names)
    held = [(r["item"], _words(r["t"])) for r in items.filter(F.length("t") > 0).collect()]
    sent = df.sparkSession.sparkContext.broadcast(WindowIndex([(i, w) for i, w in held if w], size))
    return with_struct(df, _scan_udf(sent)(F.col(f"`{text_col}`").cast("string")), names)


def contamination_report(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """id_col, n_words, n_hit, n_items, items_sha256 and contaminated for every row of df."""
    found = find_contamination(df.select(F.col(f"`{id_col}`"), F.col(f"`{options.pop('text_col', 'text')}`").alias("text")), benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_contaminated(df: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", spans_only: bool = False) -> DataFrame:
    """df without contaminated texts, or, with ``spans_only``, with their hit words cut out."""
    tag = "hits_of_" + "_".join(df.columns)[:120]
    found = find_contamination(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(tag), F.col(f"`{text_col}`").alias("text")), benchmark, size)
    if not spans_only:
        return found.filter(F.size("spans") == 0).select(f"`{tag}`.*")

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if text and ranges:
                    s = scan.Scan(pa.array([text]), word=scan.ALNUM_LOWER)
                    data, kept, at = s.buf.tobytes(), [], 0
                    for r in ranges:
                        kept.append(data[at : s.start[r["first"]]])
                        at = s.end[r["last"]]
                    text = b"".join([*kept, data[at:]]).decode()
                out.append(text)
            yield pa.array(out, type=pa.string())

    cut.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    clean = F.arrow_udf(cut, returnType="string")(F.col("text").cast("string"), F.col("spans"))
    return found.withColumn("clean", clean).select(*[F.col("clean").alias(c) if c == text_col else F.col(f"`{tag}`")[c].alias(c) for c in df.columns])
