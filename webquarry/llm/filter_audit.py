"""How filters interact: what each removes alone, after others, and in every order.

Five filters judge whole texts: A under 200 words, B fewer than half of the words
distinct, C more than 2 % capitals, D one of ``#$%&*|``, E a copy of a text with a
smaller id.  Failures are bits of a mask, so a table becomes counters by part and
mask, which add up over any split of the rows; all 120 orders are then read off at
most 32 counters a part.

Copies are found by sorting: rows are ranged by (fingerprint, id), so a text with
any number of copies spreads over many tasks, and sorted inside a task by
(fingerprint, full text, id).  A row is compared with its predecessor.  A run that a
task boundary cuts is mended by one summary row for each task: the digest of its last
text and the smallest id seen there.

Nulls: a null text is the empty text, a null part the empty string, a null id is
smaller than every other id and has no label.  Rows that share text and id are no
copies of each other.  Ids must be whole numbers.  An empty table gives no rows.
Words are counted distinct by 64-bit hashes within one text (for 20,000 words, one
text in 10^11 would be off by one).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import scan
from webquarry.llm.store import joined, small, stored
from webquarry.llm.udf import release

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
#: A null id; it sorts before all others.
NO_ID = -(1 << 63)

_CAPITAL = scan.byte_class((0x41, 0x5A))
_SYMBOL = scan.byte_class(*[(b, b) for b in b"#$%&*|"])
_CHARACTER = ~scan.byte_class((0x80, 0xBF))
_ROW = "row long, id long, part string, mask int, edge binary"


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits 0 to 3 (A to D) of each text of a chunk."""
    s = scan.Scan(texts, fold=None)
    words = np.diff(s.first)
    order = np.lexsort((hashes := s.words(), s.doc))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (s.doc[1:] != s.doc[:-1])
    distinct = s.word_sums(new.astype(np.int64))
    mask = (words < MIN_WORDS).astype(np.int32)
    mask |= (100 * distinct < DISTINCT_PERCENT * words).astype(np.int32) << 1
    mask |= (100 * s.count(_CAPITAL) > CAPITAL_PERCENT * s.count(_CHARACTER)).astype(np.int32) << 2
    return mask | (s.count(_SYMBOL) > 0).astype(np.int32) << 3


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Masks of sorted rows with bit 4 (E) as far as this task can tell.

    ``edge`` is the text's digest where an earlier task may hold the same text, and in
    the summary rows (mask -1, id the smallest of this task) that later tasks need.
    """
    release()
    task, n = TaskContext.get().partitionId(), 0
    first_print = last_print = None
    last_text, lowest, digest = None, 0, b""
    seen: dict[bytes, int] = {}  # smallest id by digest, of the texts with the current fingerprint
    for batch in batches:
        if not batch.num_rows:
            continue
        text, ids, prints = batch.column("text"), batch.column("id").to_numpy(), batch.column("print").to_numpy()
        same = np.zeros(len(ids), dtype=bool)
        same[0] = text[0].as_py() == last_text
        same[1:] = pc.equal(text.slice(1), text.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(~same)
        low = np.full(len(ids), lowest, dtype=np.int64)
        if len(starts):
            low[starts[0] :] = np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
        first_print = prints[0] if first_print is None else first_print
        edge: list[bytes | None] = [None] * len(ids)
        # digests are needed at both ends of a task only: for its first and for its last fingerprint
        ends = np.flatnonzero((prints == first_print) | (prints == prints[-1]))
        if prints[-1] != last_print:
            seen = {}
        last_print = prints[-1]
        for i in ends:
            if not same[i]:
                digest = hashlib.sha256(text[int(i)].as_py().encode()).digest()
            if prints[i] == first_print:
                edge[i] = digest
            if prints[i] == last_print:
                seen.setdefault(digest, int(low[i]))
        last_text, lowest = text[len(ids) - 1].as_py(), int(low[-1])
        mask = np.concatenate([text_masks(c) for c in scan.chunks(text)]) | (ids > low).astype(np.int32) << 4
        rows = pa.array(np.arange(n, n + len(ids)) + (task << 33), pa.int64())
        n += len(ids)
        columns = [rows, batch.column("id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(edge, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "part", "mask", "edge"])
    if seen:
        k = len(seen)
        columns = [pa.nulls(k, pa.int64()), pa.array(seen.values(), pa.int64()), pa.nulls(k, pa.string())]
        columns += [pa.array([-1] * k, pa.int32()), pa.array(seen.keys(), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "part", "mask", "edge"])


def failure_masks(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """row, id, part and mask of every document; bit k of mask is set if filter k of ABCDE fails."""
    spark = documents.sparkSession
    base = documents.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    ).withColumn("print", F.xxhash64("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = base.repartitionByRange(tasks, "print", "id").sortWithinPartitions("print", "text", "id")
    rows, _ = stored(ordered.mapInArrow(_compared, _ROW), "audit")
    # at most a few rows for each task: a text at a boundary, and others only if 64-bit fingerprints collide
    edges = rows.filter("mask < 0").groupBy("edge").agg(F.min("id").alias("lowest"))
    earlier = (F.col("lowest") < F.col("id")) & (F.col("mask").bitwiseAND(16) == 0)
    return (
        rows.filter("mask >= 0")
        .join(F.broadcast(edges), "edge", "left")
        .select("row", "id", "part", (F.col("mask") + F.when(earlier, 16).otherwise(0)).alias("mask"))
    )


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of the step's filter, bits of the filters before it) for all orders."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[i] for i in order)
        for k, i in enumerate(order):
            out.append((name, k + 1, 1 << i, sum(1 << j for j in order[:k])))
    return out


def part_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counters by part and mask: n, good (quality 1) and toxic (toxic 1); they add up over any split of the rows."""
    flags = labels.select(F.col(f"`{id_col}`").cast("long").alias("id"), "quality", "toxic").filter("id IS NOT NULL")
    flags = flags.groupBy("id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    flags, _ = stored(flags, "audit-labels")
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return (
        joined(masks, flags, "id", "row", "left")
        .groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), one("good"), one("toxic"))
    )


def interactions(counters: DataFrame) -> DataFrame:
    """Every order and step of every part, from its counters."""
    steps = _steps()
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in steps]), F.col("k") + 1)
    each = counters.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))))
    each = each.withColumn("bit", pick(2)).withColumn("before", pick(3))
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    passed = F.col("mask").bitwiseAND(F.col("before")) == 0
    count = lambda on, c, name: F.sum(F.when(on, F.col(c)).otherwise(0)).cast("long").alias(name)
    counted = each.groupBy("part", "k", "bit").agg(
        count(passed & ~fails, "n", "kept"),
        count(passed & fails, "n", "removed"),
        count(~passed & fails, "n", "redundant"),
        count(F.col("mask") == F.col("bit"), "n", "unique_fails"),
        count(passed & fails, "good", "good_lost"),
        count(passed & fails, "toxic", "toxic_lost"),
    )
    total = counted.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return counted.join(total, ["part", "bit"]).select(
        "part", pick(0).alias("filter_order"), pick(1).cast("int").alias("step"), "kept", "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def audit(documents: DataFrame, labels: DataFrame, part_col: str = "source") -> DataFrame:
    """One row for each part, order of the five filters and step.

    kept, removed, redundant (fails, but was removed before), unique_fails (fails this
    filter only), good_lost and toxic_lost (removed rows so labelled), and shapley: what
    the filter removes, summed over all orders.
    """
    counters, _ = stored(part_counters(failure_masks(documents, part_col=part_col), labels), "audit-counters")
    return interactions(counters)


SQL = """
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), marks AS (
  SELECT doc_id, part,
         CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 'E' ELSE '' END AS fails
  FROM texts
), flags AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marks LEFT JOIN flags USING (doc_id) GROUP BY part, fails
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT f AS o FROM letters
  UNION ALL SELECT o || f FROM orders, letters WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, s AS step, o[s:s] AS f, o[1:s - 1] AS prior
  FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5
), judged AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS only_f,
         length(translate(fails, prior, '')) = length(fails) AS present
  FROM counted, steps
), summed AS (
  SELECT part, filter_order, step::INT AS step, f,
         coalesce(sum(n) FILTER (present AND NOT failed), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (present AND failed), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (NOT present AND failed), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (only_f), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (present AND failed), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (present AND failed), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM summed
"""
