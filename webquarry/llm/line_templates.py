"""Recurring lines across documents, found by a fixed-depth template tree.

Lines are cut at sentence ends, as a passage may be appended to a line; the pieces
are called messages.  A message's tokens are its runs of non-space characters;
tokens with a digit count as one variable field, but in messages of nothing else.  The tree has two levels: the
number of tokens, then the first DEPTH tokens.  Inside a leaf, the most common
token of every position (weighted by documents) makes the leaf's template where
it has half of the documents; other positions are variable fields.  Messages that
agree with the leaf's template in SIMILAR of their positions belong to it; any
other message is a template of its own.  The result does not depend on the order
of documents.

A template recurs if at least ``min_docs`` documents have it that are not copies
of one another, however many copies there are besides: a message that recurs only
because whole documents do is left to document-level deduplication.  Documents of one
component of ``near_dup.near_duplicates`` (whole texts, digits kept) may be copies, or
separate pages that are alike through the shared messages themselves.  What tells them
apart is the rest of a text, without messages whose leaf is in many documents: in a
copy, at least half of the rest's word pairs are in the component's first document
too; in a page of its own they are not, and it counts for itself.

Messages of fewer than ``min_tokens`` tokens say little by themselves ("Yes.").
They count only where they are a whole line and hold a letter, and such a template
recurs if ``short_docs`` documents have it, copies again counted once.  All occurrences of recurring templates are dropped, and with
them short messages that lie between two of them, or between one and the line's
edge; other short messages stay.

Every step is a join or an aggregate over all messages, the same at every size.
Null texts stay null; empty texts stay empty; rows equal in id and text count as
one document, null ids included; texts are read whole.  Ties between tokens of a
position go to the larger hash.  An empty table gives an empty table.  Other
columns stay; with ``counts``, n_dropped replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm import near_dup, scan
from webquarry.llm.store import discard, joined, small, stored
from webquarry.llm.udf import text_udf, tidy, trim

U = np.uint64
DEPTH = 4
SIMILAR = 0.7
MIN_DOCS = 3
MIN_TOKENS = 5
#: Documents that a short line has to be in.
SHORT_DOCS = 10
#: Rows of two or three numbers up to which they are broadcast: at most about 64 MB.
BROADCAST_ROWS = 500_000
#: Documents up to which lists of their messages' places are broadcast.
WANTED_DOCS = 50_000

_DIGIT = scan.byte_class((0x30, 0x39))
_LETTER = scan.byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_FIELD = U(0x5EED5EED5EED5EED)

_STOP = scan.byte_class((0x2E, 0x2E), (0x21, 0x21), (0x3F, 0x3F))


class Messages:
    """Messages of a chunk: document, place in it, token range and hashes."""

    def __init__(self, chunk: pa.Array):
        s = scan.Scan(chunk, fold=None)
        self.scan, self.n_docs = s, s.n_docs
        edges = np.unique(np.concatenate([s.off[:-1], np.flatnonzero(s.buf == 10) + 1]))
        line = np.searchsorted(edges, s.start, side="right") - 1
        digits = np.concatenate([[0], np.cumsum(_DIGIT[s.buf], dtype=np.int32)])
        token = s.words()
        field = digits[s.end] > digits[s.start]
        n = len(token)
        stop = _STOP[s.buf[s.end - 1]] if n else np.zeros(0, bool)
        self.first = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | stop[:-1]]) if n else np.zeros(0, np.int64)
        first = self.first
        self.count = np.diff(np.r_[first, n])
        if n:  # a message of fields only has no template: its tokens stay as they are
            token[field & np.repeat(np.add.reduceat((~field).astype(np.int64), first) > 0, self.count)] = _FIELD
        self.token = token
        self.doc, self.line_number = (s.doc[first], line[first]) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.position = np.arange(len(first)) - np.searchsorted(self.doc, self.doc)
        place = np.arange(n) - np.repeat(first, self.count)
        power, _ = scan._powers(int(self.count.max()) + 1 if n else 1)
        if n:
            self.line = scan.mix(np.add.reduceat(token * power[place], first) + self.count.astype(U))
            head = np.where(place < DEPTH, token * power[place], U(0))
            self.leaf = scan.mix(np.add.reduceat(head, first) ^ scan.mix(self.count.astype(U)))
        else:
            self.line = self.leaf = np.zeros(0, U)

    def whole_line(self) -> np.ndarray:
        """Whether a message is all that its line holds."""
        line = self.line_number
        other = np.r_[True, line[1:] != line[:-1], True] if len(line) else np.zeros(1, bool)
        return other[:-1] & other[1:]

    def may_recur(self, min_tokens: int) -> np.ndarray:
        """Whether a message is long, or a whole line with a letter."""
        out = self.count >= min_tokens
        last = np.r_[self.first[1:], len(self.token)] - 1
        at = np.flatnonzero(~out & self.whole_line())
        letters = np.concatenate([[0], np.cumsum(_LETTER[self.scan.buf], dtype=np.int64)])
        out[at] = letters[self.scan.end[last[at]]] > letters[self.scan.start[self.first[at]]]
        return out

    def at_places(self, places: list[list[int]]) -> np.ndarray:
        """The messages at the given places of each text."""
        begin = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        out = np.zeros(len(self.first), dtype=bool)
        for d, own in enumerate(places):
            out[begin[d] + np.array(own, dtype=np.int64)] = True
        return out


def _parse(min_tokens: int):
    """Messages of a text that may recur: place, leaf, line, whether long, and whether the text's first of its leaf."""

    def start():
        def one(chunk: pa.Array) -> dict:
            x = Messages(chunk)
            long = x.count >= min_tokens
            at = np.flatnonzero(x.may_recur(min_tokens))
            doc, leaf = x.doc[at], x.leaf[at]
            both = scan.mix(leaf + doc.astype(U))  # of a text and a leaf
            order = np.argsort(both, kind="stable")
            first = np.ones(len(at), dtype=bool)
            first[order[1:][both[order][1:] == both[order][:-1]]] = False
            arrays = [pa.array(x.position[at].astype(np.int32)), *(pa.array(c.view(np.int64)) for c in (leaf, x.line[at])), pa.array(long[at]), pa.array(first)]
            offsets = pa.array(np.searchsorted(doc, np.arange(x.n_docs + 1)), pa.int32())
            return {"lines": pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, names=["position", "leaf", "line", "long", "first"]))}

        return one

    return text_udf("lines array<struct<position: int, leaf: long, line: long, long: boolean, first: boolean>>", start)


@tidy
def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of chosen messages: leaf, line, docs, place, token."""
    for batch in batches:
        base = 0
        for chunk in scan.chunks(batch.column("text")):
            x = Messages(chunk)
            wanted = batch.column("wanted").slice(base, len(chunk)).to_pylist()
            base += len(chunk)
            begin = np.searchsorted(x.doc, np.arange(x.n_docs + 1))
            rows = [(w, int(begin[d]) + w["position"]) for d, ws in enumerate(wanted) for w in ws]
            if not rows:
                continue
            picked = np.array([i for _, i in rows])
            n = x.count[picked]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            token = x.token[np.repeat(x.first[picked], n) + place]
            column = lambda name: pa.array(np.repeat(np.array([w[name] for w, _ in rows], dtype=np.int64), n))
            yield pa.RecordBatch.from_arrays([column("leaf"), column("line"), column("docs"), pa.array(place.astype(np.int32)), pa.array(token.view(np.int64))], names=["leaf", "line", "docs", "place", "token"])


@tidy
def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct word pairs of each text's messages, but those at the places listed: component, key, pairs (hashes in order)."""
    for batch in batches:
        base = 0
        for chunk in scan.chunks(batch.column("text")):
            x = Messages(chunk)
            rest = ~x.at_places([p or [] for p in batch.column("places").slice(base, len(chunk)).to_pylist()])
            inside = np.repeat(rest, x.count)[:-1] & (np.diff(np.repeat(np.arange(len(x.first)), x.count)) == 0)
            at = np.flatnonzero(inside)
            pair = scan.mix(x.token[at] * U(0x9E3779B97F4A7C15) + x.token[at + 1])
            begin = np.searchsorted(np.repeat(x.doc, x.count)[at], np.arange(x.n_docs + 1))
            pairs = [np.unique(pair[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
            names = [batch.column(c).slice(base, len(chunk)) for c in ("component", "key")]
            yield pa.RecordBatch.from_arrays([*names, pa.array(pairs, pa.binary())], names=["component", "key", "pairs"])
            base += len(chunk)


def _apart(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether less than half of the first column's pairs are among the second's."""
    for rest, first in batches:
        out = []
        for own, whole in zip(rest.to_pylist(), first.to_pylist(), strict=True):
            mine, known = np.frombuffer(own, dtype=U), np.frombuffer(whole or b"", dtype=U)
            out.append(2 * len(np.intersect1d(mine, known, assume_unique=True)) < len(mine))
        yield pa.array(out, pa.bool_())


_apart = tidy(_apart)
_apart.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def hosts(keyed: DataFrame, lines: DataFrame, copies: DataFrame) -> DataFrame:
    """key and host of all documents in ``copies`` (key, component_id): a copy's host is its component.

    lines: the messages (key, position) that may recur; the rest of a text decides.
    """
    spark = keyed.sparkSession
    alike, alike_at = stored(copies.groupBy("component_id").count().filter("count > 1").select("component_id"), "alike")
    members, members_at = stored(joined(copies, alike, "component_id", "key").select("key", F.col("component_id").alias("component")), "members")
    places = lines.join(members.filter("key <> component").select("key"), "key", "left_semi").groupBy("key").agg(F.collect_set("position").alias("places"))
    texts = keyed.join(F.broadcast(members) if small(members, BROADCAST_ROWS) else members, "key").join(places, "key", "left")
    pairs = texts.select("component", "key", "places", "text").mapInArrow(_pairs_of, "component long, key long, pairs binary")
    pairs, pairs_at = stored(pairs.dropDuplicates(["key"]), "pairs")
    first, first_at = stored(pairs.filter("key = component").select("component", F.col("pairs").alias("first")), "first-pairs")
    rest = joined(pairs.filter("key <> component"), first, "component", "key", "inner", rows=0)
    apart = rest.select("key", F.arrow_udf(_apart, "boolean")("pairs", "first").alias("apart")).filter("apart")
    apart, apart_at = stored(apart, "apart")
    found = joined(copies, apart, "key", "component_id", "left", BROADCAST_ROWS)
    found, _ = stored(found.select("key", F.when(F.col("apart"), F.col("key")).otherwise(F.col("component_id")).alias("host")), "hosts")
    discard(spark, alike_at, members_at, pairs_at, first_at, apart_at)
    return found


def _cut(min_tokens: int, lines):
    """Text and number of dropped messages, for texts that the second column marks; the others stay in Arrow.

    ``lines`` is a broadcast of the line hashes of recurring messages, or None where
    the second column lists the places of each text's messages to drop.
    """

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = scan.Lookup(lines.value.view(U)) if lines is not None else None
        for texts, marks in batches:
            base = 0
            # chunk by chunk: the results of a whole Arrow batch (10,000 texts) are never held at once
            for chunk in scan.chunks(texts):
                own, mark = texts.slice(base, len(chunk)), marks.slice(base, len(chunk))
                base += len(chunk)
                mask = pc.and_(mark.is_valid(), own.is_valid())  # null texts stay null
                at = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
                dropped = np.zeros(len(own), dtype=np.int64)
                if len(at):
                    x = Messages(chunk.take(pa.array(at)))
                    if known is not None:
                        gone = np.zeros(len(x.first), dtype=bool)
                        gone[known.find(x.line)[0]] = True
                        gone &= x.may_recur(min_tokens)
                    else:
                        gone = x.at_places(mark.take(pa.array(at)).to_pylist())
                    dropped[at] = np.bincount(x.doc[gone], minlength=len(at))
                    own = pc.replace_with_mask(own, mask, pa.array(without(x, gone, min_tokens), type=pa.string()))
                    del x
                yield pa.StructArray.from_arrays([own, pa.array(dropped)], names=["text", "n"])
            if not len(texts):
                yield pa.StructArray.from_arrays([texts, pa.array([], pa.int64())], names=["text", "n"])
            trim()

    run = tidy(run)
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType="text string, n long").asNondeterministic()


def without(x: Messages, gone: np.ndarray, min_tokens: int) -> list[str]:
    """Texts of a chunk without the messages that are marked; emptied lines go whole."""
    s = x.scan
    gone = gone.copy()
    begin = np.searchsorted(x.doc, np.arange(x.n_docs + 1))
    # short messages between dropped ones, or between a dropped one and the line's edge
    n = len(gone)
    same_line = np.r_[x.line_number[1:] == x.line_number[:-1], False] if n else np.zeros(0, bool)
    short = (x.count < min_tokens) & ~gone
    run_begins = np.flatnonzero(short & ~np.r_[False, short[:-1] & same_line[:-1]])
    run_ends = np.flatnonzero(short & ~(np.r_[short[1:], False] & same_line))
    for a, b in zip(run_begins, run_ends, strict=True):
        before = gone[a - 1] if a and same_line[a - 1] else None  # None: the line's edge
        after = gone[b + 1] if same_line[b] else None
        if (before or after) and before in (None, True) and after in (None, True):
            gone[a : b + 1] = True
    last_word = np.r_[x.first[1:], len(s.start)] - 1
    data = s.buf.tobytes()
    goes_on = gone[:-1] & gone[1:] & same_line[:-1]
    opens, closes = np.flatnonzero(gone & ~np.r_[False, goes_on][:n]), np.flatnonzero(gone & ~np.r_[goes_on, False][:n])
    parts: list[list[bytes]] = [[] for _ in range(x.n_docs)]
    at = s.off[:-1].tolist()
    for i, j in zip(opens.tolist(), closes.tolist(), strict=True):  # runs of dropped messages within a line
        d = int(x.doc[i])
        low, high = int(s.off[d]), int(s.off[d + 1])
        a, b = int(s.start[x.first[i]]), int(s.end[last_word[j]])
        leads = i == begin[d] or not same_line[i - 1]
        if leads and not same_line[j]:  # the whole line: with its break
            a = data.rfind(b"\n", low, a) + 1 or low
            line_ends = data.find(b"\n", b, high)
            b = line_ends + 1 if line_ends >= 0 else high
            if line_ends < 0 and a > low:
                a -= 1
        elif leads:
            b = int(s.start[x.first[j + 1]])
        else:
            a = int(s.end[x.first[i] - 1])
        parts[d].append(data[at[d] : max(a, at[d])])
        at[d] = max(b, at[d])
    return [b"".join([*own, data[at[d] : s.off[d + 1]]]).decode() for d, own in enumerate(parts)]


def generalised(each: DataFrame, keyed: DataFrame, min_docs: int) -> DataFrame:
    """Messages that belong to their leaf's template: columns leaf, line.

    each: a row for each distinct message: leaf, line, docs and the least (key,
    position) that has it, ``at``; keyed: key, text.
    """
    shared = each.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("leaf_docs")).filter(f"kinds > 1 and leaf_docs >= {min_docs}")
    shared, shared_at = stored(shared.select("leaf"), "shared-leaves")
    chosen = joined(each, shared, "leaf", "line").select(F.col("at.key").alias("key"), F.struct("leaf", "line", "docs", F.col("at.position").alias("position")).alias("w"))
    wanted, wanted_at = stored(chosen.groupBy("key").agg(F.collect_list("w").alias("wanted")), "wanted-lines")
    found = keyed.join(F.broadcast(wanted) if small(wanted, WANTED_DOCS) else wanted, "key").select("text", "wanted").mapInArrow(_tokens_of, "leaf long, line long, docs long, place int, token long")
    tokens, tokens_at = stored(found.distinct(), "line-tokens")
    votes = tokens.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("docs"))
    top = votes.groupBy("leaf", "place").agg(F.max(F.struct("docs", "token")).alias("m"), F.sum("docs").alias("all"))
    literal = top.filter(2 * F.col("m.docs") >= F.col("all")).select(F.struct("leaf", "place", F.col("m.token").alias("token")).alias("slot"))
    literal, literal_at = stored(literal, "literals")
    slotted = tokens.select("line", "leaf", F.struct("leaf", "place", "token").alias("slot"))
    agree = joined(slotted, literal.withColumn("same", F.lit(1)), "slot", "line", "left", BROADCAST_ROWS).groupBy("leaf", "line").agg(F.count("same").alias("same"), F.count("*").alias("tokens"))
    general, _ = stored(agree.filter(F.col("same") >= SIMILAR * F.col("tokens")).select("leaf", "line"), "general")
    discard(keyed.sparkSession, shared_at, wanted_at, tokens_at, literal_at)
    return general


def recurring_lines(keyed: DataFrame, min_docs: int, min_tokens: int, short_docs: int) -> tuple[DataFrame, DataFrame]:
    """(messages, drops) of a table of key, text: recurring messages (message: its leaf and line),
    and their occurrences (key, position, message), both stored."""
    spark = keyed.sparkSession
    messages, messages_at = stored(keyed.select("key", F.explode(_parse(min_tokens)(F.col("text"))["lines"]).alias("x")).select("key", "x.*"), "messages")
    enough = lambda name: F.col(name) >= F.when(F.col("long"), min_docs).otherwise(short_docs)
    # leaves that enough documents have, copies counted one by one: only these are looked at further
    hot, hot_at = stored(messages.filter("first").groupBy("leaf", "long").count().filter(enough("count")).select("leaf"), "leaves")
    lines, lines_at = stored(joined(messages, hot, "leaf", "key", "left_semi"), "lines")
    discard(spark, messages_at, hot_at)
    # documents by component of near copies
    holders, holders_at = stored(lines.select("key").distinct(), "holders")
    copies = near_dup.near_duplicates(keyed, "key", only=holders).select("key", "component_id").distinct()
    copies, copies_at = stored(copies, "copies")
    host = hosts(keyed, lines, copies)
    groups = lines.filter("first").select("key", "leaf", "long").join(host, "key").select("leaf", "long", "host").distinct()
    live, live_at = stored(groups.groupBy("leaf", "long").count().filter(enough("count")).select("leaf"), "live-leaves")
    lines, live_lines_at = stored(joined(lines, live, "leaf", "key", "left_semi").select("key", "position", F.struct("leaf", "line").alias("message"), "long"), "live-lines")
    # a row for each distinct message; docs counts rows equal in id and text once
    once = lines.groupBy("message", "key").agg(F.min("position").alias("position"), F.first("long").alias("long"))
    each = once.groupBy("message").agg(F.count("*").alias("docs"), F.min(F.struct("key", "position")).alias("at"), F.first("long").alias("long"))
    each, each_at = stored(each.select("message", "message.*", "docs", "at", "long"), "each-message")
    general = generalised(each.filter("long"), keyed, min_docs)
    template = F.when(F.col("general"), F.xxhash64(F.col("leaf"), F.lit("leaf"))).otherwise(F.col("line"))
    named, named_at = stored(each.join(general.withColumn("general", F.lit(True)), ["leaf", "line"], "left").select("message", template.alias("template")), "named-messages")
    found, found_at = stored(joined(lines, named, "message", "key", "inner", BROADCAST_ROWS).select("key", "position", "message", "template", "long"), "found")
    groups = found.select("key", "template", "long").distinct().join(host, "key").select("template", "long", "host").distinct()
    recur, recur_at = stored(groups.groupBy("template", "long").count().filter(enough("count")).select("template"), "recurring")
    drops, _ = stored(joined(found, recur, "template", "key", "left_semi").select("key", "position", "message"), "drops")
    dropped, _ = stored(joined(named, recur, "template", "message", "left_semi").select("message"), "dropped-messages")
    discard(spark, lines_at, holders_at, copies_at, live_at, live_lines_at, each_at, named_at, found_at, recur_at)
    return dropped, drops


def drop_recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, short_docs: int = SHORT_DOCS, counts: bool = False) -> DataFrame:
    """df with recurring messages cut from its text; with ``counts``, plus n_dropped (long).

    The last pass over the texts finds the messages again by their hashes where these
    may be broadcast, and takes their places from a join otherwise.  The list of texts
    that need it is broadcast under the same condition; without it all are looked at.
    """
    spark = df.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    key = F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\0")), F.coalesce(text, F.lit("\0")))
    keyed = df.withColumn("webquarry_key", key)
    dropped, drops = recurring_lines(keyed.select(F.col("webquarry_key").alias("key"), text.alias("text")), min_docs, min_tokens, short_docs)
    lines = None
    if small(dropped):
        lines = spark.sparkContext.broadcast(np.sort(dropped.select("message.line").toArrow()["line"].to_numpy()))
        keys, _ = stored(drops.select(F.col("key").alias("webquarry_key")).distinct(), "keys")
        marked = keyed.join(F.broadcast(keys.withColumn("webquarry_drop", F.lit(True))), "webquarry_key", "left") if small(keys) else keyed.withColumn("webquarry_drop", F.lit(True))
    else:
        places = drops.groupBy(F.col("key").alias("webquarry_key")).agg(F.collect_set("position").alias("webquarry_drop"))
        marked = keyed.join(places, "webquarry_key", "left")
    names = [c for c in df.columns if not (counts and c.lower() == "n_dropped")]
    # the text goes through the function alone, not beside it once more
    kept = F.struct(F.lit(True).alias("webquarry_row"), *[F.col(f"`{c}`") for c in names if c != text_col]).alias("kept")
    cut = marked.select(kept, _cut(min_tokens, lines)(text, F.col("webquarry_drop")).alias("cut"))
    columns = [F.col("cut.text").alias(c) if c == text_col else F.col("kept")[c].alias(c) for c in names]
    return cut.select(*columns, *([F.col("cut.n").alias("n_dropped")] if counts else []))
