"""What clicks reveal: exploration of a page's states along paths of actions.

Input rows say what a page shows in each state (``views``) and what each click does in
it (``clicks``).  An action is a candidate in a state; it is taken once, on the first
path that comes to it, depth first from the page's initial candidates in their order.
After a click that opens no dialog and leads to no URL, the candidates go on that the
state before did not show, or all of them if the click was no disclosure (a menu, say)
and the state has changed.

Pages are independent: views, clicks and starts are each gathered by page in one shuffle,
a page is walked depth first in its row (memory: that of one page, and 64 in a worker),
and its results stay beside what they came from, so nothing is joined or shuffled after.
Nulls in keys, labels and states are values like any other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a page shows: candidates of a state in their order; links are not offered at first (is_link).
VIEWS = "norm_url string, state string, pos int, key string, label string, is_link boolean"
#: What a click does: it leads to a URL, opens a dialog (modal_title not null), or ends in a state.
CLICKS = "norm_url string, state string, key string, label string, disclosure boolean, to_url string, modal_title string, to_state string"
_TAKEN = "array<struct<click:int,path:array<int>>>"
#: Pages of which a worker holds Python objects at a time.
SLICE = 64


def _walk(views: list[tuple], clicks: list[tuple], starts: set, max_nested: int) -> Iterator[tuple[int, list[int]]]:
    """A page's clicks as they are taken: place in ``clicks``, and the path as places in ``views``, itself last.

    views: (state, key, label, is_link) in order; clicks: (state, key, label, disclosure, to_state if it opens one).
    """
    shown, done, seen = defaultdict(list), defaultdict(list), set()
    for i, (state, *_) in enumerate(views):
        shown[state].append(i)
    for c, click in enumerate(clicks):
        done[click[:3]].append(c)
    names = {state: {views[i][1:3] for i in own} for state, own in shown.items()}
    stack = [[i] for i, v in reversed(list(enumerate(views))) if v[0] in starts and not v[3]]
    while stack:
        path = stack.pop()
        node = views[path[-1]][:3]
        if node in seen:
            continue
        seen.add(node)
        after = []
        for c in done.get(node, ()):
            yield c, path
            disclosure, to = clicks[c][3:]
            if to is None or len(path) > max_nested:
                continue
            every, known = not disclosure and to != node[0], names.get(node[0], ())
            after += [i for i in shown.get(to, ()) if every or views[i][1:3] not in known]
        stack += [[*path, i] for i in sorted(after, reverse=True)]


def _taken(max_nested: int):
    """A column of views, clicks and starts (arrays of a page) to the clicks taken."""

    def rows(column: pa.Array, *names: str) -> list[list[tuple]]:
        """The structs of each page as tuples of the named fields."""
        flat, sizes = column.flatten(), column.value_lengths().fill_null(0).to_pylist()
        each = zip(*(flat.field(n).to_pylist() for n in names))
        return [[next(each) for _ in range(n)] for n in sizes]

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("click", pa.int32()), ("path", pa.list_(pa.int32()))]))
        for batch in batches:
            for at in range(0, max(len(batch[0]), 1), SLICE):
                views, clicks, starts = (x.slice(at, SLICE) for x in batch)
                pages = zip(rows(views, "state", "key", "label", "is_link"), rows(clicks, "state", "key", "label", "disclosure", "opens"), starts.to_pylist(), strict=True)
                yield pa.array([[{"click": c, "path": path} for c, path in _walk(v, k, set(s or ()), max_nested)] for v, k, s in pages], type=kind)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returnType=_TAKEN).asNondeterministic()


def taken_clicks(views: DataFrame, clicks: DataFrame, starts: DataFrame, max_nested: int) -> DataFrame:
    """Pages with the clicks taken, in order: norm_url, views, clicks, taken (click and path, places in the arrays before).

    starts: norm_url, state (initial).  max_nested: clicks that may precede an action.
    """
    opens = F.when(F.col("to_url").isNull() & F.col("modal_title").isNull(), F.col("to_state"))
    seen = views.select("norm_url", F.struct("pos", "state", "key", "label", F.coalesce("is_link", F.lit(False)).alias("is_link")).alias("v"))
    done = clicks.select("norm_url", F.struct("state", "key", "label", F.coalesce("disclosure", F.lit(False)).alias("disclosure"), "to_url", "modal_title", "to_state", opens.alias("opens")).alias("c"))
    gathered = lambda df, what, name: df.groupBy("norm_url").agg(F.array_sort(F.collect_list(what)).alias(name))
    pages = gathered(seen, "v", "views").join(gathered(done, "c", "clicks"), "norm_url").join(gathered(starts.distinct(), "state", "starts"), "norm_url")
    return pages.select("norm_url", "views", "clicks", _taken(max_nested)("views", "clicks", "starts").alias("taken"))


def discoveries(views: DataFrame, clicks: DataFrame, starts: DataFrame, max_nested: int = 5) -> DataFrame:
    """What taken clicks lead to, as probe rows of ``traversal``: norm_url, seq, type, label, key, path, depth, signature, title, url.

    seq numbers a page's results in their order.  A disclosure, and a click that changes
    nothing, is no result.
    """

    def result(t: Column) -> Column:
        c = F.get("clicks", t["click"])
        changed = ~c["disclosure"] & F.coalesce(c["to_state"] != c["state"], F.lit(False))
        kind = F.when(c["to_url"].isNotNull(), "url").when(c["modal_title"].isNotNull(), "modal").when(changed, "state")
        path = F.transform(t["path"], lambda i: F.struct(F.get("views", i)["key"].alias("key"), F.get("views", i)["label"].alias("label")))
        return F.struct(kind.alias("type"), c.alias("click"), path.alias("path"))

    found = F.filter(F.transform("taken", result), lambda r: r["type"].isNotNull())
    rows = taken_clicks(views, clicks, starts, max_nested).select("norm_url", F.posexplode(found).alias("seq", "r"))
    when = lambda kind, field: F.when(F.col("r.type") == kind, F.col(f"r.click.{field}"))
    return rows.select(
        "norm_url", "seq", "r.type", "r.click.label", "r.click.key", "r.path", F.size("r.path").alias("depth"),
        when("state", "to_state").alias("signature"), when("modal", "modal_title").alias("title"), F.col("r.click.to_url").alias("url"),
    )
