"""Depth-first crawl with typed discoveries: pages, states, dialogs, URLs and forms.

The order is that of one worker with a stack: a page is captured, what it leads to is
pushed (links, then what clicks revealed in their order, then forms), what is already
known is not pushed again, and the last push is taken next.  A page is placed by the
pushes that lead to it: its key is the list of their negated numbers, and keys in
ascending order are the order of capture, as an array sorts before its extensions.

Keys come from a fixpoint instead of a replay.  In every round each page takes, of all
pages that lead to it and may expand, the one with the smallest key (the first that the
worker would have met) and extends that key.  Depth grows along a key, so keys are no
longer than the depth limit, and what followed from a key that has changed is gone
after that many rounds.  A round is a join and an aggregate; it ends when no key
changes, and then the keys are those of the replay.

Only the first page with a probe fingerprint has its clicks and forms followed; who is
first follows from the keys of the round.  Pages whose (URL, state fingerprint) was
visited are neither captured nor expanded; the start is exempt.

Captures are numbered in order over all partitions (``numbered``), and the page budget
is a cut in these numbers: pages, states and every occurrence of a dialog count.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquarry.functions import text, urls
from webquarry.operators.dedup import first_seen
from webquarry.operators.discovery import with_parents
from webquarry.store import discard, stored_at

#: Kinds of pushes in their order, and how push numbers are built: kind, probe, link place.
LINK, CLICK, FORM = 0, 1, 2
_KIND, _PROBE = 1 << 50, 1 << 20

#: Columns of the tables that ``typed_crawl`` takes.
CAPTURE = "url string, norm_url string, title string, links array<struct<text: string, href: string>>, probe_fingerprint string"
PROBES = (
    "norm_url string, seq int, type string, label string, key string, path array<struct<key: string, label: string>>, "
    "depth int, signature string, title string, url string, links array<struct<text: string, href: string>>"
)


class Crawl(NamedTuple):
    """nodes: place, kind (page, state, modal), id, url, norm_url, title, depth, discovered_via, parent_id;
    edges: from, to, label."""

    nodes: DataFrame
    edges: DataFrame


def numbered(df: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """df with ``place``: how many rows (or how much weight) come before a row in the given order.

    Rows are ranged over tasks, summed in each, and moved by the sums of the tasks
    before; the driver holds one number for each task.  Ties keep any order.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    rows, _ = stored_at(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("at", 33)
    own = F.col(weight) if weight else F.lit(1)
    sums = rows.groupBy(task.alias("task")).agg(F.sum(own).cast("long").alias("n")).orderBy("task").collect()
    before, total = {}, 0
    for row in sums:
        before[row["task"]] = total
        total += row["n"]
    if weight:
        inside = F.sum(own).over(Window.partitionBy(task).orderBy("at")) - own
    else:
        inside = F.col("at").bitwiseAND((1 << 33) - 1)
    offsets = spark.createDataFrame([(k, v) for k, v in before.items()], "task int, offset long")
    moved = rows.withColumn("inside", inside).join(F.broadcast(offsets), task == F.col("task"))
    return moved.withColumn("place", (F.col("inside") + F.col("offset")).cast("long")).drop("at", "inside", "task", "offset")


def push(kind: int, probe: Column | None = None, link: Column | None = None) -> Column:
    """Number of a push within its page."""
    zero = F.lit(0).cast("long")
    return F.lit(kind * _KIND) + (zero if probe is None else probe.cast("long") * _PROBE) + (zero if link is None else link.cast("long"))


def _steps(captures: DataFrame, probes: DataFrame | None, forms: DataFrame | None, start_url: str, scope: str) -> DataFrame:
    """All pushes that pages may make: source, target, push, href, inc, needs, unless, probed, via.

    A push is made if the page's depth plus ``needs`` is below the limit, its depth plus
    ``unless`` (if not null) above it, and, where it is ``probed``, the page is the first
    of its fingerprint; the target lies ``inc`` deeper.
    """
    columns = ["source", "target", "push", "href", "inc", "needs", "unless", "probed", "via"]
    quoted = lambda what, c: F.concat(F.lit(f'{what}: "'), c, F.lit('"'))

    def row(df, number, href, inc, needs, probed, via, unless=F.lit(None)):
        at = df.select(F.col("norm_url").alias("source"), number.alias("push"), href.alias("href"), inc.cast("int").alias("inc"), needs.cast("int").alias("needs"), unless.cast("int").alias("unless"), F.lit(probed).alias("probed"), via.alias("via"))
        at = at.withColumn("target", urls.normalize_url(F.col("href")))
        return at.filter(urls.in_scope(F.col("href"), F.lit(start_url), scope) & urls.is_navigable(F.col("target"))).select(*columns)

    links = captures.select("norm_url", F.posexplode("links").alias("pos", "link"))
    out = row(links, push(LINK, None, F.col("pos")), F.col("link.href"), F.lit(1), F.lit(0), False, quoted("link", F.col("link.text")))
    if probes is not None:
        # a state is captured once: where an earlier result within the limit shows it too, this one pushes nothing
        earlier = Window.partitionBy("norm_url", "type", "signature").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        inside = probes.filter(F.col("type").isin("state", "modal")).withColumn("unless", F.when(F.col("type") == "state", F.min("depth").over(earlier)))
        inside = inside.select("norm_url", "seq", "type", "depth", "unless", F.posexplode("links").alias("pos", "link"))
        is_state = F.col("type") == "state"
        via = F.when(is_state, quoted("link", F.col("link.text"))).otherwise(quoted("modal link", F.col("link.text")))
        needs = F.when(is_state, F.col("depth")).otherwise(1)
        out = out.unionByName(row(inside, push(CLICK, F.col("seq"), F.col("pos") + 1), F.col("link.href"), needs + 1, needs, True, via, F.col("unless")))
        found = probes.filter(F.col("type") == "url")
        steps = F.greatest(F.coalesce(F.size("path"), F.lit(0)), F.lit(1))
        leads = row(found, push(CLICK, F.col("seq")), F.col("url"), steps, F.lit(0), True, quoted("click", F.col("label")))
        out = out.unionByName(leads.filter("source <> target"))
    if forms is not None:
        sent = row(forms, push(FORM, None, F.col("form_pos")), F.col("url"), F.lit(1), F.lit(0), True, quoted("form", F.col("action")))
        out = out.unionByName(sent.filter("source <> target"))
    return out


def _placed(captures: DataFrame, steps: DataFrame, start_url: str, max_depth: int) -> tuple[DataFrame, str]:
    """The fixpoint: norm_url, key, depth, href, via, source, push, probes (whether its clicks and forms are followed)."""
    spark = captures.sparkSession
    start = urls.normalize(start_url)
    schema = "norm_url string, key array<bigint>, depth int, href string, via string, source string, push bigint"
    root = spark.createDataFrame([(start, [], 0, start_url, "seed", None, None)], schema)
    prints = captures.select("norm_url", "probe_fingerprint")
    now, at, state = root, None, None
    while True:
        # of pages that may expand, the first with each fingerprint; pages without one stand for themselves
        print_of = F.coalesce(F.concat(F.lit("p"), F.col("probe_fingerprint")), F.concat(F.lit("u"), F.col("norm_url")))
        known = now.join(prints, "norm_url").withColumn("print", print_of)
        first = known.filter(F.col("depth") < max_depth).groupBy("print").agg(F.min(F.struct("key", "norm_url")).alias("first"))
        known = known.join(first, "print", "left").withColumn("probes", F.coalesce((F.col("first.norm_url") == F.col("norm_url")) & (F.col("depth") < max_depth), F.lit(False)))
        made = known.select(F.col("norm_url").alias("source"), "key", "depth", "probes").join(steps, "source")
        made = made.filter((F.col("depth") + F.col("needs") < max_depth) & (F.col("unless").isNull() | (F.col("depth") + F.col("unless") > max_depth)) & (~F.col("probed") | F.col("probes")) & (F.col("target") != start))
        best = made.groupBy("target").agg(F.min_by(F.struct("depth", "inc", "href", "via", "source"), F.struct("key", "push", "source")).alias("b"), F.min(F.struct("key", "push", "source")).alias("k"))
        after = best.select(
            F.col("target").alias("norm_url"), F.concat(F.col("k.key"), F.array(-F.col("k.push"))).alias("key"), (F.col("b.depth") + F.col("b.inc")).alias("depth"),
            "b.href", "b.via", F.col("b.source").alias("source"), F.col("k.push").alias("push"),
        )
        after = after.join(prints.select("norm_url"), "norm_url", "left_semi").unionByName(root)
        # who probes belongs to the keys before: it is part of what must not change any more
        after = after.join(known.filter("probes").select("norm_url", F.lit(True).alias("probes")), "norm_url", "left")
        after, new_at = stored_at(after.withColumn("probes", F.coalesce("probes", F.lit(False))), "placed")
        told = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("norm_url", "key", "depth", "probes").cast("decimal(38,0)")).alias("sum")).first()
        if at:
            discard(spark, at)
        now, at = after, new_at
        if told == state:
            return now, at
        state, now = told, now.drop("probes")


def typed_crawl(
    captures: DataFrame,
    start_url: str,
    probes: DataFrame | None = None,
    forms: DataFrame | None = None,
    max_depth: int = 5,
    max_pages: int | None = 50,
    scope: str = "site",
    visited_states: DataFrame | None = None,
) -> Crawl:
    """Depth-first capture over a corpus of screens and of what clicks and forms led to.

    captures: columns CAPTURE, and optionally status, is_ready and state_fingerprint;
    of rows that share a normal URL the first by url counts, rows with status 400 or more
    or not ready do not.  probes: columns PROBES, by norm_url and seq, which must be
    unique in a page and below 2**30.  forms: norm_url, form_pos, action, url (null: not
    sent).  visited_states: norm_url, state_fingerprint.

    States lie within the depth limit; dialogs are one below their page and URLs as deep
    as their path is long, without a limit.  A repeated state is an edge only, a repeated
    dialog replaces the one before.  Edges are those that the worker adds: the one by
    which a screen was found, and those to screens captured by then.
    """
    spark = captures.sparkSession
    usable = captures
    if "status" in captures.columns:
        usable = usable.filter(F.col("status").isNull() | (F.col("status") < 400))
    if "is_ready" in captures.columns:
        usable = usable.filter(F.coalesce("is_ready", F.lit(True)))
    if visited_states is not None:
        seen = visited_states.select("norm_url", "state_fingerprint").distinct()
        begins = usable.filter(F.col("norm_url") == urls.normalize(start_url))
        usable = usable.filter(F.col("norm_url") != urls.normalize(start_url)).join(seen, ["norm_url", "state_fingerprint"], "left_anti").unionByName(begins)
    names = ["url", "norm_url", "title", "links", "probe_fingerprint"]
    usable, usable_at = stored_at(first_seen(usable.select(*names), ["norm_url"], ["url"]), "captures")
    steps, steps_at = stored_at(_steps(usable, probes, forms, start_url, scope), "steps")
    placed, placed_at = _placed(usable, steps, start_url, max_depth)

    pages = placed.join(usable.select("norm_url", "title"), "norm_url").select("norm_url", "key", "depth", F.col("href").alias("url"), "via", "source", "push", "probes", "title")
    pages = pages.withColumn("id", text.screen_id(F.col("url"), F.col("norm_url")))
    pages, pages_at = stored_at(pages, "placed-pages")
    no_number = F.lit(None).cast("int")
    page_rows = pages.select("norm_url", "key", no_number.alias("seq"), F.lit("page").alias("kind"), F.lit(1).alias("weight"))
    events = page_rows
    clicks = None
    if probes is not None:
        clicks = probes.join(pages.filter("probes").select("norm_url", F.col("id").alias("screen_id"), F.col("url").alias("page_url"), F.col("depth").alias("page_depth"), F.col("key").alias("page_key")), "norm_url")
        clicks = _clicks(clicks, max_depth)
        clicks, clicks_at = stored_at(clicks, "clicks")
        events = page_rows.unionByName(clicks.filter("kind <> 'url'").select("norm_url", F.col("page_key").alias("key"), "seq", "kind", "weight"))
    events, events_at = stored_at(numbered(events.withColumn("after", F.coalesce("seq", F.lit(-1))), ["key", "after"], "weight").drop("after", "key"), "events")
    if max_pages is not None:
        events = events.filter(F.col("place") < max_pages)
    taken = events.filter("kind = 'page'").join(pages, "norm_url")
    taken, taken_at = stored_at(taken.drop("seq", "weight"), "taken")
    out = _assembled(usable, taken, events, clicks, forms, start_url, scope, max_depth)
    nodes, _ = stored_at(out.nodes, "crawl-nodes")
    edges, _ = stored_at(out.edges, "crawl-edges")
    discard(spark, usable_at, steps_at, placed_at, pages_at, events_at, taken_at, *([clicks_at] if clicks is not None else []))
    return Crawl(nodes, edges)


def _clicks(clicks: DataFrame, max_depth: int) -> DataFrame:
    """Probe results of the pages that probe: with kind, parent_id, own id and url, and weight (0 for a repeated state)."""
    deep = F.col("page_depth") + F.col("depth")
    usable = clicks.filter((F.col("type") != "state") | (deep <= max_depth)).withColumn("kind", F.col("type"))
    own = F.when(F.col("kind") == "state", urls.state_url(F.col("page_url"), F.col("signature"))).when(F.col("kind") == "modal", text.modal_url(F.col("page_url"), F.col("label"), F.col("key")))
    usable = usable.withColumn("own_url", own).withColumn("own_id", F.concat(text.slug(F.col("own_url")), F.lit("-"), text.short_id(F.col("own_url"))))
    states = usable.filter("kind = 'state'")
    parents = with_parents(usable, states.select("screen_id", "path", F.col("own_id").alias("id"), "seq"))
    firsts = first_seen(states.select("screen_id", "own_id", "seq"), ["screen_id", "own_id"], ["seq"]).select("screen_id", "seq", F.lit(True).alias("is_first"))
    marked = parents.join(firsts, ["screen_id", "seq"], "left")
    weight = F.when((F.col("kind") == "modal") | F.coalesce("is_first", F.lit(False)), 1).otherwise(0)
    return marked.withColumn("weight", weight).drop("is_first")


def _assembled(usable, taken, events, clicks, forms, start_url, scope, max_depth) -> Crawl:
    """Nodes and edges of what was captured."""
    label = lambda what, c: F.concat(F.lit(f'{what}: "'), c, F.lit('"'))
    known = taken.select(F.col("norm_url").alias("target"), F.col("id").alias("to"), F.col("place").alias("known_at"))
    where = taken.select(F.col("norm_url").alias("source"), F.col("id").alias("source_id"))
    found = taken.join(where, "source", "left")
    if clicks is not None:
        number = F.when(F.shiftright("push", 50) == CLICK, F.shiftright(F.col("push").bitwiseAND(_KIND - 1), 20).cast("int"))
        inside = F.when(F.col("push").bitwiseAND(_PROBE - 1) > 0, F.col("own_id")).otherwise(F.col("click_parent"))
        by = clicks.select(F.col("norm_url").alias("source"), F.col("seq").alias("number"), F.col("parent_id").alias("click_parent"), "own_id")
        found = found.withColumn("number", number).join(by, ["source", "number"], "left").withColumn("parent_id", F.coalesce(inside, "source_id"))
    else:
        found = found.withColumn("parent_id", F.col("source_id"))
    columns = ["place", "kind", "id", "url", "norm_url", "title", "depth", F.col("via").alias("discovered_via"), "parent_id"]
    nodes = found.select(*columns)
    edges = [found.filter("parent_id is not null").select(F.col("parent_id").alias("from"), F.col("id").alias("to"), F.col("via").alias("label"))]

    def leads(rows: DataFrame) -> DataFrame:
        """Edges of rows (from, place, href, label) to screens captured by then."""
        rows = rows.withColumn("target", urls.normalize_url(F.col("href")))
        rows = rows.filter(urls.in_scope(F.col("href"), F.lit(start_url), scope) & urls.is_navigable(F.col("target")))
        return rows.join(known, "target").filter("known_at <= place").select("from", "to", "label")

    expands = taken.filter(F.col("depth") < max_depth)
    links = expands.select("norm_url", F.col("id").alias("from"), "place").join(usable.select("norm_url", F.explode("links").alias("link")), "norm_url")
    edges.append(leads(links.select("from", "place", F.col("link.href").alias("href"), label("link", F.col("link.text")).alias("label"))))
    if clicks is not None:
        here = clicks.join(taken.select("norm_url", F.col("place").alias("page_place")), "norm_url")
        # a repeated state weighs nothing: it is an event as well, so that the budget cuts it at its place
        timed = here.join(events.filter("kind <> 'page'").select("norm_url", "seq", "place"), ["norm_url", "seq"])
        via = F.when(F.col("kind") == "state", label("click", F.col("label"))).otherwise(label("modal", F.col("label")))
        depth = F.when(F.col("kind") == "state", F.col("page_depth") + F.col("depth")).otherwise(F.col("page_depth") + 1)
        own = timed.select("place", "kind", F.col("own_id").alias("id"), F.col("own_url").alias("url"), F.col("own_url").alias("norm_url"), "title", depth.cast("int").alias("depth"), via.alias("discovered_via"), "parent_id", "links", "page_place", "weight")
        edges.append(own.select(F.col("parent_id").alias("from"), F.col("id").alias("to"), F.col("discovered_via").alias("label")))
        captured = own.filter("weight = 1")
        states = captured.filter("kind = 'state'")
        # the last of a dialog's occurrences replaces those before, at the first one's place
        modals = captured.filter("kind = 'modal'").withColumn("later", -F.col("place"))
        place = modals.groupBy("id").agg(F.min("place").alias("first_place"))
        modals = first_seen(modals, ["id"], ["later"]).drop("later").join(place, "id").withColumn("place", F.col("first_place")).drop("first_place")
        both = states.unionByName(modals.select(*states.columns))
        nodes = nodes.unionByName(both.select(*nodes.columns))
        linked = states.filter(F.col("depth") < max_depth).select(F.col("id").alias("from"), F.col("page_place").alias("place"), F.explode("links").alias("link"))
        edges.append(leads(linked.select("from", "place", F.col("link.href").alias("href"), label("link", F.col("link.text")).alias("label"))))
        jumps = here.filter("kind = 'url'").select(F.col("parent_id").alias("from"), F.col("page_place").alias("place"), F.col("url").alias("href"), label("click", F.col("label")).alias("label"), "norm_url")
        edges.append(leads(jumps.filter(urls.normalize_url(F.col("href")) != F.col("norm_url")).drop("norm_url")))
    if forms is not None:
        sent = forms.join(expands.filter("probes").select("norm_url", F.col("id").alias("from"), "place"), "norm_url").filter(F.col("url").isNotNull())
        sent = sent.filter(urls.normalize_url(F.col("url")) != F.col("norm_url"))
        edges.append(leads(sent.select("from", "place", F.col("url").alias("href"), label("form", F.col("action")).alias("label"))))
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    return Crawl(nodes, all_edges.distinct())
