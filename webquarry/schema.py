"""Record schemas: screens and their parts, graph, checkpoint and artefacts."""

from __future__ import annotations

from pyspark.sql import types as T


_PLAIN = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType()}


def _split(text: str) -> list[str]:
    """Parts at the commas outside angle brackets."""
    parts, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(text[begin:i])
            begin = i + 1
    return [p.strip() for p in [*parts, text[begin:]]]


def _type(text: str) -> T.DataType:
    if text.startswith("array<"):
        return T.ArrayType(_type(text[6:-1].strip()))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(n.strip(), _type(k.strip())) for n, k in (f.split(":", 1) for f in _split(text[7:-1]))])
    return _PLAIN[text]


def _of(text: str) -> T.StructType:
    """Schema of "name type, ..."; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(n, _type(k.strip())) for n, k in (f.split(" ", 1) for f in _split(text))])


HEADING = "struct<level: string, text: string>"
LINK = "struct<text: string, href: string>"
BUTTON = "struct<text: string, locator: string>"
CANDIDATE = "struct<key: string, label: string, inside_row: boolean>"
FIELD = "struct<tag: string, type: string, name: string, id: string, placeholder: string, label: string, required: boolean, locator: string>"
FORM = f"struct<action: string, method: string, fields: array<{FIELD}>>"
TABLE = "struct<headers: array<string>, rows: array<array<string>>>"
MODAL = f"struct<title: string, body_text: string, links: array<{LINK}>, buttons: array<{BUTTON}>, forms: array<{FORM}>>"
STEP = "struct<key: string, label: string>"

#: What is read from one page.
SCREEN = _of(
    f"title string, meta_description string, headings array<{HEADING}>, links array<{LINK}>, buttons array<{BUTTON}>, nav_candidates array<{CANDIDATE}>, "
    f"snapshot array<{CANDIDATE}>, forms array<{FORM}>, form_queries array<string>, tables array<{TABLE}>, modal {MODAL}, body_text string, visible_text string, dom_signature string, aria_snapshot string, is_ready boolean"
)
#: Work still to do: where a URL was found and by which actions.
FRONTIER = _of(f"url string, depth int, discovered_via string, parent_screen_id string, from_url string, action_path array<{STEP}>")
NODE = _of("id string, url string, title string, depth int, seq long")
EDGE = _of("from string, to string, label string")
META = _of("screen_id string, url string, normalized_url string, depth int, discovered_via string, title string, http_status int, crawled_at timestamp")
PAGE_STATE = _of("norm_url string, url string, depth int, discovered_via string, parent_screen_id string, from_url string, signature string")
APP_MAP = _of(f"name string, url string, slug string, headings array<string>, fields array<struct<label: string, tag: string, name: string, type: string, placeholder: string, locator: string>>, buttons array<{BUTTON}>")
MODULE = _of("id string, title string, markdown string")
#: Results of click probes, given as rows: type is url, modal or state.
PROBE = _of(f"screen_id string, page_url string, page_depth int, type string, label string, key string, path array<{STEP}>, url string, signature string, depth int, title string")
LOG = _of("level string, line string, at timestamp")
JOB = _of("id string, status string, start_url string, created_at timestamp, error string, pending_auth_url string")
