"""Content fingerprints of screens: full, cheap and change signature.

Fingerprints are hashes of Spark's JSON with nulls kept.  They are consistent
inside the engine, not byte-equal to other JSON writers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions.text import collapsed
from webquarry.functions.urls import looks_like_login

_KEEP_NULLS = {"ignoreNullFields": "false"}


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _each(name: str, function) -> Column:
    return F.coalesce(F.transform(name, function), F.array())


def state_fingerprint() -> Column:
    """Hash of everything a screen shows: title, headings, text, links, buttons, forms, tables."""
    shown = F.struct(
        _text("title").alias("title"),
        _each("headings", lambda h: h["text"]).alias("headings"),
        _text("body_text").alias("text"),
        _each("links", lambda x: F.array(x["href"], x["text"])).alias("links"),
        _each("buttons", lambda b: b["text"]).alias("buttons"),
        _each("forms", lambda f: F.struct(f["action"], f["method"], F.transform(f["fields"], lambda x: x["name"]))).alias("forms"),
        _each("tables", lambda t: F.struct(t["headers"], t["rows"])).alias("tables"),
    )
    return F.sha1(F.to_json(shown, _KEEP_NULLS))


def probe_fingerprint() -> Column:
    """Title, headings and counts of links, buttons and forms: cheap and lossy."""
    count = lambda name: F.coalesce(F.size(name), F.lit(0)).cast("string")
    return F.concat_ws("::", _text("title"), F.array_join(_each("headings", lambda h: h["text"]), "|"), F.concat_ws(":", count("links"), count("buttons"), count("forms")))


def page_signature() -> Column:
    """Hash that changes when a page's visible text, links or fields do."""
    seen = F.struct(
        _text("title").alias("title"),
        collapsed(_text("visible_text")).alias("text"),
        _each("links", lambda x: F.array(x["href"], x["text"])).alias("links"),
        _each("forms", lambda f: F.transform(f["fields"], lambda x: F.array(x["name"], x["type"], x["placeholder"]))).alias("fields"),
    )
    return F.sha1(F.to_json(seen, _KEEP_NULLS))


def has_password(forms: str = "forms") -> Column:
    return F.coalesce(F.exists(forms, lambda f: F.exists(f["fields"], lambda x: x["type"] == "password")), F.lit(False))


def is_login_wall(url: Column, forms: str = "forms") -> Column:
    """Whether a screen looks like a login: by a password field, or by the path of its URL; null URLs have no path."""
    return has_password(forms) | F.coalesce(looks_like_login(url), F.lit(False))
