"""String functions: hashes, slugs, selectors, labels, markdown headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript's \s has it, for a regular-expression class.
SPACE = r" \t\n\r\x0b\f   -     　﻿"
# Fixed value: labels that sound like a change rather than a way on.
DESTRUCTIVE = "delete|remove|logout|log out|sign out|deactivate|disable|unsubscribe|discard|revoke"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return trimmed(F.regexp_replace(text, f"[{SPACE}]+", " "))


def short_id(text: Column, length: int = 10) -> Column:
    return F.substring(F.sha1(text), 1, length)


def _dashed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug(text: Column) -> Column:
    """Lower case, the first scheme removed, dashes for the rest, 60 characters, else "page"."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?s)^(.*?)https?://", "$1")
    cut = F.substring(_dashed(plain), 1, 60)
    return F.when(cut == "", F.lit("page")).otherwise(cut)


def anchor(title: Column) -> Column:
    """Anchor name of a title; empty and null titles are untitled."""
    return _dashed(F.lower(F.when(F.coalesce(title, F.lit("")) == "", F.lit("untitled")).otherwise(title)))


def screen_id(url: Column, normal: Column) -> Column:
    """Slug of the URL as found, and hash of its normal form."""
    return F.concat(slug(url), F.lit("-"), short_id(normal))


def modal_url(base: Column, label: Column, key: Column) -> Column:
    """Synthetic URL of a dialog opened from a page."""
    return F.concat(base, F.lit("#modal:"), slug(label), F.lit("-"), short_id(key))


def escape_attribute(value: Column) -> Column:
    return F.regexp_replace(value, r'([\\"])', r"\\$1")


def quoted(value: Column) -> Column:
    """Backslashes and single quotes escaped."""
    return F.regexp_replace(value, r"([\\'])", r"\\$1")


def field_selector(name: Column, ident: Column, placeholder: Column) -> Column:
    """CSS selector of a form field by the first of name, id and placeholder it has; else null."""
    one = lambda attribute, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f'[{attribute}="'), escape_attribute(value), F.lit('"]')))
    return F.coalesce(one("name", name), one("id", ident), one("placeholder", placeholder))


def clamp_int(value: Column, low: int, high: int, otherwise: int) -> Column:
    """Leading integer of a text within bounds; ``otherwise`` where there is none."""
    number = F.regexp_extract(F.coalesce(value, F.lit("")), rf"^[{SPACE}]*([+-]?[0-9]+)", 1)
    wide = F.when(number == "", None).otherwise(F.coalesce(number.try_cast("decimal(38,0)"), F.when(number.startswith("-"), F.lit(low)).otherwise(F.lit(high))))
    return F.when(wide.isNull(), F.lit(otherwise)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), wide))).cast("int")


def is_destructive(label: Column) -> Column:
    return label.rlike(f"(?i){DESTRUCTIVE}")


def mermaid_label(text: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r'["\[\]{}()\\]', "")
    return F.substring(collapsed(plain), 1, 60)


def mermaid_id(ident: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(ident, "[^a-zA-Z0-9]", "_"))


def demoted(markdown: Column, levels: int) -> Column:
    """Headings of a markdown text lowered by ``levels`` (six at most), code fences untouched.

    The text is cut at fence lines; every second piece is inside a fence.
    """
    blank = SPACE.replace(r"\n", "")
    fence = rf"(?<![^\n])[{blank}]*```[^\n]*"

    def lowered(piece: Column) -> Column:
        for n in range(6, 0, -1):  # from the lowest level on, so that none is lowered twice
            piece = F.regexp_replace(piece, rf"(?<![^\n])#{{{n}}}(?=[{blank}])", "#" * min(6, n + levels))
        return piece

    lines = F.regexp_extract_all(markdown, F.lit(fence), F.lit(0))
    pieces = F.transform(F.split(markdown, fence), lambda p, i: F.concat(F.when(i % 2 == 0, lowered(p)).otherwise(p), F.coalesce(F.get(lines, i), F.lit(""))))
    return F.array_join(pieces, "")
