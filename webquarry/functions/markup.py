"""Facets of simple HTML by expressions, for scans that need no tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_code(html: Column) -> Column:
    """HTML without scripts, styles and comments."""
    return F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")


def plain_text(html: Column) -> Column:
    """Text between tags with single spaces; entities stay as written."""
    return F.trim(F.regexp_replace(F.regexp_replace(without_code(html), "<[^>]*>", " "), "[ \t\n\r]+", " "))
