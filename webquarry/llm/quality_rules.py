"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a boolean column that is true where a text fails it.  Each rule's cost
and rejection rate are estimated on a bounded sample of rows; rules then run in
the order of rejections per cost, and a text that one rule rejects is not put to
the next (the branches of one CASE).  The order changes the time, never the
verdict.

Words are runs of anything but space and the controls from tab to carriage
return.  Nulls count as empty texts and have no words.  Windows are compared by
64-bit hashes within one text.  Input columns stay; result columns replace
clashing ones.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.llm.store import discard, stored
from webquarry.llm.udf import without

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that costs and rejection rates are estimated on.
SAMPLE_ROWS = 1000
#: Longest text of the sample; order and times of rules hold for longer ones as they do for these.
SAMPLE_CHARS = 20_000


def occurrences(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _covered(found: Column, size: int) -> Column:
    """Words under windows that begin at the given ascending places."""
    steps = F.transform(found, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(found, k + 1) - x, F.lit(size))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def with_statistics(df: DataFrame, text_col: str = "text", size: int = 3) -> DataFrame:
    """df plus n_words, word_chars, n_symbols, n_dup_lines, n_lines and n_repeat_words.

    n_lines: lines with a word; n_dup_lines: those equal to an earlier line;
    n_repeat_words: words in ``size``-word windows that the text has twice or more.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]
    tag = "stats_of_" + "_".join(df.columns)[:120]
    keep = without(df.columns, names)
    all_of = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("one"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = df.select(all_of.alias(tag), text.alias("t"))
    words = F.array_remove(F.split("t", f"[{SPACES}]+"), "")
    out = out.select(tag, "t", words.alias("w"))
    at_least = F.size("w") >= size
    hashes = F.transform("w", lambda x, i: F.struct(F.xxhash64(x, *[F.get("w", i + k) for k in range(1, size)]).alias("h"), i.alias("i")))
    windows = F.when(at_least, F.sort_array(F.slice(hashes, F.lit(1), F.size("w") - (size - 1)))).otherwise(F.slice(hashes, 1, 0))
    out = out.select(tag, "t", F.size("w").cast("long").alias("n_words"), windows.alias("s"))
    same = lambda x, k: F.coalesce(F.get("s", k)["h"] == x["h"], F.lit(False))
    twice = F.filter("s", lambda x, k: same(x, k + 1) | F.when(k > 0, same(x, k - 1)).otherwise(False))
    out = out.select(tag, "t", "n_words", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    out = out.select(tag, "t", "n_words", _covered(F.col("p"), size).alias("n_repeat_words"), lines.alias("l"))
    return out.select(
        *[F.col(tag)[c].alias(c) for c in keep],
        "n_words",
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        occurrences(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.size("l").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def base_failed() -> Column:
    """Too short, or mostly repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules(text_col: str = "text") -> list[Rule]:
    """Rules over with_statistics() and the text itself."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words, chars = F.col("n_words"), F.col("word_chars")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > words + 20),
        Rule("word_length", (chars < 2 * words) | (chars > 20 * words)),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("capitals", 100 * occurrences(text, UPPER) > 40 * chars),
        Rule("digits", 100 * occurrences(text, "0123456789") > 30 * chars),
        Rule("exclamations", 4 * occurrences(text, "!?") > words + 20),
        Rule("ellipsis_lines", (F.col("n_lines") >= 4) & (10 * F.regexp_count(text, F.lit("(\\.\\.\\.|…)[ \t]*(\n|$)")) > 3 * F.col("n_lines"))),
    ]


def sampled(df: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first texts of at most SAMPLE_CHARS characters that Spark comes by: it reads
    input splits one after another until there are enough, so the work does not grow with df."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias(text_col)
    return df.sparkSession.createDataFrame(df.select(text).filter(F.length(text_col) <= SAMPLE_CHARS).take(rows), f"`{text_col}` string")


def estimate(df: DataFrame, rules: list[Rule], text_col: str = "text") -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) for each rule on a sample of df's texts."""
    sample, at = stored(with_statistics(sampled(df, text_col), text_col), "rule-sample")
    checked = [F.coalesce(r.fails, F.lit(False)).cast("double") for r in rules]
    rates = sample.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"r{i}") for i, c in enumerate(checked)]).first()

    def seconds(column: Column) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            sample.select(F.sum(column)).collect()
            best = min(best, time.perf_counter() - began)
        return best

    floor = seconds(F.lit(0.0))
    out = [(r, max(seconds(c) - floor, 1e-4), rates[f"r{i}"]) for i, (r, c) in enumerate(zip(rules, checked, strict=True))]
    discard(df.sparkSession, at)
    return out


def ordered(estimates: list[tuple[Rule, float, float]]) -> list[Rule]:
    """Rules by rejections per second, most first; ties by name."""
    return [r for r, _, _ in sorted(estimates, key=lambda e: (-e[2] / e[1], e[0].name))]


def first_failure(rules: list[Rule]) -> Column:
    """Name of the first rule in the given order that a row fails; null if it fails none."""
    out = F.when(F.lit(False), F.lit(""))
    for r in rules:
        out = out.when(r.fails, F.lit(r.name))
    return out


def judge(df: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """df plus its statistics, base_failed and kept (false where base or any rule fails)."""
    counted = with_statistics(df.drop("base_failed", "kept"), text_col)
    rules = default_rules(text_col) if rules is None else rules
    cascade = [Rule("base", base_failed()), *ordered(estimate(df, rules, text_col))]
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", first_failure(cascade).isNull())


#: DuckDB statement for what judge() gives with the default rules.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM g) WHERE k > 1),
v AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (SELECT w.doc_id, t, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(v.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN v ON w.doc_id = v.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words + 20 OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines)
    OR 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 40 * word_chars OR 100 * (length(t) - length(regexp_replace(t, '[0-9]', '', 'g'))) > 30 * word_chars
    OR 4 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > n_words + 20
    OR (n_lines >= 4 AND 10 * len(regexp_extract_all(t, '(\.\.\.|…)[ \t]*(\n|$)')) > 3 * n_lines)) AS kept
FROM b
"""
