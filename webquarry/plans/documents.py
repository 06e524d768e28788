"""Documents of a whole site as rows in order: the index of screens and the knowledge base.

A document is a table of sections and pieces of text.  ``placed`` gives every piece its
line number and the characters before it, from sums by task, so a reader can fetch any
part by its offset; ``write_parts`` writes the pieces to part files that, read one after
another, are the document.  No task and no row holds more than its share of a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import text
from webquarry.operators.traversal import numbered

#: Columns that order a document's pieces.
ORDER = ["section", "major", "minor", "name"]
HEAD, ENTRIES, MIDDLE, REST = 0, 1, 2, 3


def _piece(df: DataFrame, section: int, content: Column, major: Column | None = None, minor: Column | None = None, name: Column | None = None) -> DataFrame:
    long = lambda c: (F.lit(0) if c is None else c).cast("long")
    return df.select(F.lit(section).alias("section"), long(major).alias("major"), long(minor).alias("minor"), (F.lit("") if name is None else name).alias("name"), content.alias("text"))


def index_lines(nodes: DataFrame, edges: DataFrame, start_url: str, generated_at: str) -> DataFrame:
    """The index: screens by depth and order of capture, then edges. nodes: id, url, title, depth, seq."""
    title = F.when(F.coalesce("title", F.lit("")) == "", F.lit("(untitled)")).otherwise(F.col("title"))
    entry = F.concat(F.lit("- **"), title, F.lit("**, depth "), F.col("depth").cast("string"), F.lit(": `"), F.col("url"), F.lit("`, document `"), F.col("id"), F.lit("`"))
    edge = F.concat(F.lit("- `"), F.col("from"), F.lit("` --("), F.col("label"), F.lit(")--> `"), F.col("to"), F.lit("`"))
    count = F.count("*").cast("string")
    head = nodes.agg(F.concat(F.lit(f"# Screens of {start_url}\n\nMade {generated_at}; screens: "), count, F.lit(".\n")).alias("t"))
    middle = edges.agg(F.concat(F.lit("\n## Ways between screens\n\nEdges: "), count, F.lit(".\n")).alias("t"))
    parts = [
        _piece(head, HEAD, F.col("t")),
        _piece(nodes, ENTRIES, entry, F.col("depth"), F.col("seq"), F.col("id")),
        _piece(middle, MIDDLE, F.col("t")),
        _piece(edges, REST, edge, name=F.concat_ws("\x01", "from", "to", "label")),
    ]
    return _together(parts)


def knowledge_base_lines(entries: DataFrame, start_url: str, generated_at: str) -> DataFrame:
    """Contents, and every screen's document with its headings one level down. entries: title, markdown, seq."""
    anchor = text.anchor(F.col("title"))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("](#"), anchor, F.lit(")"))
    body = F.concat(F.lit('<a id="'), anchor, F.lit('"></a>\n\n'), text.demoted(F.col("markdown"), 1), F.lit("\n---\n"))
    head = entries.agg(F.concat(F.lit(f"# All screens of {start_url}\n\nMade {generated_at}; screens: "), F.count("*").cast("string"), F.lit(".\n\n## Contents\n")).alias("t"))
    gap = entries.sparkSession.range(1).select(F.lit("").alias("t"))
    parts = [_piece(head, HEAD, F.col("t")), _piece(entries, ENTRIES, line, F.col("seq")), _piece(gap, MIDDLE, F.col("t")), _piece(entries, REST, body, F.col("seq"))]
    return _together(parts)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def placed(lines: DataFrame) -> DataFrame:
    """Pieces with line (their number) and offset (characters before them; each ends in a line break)."""
    sized = lines.withColumn("size", F.length("text").cast("long") + 1)
    offsets = numbered(sized, ORDER, "size").withColumnRenamed("place", "offset")
    return offsets.select(*ORDER, "text", "offset", "size")


def contents(pieces: DataFrame) -> DataFrame:
    """One row a section of placed pieces: pieces, first offset, and characters."""
    return pieces.groupBy("section").agg(F.count("*").alias("pieces"), F.min("offset").alias("offset"), F.sum("size").alias("size"))


def write_parts(lines: DataFrame, folder: str) -> None:
    """The document as text files in the order of their names."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, *ORDER).sortWithinPartitions(*ORDER).select("text").write.mode("overwrite").text(folder)
