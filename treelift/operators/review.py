"""Lines that a reviewer was shown, and whether what the reviewer cites stands there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelift.operators.decisions import is_sensitive, redaction


def shown_lines(texts: DataFrame) -> DataFrame:
    """source_id, path, line, text: the lines of files (source_id, path, content) that redaction left as they were; sensitive files have none."""
    rows = texts.where(F.col("content").isNotNull() & ~is_sensitive(F.col("path")))
    kept = redaction(F.col("content"))["unchanged"]
    # a row is one line from here on: rows that carry all lines of their file would copy it once a line
    lines = F.transform(F.array(F.split("content", "\n")), lambda every: F.transform(kept, lambda n: F.struct(n.alias("line"), F.get(every, n - 1).alias("text"))))
    return rows.select("source_id", "path", F.inline(F.get(lines, F.lit(0))))


def resolve_lines(citations: DataFrame, lines: DataFrame) -> DataFrame:
    """All columns of citations and resolved: the cited line if it shows the value, else the only neighbour that does, else null.

    citations has source_id, path, line and value, lines has source_id, path, line and text.  The band of three lines is three
    equalities.  Repeated citations stay, each different one is looked up once; nulls resolve to nothing, an empty value stands everywhere.
    """
    key = ["source_id", "path", "line", "value"]
    asked = citations.select(*key).dropna().distinct()
    near = asked.select(*key, F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("at"))
    seen = near.join(lines.select("source_id", "path", F.col("line").alias("at"), "text"), ["source_id", "path", "at"]).where(F.contains("text", "value"))
    places = seen.groupBy(*key).agg(F.bool_or(F.col("at") == F.col("line")).alias("exact"), F.min("at").alias("low"), F.max("at").alias("high"))
    found = places.select(*key, F.when(F.col("exact"), F.col("line")).when(F.col("low") == F.col("high"), F.col("low")).alias("resolved"))
    return citations.join(found, key, "left").select(*citations.columns, "resolved")
