"""Unified diffs to the lines they add, in order of position within each diff."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import split_lines


def hunk_start(line):
    """Where a hunk begins in the new file; null for a header that doesn't say."""
    return F.nullif(F.regexp_extract(line, "^[^+]*\\+([0-9]+)[^0-9]", 1), F.lit("")).cast("bigint")


def added_lines(diffs: DataFrame, diff_col: str = "diff", key: str = "diff_id") -> DataFrame:
    """(key, filename, line_number, line, previous): added lines; ``previous`` is the added line before in the same file.

    A file begins at a line ``+++ b/...`` and ends at any other ``+++ `` line. Line numbers go on from file to file
    until a hunk header sets them. A null diff has no lines.
    """
    rows = diffs.select(key, F.posexplode(split_lines(F.col(diff_col))).alias("pos", "raw"))
    raw = F.col("raw")
    kind = F.when(raw.startswith("+++ "), "file").when(raw.startswith("--- "), "skip").when(raw.startswith("@@ "), "hunk").when(raw.startswith("+"), "add").when(raw.startswith("-"), "del").otherwise("same")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("kind") == "file", F.struct(F.when(raw.startswith("+++ b/"), F.substring(raw, 7, 1 << 30)).alias("name")))
    start = F.when(F.col("kind") == "hunk", hunk_start(raw))
    rows = rows.withColumn("kind", kind).withColumn("start", start)
    rows = rows.withColumn("file", F.last(mark, ignorenulls=True).over(so_far)["name"]).withColumn("file_no", F.count(F.when(F.col("kind") == "file", 1)).over(so_far))
    rows = rows.withColumn("base", F.last("start", ignorenulls=True).over(so_far)).withColumn("hunk", F.count("start").over(so_far))
    within = Window.partitionBy(key, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.coalesce(F.sum(F.when(F.col("file").isNotNull() & F.col("kind").isin("add", "same"), 1).otherwise(0)).over(within), F.lit(0))
    rows = rows.withColumn("line_number", F.coalesce("base", F.lit(0)) + counted)
    added = rows.where((F.col("kind") == "add") & F.col("file").isNotNull())
    line = F.substring("raw", 2, 1 << 30)
    before = F.lag(line, 1, "").over(Window.partitionBy(key, "file_no").orderBy("pos"))
    return added.select(key, F.col("file").alias("filename"), F.col("line_number").cast("bigint").alias("line_number"), line.alias("line"), before.alias("previous"))
