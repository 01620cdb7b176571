"""Sets of findings: a finding is the same as another if file, hash and type agree; the line doesn't count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["filename", "secret_hash", "type"]


def dedup(findings: DataFrame) -> DataFrame:
    """One row for each identity, with its first line; verified if any is, labelled true before false before not at all."""
    return findings.groupBy(*IDENTITY).agg(F.min("line_number").alias("line_number"), F.max("is_secret").alias("is_secret"), F.max("is_verified").alias("is_verified"))


def subtract(findings: DataFrame, known: DataFrame) -> DataFrame:
    return findings.join(known.select(*IDENTITY), IDENTITY, "left_anti")


def intersect(findings: DataFrame, known: DataFrame) -> DataFrame:
    return findings.join(known.select(*IDENTITY), IDENTITY, "left_semi")


def merge(new: DataFrame, old: DataFrame) -> DataFrame:
    """The new findings with labels from the old where they have none of their own."""
    before = dedup(old).select(*IDENTITY, F.col("is_secret").alias("old_secret"), F.col("is_verified").alias("old_verified"))
    return new.join(before, IDENTITY, "left").select(*IDENTITY, "line_number", F.coalesce("is_secret", "old_secret").alias("is_secret"), (F.col("is_verified") | F.coalesce("old_verified", F.lit(False))).alias("is_verified"))


def trim(known: DataFrame, scanned: DataFrame, files: DataFrame) -> DataFrame:
    """Of the files (filename) that were scanned only what was found again, with its new line; other files as they are."""
    # one shuffle, by file, for the flag of the file and the line of each identity; what isn't known matches nothing, as in a join
    tagged = known.select(*IDENTITY, "line_number", "is_secret", "is_verified", F.lit(True).alias("__known"), F.lit(False).alias("__listed"))
    again = scanned.select(*IDENTITY, "line_number").withColumns({"__known": F.lit(False), "__listed": F.lit(False)})
    listed = files.select("filename").distinct().withColumns({"__known": F.lit(False), "__listed": F.lit(True)})
    rows = tagged.unionByName(again, allowMissingColumns=True).unionByName(listed, allowMissingColumns=True)
    rows = rows.withColumn("__in", F.max("__listed").over(Window.partitionBy("filename")) & F.col("filename").isNotNull())
    new = F.min(F.when(~F.col("__known") & ~F.col("__listed"), F.col("line_number"))).over(Window.partitionBy(*IDENTITY))
    seen = F.max(~F.col("__known") & ~F.col("__listed")).over(Window.partitionBy(*IDENTITY)) & F.col("secret_hash").isNotNull() & F.col("type").isNotNull()
    rows = rows.withColumns({"__new": new, "__seen": seen}).where("__known and (not __in or __seen)")
    return rows.select(*IDENTITY, F.when(F.col("__in"), F.col("__new")).otherwise(F.col("line_number")).alias("line_number"), "is_secret", "is_verified")


def by_file(findings: DataFrame) -> DataFrame:
    """(filename, secrets): the findings of each file that has any, by line."""
    entry = F.struct("line_number", "secret_hash", "type", "is_secret", "is_verified")
    return findings.groupBy("filename").agg(F.sort_array(F.collect_list(entry)).alias("secrets"))


def count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("secrets"), F.countDistinct("filename").alias("files"))


def files(findings: DataFrame) -> DataFrame:
    return findings.select("filename").distinct().orderBy("filename")


def difference(a: DataFrame, b: DataFrame, exactly: bool = False) -> DataFrame:
    """What one has and the other has not: by identity, or by all columns. Empty means equal."""
    # one grouping of both for both sides, in which nulls are equal
    columns = [*IDENTITY, "line_number", "is_secret", "is_verified"] if exactly else IDENTITY
    both = a.select(*columns, F.lit(1).alias("__left"), F.lit(0).alias("__right")).union(b.select(*columns, F.lit(0), F.lit(1)))
    many = F.sum if exactly else F.max
    rows = both.groupBy(*columns).agg((many("__left") - many("__right")).alias("__n")).where("__n <> 0")
    rows = rows.withColumn("side", F.when(F.col("__n") > 0, "left").otherwise("right"))
    if exactly:
        rows = rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.abs("__n"))))
    return rows.select(*columns, "side")


def equal(a: DataFrame, b: DataFrame, exactly: bool = False) -> bool:
    return difference(a, b, exactly).isEmpty()
