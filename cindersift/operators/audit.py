"""Audits of labelled findings: statistics, reports, work-lists and differences of two baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collection import IDENTITY, dedup


def _share(part, whole):
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def stats(findings: DataFrame) -> DataFrame:
    """For each type: labelled true and false, not labelled, precision, and recall against what isn't labelled."""
    by = findings.groupBy("type").agg(F.count_if(F.col("is_secret")).alias("true_positives"), F.count_if(~F.col("is_secret")).alias("false_positives"), F.count_if(F.col("is_secret").isNull()).alias("unknown"))
    yes, no, open_ = F.col("true_positives"), F.col("false_positives"), F.col("unknown")
    return by.select("type", yes, no, open_, _share(yes, yes + no).alias("precision"), _share(yes, yes + open_).alias("recall"))


def report(findings: DataFrame, only: bool | None = None) -> DataFrame:
    """(category, filename, secret_hash, lines, types): a row for each secret of a file; ``only`` keeps one label."""
    rows = findings if only is None else findings.where(F.col("is_secret") == F.lit(only))
    label = F.when(F.max("is_secret").isNull(), "UNVERIFIED").when(F.max("is_secret"), "VERIFIED_TRUE").otherwise("VERIFIED_FALSE")
    return rows.groupBy("filename", "secret_hash").agg(label.alias("category"), F.sort_array(F.collect_set("line_number")).alias("lines"), F.sort_array(F.collect_set("type")).alias("types"))


def unlabelled(findings: DataFrame) -> DataFrame:
    return findings.where("is_secret is null").orderBy("filename", "line_number")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(filename, secret_hash, type, line_number, change): what the new one adds and what it no longer has."""
    # one join for both changes; each identity is there once on a side, and what isn't known is equal to nothing
    a = dedup(old).select(*IDENTITY, "line_number", F.lit(True).alias("__old"))
    b = dedup(new).select(*(F.col(c).alias(f"__{c}") for c in IDENTITY), F.col("line_number").alias("__line"), F.lit(True).alias("__new"))
    both = a.join(b, [F.col(c) == F.col(f"__{c}") for c in IDENTITY], "full").where("__old is null or __new is null")
    gone = F.col("__old").isNotNull()

    def of(one: str, other: str):
        return F.when(gone, F.col(one)).otherwise(F.col(other)).alias(one)

    change = F.when(gone, "removed").otherwise("added").alias("change")
    return both.select(*(of(c, f"__{c}") for c in IDENTITY), of("line_number", "__line"), change).orderBy("filename", "line_number")


def recover(findings: DataFrame, rescanned: DataFrame) -> DataFrame:
    """Findings with the secret's value out of a new scan of the same files that kept values."""
    # grouped by what the join is by, so values are shuffled once
    values = rescanned.groupBy("filename", "secret_hash").agg(F.collect_set("secret_value").alias("__values"))
    joined = findings.join(values, ["filename", "secret_hash"], "left")
    return joined.select(*joined.columns[:-1], F.explode_outer("__values").alias("secret_value"))


def verdicts(findings: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """(name, found): whether each detector, given as (class name, type), found anything."""
    # of literals, so that no Python worker is started for it
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in names)).cast("array<struct<name:string,type:string>>")
    registry = findings.sparkSession.range(1).select(F.inline(each))
    kinds = findings.select("type").distinct().withColumn("found", F.lit(True))
    return registry.join(kinds, "type", "left").select("name", F.coalesce("found", F.lit(False)).alias("found")).orderBy("name")
