"""A corpus from raw documents to tokens: each stage takes what the one before it kept, written and read again.

Defined results: a null, empty or white-space text goes in the first stage; a null id or source is one like others; of
rows that repeat an id and a text one stays; two texts with one id are two documents; an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindersift.llm import bpe, columnar, linededup, minhash, mixing, quality
from cindersift.session import drop_since, made, written
from cindersift.sources.tables import read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return quality.good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that repeat an earlier one, exactly or nearly; a document of nothing else goes."""
    return linededup.without_repeated_lines(docs, count_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one row of those that repeat an id and a text."""
    return minhash.without_copies(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of the mixing schedule; documents of sources below their weight come again in a further epoch.

    The order is that of the rows in the files, and of the files by their names.
    """
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts, with whether they decode to the very text.

    ``part`` and ``row`` say where each document stands in the schedule (file and row in it); null if docs aren't of files.
    """
    part, row = columnar.free("part", docs.columns), columnar.free("row", docs.columns)
    try:
        placed = docs.select("*", F.regexp_extract("_metadata.file_path", "part-([0-9]+)", 1).try_cast("int").alias(part), F.col("_metadata.row_index").alias(row))
    except AnalysisException:
        placed = docs.select("*", F.lit(None).cast("int").alias(part), F.lit(None).cast("bigint").alias(row))
    return bpe.encoded(placed, check=True, keep_text=False)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources", mixing_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: A fitted classifier and an edit join come first, which SQL can't express; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, f"{sf_dir}/documents.parquet")
    mark = made()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            # what the stage had written on its way, and its input, aren't read any more
            drop_since(spark, mark, but=1)
    return docs
