"""Queries of the corpus operators: name -> (spark, sf_dir) -> DataFrame, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table
from . import bpe, htmltree, linededup, media, minhash, mixing, quality, records, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark passage."""
    return topk.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page."""
    pages = _table(spark, sf_dir, "pages")
    return htmltree.extract(pages, htmltree.fit(pages))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule that mixes all sources, with the stretch of a document that each slot takes."""
    return mixing.schedule(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its probability of being good and whether it is kept."""
    scored = quality.scored(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "quality", (scored.quality >= quality.THRESHOLD).alias("keep"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, and whether they decode to its very text."""
    return bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), check=True, keep_text=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages and gaps found in archives of the pages, among which there are torn, flipped and cut records."""
    damage = {"torn": (warc.DAMAGED_EVERY, warc.TORN_AT), "flipped": (warc.DAMAGED_EVERY, warc.FLIPPED_AT), "cut": (warc.DAMAGED_EVERY, warc.CUT_AT)}
    archives = warc.write_archives(_table(spark, sf_dir, "pages"), damage=damage)
    return warc.pages_of(warc.read_archives(archives))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile and difference hash of each document drawn as an image, in seven kinds of file."""
    return media.tiles(media.pictures(_table(spark, sf_dir, "documents")))


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as a framed record, read back in shuffled order through the offset index."""
    tokens = bpe.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    folder, index = records.write_records(tokens)
    return records.read_records(folder, index, seed=1)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that repeats another nearly, with the first of its group."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line that repeats an earlier one, exactly or within a few edits, and which."""
    return linededup.repeated_lines(_table(spark, sf_dir, "documents"))


QUERIES = {"op1_topk": op1_topk, "op2_html": op2_html, "op3_mixing": op3_mixing, "op4_quality": op4_quality, "op5_bpe": op5_bpe, "op6_warc": op6_warc, "op7_media": op7_media, "op8_records": op8_records, "op9_minhash": op9_minhash, "op10_line_dedup": op10_line_dedup}

ORACLES: dict[str, str] = {"op1_topk": topk.oracle(), "op3_mixing": mixing.oracle(), "op6_warc": warc.oracle(), "op10_line_dedup": linededup.oracle()}
