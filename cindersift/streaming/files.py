"""Scans of streams: each row is a whole file, so lines and their neighbours are within it and nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scan import Scanner
from ..sources.files import texts_of


def stream_files(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(filename, text) of the files that appear in a folder."""
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return texts_of(source.option("maxFilesPerTrigger", max_files).load(folder))


def scan_stream(scanner: Scanner, files: DataFrame, filename: Column | None = None, text: str = "text", *keys: str) -> DataFrame:
    """Findings in a stream of files, as a stream; write it with ``writeStream`` in append mode."""
    return scanner.scan_table(files, F.col("filename") if filename is None else filename, text, *keys)
