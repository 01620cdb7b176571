"""Tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than cores and no more than this for each core is dealt out to all cores.
SPREAD_BYTES = 128 << 20


def spread(table: DataFrame) -> DataFrame:
    """The table over all cores, where it has too few files for that.

    A small file of one row group is one task, whatever its size; larger tables come in enough splits and stay as they are.
    """
    cores, files = table.sparkSession.sparkContext.defaultParallelism, table.inputFiles()
    if table.isStreaming or not files or len(files) >= cores:
        return table
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size <= cores * SPREAD_BYTES else table


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A table, or some of its columns, over all cores."""
    table = spark.read.parquet(path)
    return spread(table.select(*columns) if columns else table)
