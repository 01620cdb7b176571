"""Session helpers: the folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a Python worker gets at a time; Spark's own bound is many times that, for each worker and its task in the JVM.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):  # local-cluster is on one machine too
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="cindersift-")
    spark.conf.set(CHECKPOINT_KEY, made)
    return made


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by their bytes, unless the session says how; a longer row is a batch of its own."""
    if BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_made: list[str] = []


def made() -> int:
    """How many tables :func:`written` has left so far, a mark for :func:`drop_since`."""
    return len(_made)


def drop_since(spark: SparkSession, mark: int, but: int = 0) -> None:
    """Deletes the tables written after a mark, without the last ``but`` of them, once nothing reads them any more."""
    end = len(_made) - but
    for path in _made[mark:end]:
        _delete(spark, path)
    del _made[mark:end]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shared(df: DataFrame) -> DataFrame:
    """``df`` for a plan that uses it more than once: its last shuffle is made once and used again.

    For that its plan must be the same at each place. No filter passes the count that is put on it, and that is of all its columns.
    """
    return df.observe(f"shared-{uuid.uuid4().hex}", F.count(F.struct(*df.columns)).alias("rows"))


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`written` once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)
        _made[:] = [p for p in _made if p.removeprefix("file:").lstrip("/") != folder.removeprefix("file:").lstrip("/")]
