"""Files to scan: which there are, and their texts."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts of so many characters go on together.
BATCH_CHARS = 1 << 21
#: And so many names.
BATCH_NAMES = 1 << 14


def walk(folder: str) -> Iterator[str]:
    """All files below a folder, but none below one whose name begins with a dot. What can't be read is passed over."""
    for place, folders, names in os.walk(folder):
        folders[:] = sorted(f for f in folders if not f.startswith("."))
        yield from (os.path.join(place, n) for n in names if os.path.isfile(os.path.join(place, n)))


def tracked(folder: str) -> list[str]:
    """The files that git tracks in a folder; all of them where git can't say."""
    try:
        found = subprocess.run(["git", "ls-files", "-z"], cwd=folder, capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return list(walk(folder))
    return [p for n in found.decode("utf-8", "surrogateescape").split("\0") if n and os.path.isfile(p := os.path.join(folder, n))]


def relative(path: str, root: str) -> str:
    """The path below root; as an absolute one if it isn't."""
    whole, base = os.path.abspath(os.path.join(root, path)), os.path.abspath(root)
    return os.path.relpath(whole, base) if os.path.commonpath([whole, base]) == base else whole


def files_to_scan(paths: Iterable[str] = (), all_files: bool = False, root: str = ".") -> list[str]:
    """Sorted and distinct: files as given, folders by what git tracks or by all their files; without paths the root."""
    found: set[str] = set()
    for given in list(paths) or [root]:
        path = os.path.join(root, given)
        if os.path.isfile(path):
            found.add(relative(path, root))
        elif os.path.isdir(path):
            found.update(relative(p, root) for p in (walk(path) if all_files else tracked(path)))
    return sorted(found)


def _folders(root: str, wanted: int) -> list[tuple[str, bool]]:
    """About as many folders as wanted that are to be walked, and (False) those above them, of which only their own files are."""
    whole, above = [root], []
    while whole and len(whole) < wanted:
        found = []
        for folder in whole:
            above.append((folder, False))
            try:
                with os.scandir(folder) as entries:
                    found += sorted(e.path for e in entries if not e.name.startswith(".") and e.is_dir(follow_symlinks=False))
            except OSError:
                continue
        whole = found
    return above + [(folder, True) for folder in whole]


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(filename) of all files below root, as :func:`files_to_scan` finds them, but walked by tasks and never listed on the driver.

    In no order, and spread evenly whatever the folders hold. Names that aren't UTF-8, which no column can have, are passed over.
    """
    base = os.path.abspath(root)
    tasks = 4 * spark.sparkContext.defaultParallelism

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[str] = []
        for folder, deep in ((f, d) for batch in batches for f, d in zip(batch["folder"], batch["deep"])):
            if deep:
                paths = walk(folder)
            else:
                paths = (p for n in (os.listdir(folder) if os.access(folder, os.R_OK) else []) if os.path.isfile(p := os.path.join(folder, n)))
            for path in paths:
                try:
                    path.encode()
                except UnicodeEncodeError:
                    continue
                found.append(os.path.relpath(path, base))
                if len(found) == BATCH_NAMES:
                    yield pd.DataFrame({"filename": found})
                    found = []
        yield pd.DataFrame({"filename": pd.Series(found, dtype=object)})

    folders = spark.createDataFrame(_folders(base, tasks), "folder string, deep boolean").repartition(tasks)
    return folders.mapInPandas(names, "filename string").repartition(tasks)


def is_valid_file(root: str):
    @F.pandas_udf("boolean")
    def valid(names: pd.Series) -> pd.Series:
        return names.map(lambda n: os.path.isfile(os.path.join(root, n))).astype(bool)

    return valid


def read_texts(names: DataFrame, root: str = ".") -> DataFrame:
    """(filename, text) of files that tasks can read by path; what isn't there or isn't UTF-8 has no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[str, str]] = []
        size = 0
        for name in (n for batch in batches for n in batch["filename"]):
            try:
                with open(os.path.join(root, name), "rb") as f:
                    found.append((name, f.read().decode("utf-8")))
            except (OSError, UnicodeDecodeError):
                continue
            size += len(found[-1][1])
            if size > BATCH_CHARS:
                yield pd.DataFrame(found, columns=["filename", "text"])
                found, size = [], 0
        yield pd.DataFrame(found, columns=["filename", "text"])

    return names.select("filename").mapInPandas(read, "filename string, text string")


def texts_of(binary_files: DataFrame, path: Column | None = None) -> DataFrame:
    """(filename, text) of a ``binaryFile`` source, for files in any storage that Spark reads; without what isn't UTF-8."""
    text = F.col("content").cast("string")
    return binary_files.where(F.is_valid_utf8(text)).select((path if path is not None else F.col("path")).alias("filename"), text.alias("text"))
