"""The scan plan: file filters, lines, line filters, detectors, secret filters, hashes. No shuffle in all of it."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import custom
from ..operators import detectors as D
from ..operators import diff as diffs
from ..operators import filters as T
from ..operators.lines import lines_of
from ..settings import Settings, get_settings, patterns_of, short
from ..sources import files as sources

ADHOC = "adhoc-line-scan"
FINDING = "type string, filename string, secret_hash string, line_number bigint, is_secret boolean, is_verified boolean"


def _or(parts: list[Column]) -> Column:
    return functools.reduce(operator.or_, parts, F.lit(False))


class Scanner:
    """Plans scans under given settings. Results are DataFrames of findings; nothing runs before they are used."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, keep_value: bool = False):
        self.spark, self.settings, self.keep_value = spark, settings or get_settings(), keep_value

    # filters by phase ---------------------------------------------------------------------------------------------
    def _words(self) -> T.Wordlist | None:
        params = self.settings.filters.get("wordlist.should_exclude_secret")
        return T.Wordlist(params.get("file_name", params.get("wordlist")), params.get("min_length", 3)) if params else None

    def excluded_file(self, filename: Column) -> Column:
        on = self.settings.filters
        parts = [f(filename) for n, f in T.FILE.items() if n in on]
        if "regex.should_exclude_file" in on:
            parts.append(T.should_exclude_file(filename, patterns_of(on["regex.should_exclude_file"])))
        parts += [f(filename=filename) for f in custom.filters("file", on)]
        return _or(parts)

    def excluded_line(self, filename: Column, line: Column, previous: Column) -> Column:
        on, parts = self.settings.filters, []
        if "is_line_allowlisted" in on:
            parts.append(T.is_line_allowlisted(filename, line, previous))
        if "is_indirect_reference" in on:
            parts.append(T.is_indirect_reference(line))
        if "regex.should_exclude_line" in on:
            parts.append(T.should_exclude_line(line, patterns_of(on["regex.should_exclude_line"])))
        parts += [f(filename=filename, line=line) for f in custom.filters("line", on)]
        return _or(parts)

    def excluded_secret(self, secret: Column, line: Column, by_pattern: Column) -> Column:
        on = self.settings.filters
        parts = [f(secret) for n, f in T.SECRET.items() if n in on]
        if "is_likely_id_string" in on:
            parts.append(T.is_likely_id_string(secret, line, by_pattern))
        if "regex.should_exclude_secret" in on:
            parts.append(T.should_exclude_secret(secret, patterns_of(on["regex.should_exclude_secret"])))
        if words := self._words():
            parts.append(words.excludes(secret))
        parts += [f(secret=secret) for f in custom.filters("secret", on)]
        return _or(parts)

    # plan ---------------------------------------------------------------------------------------------------------
    def detect(self, lines: DataFrame, eager: bool = True) -> DataFrame:
        """Lines (filename, line, ...) to a row for each candidate: type, secret and by_pattern beside the input's columns."""
        return D.secrets(lines, self.settings.detectors(), eager)

    @property
    def sign(self) -> str | None:
        """What a line has if anything is found in it, for :func:`lines_of`."""
        return D.sign_of(self.settings.detectors())

    def _secrets(self, candidates: DataFrame) -> DataFrame:
        real = (F.col("secret") == "") | ~self.excluded_secret(F.col("secret"), F.col("line"), F.col("by_pattern"))
        return candidates.where(real)

    def _findings(self, candidates: DataFrame, *keys: str) -> DataFrame:
        value = [F.col("secret").alias("secret_value")] if self.keep_value else []
        return candidates.select(*keys, "type", "filename", F.sha1("secret").alias("secret_hash"), "line_number", F.lit(None).cast("boolean").alias("is_secret"), F.lit(False).alias("is_verified"), *value)

    def scan_table(self, table: DataFrame, filename: Column, text: str = "text", *keys: str) -> DataFrame:
        """Findings in the texts of a table, one row being one file; ``keys`` are carried along."""
        files = table.select(*keys, filename.alias("filename"), F.col(text).alias("text")).where(~self.excluded_file(F.col("filename")))
        lines = lines_of(files, sign=self.sign).where(~self.excluded_line(F.col("filename"), F.col("line"), F.col("previous")))
        return self._findings(self._secrets(self.detect(lines)), *keys)

    def scan_files(self, paths: list[str] | DataFrame, root: str = ".") -> DataFrame:
        """Findings in files on disk, by a list of names or a table of different ones (filename). File filters run on the names, before anything is read."""
        names = paths if isinstance(paths, DataFrame) else self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "filename string")
        if any(short(n) == "is_invalid_file" for n in self.settings.filters):
            names = names.where(sources.is_valid_file(root)(F.col("filename")))
        kept = names.where(~self.excluded_file(F.col("filename")))
        read = sources.read_texts(kept, root)
        lines = lines_of(read, sign=self.sign).where(~self.excluded_line(F.col("filename"), F.col("line"), F.col("previous")))
        return self._findings(self._secrets(self.detect(lines)))

    def scan_file(self, path: str, root: str = ".") -> DataFrame:
        return self.scan_files([path], root)

    def scan_line(self, line: str) -> DataFrame:
        """Findings in one line given ad hoc: only secret filters hold, and the line has number 0."""
        row = self.spark.createDataFrame([(ADHOC, 0, line)], "filename string, line_number bigint, line string")
        return self._findings(self._secrets(self.detect(row)))

    def scan_diffs(self, table: DataFrame, diff: str = "diff", key: str = "diff_id") -> DataFrame:
        """Findings in the lines that unified diffs add; the line before is the added line before."""
        added = diffs.added_lines(table, diff, key).where(~self.excluded_file(F.col("filename")))
        kept = added.where(~self.excluded_line(F.col("filename"), F.col("line"), F.col("previous")))
        return self._findings(self._secrets(self.detect(kept)), key)

    def scan_diff(self, text: str) -> DataFrame:
        return self.scan_diffs(self.spark.createDataFrame([(0, text)], "diff_id bigint, diff string")).drop("diff_id")
