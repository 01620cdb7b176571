"""Redaction: patterns replaced one after the other, each in what the last has left."""

from __future__ import annotations

import logging
import re
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import REDACTIONS, java, wrong

_log = logging.getLogger(__name__)


def valid_rules(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The rules whose pattern is one; others are skipped with a warning."""
    kept = []
    for pattern, placeholder in rules:
        if error := wrong(pattern):
            _log.warning("redaction pattern %r is skipped: %s", pattern, error)
        else:
            kept.append((pattern, placeholder))
    return kept


def redact(text: Column, rules: list[tuple[str, str]] | None = None, enabled: bool = True) -> Column:
    for pattern, placeholder in valid_rules(REDACTIONS if rules is None else rules) if enabled else []:
        text = F.regexp_replace(text, java(pattern), placeholder)
    return text


def with_session(text: Column, session: str | None) -> Column:
    """What is logged in a session begins with its id, unless it is blank."""
    return text if session is None else F.when(F.trim(text) != "", F.concat(F.lit(f"[{session}] "), text)).otherwise(text)


def write_redacted(table: DataFrame, column: str, path: str, rules: list[tuple[str, str]] | None = None, session: str | None = None, mode: str = "append") -> None:
    """Writes a table as Parquet with one column redacted on its way."""
    table.withColumn(column, with_session(redact(F.col(column), rules), session)).write.mode(mode).parquet(path)


class RedactingWriter:
    """A text sink for the driver's log: each write is redacted, and begins with the session's id unless it is blank."""

    def __init__(self, sink: TextIO, rules: list[tuple[str, str]] | None = None, session: str | None = None, enabled: bool = True):
        self.sink, self.session = sink, session
        self.rules = [(re.compile(p), r.replace("\\", "\\\\")) for p, r in valid_rules(REDACTIONS if rules is None else rules)] if enabled else []

    def write(self, text: str) -> int:
        for pattern, placeholder in self.rules:
            text = pattern.sub(placeholder, text)
        return self.sink.write(f"[{self.session}] {text}" if self.session is not None and text.strip() else text)

    def flush(self) -> None:
        self.sink.flush()
