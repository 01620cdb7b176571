"""The built-in filters: predicates that exclude a file, a line or a secret."""

from __future__ import annotations

import functools
import hashlib
import operator
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import patterns as P


def _or(parts: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, parts, F.lit(False))


def compiled(patterns: Iterable[str]) -> list[str]:
    """The patterns, each checked here rather than in a task. ValueError for the first that isn't one."""
    out = list(patterns)
    for p in out:
        if wrong := P.wrong(p):
            raise ValueError(f"not a pattern: {p!r}: {wrong}")
    return out


def base(filename: Column) -> Column:
    return F.element_at(F.split(filename, "/"), -1)


def is_non_text_file(filename: Column) -> Column:
    # what follows the last dot first, which needs no pattern and is another for most names
    tail = F.substring_index(filename, ".", -1).isin([e[1:] for e in P.NOT_TEXT])
    return tail & F.regexp_extract(base(filename), "^.+(\\.[^.]*)$", 1).isin(P.NOT_TEXT)


def is_lock_file(filename: Column) -> Column:
    return base(filename).isin(P.LOCKS)


def is_swagger_file(filename: Column) -> Column:
    return filename.contains("swagger")


def matches_any(value: Column, patterns: Iterable[str]) -> Column:
    """Any of the user's patterns is found: for files, lines and secrets alike."""
    return _or(value.rlike(P.java(p)) for p in compiled(patterns))


should_exclude_file = should_exclude_line = should_exclude_secret = matches_any


def is_indirect_reference(line: Column) -> Column:
    return (F.octet_length(line) <= P.INDIRECT_BYTES) & line.rlike(P.java(P.INDIRECT))


def is_line_allowlisted(filename: Column, line: Column, previous: Column) -> Column:
    def said(styles: list[tuple[str, str]]) -> Column:
        own = _or(line.rlike(P.java(P.allowlist(*s, False))) for s in styles)
        above = _or(previous.rlike(P.java(P.allowlist(*s, True))) for s in styles)
        return (line.contains("pragma") & own) | (previous.contains("nextline") & above)

    yaml = F.regexp_extract(base(filename), "^.+(\\.[^.]*)$", 1).isin(".yaml", ".yml")
    return F.when(yaml, said(P.COMMENTS[:1])).otherwise(said(P.COMMENTS))


def is_sequential_string(secret: Column) -> Column:
    # all sequences at once, which a secret with what is between them isn't in; the upper case is made once
    return F.lit("\n".join(P.SEQUENCES)).contains(F.upper(secret)) & ~secret.contains("\n")


def is_potential_uuid(secret: Column) -> Column:
    return secret.rlike(P.java(P.UUID))


def is_likely_id_string(secret: Column, line: Column, by_pattern: Column | bool = False) -> Column:
    at = F.instr(line, secret)
    found = (at > 0) & F.substring(line, F.lit(1), at - 1).rlike(P.java(P.ID_BEFORE))
    return found & ~(by_pattern if isinstance(by_pattern, Column) else F.lit(by_pattern))


def is_templated_secret(secret: Column) -> Column:
    pairs = _or(secret.startswith(a) & secret.endswith(b) for a, b in (("{", "}"), ("<", ">"), ("${", "}")))
    return (F.octet_length(secret) <= 1) | pairs


def is_prefixed_with_dollar_sign(secret: Column) -> Column:
    return secret.startswith("$")


def is_not_alphanumeric_string(secret: Column) -> Column:
    return ~secret.rlike("[A-Za-z]")


class Wordlist:
    """Words that no secret contains; ASCII case doesn't matter. ``digest`` is the SHA-1 of the file."""

    MAX_WORDS = 100_000

    def __init__(self, path: str, min_length: int = 3):
        data = Path(path).read_bytes()
        self.path, self.min_length, self.digest = path, min_length, hashlib.sha1(data).hexdigest()
        words = (w.strip().lower() for w in data.decode("utf-8").splitlines())
        self.words = sorted({w for w in words if len(w.encode()) >= min_length})
        if len(self.words) > self.MAX_WORDS:
            raise ValueError(f"{path} has more than {self.MAX_WORDS} words")

    def excludes(self, secret: Column) -> Column:
        """One alternation of literal words, tried at each place."""
        return secret.rlike("(?i)" + "|".join(f"\\Q{w}\\E" for w in self.words)) if self.words else F.lit(False)


FILE = {"is_non_text_file": is_non_text_file, "is_lock_file": is_lock_file, "is_swagger_file": is_swagger_file}
SECRET = {"is_sequential_string": is_sequential_string, "is_potential_uuid": is_potential_uuid, "is_templated_secret": is_templated_secret, "is_prefixed_with_dollar_sign": is_prefixed_with_dollar_sign, "is_not_alphanumeric_string": is_not_alphanumeric_string}
#: What each filter takes, which says in which phase it runs.
PARAMETERS = (
    {name: {"filename"} for name in (*FILE, "is_invalid_file", "regex.should_exclude_file")}
    | {"is_line_allowlisted": {"filename", "line", "context"}, "is_indirect_reference": {"line"}, "regex.should_exclude_line": {"line"}}
    | {name: {"secret"} for name in (*SECRET, "regex.should_exclude_secret", "wordlist.should_exclude_secret")}
    | {"is_likely_id_string": {"secret", "line", "plugin"}}
)


def with_parameters(*wanted: str) -> list[str]:
    """The filters that take all of these parameters."""
    return sorted(name for name, takes in PARAMETERS.items() if set(wanted) <= takes)
