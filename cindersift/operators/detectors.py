"""The 27 built-in detectors: column expressions from a line (and its file's name) to an array of secrets."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import entropy as E
from ..functions import patterns as P



#: Expressions are made as SQL text: one call to the JVM for each, not one for each of their hundreds of parts.
NOTHING = "cast(array() as array<string>)"


def nothing() -> Column:
    return F.expr(NOTHING)


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(line: str, marks: list[str], low: str = "") -> str:
    """Whether a line has any of the marks; in lower case if ``low`` is the line in that."""
    seen = low or line
    return "(" + " or ".join(f"contains({seen}, {text(m)})" for m in marks) + ")"


def matches(line: str, parts: list[tuple[str, int]]) -> str:
    """All secrets of some patterns in order: the whole match, or a group where it takes part."""
    found = [f"regexp_extract_all({line}, {text(P.java(p))}, {g})" for p, g in parts]
    return f"filter({'concat(' + ', '.join(found) + ')' if len(found) > 1 else found[0]}, s -> s <> '')"


def by_rule(rule: P.Rule):
    def find(line: str, filename: str, eager: bool = True, low: str = "") -> str:
        found, lower = matches(line, rule.parts), low or f"lower({line})"
        seen = [_any(lower if rule.fold else line, rule.marks)] if rule.marks else []
        seen += [_any(lower, rule.folded)] if rule.folded else []
        return f"if({' or '.join(seen)}, {found}, {NOTHING})" if seen else found

    return find


def _jwt_valid(token: str) -> str:
    bare = "rtrim('=', p)"
    decoded = f"if(length(p) % 4 <> 1, try_to_binary(concat(translate({bare}, '-_', '+/'), repeat('=', cast(pmod(4 - length({bare}) % 4, 4) as int))), 'base64'), null)"
    fine = f"if(i < 2, is_valid_utf8(cast({decoded} as string)) and try_parse_json(cast({decoded} as string)) is not null, {decoded} is not null)"
    return f"forall(transform(split({token}, '\\\\.'), (p, i) -> {fine}), ok -> coalesce(ok, false))"


def jwt_is_valid(token: str) -> Column:
    """Every part of the token in a column decodes, and the first two are JSON in UTF-8."""
    return F.expr(_jwt_valid(token))


def _jwt(line: str, filename: str, eager: bool = True, low: str = "") -> str:
    rule = next(r for r in P.RULES if r.name == "JwtTokenDetector")
    return f"filter({by_rule(rule)(line, filename)}, t -> {_jwt_valid('t')})"


def is_private_ip(ip: Column) -> Column:
    return ip.rlike(P.PRIVATE_IP)


def _ip(line: str, filename: str, eager: bool = True, low: str = "") -> str:
    # what has a word character or a dot beside it is consumed all the same, by the second way to match
    edge = "[0-9A-Za-z_.]"
    pattern = P.java(f"(?<!{edge})((?>{P.IP}))(?!{edge})|{P.IP}")
    found = f"filter(regexp_extract_all({line}, {text(pattern)}, 1), s -> s <> '' and not s rlike {text(P.PRIVATE_IP)})"
    return f"if({line} rlike '[0-9][.][0-9]', {found}, {NOTHING})"


@dataclass(frozen=True)
class ByEntropy:
    """Strings of a charset by their entropy: those in quotes, and where none of these is above the limit, bare ones."""

    charset: str
    limit: float
    of_hex: bool

    def find(self, line: Column, eager: bool = True) -> Column:
        return E.strong_in(self.charset, self.limit, self.of_hex, eager)(line)

    @property
    def sign(self) -> str:
        """A run of the charset that is long enough for the limit; counts of RE2 end at 1000."""
        return f"[{self.charset}]{{{min(E.least_length(self.limit), 1000)}}}"


def family_sql(filename: str) -> str:
    """Which keyword rules hold for a file, by the text after its last dot."""
    cases = " ".join(f"when lower(substring_index({filename}, '.', -1)) in ({', '.join(map(text, ends))}) then '{name}'" for name, ends in P.FAMILIES.items())
    return f"(case {cases} else 'quotes' end)"


def family(filename: str) -> Column:
    return F.expr(family_sql(filename))


def _keyword(exclude: str | None = None):
    def one(line: str, pattern: str) -> str:
        found = f"nullif(regexp_extract({line}, {text(P.java(pattern))}, 1), '')"
        needs = " and ".join(f"contains({line}, {text(n)})" for n in P.NEEDS.get(pattern, []))
        return f"if({needs}, {found}, null)" if needs else found

    def find(line: str, filename: str, eager: bool = True, low: str = "") -> str:
        cases = []
        for name, groups in P.KEYWORD_GROUPS.items():
            firsts = []
            for group in groups:
                first = "coalesce(" + ", ".join(one(line, p) for p in group) + ")"
                firsts.append(f"if({line} rlike {text(P.java(P.COMPARISON))}, {first}, null)" if group is P.COMPARED else first)
            cases.append(f"when '{name}' then array_distinct(array_compact(array({', '.join(firsts)})))")
        guard = _any(line, P.KEYWORD_MARKS, low or f"lower({line})")
        if exclude:
            guard += f" and not {line} rlike {text(P.java('(?i)' + exclude))}"
        return f"if({guard}, case {family_sql(filename)} {' '.join(cases)} end, {NOTHING})"

    return find


class Verified(IntEnum):
    """What is known of a secret from elsewhere."""

    FALSE = 1
    UNVERIFIED = 2
    TRUE = 3


@dataclass(frozen=True)
class Detector:
    """A detector with its parameters. ``sql(line, filename, eager, low)`` is, for columns of those names, an array of secrets
    (``low`` may name the line in lower case); one by entropy has ``entropy`` instead, and a custom one ``column``, which
    takes and makes columns. ``sign`` is what lines have that it finds something in (see ``P.SIGNS``), None if that isn't known."""

    name: str
    kind: str
    sql: Any
    params: dict
    column: Any = None
    entropy: ByEntropy | None = None
    sign: str | None = None

    def find(self, line: str = "line", filename: str = "filename", eager: bool = True) -> Column:
        if self.entropy:
            return self.entropy.find(F.col(line), eager)
        return self.column(F.col(line), F.col(filename), eager) if self.column else F.expr(self.sql(line, filename, eager))

    @property
    def by_pattern(self) -> bool:
        return "High Entropy" not in self.kind and self.kind != P.KEYWORD_KIND


    def verify(self, secret: str) -> Verified:
        """Nothing is asked over a network, so no secret is verified."""
        return Verified.UNVERIFIED

    def json(self) -> dict[str, Any]:
        """Its name and its parameters, those that it has by default too."""
        return {"name": self.name} | DEFAULTS.get(self.name, {}) | self.params


#: Parameters that a detector has when none are given.
DEFAULTS: dict[str, dict[str, Any]] = {P.BASE64_NAME: {"limit": P.BASE64_LIMIT}, P.HEX_NAME: {"limit": P.HEX_LIMIT}, P.KEYWORD_NAME: {"keyword_exclude": ""}}
KINDS = {r.name: r.kind for r in P.RULES} | {P.IP_NAME: P.IP_KIND, P.BASE64_NAME: P.BASE64_KIND, P.HEX_NAME: P.HEX_KIND, P.KEYWORD_NAME: P.KEYWORD_KIND}
ALIASES = {"IPPublicDetector": P.IP_NAME}
#: Custom detectors by class name, see :mod:`cindersift.operators.custom`.
CUSTOM: dict[str, Any] = {}


def detector(name: str, **params: Any) -> Detector:
    """The detector of a class name. KeyError for an unknown one."""
    name = ALIASES.get(name, name)
    if name in CUSTOM:
        return CUSTOM[name](**params)
    kind = KINDS[name]
    if name == P.BASE64_NAME:
        by = ByEntropy(P.BASE64, float(params.get("limit", P.BASE64_LIMIT)), False)
        return Detector(name, kind, None, params, entropy=by, sign=by.sign)
    if name == P.HEX_NAME:
        by = ByEntropy(P.HEX, float(params.get("limit", P.HEX_LIMIT)), True)
        return Detector(name, kind, None, params, entropy=by, sign=by.sign)
    if name == P.IP_NAME:
        find = _ip
    elif name == P.KEYWORD_NAME:
        find = _keyword(params.get("keyword_exclude") or None)
    elif name == "JwtTokenDetector":
        find = _jwt
    else:
        find = by_rule(next(r for r in P.RULES if r.name == name))
    return Detector(name, kind, find, params, sign=P.SIGNS[name])


def sign_of(detectors: list[Detector]) -> str | None:
    """What lines have that any of these detectors finds something in; None where all lines must be looked at."""
    signs = [d.sign for d in detectors]
    return None if None in signs else "|".join(dict.fromkeys([*signs, P.FOLDED]))


def regex_detector(kind: str, patterns: list[tuple[str, int]] | list[str]) -> Detector:
    """A detector of one's own by patterns; a pattern alone yields its first group, or the match if it has none."""
    import re

    parts = [p if isinstance(p, tuple) else (p, min(re.compile(p).groups, 1)) for p in patterns]
    return Detector(kind, kind, lambda line, filename, eager=True, low="": matches(line, parts), {})


def secrets(lines: DataFrame, detectors: list[Detector], eager: bool = True) -> DataFrame:
    """Lines (filename, line, ...) to a row for each secret: type, secret and by_pattern beside the input's columns.

    Detectors by entropy take many lines at once. What was found is worked out before lines are exploded to it, so that this
    is compiled code but for the patterns of lines that have their marks; lines without any secret end there.
    """
    kept, rows, entries = lines.columns, lines.withColumn("__low", F.lower("line")), []
    nothing = "cast(array() as array<struct<type:string,secret:string,by_pattern:boolean>>)"
    for i, d in enumerate(detectors):
        found = d.find("line", "filename", eager) if d.entropy or d.column else F.expr(d.sql("line", "filename", eager, "__low"))
        rows = rows.withColumn(f"__found{i}", found)
        entries.append(f"if(size(__found{i}) > 0, transform(__found{i}, s -> named_struct('type', {text(d.kind)}, 'secret', s, 'by_pattern', {str(d.by_pattern).lower()})), {nothing})")
    found = rows.select(*kept, F.expr(f"concat({', '.join([nothing, *entries])})").alias("__f"))
    # not the column alone: for that a filter would be inferred, in which all detectors run once more
    return found.select(*kept, F.explode(F.expr(f"if(size(__f) > 0, __f, {nothing})")).alias("__s")).select(*kept, "__s.*")


def names() -> list[str]:
    """Class names of all detectors, sorted."""
    return sorted([*KINDS, *CUSTOM], key=str.lower)


def kind_to_name() -> dict[str, str]:
    return {kind: name for name, kind in KINDS.items()} | {getattr(c, "kind", n): n for n, c in CUSTOM.items()}
