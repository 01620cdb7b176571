"""The same operators in DuckDB's SQL, for checks side by side."""

from __future__ import annotations

from .functions import patterns as P
from .operators import detectors as D


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return lit(P.re2(pattern))


def _entropy(v: str, of_hex: bool) -> str:
    plain = f"list_sum(list_transform(list_distinct(string_split({v}, '')), lambda k: -((length({v}) - length(replace({v}, k, ''))) / length({v})::DOUBLE) * log2((length({v}) - length(replace({v}, k, ''))) / length({v})::DOUBLE)))"
    if not of_hex:
        return plain
    return f"({plain} - CASE WHEN length({v}) > 1 AND regexp_full_match({v}, '[0-9]+') THEN 1.2 / log2(length({v})::DOUBLE) ELSE 0 END)"


def _all(parts: list[tuple[str, int]]) -> str:
    lists = ", ".join(f"regexp_extract_all(line, {rx(p)}, {g})" for p, g in parts)
    return f"list_filter(list_concat({lists}), lambda s: s <> '')" if len(parts) > 1 else f"list_filter({lists}, lambda s: s <> '')"


def family_sql() -> str:
    cases = " ".join(f"WHEN list_contains([{', '.join(map(lit, ends))}], lower(split_part(filename, '.', -1))) THEN '{name}'" for name, ends in P.FAMILIES.items())
    return f"CASE {cases} ELSE 'quotes' END"


def detect(name: str) -> str:
    """A list of secrets of ``line`` in ``filename``."""
    if name == P.IP_NAME:
        edge = "([0-9A-Za-z_.]??)"
        p = lit(edge + f"({P.re2(P.IP)})" + edge.replace("??", "?"))
        found = f"list_zip(regexp_extract_all(line, {p}, 1), regexp_extract_all(line, {p}, 2), regexp_extract_all(line, {p}, 3))"
        return f"list_transform(list_filter({found}, lambda x: coalesce(x[1], '') = '' AND coalesce(x[3], '') = '' AND NOT regexp_matches(x[2], {lit(P.PRIVATE_IP)})), lambda x: x[2])"
    if name in (P.BASE64_NAME, P.HEX_NAME):
        of_hex = name == P.HEX_NAME
        charset, limit, least = (P.HEX, 3.0, 9) if of_hex else (P.BASE64, 4.5, 23)

        def strong(found: str) -> str:
            return f"list_filter({found}, lambda v: length(v) >= {least} AND round({_entropy('v', of_hex)}, 12) > {limit})"

        quotes = ", ".join(f"regexp_extract_all(line, {lit(q + '([' + charset + ']+)' + q)}, 1)" for q in "\"'")
        quoted = strong(f"list_concat({quotes})")
        bare = strong(f"regexp_extract_all(line, {lit('[' + charset + ']{' + str(least) + ',}')})")
        return f"CASE WHEN len({quoted}) > 0 THEN {quoted} ELSE {bare} END"
    if name == P.KEYWORD_NAME:
        cases = []
        for family, groups in P.KEYWORD_GROUPS.items():
            firsts = ", ".join("coalesce(" + ", ".join(f"nullif(regexp_extract(line, {rx(p)}, 1), '')" for p in group) + ")" for group in groups)
            cases.append(f"WHEN '{family}' THEN list_distinct([{firsts}])")
        return f"CASE {family_sql()} {' '.join(cases)} END"
    found = _all(next(r for r in P.RULES if r.name == name).parts)
    return f"list_filter({found}, lambda t: {_json_part('t', 1)} AND {_json_part('t', 2)})" if name == "JwtTokenDetector" else found


def _json_part(token: str, k: int) -> str:
    """Part k of a token decodes, to JSON of ASCII; a blob as text has its quotes as \\x22."""
    part = f"split_part({token}, '.', {k})"
    bare = f"rtrim({part}, '=')"
    blob = f"from_base64(concat(translate({bare}, '-_', '+/'), repeat('=', CAST((4 - length({bare}) % 4) % 4 AS BIGINT))))"
    return f"CASE WHEN length({part}) % 4 <> 1 AND length({bare}) % 4 <> 1 AND regexp_full_match({bare}, '[-_0-9A-Za-z]*') THEN json_valid(replace(CAST({blob} AS VARCHAR), '\\x22', '\"')) ELSE FALSE END"


def _any(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


_BASE = "split_part(filename, '/', -1)"
_ENDING = f"regexp_extract({_BASE}, '^.+(\\.[^.]*)$', 1)"


def _allowlisted() -> str:
    def said(styles: list[tuple[str, str]]) -> str:
        return _any([f"regexp_matches(line, {rx(P.allowlist(*s, False))})" for s in styles] + [f"regexp_matches(previous, {rx(P.allowlist(*s, True))})" for s in styles])

    return f"CASE WHEN {_ENDING} IN ('.yaml', '.yml') THEN {said(P.COMMENTS[:1])} ELSE {said(P.COMMENTS)} END"


FILTERS = {
    "is_non_text_file": f"{_ENDING} IN ({', '.join(map(lit, P.NOT_TEXT))})",
    "is_lock_file": f"{_BASE} IN ({', '.join(map(lit, P.LOCKS))})",
    "is_swagger_file": "contains(filename, 'swagger')",
    "is_indirect_reference": f"(strlen(line) <= {P.INDIRECT_BYTES} AND regexp_matches(line, {rx(P.INDIRECT)}))",
    "is_line_allowlisted": _allowlisted(),
    "is_sequential_string": _any([f"contains({lit(s)}, upper(secret))" for s in P.SEQUENCES]),
    "is_potential_uuid": f"regexp_matches(secret, {rx(P.UUID)})",
    "is_likely_id_string": f"(instr(line, secret) > 0 AND regexp_matches(substr(line, 1, instr(line, secret) - 1), {rx(P.ID_BEFORE)}))",
    "is_templated_secret": "(strlen(secret) <= 1 OR (starts_with(secret, '{') AND ends_with(secret, '}')) OR (starts_with(secret, '<') AND ends_with(secret, '>')) OR (starts_with(secret, '${') AND ends_with(secret, '}')))",
    "is_prefixed_with_dollar_sign": "starts_with(secret, '$')",
    "is_not_alphanumeric_string": "NOT regexp_matches(secret, '[A-Za-z]')",
}


def matches_any(column: str, patterns: list[str]) -> str:
    return _any([f"regexp_matches({column}, {rx(p)})" for p in patterns])


def lines(table: str, keys: str, filename: str, text: str) -> str:
    """CTE ``lines`` of a table's texts."""
    cut = f"regexp_split_to_array({text}, '\\r?\\n')"
    return f"""lines AS MATERIALIZED (SELECT {keys}, filename, i AS line_number, ls[i] AS line, CASE WHEN i = 1 THEN '' ELSE ls[i - 1] END AS previous
  FROM (SELECT {keys}, filename, ls, unnest(range(1, len(ls) + 1)) AS i FROM
    (SELECT {keys}, filename, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM (SELECT {keys}, {filename} AS filename, {cut} AS ls FROM {table}))))"""


def scan(source: str, keys: str, names: list[str] | None = None, filtered: bool = True, line_filters: bool = True) -> str:
    """CTE ``found`` (keys, filename, line_number, line, type, secret) in what ``source`` names: a table of lines."""
    on = FILTERS if filtered else {}
    where = " AND ".join(["TRUE"] + [f"NOT ({on[n]})" for n in ("is_non_text_file", "is_lock_file", "is_swagger_file", "is_line_allowlisted", "is_indirect_reference") if n in on and line_filters])
    each = "\n  UNION ALL ".join(f"SELECT {keys}, filename, line_number, line, '{D.KINDS[n]}' AS type, {str(n not in (P.BASE64_NAME, P.HEX_NAME, P.KEYWORD_NAME)).upper()} AS by_pattern, unnest({detect(n)}) AS secret FROM kept" for n in names or list(D.KINDS))
    bad = [on[n] for n in ("is_sequential_string", "is_potential_uuid", "is_templated_secret", "is_prefixed_with_dollar_sign", "is_not_alphanumeric_string") if n in on]
    if filtered:
        bad.append(f"(NOT by_pattern AND {on['is_likely_id_string']})")
    keep = " AND ".join(["secret IS NOT NULL", "secret <> ''", *(f"NOT ({b})" for b in bad)])
    return f"kept AS MATERIALIZED (SELECT * FROM {source} WHERE {where}),\nfound AS MATERIALIZED (SELECT * FROM ({each}) WHERE {keep})"
