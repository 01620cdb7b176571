"""Queries of the scanner and its collections, each with DuckDB's SQL for the same rows."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from . import planted
from .functions import entropy as E
from .functions import patterns as P
from . import baseline
from .operators import audit, collection, custom, diff, filters, redact
from .operators import detectors as D
from .operators.lines import lines_of, with_context
from .plans.scan import Scanner
from .session import fresh_path, shared, written
from .settings import Settings, transient_settings
from .sources.files import files_below
from .sources.tables import read_table
from .streaming.files import scan_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _docs(spark: SparkSession, sf: str, name: str = "documents") -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def _add(name: str, sql: str | None):
    def register(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return register


# detectors ------------------------------------------------------------------------------------------------------------
def _detector(name: str, family: str | None = None) -> None:
    where = f" WHERE {O.family_sql()} = '{family}'" if family else ""
    label = f"keyword_{family}" if family else name
    sql = f"WITH {planted.lines_sql()} SELECT * FROM (SELECT doc_id, template, unnest({O.detect(name)}) AS secret FROM planted{where}) WHERE secret IS NOT NULL"

    @_add(f"det_{label}", sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        lines = planted.lines(_docs(spark, sf))
        if family:
            lines = lines.where(D.family("filename") == family)
        return D.secrets(lines, [D.detector(name)]).select("doc_id", "template", "secret")


for _name in D.KINDS:
    if _name != P.KEYWORD_NAME:
        _detector(_name)
for _family in P.KEYWORD_GROUPS:
    _detector(P.KEYWORD_NAME, _family)


# filters --------------------------------------------------------------------------------------------------------------
_SKIP_FILES, _SKIP_LINES, _SKIP_SECRETS = ["^test/", "notes"], ["^skip this", "not said"], ["^MyPass", "[A-F]{3}"]
_WORDS = ["password", "abc"]


def _filter(name: str, sql: str, column: Callable[[], F.Column]) -> None:
    @_add(f"filter_{name}", f"WITH {planted.candidates_sql()} SELECT doc_id, item FROM c WHERE {sql}")
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return planted.candidates(_docs(spark, sf)).where(column()).select("doc_id", "item")


for _name, _on in (*filters.FILE.items(), *filters.SECRET.items()):
    _filter(_name, O.FILTERS[_name], lambda f=_on, c="filename" if _name in filters.FILE else "secret": f(F.col(c)))
_filter("is_likely_id_string", O.FILTERS["is_likely_id_string"], lambda: filters.is_likely_id_string(F.col("secret"), F.col("line")))
_filter("is_indirect_reference", O.FILTERS["is_indirect_reference"], lambda: filters.is_indirect_reference(F.col("line")))
_filter("should_exclude_file", O.matches_any("filename", _SKIP_FILES), lambda: filters.should_exclude_file(F.col("filename"), _SKIP_FILES))
_filter("should_exclude_line", O.matches_any("line", _SKIP_LINES), lambda: filters.should_exclude_line(F.col("line"), _SKIP_LINES))
_filter("should_exclude_secret", O.matches_any("secret", _SKIP_SECRETS), lambda: filters.should_exclude_secret(F.col("secret"), _SKIP_SECRETS))


@_add("filter_wordlist", f"WITH {planted.candidates_sql()} SELECT doc_id, item FROM c WHERE " + " OR ".join(f"contains(lower(secret), '{w}')" for w in _WORDS))
def filter_wordlist(spark: SparkSession, sf: str) -> DataFrame:
    with tempfile.NamedTemporaryFile("w", suffix=".txt") as file:
        file.write("\n".join([*_WORDS, "Password ", "hi"]))
        file.flush()
        words = filters.Wordlist(file.name)
    return planted.candidates(_docs(spark, sf)).where(words.excludes(F.col("secret"))).select("doc_id", "item")


_PRAGMA_SQL = ", ".join(f"{{'item': {i}, 'line': {O.lit('x = 1 ' + s)}, 'previous': '', 'filename': '{n}'}}, {{'item': {100 + i}, 'line': 'x = 1', 'previous': {O.lit(p)}, 'filename': '{n}'}}" for i, (s, p, n) in enumerate(planted.PRAGMAS))


@_add("filter_is_line_allowlisted", f"WITH c AS (SELECT doc_id, unnest([{_PRAGMA_SQL}]) AS x FROM documents), d AS (SELECT doc_id, x.item AS item, x.line AS line, x.previous AS previous, x.filename AS filename FROM c) SELECT doc_id, item FROM d WHERE {O.FILTERS['is_line_allowlisted']}")
def filter_is_line_allowlisted(spark: SparkSession, sf: str) -> DataFrame:
    each = []
    for i, (own, before, name) in enumerate(planted.PRAGMAS):
        for item, line, previous in ((i, "x = 1 " + own, ""), (100 + i, "x = 1", before)):
            each.append(F.struct(F.lit(item).alias("item"), F.lit(line).alias("line"), F.lit(previous).alias("previous"), F.lit(name).alias("filename")))
    rows = _docs(spark, sf).select("doc_id", F.explode(F.array(*each)).alias("x")).select("doc_id", "x.*")
    return rows.where(filters.is_line_allowlisted(F.col("filename"), F.col("line"), F.col("previous"))).select("doc_id", "item")


# entropy --------------------------------------------------------------------------------------------------------------
def _entropy(name: str, of_hex: bool, measure) -> None:
    value = "CAST(123456789 + doc_id * 7 AS VARCHAR)" if of_hex else "to_base64(unhex(concat(h,g)))"
    e = O._entropy("v", of_hex)
    sql = f"WITH {planted._WITH}, v AS (SELECT doc_id, unnest([h, {value}]) AS v FROM h) SELECT doc_id, v AS value, CAST(round({e} * 1e9::DOUBLE) AS BIGINT) AS entropy_nano FROM v"

    @_add(name, sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        second = F.expr("cast(123456789 + doc_id * 7 as string)" if of_hex else "base64(unhex(concat(h,g)))")
        rows = planted._hashes(_docs(spark, sf)).select("doc_id", F.explode(F.array(F.col("h"), second)).alias("value"))
        return rows.select("doc_id", "value", F.round(measure(F.col("value")) * 1e9).cast("bigint").alias("entropy_nano"))


_entropy("entropy_base64", False, E.shannon)
_entropy("entropy_hex", True, lambda v: E.hex_shannon(v, None))


# scans ----------------------------------------------------------------------------------------------------------------
def _scan(name: str, table: str, keys: list[str], text: str) -> None:
    where = f"concat('{table}/', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys[:1])})"
    each = ", ".join(keys)
    sql = f"WITH {O.lines(table, each, where, text)},\n{O.scan('lines', each)}\nSELECT {each}, filename, line_number, type, sha1(secret) AS secret_hash FROM found"

    @_add(name, sql)
    def query(spark: SparkSession, sf: str) -> DataFrame:
        scanner = Scanner(spark, Settings.default())
        found = scanner.scan_table(_docs(spark, sf, table), F.concat(F.lit(f"{table}/"), F.col(keys[0]).cast("string")), text, *keys)
        return found.select(*keys, "filename", "line_number", "type", "secret_hash")


_scan("scan_documents", "documents", ["doc_id"], "text")
_scan("scan_pages", "pages", ["page_id"], "html")
_scan("scan_conversations", "conversations", ["conv_id", "turn"], "text")


@_add("scan_planted", f"WITH {planted.lines_sql()}, {O.scan('planted', 'doc_id, template')} SELECT doc_id, template, line_number, type, sha1(secret) AS secret_hash FROM found")
def scan_planted(spark: SparkSession, sf: str) -> DataFrame:
    s = Scanner(spark, Settings.default())
    name, line = F.col("filename"), F.col("line")
    rows = planted.lines(_docs(spark, sf), s.sign).where(~s.excluded_file(name) & ~s.excluded_line(name, line, F.col("previous")))
    return s._findings(s._secrets(s.detect(rows)), "doc_id", "template").select("doc_id", "template", "line_number", "type", "secret_hash")


_ADHOC = "adhoc AS (SELECT doc_id, template, 'adhoc-line-scan' AS filename, CAST(0 AS BIGINT) AS line_number, line, previous FROM planted), "


@_add("scan_line", f"WITH {planted.lines_sql()}, {O.scan('adhoc', 'doc_id, template', line_filters=False).replace('kept AS MATERIALIZED', _ADHOC + 'kept AS MATERIALIZED')} SELECT doc_id, template, line_number, type, sha1(secret) AS secret_hash FROM found")
def scan_line(spark: SparkSession, sf: str) -> DataFrame:
    """Each planted line as if given ad hoc: secret filters alone."""
    s = Scanner(spark, Settings.default())
    rows = planted.lines(_docs(spark, sf), s.sign).select("doc_id", "template", "line", F.lit("adhoc-line-scan").alias("filename"), F.lit(0).cast("bigint").alias("line_number"))
    return s._findings(s._secrets(s.detect(rows)), "doc_id", "template").select("doc_id", "template", "line_number", "type", "secret_hash")


@_add("lines", f"WITH {O.lines('documents', 'doc_id', 'CAST(doc_id AS VARCHAR)', 'text')} SELECT doc_id, line_number, md5(line) AS line_md5, md5(previous) AS previous_md5 FROM lines")
def lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "line_number", F.md5("line").alias("line_md5"), F.md5("previous").alias("previous_md5"))


# collections ----------------------------------------------------------------------------------------------------------
_FEW = ["AWSKeyDetector", "GitHubTokenDetector", "StripeDetector", P.HEX_NAME]
_FILE = "concat('dir/', CAST(doc_id // 4 AS VARCHAR), '/', filename)"
_FOUND = f"WITH {planted.lines_sql()}, {O.scan('planted', 'doc_id', _FEW, False)}, raw AS (SELECT {_FILE} AS filename, type, sha1(secret) AS secret_hash, secret, line_number + 100 * (doc_id % 4) AS line_number, doc_id FROM found)"
_SECRET = "CASE line_number % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END"
_DEDUP = f"{_FOUND}, now AS (SELECT filename, secret_hash, type, CAST(min(line_number) AS BIGINT) AS line_number FROM raw GROUP BY ALL), new AS (SELECT filename, secret_hash, type, line_number FROM now WHERE line_number % 5 <> 0), old AS (SELECT filename, secret_hash, type, line_number + 1 AS line_number, {_SECRET} AS is_secret, line_number % 7 = 0 AS is_verified FROM now WHERE line_number % 4 <> 0)"


def _found(spark: SparkSession, sf: str, keep_value: bool = False) -> DataFrame:
    s = Scanner(spark, Settings().configure_plugins([{"name": n} for n in _FEW]), keep_value)
    rows = s._findings(s.detect(planted.lines(_docs(spark, sf), s.sign)), "doc_id")
    path = F.concat(F.lit("dir/"), F.floor(F.col("doc_id") / 4).cast("string"), F.lit("/"), F.col("filename"))
    return rows.withColumn("filename", path).withColumn("line_number", F.col("line_number") + 100 * (F.col("doc_id") % 4)).drop("doc_id")


def _now(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    """The findings, scanned and shuffled once for all that is derived of them; by a column of their identity, or by all of it."""
    found = _found(spark, sf)
    now = shared(collection.dedup(found.repartition(by) if by else found).select(*collection.IDENTITY, "line_number"))
    # a scan has no labels
    return now.withColumns({"is_secret": F.lit(None).cast("boolean"), "is_verified": F.lit(False)})


def _new_old(spark: SparkSession, sf: str, now: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    now = _now(spark, sf) if now is None else now
    label = F.when(F.col("line_number") % 3 == 0, True).when(F.col("line_number") % 3 == 1, False)
    old = now.where("line_number % 4 <> 0").withColumn("is_secret", label).withColumn("is_verified", F.col("line_number") % 7 == 0).withColumn("line_number", F.col("line_number") + 1)
    return now.where("line_number % 5 <> 0"), old


_ID = "filename, secret_hash, type"
_SAME = "n.filename = o.filename AND n.secret_hash = o.secret_hash AND n.type = o.type"


@_add("dedup", f"{_FOUND} SELECT {_ID}, CAST(min(line_number) AS BIGINT) AS line_number FROM raw GROUP BY ALL")
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    return collection.dedup(_found(spark, sf)).select(*collection.IDENTITY, "line_number")


@_add("subtract", f"{_DEDUP} SELECT {_ID}, line_number FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_SAME})")
def subtract(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _new_old(spark, sf)
    return collection.subtract(new, old).select(*collection.IDENTITY, "line_number")


@_add("intersect", f"{_DEDUP} SELECT {_ID}, line_number FROM new n WHERE EXISTS (SELECT 1 FROM old o WHERE {_SAME})")
def intersect(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _new_old(spark, sf)
    return collection.intersect(new, old).select(*collection.IDENTITY, "line_number")


@_add("merge", f"{_DEDUP} SELECT n.filename, n.secret_hash, n.type, n.line_number, o.is_secret, coalesce(o.is_verified, FALSE) AS is_verified FROM new n LEFT JOIN old o ON {_SAME}")
def merge(spark: SparkSession, sf: str) -> DataFrame:
    return collection.merge(*_new_old(spark, sf))


_LISTED = "(SELECT DISTINCT filename FROM now WHERE line_number % 2 = 0)"


@_add("trim", f"{_DEDUP} SELECT o.filename, o.secret_hash, o.type, n.line_number, o.is_secret, o.is_verified FROM old o JOIN new n ON {_SAME} WHERE o.filename IN {_LISTED} UNION ALL SELECT {_ID}, line_number, is_secret, is_verified FROM old WHERE filename NOT IN {_LISTED}")
def trim(spark: SparkSession, sf: str) -> DataFrame:
    now = _now(spark, sf)
    new, old = _new_old(spark, sf, now)
    return collection.trim(old, new, now.where("line_number % 2 = 0").select("filename"))


@_add("equals", f"{_DEDUP} SELECT {_ID}, 'left' AS side FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_SAME}) UNION ALL SELECT {_ID}, 'right' FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE {_SAME})")
def equals(spark: SparkSession, sf: str) -> DataFrame:
    return collection.difference(*_new_old(spark, sf))


@_add("group_by_file", f"{_DEDUP} SELECT filename, count(*) AS secrets, string_agg(concat(line_number, ' ', secret_hash, ' ', type), ',' ORDER BY line_number, secret_hash, type) AS entries FROM old GROUP BY filename")
def group_by_file(spark: SparkSession, sf: str) -> DataFrame:
    # shuffled by file from the start, so that grouping by file needs no other shuffle
    rows = collection.by_file(_new_old(spark, sf, _now(spark, sf, "filename"))[1])
    entry = F.transform("secrets", lambda s: F.concat_ws(" ", s["line_number"].cast("string"), s["secret_hash"], s["type"]))
    return rows.select("filename", F.size("secrets").cast("bigint").alias("secrets"), F.array_join(entry, ",").alias("entries"))


@_add("count_secrets", f"{_DEDUP} SELECT count(*) AS secrets, count(DISTINCT filename) AS files FROM old")
def count_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return collection.count(_new_old(spark, sf)[1])


_TP, _FP, _UN = "count(*) FILTER (WHERE is_secret)", "count(*) FILTER (WHERE NOT is_secret)", "count(*) FILTER (WHERE is_secret IS NULL)"


@_add("audit_stats", f"{_DEDUP} SELECT type, {_TP} AS true_positives, {_FP} AS false_positives, {_UN} AS unknown, CASE WHEN {_TP} + {_FP} > 0 THEN round({_TP} / ({_TP} + {_FP})::DOUBLE, 4) ELSE 0.0::DOUBLE END AS precision, CASE WHEN {_TP} + {_UN} > 0 THEN round({_TP} / ({_TP} + {_UN})::DOUBLE, 4) ELSE 0.0::DOUBLE END AS recall FROM old GROUP BY type")
def audit_stats(spark: SparkSession, sf: str) -> DataFrame:
    return audit.stats(_new_old(spark, sf)[1])


@_add("audit_report", f"{_DEDUP} SELECT filename, secret_hash, CASE WHEN max(is_secret::INT) IS NULL THEN 'UNVERIFIED' WHEN max(is_secret::INT) = 1 THEN 'VERIFIED_TRUE' ELSE 'VERIFIED_FALSE' END AS category, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM old GROUP BY filename, secret_hash")
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    return audit.report(_new_old(spark, sf)[1]).select("filename", "secret_hash", "category", F.array_join("types", ",").alias("types"))


@_add("audit_unlabelled", f"{_DEDUP} SELECT {_ID}, line_number FROM old WHERE is_secret IS NULL")
def audit_unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return audit.unlabelled(_new_old(spark, sf)[1]).select(*collection.IDENTITY, "line_number")


@_add("audit_diff", f"{_DEDUP} SELECT {_ID}, line_number, 'added' AS change FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE {_SAME}) UNION ALL SELECT {_ID}, line_number, 'removed' FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE {_SAME})")
def audit_diff(spark: SparkSession, sf: str) -> DataFrame:
    new, old = _new_old(spark, sf)
    return audit.diff(old, new)


# diffs and redaction --------------------------------------------------------------------------------------------------
_NL = "chr(10)"
_DIFF = "concat_ws(chr(10), 'diff --git a/x b/x', '--- a/x.py', '+++ b/x.py', '@@ -1,3 +1,4 @@', ' same', concat('+password = \"', h, '\"'), '-gone', '+# pragma: allowlist nextline secret', concat('+token = \"', g, '\"'), '@@ -20 +30,2 @@', concat('+key AKIA', substr(upper(h),1,16)), '\\\\ No newline', '+++ /dev/null', '+lost', concat('+++ b/dir/y', cast(doc_id % 3 as string), '.go'), '+carried on', '@@ bad @@', concat('+secret := \"', g, '\"'))"
_DIFF_SQL = _DIFF.replace("\\\\", "\\")
_ADDED = f"""{planted._WITH}, diffs AS (SELECT doc_id AS diff_id, {_DIFF_SQL} AS diff FROM h),
r AS (SELECT diff_id, pos, ls[pos] AS raw FROM (SELECT diff_id, string_split(diff, chr(10)) AS ls, unnest(range(1, len(string_split(diff, chr(10))) + 1)) AS pos FROM diffs)),
k AS (SELECT *, CASE WHEN starts_with(raw, '+++ ') THEN 'file' WHEN starts_with(raw, '--- ') THEN 'skip' WHEN starts_with(raw, '@@ ') THEN 'hunk' WHEN starts_with(raw, '+') THEN 'add' WHEN starts_with(raw, '-') THEN 'del' ELSE 'same' END AS kind FROM r),
s AS (SELECT *, CASE WHEN kind = 'hunk' THEN CAST(nullif(regexp_extract(raw, '^[^+]*\\+([0-9]+)[^0-9]', 1), '') AS BIGINT) END AS start FROM k),
f AS (SELECT *, count(CASE WHEN kind = 'file' THEN 1 END) OVER w AS file_no, count(start) OVER w AS hunk FROM s WINDOW w AS (PARTITION BY diff_id ORDER BY pos)),
m AS (SELECT *, max(CASE WHEN kind = 'file' AND starts_with(raw, '+++ b/') THEN substr(raw, 7) END) OVER (PARTITION BY diff_id, file_no) AS file, coalesce(max(start) OVER (PARTITION BY diff_id, hunk), 0) AS base FROM f),
c AS (SELECT *, base + coalesce(sum(CASE WHEN file IS NOT NULL AND kind IN ('add', 'same') THEN 1 ELSE 0 END) OVER (PARTITION BY diff_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_number FROM m),
added AS MATERIALIZED (SELECT diff_id, file AS filename, CAST(line_number AS BIGINT) AS line_number, substr(raw, 2) AS line, coalesce(lag(substr(raw, 2)) OVER (PARTITION BY diff_id, file_no ORDER BY pos), '') AS previous FROM c WHERE kind = 'add' AND file IS NOT NULL)"""


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return planted._hashes(_docs(spark, sf)).select(F.col("doc_id").alias("diff_id"), F.expr(_DIFF).alias("diff"))


@_add("diff_added_lines", f"WITH {_ADDED} SELECT * FROM added")
def diff_added_lines(spark: SparkSession, sf: str) -> DataFrame:
    return diff.added_lines(_diffs(spark, sf))


@_add("scan_diff", f"WITH {_ADDED}, {O.scan('added', 'diff_id')} SELECT diff_id, filename, line_number, type, sha1(secret) AS secret_hash FROM found")
def scan_diff(spark: SparkSession, sf: str) -> DataFrame:
    return Scanner(spark, Settings.default()).scan_diffs(_diffs(spark, sf)).select("diff_id", "filename", "line_number", "type", "secret_hash")


def _redacted_sql(column: str) -> str:
    for pattern, placeholder in P.REDACTIONS:
        column = f"regexp_replace({column}, {O.rx(pattern)}, '{placeholder}', 'g')"
    return column


@_add("redact_documents", f"SELECT doc_id, md5({_redacted_sql('text')}) AS redacted_md5 FROM documents")
def redact_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(redact.redact(F.col("text"))).alias("redacted_md5"))


@_add("redact_planted", f"WITH {planted.lines_sql()} SELECT doc_id, template, {_redacted_sql('line')} AS redacted FROM planted")
def redact_planted(spark: SparkSession, sf: str) -> DataFrame:
    return planted.lines(_docs(spark, sf)).select("doc_id", "template", redact.redact(F.col("line")).alias("redacted"))


@_add("redact_session", f"WITH {planted.lines_sql()}, r AS (SELECT doc_id, template, line_number, line, regexp_replace(line, '[0-9]{{4,}}', '<N>', 'g') AS x FROM planted) SELECT doc_id, template, line_number, CASE WHEN trim(x) <> '' THEN concat('[s1] ', x) ELSE x END AS redacted, md5(line) AS plain_md5 FROM r")
def redact_session(spark: SparkSession, sf: str) -> DataFrame:
    """Rules of one's own, of which the second is no pattern and is skipped; a session's id; and redaction switched off."""
    rules = [("[0-9]{4,}", "<N>"), ("(never closed", "x")]
    rows = planted.lines(_docs(spark, sf))
    return rows.select("doc_id", "template", "line_number", redact.with_session(redact.redact(F.col("line"), rules), "s1").alias("redacted"), F.md5(redact.redact(F.col("line"), enabled=False)).alias("plain_md5"))


# audits, contexts, documents, streams and rules of one's own ----------------------------------------------------------
@_add("audit_recover", f"{_DEDUP} SELECT o.filename, o.secret_hash, o.type, o.line_number, v.secret AS secret_value FROM old o LEFT JOIN (SELECT DISTINCT filename, secret_hash, secret FROM raw) v ON o.filename = v.filename AND o.secret_hash = v.secret_hash")
def audit_recover(spark: SparkSession, sf: str) -> DataFrame:
    # one scan, written with its values, for the findings and for the values
    raw = written(_found(spark, sf, keep_value=True), "values")
    return audit.recover(_new_old(spark, sf, written(collection.dedup(raw), "findings"))[1], raw).select(*collection.IDENTITY, "line_number", "secret_value")


#: Class names and types of all detectors, written out once more.
_REGISTRY = """(VALUES ('AWSKeyDetector','AWS Access Key'),('AzureStorageKeyDetector','Azure Storage Account access key'),('ArtifactoryDetector','Artifactory Credentials'),
('CloudantDetector','Cloudant Credentials'),('IbmCloudIamDetector','IBM Cloud IAM Key'),('IbmCosHmacDetector','IBM COS HMAC Credentials'),('SoftlayerDetector','SoftLayer Credentials'),
('BasicAuthDetector','Basic Auth Credentials'),('DiscordBotTokenDetector','Discord Bot Token'),('GitHubTokenDetector','GitHub Token'),('GitLabTokenDetector','GitLab Token'),
('JwtTokenDetector','JSON Web Token'),('PrivateKeyDetector','Private Key'),('MailchimpDetector','Mailchimp Access Key'),('NpmDetector','NPM tokens'),('OpenAIDetector','OpenAI Token'),
('PypiTokenDetector','PyPI Token'),('SendGridDetector','SendGrid API Key'),('SlackDetector','Slack Token'),('SquareOAuthDetector','Square OAuth Secret'),('StripeDetector','Stripe Access Key'),
('TelegramBotTokenDetector','Telegram Bot Token'),('TwilioKeyDetector','Twilio API Key'),('IpPublicDetector','Public IP (ipv4)'),('Base64HighEntropyString','Base64 High Entropy String'),
('HexHighEntropyString','Hex High Entropy String'),('KeywordDetector','Secret Keyword')) AS registry(name, type)"""


@_add("audit_verdicts", f"{_FOUND} SELECT name, type IN (SELECT type FROM raw) AS found FROM {_REGISTRY}")
def audit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verdicts(_found(spark, sf), list(D.KINDS.items()))


@_add("registry", f"SELECT name, type, row_number() OVER (ORDER BY lower(name)) - 1 AS place, 2 AS verified FROM {_REGISTRY}")
def registry(spark: SparkSession, sf: str) -> DataFrame:
    """All detectors by name, with their types as found by type, and what is known of any secret of theirs."""
    by_type = {name: kind for kind, name in D.kind_to_name().items()}
    return spark.createDataFrame([(n, by_type[n], i, int(D.detector(n).verify("x"))) for i, n in enumerate(x for x in D.names() if x in D.KINDS)], "name string, type string, place bigint, verified int")


@_add("context", f"WITH {O.lines('documents', 'doc_id', 'CAST(doc_id AS VARCHAR)', 'text')} SELECT doc_id, line_number, md5(string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_number ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS context_md5 FROM lines")
def context(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_context(lines_of(_docs(spark, sf).select("doc_id", "text")), 2, "doc_id")
    return rows.select("doc_id", "line_number", F.md5(F.array_join("context", "\n")).alias("context_md5"))


@_add("baseline_document", f"{_DEDUP} SELECT {_ID}, line_number, is_secret, is_verified FROM old")
def baseline_document(spark: SparkSession, sf: str) -> DataFrame:
    """Findings written as a baseline in parts, and read again as such."""
    path = fresh_path(spark, "baseline")
    baseline.save_parts(_new_old(spark, sf)[1], path, Settings.default())
    return baseline.load_parts(spark, path).select(*collection.IDENTITY, "line_number", "is_secret", "is_verified")


@_add("scan_stream", ORACLES["scan_documents"])
def scan_documents_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of all that is there, its findings appended to files."""
    source = f"{sf}/documents.parquet"
    table = spark.read.parquet(source)
    alone = all(f.endswith("/documents.parquet") for f in table.inputFiles())
    stream = spark.readStream.schema(table.schema)
    files = stream.option("pathGlobFilter", "documents.parquet").parquet(sf) if alone else stream.parquet(source)
    found = scan_stream(Scanner(spark, Settings.default()), files, F.concat(F.lit("documents/"), F.col("doc_id").cast("string")), "text", "doc_id")
    rows = found.select("doc_id", "filename", "line_number", "type", "secret_hash")
    path = fresh_path(spark, "scan-stream")
    rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", fresh_path(spark, "scan-stream-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


_AS_FILE = "concat(CAST(doc_id % 97 AS VARCHAR), '/', CAST(doc_id AS VARCHAR), '.txt')"


@_add("scan_files", f"WITH {O.lines('documents', 'doc_id', _AS_FILE, 'text')},\n{O.scan('lines', 'doc_id')}\nSELECT filename, line_number, type, sha1(secret) AS secret_hash FROM found")
def scan_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as a file in a folder that all tasks see, found by a walk and scanned from there."""
    folder = fresh_path(spark, "scan-files").removeprefix("file://")

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        there = set()
        for batch in batches:
            for i, text in zip(batch["doc_id"], batch["text"]):
                if i % 97 not in there:
                    os.makedirs(f"{folder}/{i % 97}", exist_ok=True)
                    there.add(i % 97)
                with open(f"{folder}/{i % 97}/{i}.txt", "wb") as file:
                    file.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    _docs(spark, sf).select("doc_id", "text").mapInPandas(save, "n bigint").agg(F.sum("n")).collect()
    return Scanner(spark, Settings.default()).scan_files(files_below(spark, folder), folder).select("filename", "line_number", "type", "secret_hash")


@_add("det_regex", f"WITH {planted.lines_sql()} SELECT * FROM (SELECT doc_id, template, unnest(list_concat(regexp_extract_all(line, '-us([0-9]+)', 1), regexp_extract_all(line, 'xox[bp]-[0-9]+', 0))) AS secret FROM planted) WHERE secret <> ''")
def det_regex(spark: SparkSession, sf: str) -> DataFrame:
    """A detector by patterns of one's own: the group where a pattern has one, else the match."""
    own = D.regex_detector("Tails", ["-us([0-9]+)", "xox[bp]-[0-9]+"])
    return planted.lines(_docs(spark, sf)).select("doc_id", "template", F.explode(own.find()).alias("secret"))


class EvenTail:
    """A detector of one's own, as a class."""

    secret_type = "Even Tail"

    def analyze_string(self, line: str) -> list[str]:
        return re.findall("[0-9a-f]{6}[02468](?=\\W|$)", line, re.A)


@_add("det_custom", f"WITH {planted.lines_sql()} SELECT doc_id, template, substr(secret, 1, 7) AS secret FROM (SELECT doc_id, template, unnest(regexp_extract_all(line, '[0-9a-f]{{6}}[02468]([^0-9A-Za-z_]|$)')) AS secret FROM planted)")
def det_custom(spark: SparkSession, sf: str) -> DataFrame:
    custom.register_plugin(EvenTail)
    try:
        return planted.lines(_docs(spark, sf)).select("doc_id", "template", F.explode(D.detector("EvenTail").find()).alias("secret"))
    finally:
        custom.unregister_plugin("EvenTail")


def begins_like_a_hash(secret: str) -> bool:
    return secret[:1] in set("abcdef")


@_add("filter_custom", f"WITH {planted.candidates_sql()} SELECT doc_id, item FROM c WHERE regexp_matches(secret, '^[a-f]')")
def filter_custom(spark: SparkSession, sf: str) -> DataFrame:
    custom.register_filter("begins_like_a_hash", begins_like_a_hash)
    try:
        excluded = custom.filters("secret", {"begins_like_a_hash": {}})[0](secret=F.col("secret"))
        return planted.candidates(_docs(spark, sf)).where(excluded).select("doc_id", "item")
    finally:
        custom.FILTERS.pop("begins_like_a_hash")


_CONFIG = {"plugins_used": [{"name": P.HEX_NAME, "limit": 3.5}, {"name": "NoSuchDetector"}, {"name": "AWSKeyDetector"}], "filters_used": [{"path": "any.filters.heuristic.is_sequential_string"}, {"path": "any.filters.regex.should_exclude_line", "pattern": ["commit", "^x ="]}]}
_HEX_SQL = O.detect(P.HEX_NAME).replace("> 3.0", "> 3.5")


@_add("scan_settings", f"WITH {planted.lines_sql()}, kept AS (SELECT * FROM planted WHERE NOT ({O.FILTERS['is_non_text_file']}) AND NOT ({O.matches_any('line', ['commit', '^x ='])})), f AS (SELECT doc_id, template, line_number, '{P.HEX_KIND}' AS type, unnest({_HEX_SQL}) AS secret FROM kept UNION ALL SELECT doc_id, template, line_number, 'AWS Access Key', unnest({O.detect('AWSKeyDetector')}) FROM kept) SELECT doc_id, template, line_number, type, sha1(secret) AS secret_hash FROM f WHERE NOT ({O.FILTERS['is_sequential_string']})")
def scan_settings(spark: SparkSession, sf: str) -> DataFrame:
    """A scan under the settings of a baseline, within their scope: a limit, a detector that isn't known, filters in place of the first ones."""
    with transient_settings(_CONFIG):
        s = Scanner(spark)
        name, line = F.col("filename"), F.col("line")
        rows = planted.lines(_docs(spark, sf), s.sign).where(~s.excluded_file(name) & ~s.excluded_line(name, line, F.col("previous")))
        return s._findings(s._secrets(s.detect(rows)), "doc_id", "template").select("doc_id", "template", "line_number", "type", "secret_hash")
