"""Baseline documents: read, upgrade, format and write; and as DataFrames of findings."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import collection
from .plans.scan import FINDING, Scanner
from .settings import Settings, get_settings
from .sources.files import files_to_scan

VERSION = "1.5.0"
#: One document is for people and version control, and whole on the driver; larger sets of findings are saved in parts.
MAX_ENTRIES = 1_000_000
#: An entry of a baseline in parts.
ENTRY = "type string, filename string, hashed_secret string, is_verified boolean, line_number bigint, is_secret boolean"


class BaselineError(ValueError):
    """The document can't be read, or isn't a baseline."""


def version_of(text: str) -> tuple[int, int, int] | None:
    parts = text.split(".")
    return tuple(map(int, parts)) if len(parts) == 3 and all(p.isascii() and p.isdigit() for p in parts) else None


def create(spark: SparkSession, paths: list[str] | None = None, all_files: bool = False, root: str = ".", settings: Settings | None = None) -> DataFrame:
    """Findings in files below root, each once, with names relative to it."""
    return collection.dedup(Scanner(spark, settings).scan_files(files_to_scan(paths or [], all_files, root), root))


def load_from_file(path: str) -> dict:
    try:
        return json.loads(Path(path).read_text("utf-8"))
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as error:
        raise BaselineError(f"{path}: {error}") from error


def load(spark: SparkSession, document: dict) -> DataFrame:
    """The findings of a baseline. BaselineError if its results are not such."""
    if not isinstance(document, dict) or not isinstance(document.get("results"), dict):
        raise BaselineError("no results")
    rows = []
    for filename, entries in document["results"].items():
        for e in entries:
            try:
                rows.append((e["type"], e.get("filename", filename), e["hashed_secret"], int(e.get("line_number", 0)), e.get("is_secret"), bool(e.get("is_verified", False))))
            except (KeyError, TypeError, ValueError) as error:
                raise BaselineError(f"an entry of {filename}: {error!r}") from error
    return spark.createDataFrame(rows, FINDING)


def results(findings: DataFrame, slim: bool = False) -> dict:
    """The ``results`` of a baseline: files by name, their entries by line."""
    rows = findings.orderBy("filename", "line_number", "type", "secret_hash").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise BaselineError(f"more than {MAX_ENTRIES} findings; save them in parts (save_parts)")
    out: dict[str, list] = {}
    for r in rows:
        entry = {"type": r["type"], "filename": r["filename"], "hashed_secret": r["secret_hash"], "is_verified": r["is_verified"]}
        if not slim:
            entry["line_number"] = r["line_number"]
        if r["is_secret"] is not None:
            entry["is_secret"] = r["is_secret"]
        out.setdefault(r["filename"], []).append(entry)
    return out


def format_for_output(findings: DataFrame, settings: Settings | None = None, slim: bool = False) -> dict:
    document = {"version": VERSION} | (settings or get_settings()).as_dict() | {"results": results(findings, slim)}
    if not slim:
        document["generated_at"] = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return document


def formatted(findings: DataFrame) -> DataFrame:
    """(filename, entries): the results of a baseline as a table, for sets of any size."""
    entry = F.struct("line_number", "type", "filename", F.col("secret_hash").alias("hashed_secret"), "is_verified", "is_secret")
    return findings.groupBy("filename").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def save_to_file(document: dict, path: str) -> None:
    Path(path).write_text(json.dumps(document, indent=2) + "\n", "utf-8")


def save_parts(findings: DataFrame, path: str, settings: Settings | None = None) -> None:
    """A baseline of any size as a folder that all executors share: ``head``, the document without its results, and
    ``results``, an entry a line in JSON. Tasks write the entries, so none of them is on the driver."""
    spark = findings.sparkSession
    head = {"version": VERSION} | (settings or get_settings()).as_dict() | {"generated_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    findings.select("type", "filename", F.col("secret_hash").alias("hashed_secret"), "is_verified", "line_number", "is_secret").write.json(f"{path}/results")
    spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/head")


def load_parts(spark: SparkSession, path: str) -> DataFrame:
    """The findings of a baseline in a folder. BaselineError if its head isn't a baseline's, or of a version whose entries differ."""
    try:
        head = upgrade(json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/head").collect())))
    except (AnalysisException, json.JSONDecodeError, AttributeError) as error:
        raise BaselineError(f"{path}: {error}") from error
    if head.get("version") != VERSION:
        raise BaselineError(f"{path}: not a baseline of a known version")
    entries = spark.read.schema(f"{ENTRY}, wrong string").option("columnNameOfCorruptRecord", "wrong").json(f"{path}/results")
    bad = F.col("wrong").isNotNull() | F.col("type").isNull() | F.col("filename").isNull() | F.col("hashed_secret").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not an entry of a baseline: "), F.coalesce("wrong", "filename", F.lit(""))))).otherwise(F.col("type"))
    return entries.select(checked.cast("string").alias("type"), "filename", F.col("hashed_secret").alias("secret_hash"), F.coalesce("line_number", F.lit(0)).cast("bigint").alias("line_number"), "is_secret", F.coalesce("is_verified", F.lit(False)).alias("is_verified"))


def upgrade(document: dict) -> dict:
    """The document in the present version. One whose version can't be read is returned as it is."""
    version = version_of(str(document.get("version", "")))
    if version is None:
        return document
    new = json.loads(json.dumps(document))
    if version < (0, 12, 0):
        new["exclude"] = {"files": new.pop("exclude_regex", None), "lines": None}
        new.setdefault("word_list", {"file": None, "hash": None})
    if version < (1, 0, 0):
        filters = [{"path": f"heuristic.{n}"} for n in ("is_sequential_string", "is_potential_uuid", "is_likely_id_string", "is_templated_secret", "is_prefixed_with_dollar_sign", "is_indirect_reference")]
        filters.append({"path": "allowlist.is_line_allowlisted"})
        exclude = new.pop("exclude", None) or {}
        for part, name in (("files", "should_exclude_file"), ("lines", "should_exclude_line")):
            if exclude.get(part):
                filters.append({"path": f"regex.{name}", "pattern": [exclude[part]]})
        words = new.pop("word_list", None) or {}
        if words.get("file"):
            filters.append({"path": "wordlist.should_exclude_secret", "min_length": 3, "file_name": words["file"], "file_hash": words.get("hash")})
        new["filters_used"] = filters
        for plugin in new.get("plugins_used", []):
            for limit in ("base64_limit", "hex_limit"):
                if limit in plugin:
                    plugin["limit"] = plugin.pop(limit)
        for filename, entries in new.get("results", {}).items():
            for entry in entries:
                entry.setdefault("filename", filename)
    if version < (1, 1, 0):
        have = {f["path"].rsplit(".", 1)[-1] for f in new.setdefault("filters_used", [])}
        new["filters_used"] += [{"path": f"heuristic.{n}"} for n in ("is_lock_file", "is_not_alphanumeric_string", "is_swagger_file") if n not in have]
    new["version"] = VERSION
    return new
