"""Command line: ``scan``, ``hook`` and ``audit``."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys

from pyspark.sql import SparkSession

from . import __version__, baseline
from .operators import audit, collection, custom
from .operators import detectors as D
from .operators.lines import lines_of, with_context
from .plans.scan import Scanner
from .settings import Settings, patterns_of
from .sources.files import files_to_scan, read_texts, relative


def _settings(args: argparse.Namespace, document: dict | None) -> Settings:
    settings = Settings()
    for where in args.plugin or []:
        custom.load_plugins(where)
    if document:
        settings.configure_from_baseline(document, args.baseline)
    else:
        settings.configure_plugins([{"name": n} for n in D.names()])
    settings.disable_plugins(*(args.disable_plugin or []))
    for name, limit in (("Base64HighEntropyString", args.base64_limit), ("HexHighEntropyString", args.hex_limit)):
        if limit is not None and name in settings.plugins:
            settings.plugins[name]["limit"] = limit
    for part in ("lines", "files", "secrets"):
        if given := getattr(args, f"exclude_{part}"):
            path = f"regex.should_exclude_{part[:-1]}"
            settings.set_filter(path, pattern=[*patterns_of(settings.filters.get(path, {})), *given])
    if args.word_list:
        settings.set_filter("wordlist.should_exclude_secret", file_name=args.word_list, min_length=3)
    for path in args.filter or []:
        settings.set_filter(custom.load_filter(path))
        settings.filters[path] = {}
    settings.disable_filters(*(args.disable_filter or []))
    return settings


def _scan(spark: SparkSession, args: argparse.Namespace) -> int:
    document = baseline.upgrade(baseline.load_from_file(args.baseline)) if args.baseline else None
    settings = _settings(args, document)
    if args.list_all_plugins:
        print("\n".join(D.names()))
        return 0
    scanner = Scanner(spark, settings)
    if args.string is not None:
        line = args.string or sys.stdin.readline().rstrip("\r\n")
        names = [(d.name, d.kind) for d in settings.detectors()]
        for r in audit.verdicts(scanner.scan_line(line), names).collect():
            print(f"{r['name']:<30}: {r['found']}")
        return 0
    found = baseline.create(spark, args.path, args.all_files, args.root, settings)
    if document:
        known = baseline.load(spark, document)
        scanned = spark.createDataFrame([(f,) for f in files_to_scan(args.path, args.all_files, args.root)], "filename string")
        rest = known.join(scanned, "filename", "left_anti").select(*found.columns) if args.path else None
        found = collection.merge(found, known)
        found = found.unionByName(rest) if rest is not None else found
    made = baseline.format_for_output(found, settings, args.slim)
    if args.baseline:
        baseline.save_to_file(made, args.baseline)
    else:
        print(json.dumps(made, indent=2))
    return 0


def _unstaged(path: str) -> bool:
    try:
        return path.encode() in subprocess.run(["git", "diff", "--name-only", "-z"], capture_output=True, check=True).stdout.split(b"\0")
    except (OSError, subprocess.CalledProcessError):
        return False


def _hook(spark: SparkSession, args: argparse.Namespace) -> int:
    """0: nothing new; 1: secrets that the baseline doesn't have, or a baseline that isn't staged; 3: the baseline was brought up to date."""
    if args.baseline and _unstaged(args.baseline):
        print(f"{args.baseline} has changes that are not staged", file=sys.stderr)
        return 1
    document = baseline.load_from_file(args.baseline) if args.baseline else None
    settings = _settings(args, baseline.upgrade(document) if document else None)
    names = [relative(p, args.root) for p in args.path]
    found = collection.dedup(Scanner(spark, settings).scan_files(names, args.root)).cache()
    known = baseline.load(spark, document) if document else None
    new = collection.subtract(found, known) if known is not None else found
    if rows := new.orderBy("filename", "line_number").collect():
        for r in rows:
            print(f"{r['filename']}:{r['line_number']}: {r['type']}", file=sys.stderr)
        return 1
    if known is None:
        return 0
    trimmed = collection.trim(known, found, spark.createDataFrame([(n,) for n in names], "filename string"))
    if collection.equal(trimmed, known, exactly=True):
        return 0
    made = baseline.upgrade(document) | {"results": baseline.results(trimmed)}
    baseline.save_to_file(made, args.baseline)
    return 3


def _interactive(spark: SparkSession, args: argparse.Namespace, document: dict, known) -> int:
    """Asks for a label of each finding that has none, with the lines around it; what was said is saved at the end."""
    entries = [(name, e) for name in sorted(document["results"]) for e in document["results"][name] if e.get("is_secret") is None]
    if not entries:
        print("Nothing to audit!")
        return 0
    names = sorted({n for n, _ in entries})
    around = with_context(lines_of(read_texts(spark.createDataFrame([(n,) for n in names], "filename string"), args.root)), 2)
    wanted = audit.unlabelled(known).select("filename", "line_number").distinct()
    shown = {(r["filename"], r["line_number"]): (r["line"], r["context"]) for r in around.join(wanted, ["filename", "line_number"]).collect()}
    at, changed = 0, False
    while 0 <= at < len(entries):
        name, entry = entries[at]
        line, context = shown.get((name, entry.get("line_number", 0)), (None, []))
        print(f"Secret:      {at + 1} of {len(entries)}\nFilename:    {name}\nSecret Type: {entry['type']}")
        print("\n".join(("> " if x == line else "  ") + x for x in context) if line is not None else "ERROR: the secret's line is not there")
        said = input("Should this string be committed? (y)es, (n)o, (s)kip, (b)ack, (q)uit: " if line is not None else "(s)kip, (b)ack, (q)uit: ").strip().lower()
        if said == "q":
            break
        if said in ("y", "n") and line is not None:
            entry["is_secret"], changed = said == "n", True
        elif said == "s":
            entry["is_secret"] = None
        elif said == "b":
            at = max(at - 2, -1)
        else:
            continue
        at += 1
    if changed:
        baseline.save_to_file(document, args.path[0])
    return 0


def _audit(spark: SparkSession, args: argparse.Namespace) -> int:
    document = baseline.upgrade(baseline.load_from_file(args.path[0]))
    known = baseline.load(spark, document)
    if args.diff:
        found = audit.diff(known, baseline.load(spark, baseline.upgrade(baseline.load_from_file(args.path[1]))))
    elif args.stats:
        found = audit.stats(known).orderBy("type")
    elif args.report:
        found = audit.report(known, True if args.only_real else False if args.only_false else None)
        settings = Settings().configure_from_baseline(document)
        values = Scanner(spark, settings, keep_value=True).scan_files([r["filename"] for r in collection.files(known).collect()], args.root)
        found = audit.recover(found, values).orderBy("filename", "lines")
    elif args.list:
        found = audit.unlabelled(known)
    else:
        return _interactive(spark, args, document, known)
    for row in found.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), default=str))
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cindersift")
    parser.add_argument("--version", action="version", version=__version__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run in (("scan", _scan), ("hook", _hook), ("audit", _audit)):
        sub = commands.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("path", nargs="*")
        sub.add_argument("--root", default=".")
        if name == "audit":
            for flag in ("stats", "report", "diff", "list", "only-real", "only-false"):
                sub.add_argument(f"--{flag}", action="store_true")
            continue
        sub.add_argument("--baseline", default="")
        for flag in ("plugin", "filter", "disable-plugin", "disable-filter", "exclude-lines", "exclude-files", "exclude-secrets"):
            sub.add_argument(f"--{flag}", action="append")
        sub.add_argument("--base64-limit", type=float)
        sub.add_argument("--hex-limit", type=float)
        sub.add_argument("--word-list")
        if name == "scan":
            sub.add_argument("--string", nargs="?", const="")
            for flag in ("all-files", "slim", "list-all-plugins"):
                sub.add_argument(f"--{flag}", action="store_true")
    args = parser.parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("cindersift").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
