"""Detectors, filters, settings, rules of one's own, files, streams and the command line."""

import io
import json
import logging
import subprocess

import pytest
from pyspark.sql import functions as F

from cindersift import baseline, cli, settings
from cindersift.functions import patterns as P
from cindersift.operators import audit, collection, custom, filters, redact
from cindersift.operators import detectors as D
from cindersift.operators.lines import lines_of, with_context
from cindersift.plans.scan import Scanner
from cindersift.sources import files
from cindersift.sources.tables import read_table
from cindersift.streaming.files import scan_stream, stream_files

A, H = "A" * 16, "0123456789abcdef" * 4
ODD = "k{{x}q)z${w]-_$#tail}}"

#: detector, file, line, secrets
CASES = [
    ("AWSKeyDetector", "x", f"id ASIA{A}", [f"ASIA{A}"]),
    ("AWSKeyDetector", "x", "aws_token = '" + "b" * 40 + "'", ["b" * 40]),
    ("AWSKeyDetector", "x", "aws_token = '" + "b" * 39 + "'", []),
    ("AzureStorageKeyDetector", "x", "AccountKey=" + "a" * 86 + "==", ["AccountKey=" + "a" * 86 + "=="]),
    ("ArtifactoryDetector", "x", "k:AP6" + "y" * 10, [":AP6" + "y" * 10]),
    ("ArtifactoryDetector", "x", "someAKCinsideaword" + "y" * 10, []),
    ("CloudantDetector", "x", f"cloudant_pw='{H}'", [H]),
    ("CloudantDetector", "x", f"https://me:{H}@me.cloudant.com", [H]),
    ("IbmCloudIamDetector", "x", "ibm_key: " + "q" * 44, ["q" * 44]),
    ("IbmCloudIamDetector", "x", "ibm_key: " + "q" * 45, []),
    ("IbmCosHmacDetector", "x", "cos_secret_access_key=" + H[:48], [H[:48]]),
    ("SoftlayerDetector", "x", f"http://api.softlayer.com/soap/v3/{H}", [H]),
    ("BasicAuthDetector", "x", "http://a:8000 @b", []),
    ("DiscordBotTokenDetector", "x", "N" + "a" * 23 + ".bbbbbb." + "c" * 27, ["N" + "a" * 23 + ".bbbbbb." + "c" * 27]),
    ("GitLabTokenDetector", "x", "glft-" + "a" * 20 + " glptt-" + "b" * 40, ["glft", "glptt-" + "b" * 40]),
    ("GitLabTokenDetector", "x", "glpat-" + "a" * 19, []),
    ("JwtTokenDetector", "x", "eyJhIjoxfQ.eyJiIjoyfQ", ["eyJhIjoxfQ.eyJiIjoyfQ"]),
    ("JwtTokenDetector", "x", "eyJhIjoxfQ.bm90anNvbg", []),
    ("PrivateKeyDetector", "x", "BEGIN EC PRIVATE KEY and BEGIN PUBLIC KEY", ["BEGIN EC PRIVATE KEY"]),
    ("MailchimpDetector", "x", "ab" * 16 + "-us7", ["ab" * 16 + "-us7"]),
    ("MailchimpDetector", "x", "AB" * 16 + "-us7", []),
    ("NpmDetector", "x", "//r/:_authToken=npm_abc", ["npm_abc"]),
    ("NpmDetector", "x", "//r/:_authToken=${TOKEN}", []),
    ("OpenAIDetector", "x", "sk-proj-" + "a" * 20 + "T3BlbkFJ" + "b" * 20, ["sk-proj-" + "a" * 20 + "T3BlbkFJ" + "b" * 20]),
    ("PypiTokenDetector", "x", "pypi-AgEIcHlwaS5vcmc" + "z" * 70, ["pypi-AgEIcHlwaS5vcmc" + "z" * 70]),
    ("SendGridDetector", "x", "SG." + "a" * 22 + "." + "b" * 43, ["SG." + "a" * 22 + "." + "b" * 43]),
    ("SlackDetector", "x", "xoxb-12-34-ab", ["xoxb-12-34-ab"]),
    ("SquareOAuthDetector", "x", "sq0csp-" + "a" * 43, ["sq0csp-" + "a" * 43]),
    ("StripeDetector", "x", "rk_live_" + "a" * 24, ["rk_live_" + "a" * 24]),
    ("StripeDetector", "x", "pk_live_" + "a" * 24, []),
    ("TelegramBotTokenDetector", "x", "12345678:" + "a" * 35, ["12345678:" + "a" * 35]),
    ("TelegramBotTokenDetector", "x", "bot12345678:" + "a" * 35, []),
    ("TwilioKeyDetector", "x", "SK" + "a" * 32, ["SK" + "a" * 32]),
    ("IpPublicDetector", "x", "10.1.1.1 192.168.9.9 8.8.4.4:53 1.2.3.04", ["8.8.4.4:53"]),
    ("Base64HighEntropyString", "x", "'c3VwZXIgbG9uZyBzdHJpbmcgc2hvdWxkIGNhdXNlIGVub3VnaCBlbnRyb3B5'", ["c3VwZXIgbG9uZyBzdHJpbmcgc2hvdWxkIGNhdXNlIGVub3VnaCBlbnRyb3B5"]),
    ("Base64HighEntropyString", "x", "'c3VwZXI='", []),
    # rules of each family of languages
    ("KeywordDetector", "c.ini", f"apikey = {ODD}", [ODD]),
    ("KeywordDetector", "c.yaml", "aws_secret_key: several plain words", ["several plain words"]),
    ("KeywordDetector", "c.ini", "my_setting = \"real\"", []),
    ("KeywordDetector", "c.ini", "password = ,.:-¨@*¿?!", []),
    ("KeywordDetector", "m.go", f'apikey := "{ODD}"', [ODD]),
    ("KeywordDetector", "m.go", "password = bareword9", ["bareword9"]),
    ("KeywordDetector", "m.go", "if `abc123x` == my_password {", ["abc123x"]),
    ("KeywordDetector", "m.go", "if userInput == my_password {", []),
    ("KeywordDetector", "m.py", "if user_input == my_password:", []),
    ("KeywordDetector", "m.py", "if 'abc123x' != my_password:", ["abc123x"]),
    ("KeywordDetector", "m.js", "if (`abc123x` === the_secret)", ["abc123x"]),
    ("KeywordDetector", "m.yml", "when: \"abc123x\" == db_pass", ["abc123x"]),
    ("KeywordDetector", "m.c", 'password[9] = "abc123x"', ["abc123x"]),
    ("KeywordDetector", "m.c", "password = 'abc123x'", []),
    ("KeywordDetector", "m.cpp", 'secret.assign("abc123x")', ["abc123x"]),
    ("KeywordDetector", "m.other", "secret => 'abc123x'", ["abc123x"]),
    ("KeywordDetector", "m.other", 'private_key "abc123x";', ["abc123x"]),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, f, x) for i, (_, f, x, _) in enumerate(CASES)], "i int, filename string, line string")
    for name in dict.fromkeys(c[0] for c in CASES):
        got = {r["i"]: r["x"] for r in rows.select("i", D.detector(name).find().alias("x")).collect()}
        assert [(c[2], got[i]) for i, c in enumerate(CASES) if c[0] == name] == [(c[2], c[3]) for c in CASES if c[0] == name]


def test_detector_objects(spark):
    limited = D.detector("HexHighEntropyString", limit=3.5)
    assert limited.json() == {"name": "HexHighEntropyString", "limit": 3.5} and D.detector("KeywordDetector").json() == {"name": "KeywordDetector", "keyword_exclude": ""}
    assert D.detector("AWSKeyDetector").json() == {"name": "AWSKeyDetector"} and limited.verify("x") is D.Verified.UNVERIFIED and list(D.Verified) == [1, 2, 3]
    assert D.detector("IPPublicDetector").name == "IpPublicDetector" and D.kind_to_name()["Public IP (ipv4)"] == "IpPublicDetector"
    assert D.names() == sorted(D.names(), key=str.lower) and len(D.names()) == 27
    with pytest.raises(KeyError):
        D.detector("NoSuch")
    kept = spark.createDataFrame([("password = 'abc123x'", "a.py"), ("password = 'thistest9'", "a.py")], "line string, filename string")
    assert [len(r["x"]) for r in kept.select(D.detector("KeywordDetector", keyword_exclude="this.*9").find().alias("x")).collect()] == [1, 0]


def truth(spark, expression, **columns):
    names = list(columns)
    rows = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{n} string" for n in names))
    return [r["x"] for r in rows.select(expression.alias("x")).collect()]


def test_filters(spark):
    s, line = F.col("s"), F.col("line")
    assert truth(spark, filters.is_sequential_string(s), s=["ABCDEF", "34567", "yz01", "beef1234", "AB+"]) == [True, True, True, False, False]
    assert truth(spark, filters.is_potential_uuid(s), s=["97FB0431-46ac-41df-9ef9-1a18545ce2a0", "97fb0431-46ac-41df-9ef9"]) == [True, False]
    assert truth(spark, filters.is_templated_secret(s), s=["{a}", "<a>", "${a}", "a", "ab", "{a>"]) == [True, True, True, True, False, False]
    assert truth(spark, filters.is_prefixed_with_dollar_sign(s), s=["$a", "a$", ""]) == [True, False, False]
    assert truth(spark, filters.is_not_alphanumeric_string(s), s=["12-34", "12a", ""]) == [True, False, True]
    lines = ["myid = VALUE", "data test_ids: VALUE", "hidden: VALUE", "grid: VALUE", "id: OTHER"]
    assert truth(spark, filters.is_likely_id_string(s, line), s=["VALUE"] * 5, line=lines) == [True, True, False, False, False]
    assert truth(spark, filters.is_likely_id_string(s, line, True), s=["VALUE"], line=lines[:1]) == [False]
    assert truth(spark, filters.is_indirect_reference(line), line=["secret = get(1)", "secret = 'a(b)'", "x = a[1]" + " " * 1000]) == [True, False, False]
    names = ["a/Cargo.lock", "a/cargo.lock", "b/x.png", "b/.png", "my-swagger.json"]
    assert truth(spark, filters.is_lock_file(s), s=names) == [True, False, False, False, False]
    assert truth(spark, filters.is_non_text_file(s), s=names) == [True, True, True, False, False]
    assert truth(spark, filters.is_swagger_file(s), s=names)[-1] is True
    allow = filters.is_line_allowlisted(F.col("f"), line, F.col("p"))
    said = [("a.py", "x # pragma: allowlist secret", ""), ("a.c", "x /* pragma: whitelist secret */", ""), ("a.py", "x", "// pragma: allowlist nextline secret"), ("a.yml", "x // pragma: allowlist secret", ""), ("a.py", "x # pragma: allowlist", "")]
    assert truth(spark, allow, f=[x[0] for x in said], line=[x[1] for x in said], p=[x[2] for x in said]) == [True, True, True, False, False]
    assert truth(spark, filters.matches_any(s, ["^a", "b$"]), s=["ax", "xb", "xax"]) == [True, True, False]
    for bad in ("(", "*a", "(?<n>a)(?<n>b)"):
        with pytest.raises(ValueError):
            filters.compiled([bad])
    assert filters.compiled(["a(?>b)++"]) == ["a(?>b)++"]  # a pattern of the engine that runs it
    assert filters.with_parameters("secret", "line") == ["is_likely_id_string"] and "is_lock_file" in filters.with_parameters("filename")


def test_wordlist(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("Hunter\nab\n  q.z \n\n")
    words = filters.Wordlist(str(path))
    assert words.words == ["hunter", "q.z"] and words.digest == "%040x" % int(__import__("hashlib").sha1(path.read_bytes()).hexdigest(), 16)
    assert truth(spark, words.excludes(F.col("s")), s=["myHUNTER2", "abab", "qxz", "aq.zb"]) == [True, False, False, True]
    assert filters.Wordlist(str(path), 2).words == ["ab", "hunter", "q.z"]


def test_settings(spark):
    with settings.transient_settings():
        settings.global_initialize_all_plugins()
        assert len(settings.global_get_plugin_names()) == 27 and settings.all_plugin_class_names() == D.names()
        settings.global_disable_plugins(["IPPublicDetector", "KeywordDetector"])
        settings.global_set_plugin_limit("HexHighEntropyString", "limit", 2.5)
        settings.global_disable_filters(["any.path.is_lock_file"])
        settings.global_set_filter("regex.should_exclude_line", {"pattern": "x"})
        now = settings.get_settings()
        assert len(now.detectors()) == 25 and now.plugins["HexHighEntropyString"] == {"limit": 2.5} and "is_lock_file" not in now.filters
        assert json.loads(now.json())["plugins_used"][0] == {"name": "ArtifactoryDetector"}
        settings.configure_settings_from_baseline({"plugins_used": [{"name": "NoSuch", "a": 1}], "filters_used": [{"path": "x.is_swagger_file"}]}, "base.json")
        assert set(now.filters) == {"is_invalid_file", "is_non_text_file", "is_swagger_file", "is_baseline_file"} and len(now.detectors()) == 25
        settings.global_clear_plugins()
        assert settings.global_get_plugin_names() == []
        settings.cache_bust()
        assert set(now.filters) == set(settings.DEFAULT_FILTERS)
    with pytest.raises(RuntimeError), settings.default_settings() as inner:
        assert len(inner.plugins) == 27
        raise RuntimeError
    assert settings.get_settings().plugins == {}


def test_upgrades():
    old = {"version": "0.14.3", "exclude": {"files": "^a", "lines": None}, "word_list": {"file": "w", "hash": "h"}, "plugins_used": [{"name": "HexHighEntropyString", "hex_limit": 2}], "results": {"f": [{"type": "t", "hashed_secret": "h", "line_number": 1}]}}
    new = baseline.upgrade(old)
    paths = [f["path"].rsplit(".", 1)[-1] for f in new["filters_used"]]
    assert new["version"] == baseline.VERSION and new["plugins_used"] == [{"name": "HexHighEntropyString", "limit": 2}] and old["version"] == "0.14.3"
    assert {"should_exclude_file", "should_exclude_secret", "is_lock_file", "is_swagger_file"} <= set(paths) and len(paths) == len(set(paths)) and "exclude" not in new
    later = baseline.upgrade({"version": "1.0.0", "filters_used": [{"path": "a.is_lock_file"}], "results": {}})
    assert [f["path"].rsplit(".", 1)[-1] for f in later["filters_used"]] == ["is_lock_file", "is_not_alphanumeric_string", "is_swagger_file"]
    assert baseline.upgrade({"version": "x"}) == {"version": "x"} and baseline.upgrade(new) == new
    assert [baseline.version_of(v) for v in ("1.2.3", "1.2", "1.2.x", "")] == [(1, 2, 3), None, None, None]


def test_baseline_errors(spark, tmp_path):
    for text in ("", "[]", '{"results": []}', '{"results": {"a": [{"type": "t"}]}}'):
        path = tmp_path / "b.json"
        path.write_text(text)
        with pytest.raises(baseline.BaselineError):
            baseline.load(spark, baseline.load_from_file(str(path)))
    with pytest.raises(baseline.BaselineError):
        baseline.load_from_file(str(tmp_path / "none"))
    assert baseline.load(spark, {"results": {}}).count() == 0


def test_collections(spark):
    schema = "filename string, secret_hash string, type string, line_number bigint, is_secret boolean, is_verified boolean"
    old = spark.createDataFrame([("a", "1", "t", 5, True, False), ("a", "2", "t", 6, None, True), ("b", "3", "t", 1, False, False), ("a", "1", "t", 3, None, False)], schema)
    new = spark.createDataFrame([("a", "1", "t", 9, None, False), ("c", "4", "t", 2, None, False)], schema)
    key = lambda d: sorted((r["filename"], r["secret_hash"], r["line_number"], r["is_secret"]) for r in d.collect())
    assert key(collection.dedup(old)) == [("a", "1", 3, True), ("a", "2", 6, None), ("b", "3", 1, False)]
    assert key(collection.merge(new, old)) == [("a", "1", 9, True), ("c", "4", 2, None)]
    assert key(collection.trim(collection.dedup(old), new, new.select("filename"))) == [("a", "1", 9, True), ("b", "3", 1, False)]
    assert collection.equal(old, old.unionByName(old)) and not collection.equal(old, old.unionByName(old), exactly=True)
    assert [r["filename"] for r in collection.files(old).collect()] == ["a", "b"] and collection.count(old).first() == (4, 2)
    empty = old.limit(0)
    assert audit.stats(empty).count() == audit.report(empty).count() == audit.diff(empty, empty).count() == 0
    assert sorted((r["secret_hash"], r["change"]) for r in audit.diff(old, new).collect()) == [("2", "removed"), ("3", "removed"), ("4", "added")]
    assert [r["category"] for r in audit.report(old, True).collect()] == ["VERIFIED_TRUE"]


class Shout:
    secret_type = "Shout"

    def __init__(self, least=3):
        self.least = least

    def analyze_line(self, filename, line, line_number):
        if line == "fail":
            raise RuntimeError
        return [w for w in line.split() if w.isupper() and len(w) >= self.least and filename != "quiet"]

    def analyze_string(self, line):
        return ["FAILED"] if line == "fail" else []


class Broken(Shout):
    secret_type = "Broken"

    def __init__(self):
        raise ValueError("never")


def test_custom(spark, tmp_path, caplog):
    (tmp_path / "own.py").write_text("class Dots:\n    secret_type = 'Dots'\n    def analyze_string(self, line):\n        return ['..'] if '..' in line else []\nclass _Hidden(Dots):\n    pass\nclass Other:\n    pass\ndef short(secret):\n    return len(secret) < 4\ndef named(filename, line):\n    return line.startswith(filename)\n")
    try:
        custom.register_plugin(Shout)
        custom.register_plugin(Broken)
        rows = spark.createDataFrame([("AB ABC x", "a"), ("ABC", "quiet"), ("fail", "a")], "line string, filename string")
        assert [r["x"] for r in rows.select(D.detector("Shout").find().alias("x")).collect()] == [["ABC"], [], ["FAILED"]]
        assert [r["x"] for r in rows.select(D.detector("Shout", least=2).find().alias("x")).collect()][0] == ["AB", "ABC"]
        with caplog.at_level(logging.WARNING):
            assert [r["x"] for r in rows.select(D.detector("Broken").find().alias("x")).collect()] == [[], [], []]
        assert "never" in caplog.text and "Shout" in D.names() and D.kind_to_name()["Shout"] == "Shout"
        for bad in (int, type("NoType", (), {"analyze_string": len})):
            with pytest.raises(TypeError):
                custom.register_plugin(bad)
        assert custom.load_plugins(f"file://{tmp_path}/own.py") == ["Dots"]
        name = custom.load_filter(f"file://{tmp_path}/own.py::short")
        other = custom.load_filter(f"file://{tmp_path}/own.py::named")
        assert [custom.FILTERS[n][0] for n in (name, other)] == ["secret", "line"] and custom.phase_of(lambda filename: True) == "file"
        on = settings.Settings().configure_plugins([{"name": "Shout"}]).configure_filters([{"path": "x"}])
        on.filters |= {name: {}, other: {}}
        scanner = Scanner(spark, on, keep_value=True)
        table = spark.createDataFrame([("f", "ABC ABCD\nf ABCDE\nABCDEF")], "name string, text string")
        assert sorted(r["secret_value"] for r in scanner.scan_table(table, F.col("name")).collect()) == ["ABCD", "ABCDEF"]
    finally:
        custom.clear()
    assert D.CUSTOM == {} and custom.FILTERS == {}


def test_redaction(spark, caplog):
    with caplog.at_level(logging.WARNING):
        assert redact.valid_rules([("(", "x"), ("a", "b")]) == [("a", "b")] and "skipped" in caplog.text
    line = F.lit("api_key=" + "k" * 20 + " pk_live_" + "a" * 20)
    assert spark.range(1).select(redact.redact(line).alias("x")).first()["x"] == "[REDACTED_KEY] [REDACTED_API_KEY]"
    assert spark.range(1).select(redact.redact(line, enabled=False).alias("x")).first()["x"].startswith("api_key")
    assert truth(spark, redact.with_session(F.col("s"), "id"), s=["a", " ", ""]) == ["[id] a", " ", ""]
    sink = io.StringIO()
    for text in ("Bearer " + "z" * 20 + "\n", "\n"):
        redact.RedactingWriter(sink, session="7").write(text)
    assert sink.getvalue() == "[7] [REDACTED_BEARER_TOKEN]\n\n"


def test_redacting_sink(spark, tmp_path):
    table = spark.createDataFrame([(1, "sk-" + "a" * 24)], "n int, log string")
    redact.write_redacted(table, "log", f"{tmp_path}/out", session="s")
    redact.write_redacted(table, "log", f"{tmp_path}/out")
    assert sorted(r["log"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["[REDACTED_API_KEY]", "[s] [REDACTED_API_KEY]"]


def test_files(spark, tmp_path):
    for name in ("a.txt", ".dot", "d/b.txt", "d/e/c.txt", ".hidden/x.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(name)
    root = str(tmp_path)
    assert files.files_to_scan([], True, root) == [".dot", "a.txt", "d/b.txt", "d/e/c.txt"]
    assert files.files_to_scan(["d", "a.txt", "a.txt", "none"], True, root) == ["a.txt", "d/b.txt", "d/e/c.txt"]
    assert files.relative("/other/x", root) == "/other/x" and files.relative("d/../a.txt", root) == "a.txt"
    subprocess.run(["git", "init", "-q", "."], cwd=root, check=True)
    subprocess.run(["git", "add", "a.txt", "d/b.txt"], cwd=root, check=True)
    assert files.files_to_scan([], False, root) == ["a.txt", "d/b.txt"]
    read = files.read_texts(spark.createDataFrame([("a.txt",), ("none",), ("d/b.txt",)], "filename string"), root)
    assert sorted((r["filename"], r["text"]) for r in read.collect()) == [("a.txt", "a.txt"), ("d/b.txt", "d/b.txt")]
    (tmp_path / "bad.bin").write_bytes(b"\xff\xfe")
    texts = files.texts_of(spark.read.format("binaryFile").load([f"{root}/a.txt", f"{root}/bad.bin"]))
    assert [r["text"] for r in texts.collect()] == ["a.txt"]


def test_context_and_stream(spark, tmp_path):
    rows = lines_of(spark.createDataFrame([("a", "1\n2\n3\n4"), ("b", "9")], "filename string, text string"))
    assert {(r["filename"], r["line_number"]): r["context"] for r in with_context(rows, 1).collect()} == {("a", 1): ["1", "2"], ("a", 2): ["1", "2", "3"], ("a", 3): ["2", "3", "4"], ("a", 4): ["3", "4"], ("b", 1): ["9"]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text(f"k = 'AKIA{A[:-1]}7'\n")
    (tmp_path / "in" / "b.py").write_bytes(b"\xff AKIA" + A.encode())
    found = scan_stream(Scanner(spark, settings.Settings.default()), stream_files(spark, f"{tmp_path}/in"))

    def run():
        found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["filename"].rsplit("/", 1)[-1], r["type"]) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())

    assert run() == [("a.py", "AWS Access Key")]
    (tmp_path / "in" / "c.py").write_text(f"k = 'AKIA{A[:-1]}8'\n")
    assert run() == [("a.py", "AWS Access Key"), ("c.py", "AWS Access Key")]


def test_table_over_all_cores(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/one")
    table = read_table(spark, f"{tmp_path}/one")
    assert table.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and table.count() == 10


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text(f"first = 1\nk = 'AKIA{A[:-1]}7'\nlast = 2\n")
    base = str(root / "base.json")
    at = ["--root", str(root)]
    assert cli.main(["scan", "--list-all-plugins"], spark) == 0 and capsys.readouterr().out.splitlines() == D.names()
    assert cli.main(["scan", "--string", f"AKIA{A[:-1]}7"], spark) == 0
    said = dict(x.rsplit(":", 1) for x in capsys.readouterr().out.splitlines())
    assert said["AWSKeyDetector".ljust(30)].strip() == "True" and said["StripeDetector".ljust(30)].strip() == "False"
    assert cli.main(["scan", "--all-files", *at], spark) == 0
    document = json.loads(capsys.readouterr().out)
    assert [e["line_number"] for e in document["results"]["a.py"]] == [2] and "generated_at" in document
    baseline.save_to_file(document, base)
    assert cli.main(["hook", "a.py", *at], spark) == 1 and "a.py:2" in capsys.readouterr().err
    monkeypatch.chdir(root)
    assert cli.main(["hook", "a.py", "--baseline", "base.json", *at], spark) == 0
    (root / "a.py").write_text(f"k = 'AKIA{A[:-1]}7'\n")
    assert cli.main(["hook", "a.py", "--baseline", "base.json", *at], spark) == 3
    assert json.loads((root / "base.json").read_text())["results"]["a.py"][0]["line_number"] == 1
    # an audit: a wrong key, back at the first, then a label
    said = iter(["x", "b", "n"])
    monkeypatch.setattr("builtins.input", lambda _: next(said))
    assert cli.main(["audit", base, *at], spark) == 0 and json.loads((root / "base.json").read_text())["results"]["a.py"][0]["is_secret"] is True
    assert "> k = 'AKIA" in capsys.readouterr().out
    assert cli.main(["audit", base, *at], spark) == 0 and "Nothing to audit" in capsys.readouterr().out
    assert cli.main(["audit", base, "--stats"], spark) == 0 and json.loads(capsys.readouterr().out)["true_positives"] == 1
    assert cli.main(["audit", base, "--report", "--only-real", *at], spark) == 0
    assert json.loads(capsys.readouterr().out)["secret_value"] == f"AKIA{A[:-1]}7"
    assert cli.main(["audit", base, base, "--diff"], spark) == 0 and capsys.readouterr().out == ""
    assert cli.main(["scan", "--all-files", "--exclude-files", "^a", "--exclude-files", "json$", *at], spark) == 0 and json.loads(capsys.readouterr().out)["results"] == {}


def test_patterns_in_both_engines():
    assert P.wrong("a(") and P.wrong("a(b)") is None
    with pytest.raises(ValueError):
        P.assignment("(", "b", "c")
    with pytest.raises(ValueError):
        P.re2("[]a]")
