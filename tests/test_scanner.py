"""Values, not just verdicts, of detectors and filters; and what comes of scans."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cindersift import baseline, planted
from cindersift.functions import entropy as E
from cindersift.functions import patterns as P
from cindersift.operators import detectors as D
from cindersift.operators import audit, diff, filters, redact
from cindersift.operators.lines import lines_of, lines_with
from cindersift.plans.scan import Scanner
from cindersift.settings import Settings, patterns_of

FINDING_ROW = "type string, filename string, secret_hash string, line_number bigint, is_secret boolean, is_verified boolean"


def found(spark, name, line, filename="a.txt", eager=True):
    row = spark.createDataFrame([(line, filename)], "line string, filename string")
    return row.select(D.detector(name).find(eager=eager).alias("x")).first()["x"]


def test_detectors(spark):
    assert found(spark, "AWSKeyDetector", "k AKIA" + "Z" * 16) == ["AKIA" + "Z" * 16]
    assert found(spark, "AWSKeyDetector", "akia" + "z" * 16) == []
    assert found(spark, "GitHubTokenDetector", "ghp_" + "a" * 36) == ["ghp"]
    assert found(spark, "IpPublicDetector", "1.2.3.45.6 then 133.133.133.133:8080 and 172.16.0.1") == ["133.133.133.133:8080"]
    assert found(spark, "BasicAuthDetector", "https://username:hidden@host") == ["hidden"]
    assert found(spark, "HexHighEntropyString", "'2b00042f7481c7b056c4b410d28f33cf'") == ["2b00042f7481c7b056c4b410d28f33cf"]
    assert found(spark, "HexHighEntropyString", "2b00042f7481c7b056c4b410d28f33cf", eager=False) == []
    assert found(spark, "KeywordDetector", 'api_key = ""', "config.ini") == []
    assert found(spark, "KeywordDetector", "apikey = m{{h}o)p${e]nob(ody[finds>-_$#thisone}}", "config.ini") == ["m{{h}o)p${e]nob(ody[finds>-_$#thisone}}"]
    assert found(spark, "KeywordDetector", "password = bare", "x.py") == []


def test_lines(spark):
    rows = lines_of(spark.createDataFrame([("a\r\nb\rc\n\nd\n",), ("",), (None,)], "text string")).collect()
    assert [(r["line_number"], r["line"], r["previous"]) for r in rows] == [(1, "a", ""), (2, "b\rc", "a"), (3, "", "b\rc"), (4, "d", "")]


def test_lines_that_have_a_sign(spark):
    """They are those that all lines would give, with their numbers and the lines before."""
    texts = ["a\r\nkey\rb\nkey", "", None, "\n\nkey\r\n", "key\r\r\n\r\nkey\n\n", "é\nkéy\nthe key \ufffd\n", "\r", "none", "key\r"]
    table = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    wanted = sorted(map(tuple, lines_of(table).where("line like '%key%'").collect()))
    assert len(wanted) == 7
    assert sorted(map(tuple, lines_of(table, sign="key").collect())) == wanted
    parts = table.select("id", F.explode(lines_with("key", size=5)("text")).alias("x")).select("id", "x.*")
    assert sorted(map(tuple, parts.collect())) == wanted
    assert lines_of(table, sign="nothing").count() == 0


def test_scans_look_at_lines_with_a_sign_alone(spark):
    """Detection takes no other lines, and finds what it finds in all of them, in letters of other scripts too."""
    odd = ["\u212aey: nothing", "client_\u212aey = 'abcdefgh1'", "cl\u0131ent_key = 'abcdefgh1'", "pa\u017fswd: 'abcdefgh1', key", "contrase\u00f1a = 'abcdefgh1'", "M" + "a" * 23 + "." + "\u0661" * 6 + "." + "a" * 27, "\u0661" * 8 + ":" + "a" * 35, "k AP\u0661" + "a" * 8, "://u:p\u00e9@h"]
    table = planted.lines(spark.range(1, 3).select(F.col("id").alias("doc_id"), F.lit("\n".join(["plain words, and no more"] * 50 + odd)).alias("text")))
    one = table.groupBy("doc_id", "filename").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_number", "line"))), lambda x: x["line"]), "\n").alias("text")).cache()
    scanner = Scanner(spark, Settings.default())
    found = scanner.detect(lines_of(one)).select("type", "line", "doc_id", "filename", "line_number", "secret").collect()
    assert {r["type"] for r in found} == set(D.KINDS.values())
    signs = {d.kind: re.compile(D.sign_of([d]).encode()) for d in scanner.settings.detectors()}
    assert [r for r in found if not signs[r["type"]].search(r["line"].encode())] == []
    some = lines_of(one, sign=scanner.sign)
    assert sorted(map(tuple, found)) == sorted(map(tuple, scanner.detect(some).select("type", "line", "doc_id", "filename", "line_number", "secret").collect()))
    assert some.where("line like 'plain words%'").count() == 0
    assert D.sign_of([D.detector("AWSKeyDetector"), D.regex_detector("Own", ["x"])]) is None
    one.unpersist()


def test_planted_lines_that_have_a_sign(spark):
    """All that is planted stays, whole and numbered; of documents' own lines those that detection needs."""
    docs = spark.createDataFrame([(1, "plain\nAKIA" + "Z" * 16 + "\nplain"), (2, None)], "doc_id bigint, text string")
    every, some = planted.lines(docs).collect(), planted.lines(docs, Scanner(spark, Settings.default()).sign).collect()
    assert sorted(map(tuple, some)) == sorted(tuple(r) for r in every if r["line"] != "plain") and len(every) == len(some) + 2
    assert [(r["line_number"], r["template"]) for r in some if r["doc_id"] == 2] == [(i + 1, x[0]) for i, x in enumerate(planted.LINES)]


def test_sequences_and_tails(spark):
    secrets = ["abcdef", "", "7890123", "XYZABC", "Z=/", "/\nABC", "\n", "0123456789012345678A", "GFE"]
    rows = spark.createDataFrame([(s,) for s in secrets], "s string").select("s", filters.is_sequential_string(F.col("s")).alias("is")).collect()
    assert [r["is"] for r in rows] == [any(s.upper() in q for q in P.SEQUENCES) for s in secrets]
    names = ["a.png", "a/.png", "a.png/b", "a.tar.gz", "png", ".gz", "a.PNG", "b.7z", "x.py"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").where(filters.is_non_text_file(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["a.png", "a.tar.gz", "b.7z"]


@pytest.mark.parametrize("chars", [None, [ord(c) for c in "0123456789ABCDEFabcdef"]])
def test_entropies_by_columns(chars):
    import math

    import numpy as np

    values = ["0123456789", "a", "", "00ff", "a" * 70000 + "b" * 10, "0" * 100, "abcdefABCDEF0123456789"]
    got = E._entropies(1000, chars)(np.array([len(v) for v in values]), np.frombuffer("".join(values).encode(), np.uint8), True)
    for v, x in zip(values, got):
        wanted = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
        assert abs(x - (wanted - 1.2 / math.log2(len(v)) if len(v) > 1 and v.isdigit() else wanted)) < 1e-12


def test_verdicts_start_no_python(spark):
    found = audit.verdicts(spark.range(1).select(F.lit("k").alias("type")), [("B", "l"), ("A", "k")])
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [("A", True), ("B", False)]
    assert audit.verdicts(spark.range(1).select(F.lit("k").alias("type")), []).collect() == []


def test_scan_files_and_baseline(spark, tmp_path):
    (tmp_path / "a.py").write_text('k = "AKIA' + "B" * 16 + '"\n# pragma: allowlist nextline secret\nk = "AKIA' + "C" * 16 + '"\n')
    (tmp_path / "yarn.lock").write_text('"AKIA' + "D" * 16 + '"\n')
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe AKIA" + b"E" * 16)
    settings = Settings().configure_plugins([{"name": "AWSKeyDetector"}])
    made = baseline.create(spark, [], True, str(tmp_path), settings)
    document = baseline.format_for_output(made, settings)
    assert {f: [e["line_number"] for e in v] for f, v in document["results"].items()} == {"a.py": [1]}
    assert baseline.load(spark, json.loads(json.dumps(document))).count() == 1
    assert Scanner(spark, Settings.default()).scan_line("AKIA" + "B" * 15 + "7").where("type = 'AWS Access Key'").count() == 1


def test_diff_and_redaction(spark):
    text = "--- a/x\n+++ b/x\n@@ -1 +5,2 @@\n same\n+new\n-old\n+++ tail\n+lost"
    rows = diff.added_lines(spark.createDataFrame([(1, text), (2, None)], "diff_id int, diff string")).collect()
    assert [(r["filename"], r["line_number"], r["line"]) for r in rows] == [("x", 6, "new")]
    line = spark.createDataFrame([("Bearer " + "a" * 20 + " sk-" + "b" * 20,)], "x string").select(redact.redact(F.col("x"), None).alias("x")).first()["x"]
    assert line == "[REDACTED_BEARER_TOKEN] [REDACTED_API_KEY]"


def test_settings_and_upgrade():
    assert patterns_of({"pattern": ["a", "b"]}) == ["a", "b"] and patterns_of({"patterns": "a"}) == ["a"]
    new = baseline.upgrade({"version": "0.11.0", "exclude_regex": "x", "plugins_used": [], "results": {"f": [{"type": "t", "hashed_secret": "h", "line_number": 1}]}})
    assert new["version"] == baseline.VERSION and new["results"]["f"][0]["filename"] == "f"
    assert any(f["path"] == "regex.should_exclude_file" for f in new["filters_used"])


def test_baseline_in_parts(spark, tmp_path, monkeypatch):
    """More findings than one document takes, values that JSON escapes, and folders that are no baseline."""
    monkeypatch.setattr(baseline, "MAX_ENTRIES", 3)
    rows = [("t", f'dir/"{i}\\\n\u2028ñ.py', f"h{i}", i, (None, True, False)[i % 3], i % 2 == 0) for i in range(10)]
    findings = spark.createDataFrame(rows, FINDING_ROW)
    with pytest.raises(baseline.BaselineError):
        baseline.format_for_output(findings)
    baseline.save_parts(findings, str(tmp_path / "base"), Settings.default())
    assert sorted(map(tuple, baseline.load_parts(spark, str(tmp_path / "base")).collect())) == sorted(rows)
    empty = str(tmp_path / "empty")
    baseline.save_parts(findings.where("false"), empty, Settings.default())
    assert baseline.load_parts(spark, empty).count() == 0
    with pytest.raises(baseline.BaselineError):
        baseline.load_parts(spark, str(tmp_path / "none"))
    (tmp_path / "base" / "results" / "more.json").write_text('{"type": "t"}\n')
    with pytest.raises(Exception, match="not an entry"):
        baseline.load_parts(spark, str(tmp_path / "base")).collect()


def test_baseline_query_over_the_bound_of_one_document(spark, tmp_path, monkeypatch):
    from cindersift import queries

    monkeypatch.setattr(baseline, "MAX_ENTRIES", 3)
    spark.range(5).selectExpr("id as doc_id", "'x' as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["baseline_document"](spark, str(tmp_path)).collect()
    assert len(rows) == len(set(rows)) > 3 and {r["is_secret"] for r in rows} == {None, True, False}


def test_strings_by_entropy_many_at_once(spark):
    """Against a count of characters in Python: more strings than are measured at once, long ones, quoted before bare."""
    import math
    import random

    import pyarrow as pa

    from cindersift.functions import entropy

    def one(v, of_hex):
        plain = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v)) if v else 0.0
        return plain - 1.2 / math.log2(len(v)) if of_hex and len(v) > 1 and v.isdigit() else plain

    rng = random.Random(1)
    word = lambda: "".join(rng.choices("0123456789abcdefXYZ-_"[: rng.choice([2, 10, 16, 21])], k=rng.choice([0, 1, 9, 12, 40, 300])))
    rows = [([word() for _ in range(rng.randrange(4))], [word() for _ in range(rng.randrange(4))], rng.choice([2.5, 3.0, 3.5]), rng.random() < 0.5) for _ in range(200)] + [(None, None, None, None), ([], [], 3.0, True)]
    want = [[] if limit is None else [v for v in q if round(one(v, h), 12) > limit] or [v for v in b if round(one(v, h), 12) > limit] for q, b, limit, h in rows]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.string()), pa.list_(pa.string()), pa.float64(), pa.bool_()))]
    for made in (entropy.strong_ones(), entropy.strong_ones(3, 7)):
        assert made.func(*columns).to_pylist() == want


def test_runs_and_their_lines(spark):
    line = 'x "0123456789abcdefg" 0123456789abcdef0 +9876543210fedcba- \'aaaaaaaaab\''
    assert found(spark, "HexHighEntropyString", line) == ["0123456789abcdef", "0123456789abcdef0", "9876543210fedcba"]
    lines = spark.createDataFrame([(1, line + ' "0123456789abcdef"', "a.txt"), (2, "nothing", "a.txt"), (3, None, "a.txt"), (4, "PASSWORD = 'Abc1'", "a.py")], "n int, line string, filename string")
    rows = D.secrets(lines, [D.detector("HexHighEntropyString"), D.detector("KeywordDetector"), D.detector("AWSKeyDetector")])
    assert sorted((r["n"], r["type"], r["secret"]) for r in rows.collect()) == [(1, "Hex High Entropy String", "0123456789abcdef"), (4, "Secret Keyword", "Abc1")]


def test_strings_of_lines_many_at_once(spark):
    """Against patterns in Python: shared quotes, edges of lines, other characters, empty and missing lines, chunks of any size."""
    import math
    import random
    import re

    import pyarrow as pa

    from cindersift.functions import entropy
    from cindersift.functions import patterns as P

    def one(v, of_hex):
        plain = -sum(v.count(c) / len(v) * math.log2(v.count(c) / len(v)) for c in set(v))
        return plain - 1.2 / math.log2(len(v)) if of_hex and len(v) > 1 and v.isdigit() else plain

    rng = random.Random(2)
    part = lambda: rng.choice(['"', "'", '"', " ", "é", "\\", "-", "\r"]) if rng.random() < 0.5 else "".join(rng.choices("0123456789abcdefXYZ"[: rng.choice([2, 10, 16, 19])], k=rng.choice([1, 8, 9, 12, 40, 300])))
    lines = ["".join(part() for _ in range(rng.randrange(9))) for _ in range(500)] + [None, "", '"0123456789"0123456789"012345678901"', "0123456789ab", "cdef01234567", "'0123456789ab", "'"]
    for charset, limit, of_hex in ((P.HEX, 3.0, True), (P.HEX, 1.0, True), (P.BASE64, 3.5, False)):
        for eager in (True, False):
            want = []
            for line in lines:
                strong = lambda found: [v for v in found if len(v) >= entropy.least_length(limit) and round(one(v, of_hex), 12) > limit]
                quoted = strong(re.findall(f'"([{charset}]+)"', line or "") + re.findall(f"'([{charset}]+)'", line or ""))
                want.append(quoted or (strong(re.findall(f"[{charset}]+", line or "")) if eager else []))
            for sizes in ((1 << 14, 1 << 20), (3, 7), (2, 500)):
                found = entropy.strong_in(charset, limit, of_hex, eager, *sizes).func
                assert found(pa.array(lines, "string")).to_pylist() == want
                assert found(pa.array(lines, "large_string").slice(7)).to_pylist() == want[7:]


def test_trim_shuffles_what_is_known_once(spark):
    from cindersift.operators import collection

    row = lambda f, h, t, n, yes=None: (t, f, h, n, yes, False)
    known = spark.createDataFrame([row("a", "1", "t", 5, True), row("a", "1", "t", 6), row("a", "2", "t", 7), row("b", "1", "t", 8, False), row(None, "1", "t", 9), row("a", None, "t", 10), row("c", "3", "t", 11)], FINDING_ROW)
    scanned = spark.createDataFrame([row("a", "1", "t", 2), row("a", "1", "t", 1), row("b", "1", "t", 3), row("a", "9", "t", 4), row("a", None, "t", 4), row(None, "1", "t", 4), row("c", "3", "t", None)], FINDING_ROW)
    files = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("z",)], "filename string")
    made = collection.trim(known, scanned, files)
    assert sorted(map(tuple, made.collect()), key=str) == sorted([("a", "1", "t", 1, True, False), ("a", "1", "t", 1, None, False), ("b", "1", "t", 8, False, False), (None, "1", "t", 9, None, False), ("c", "3", "t", None, None, False)], key=str)
    plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_recover_scans_once(spark, tmp_path, monkeypatch):
    from cindersift import queries

    spark.range(3).selectExpr("id as doc_id", "'x' as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    scans, found = [], queries._found
    monkeypatch.setattr(queries, "_found", lambda *a, **k: scans.append(1) or found(*a, **k))
    rows = queries.QUERIES["audit_recover"](spark, str(tmp_path)).collect()
    assert rows and all(r["secret_value"] for r in rows) and len(scans) == 1


@pytest.mark.parametrize("name", ["subtract", "intersect", "merge", "equals", "trim", "group_by_file", "count_secrets", "audit_stats", "audit_report", "audit_unlabelled", "audit_diff"])
def test_collections_scan_once_and_write_nothing(spark, tmp_path, monkeypatch, name):
    """What is known and what is new are of one scan and one shuffle by identity, though joins and columns differ."""
    from cindersift import queries

    def refuse(*_):
        raise AssertionError("written")

    monkeypatch.setattr(queries, "written", refuse)
    spark.range(12).selectExpr("if(id = 5, null, id) as doc_id", "'x' as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    made = queries.QUERIES[name](spark, str(tmp_path))
    assert made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the rows planted for each document, and its lines
    assert plan.count("FileScan") == 2
    shuffles = [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(filename#\d+, (secret_hash#\d+, type#|\d+\), REPARTITION)", x)]
    assert len([x for x in shuffles if "ReusedExchange" not in x]) == 1


def test_difference_and_diff_as_by_joins(spark):
    """Against the definitions, with rows that repeat and with what isn't known; one shuffle each instead of several."""
    import random

    from cindersift.operators import audit, collection

    rng = random.Random(3)
    made = lambda n: spark.createDataFrame([(rng.choice(["t", "u", None]), rng.choice(["a", "b", None]), rng.choice("12"), rng.choice([1, 2, None]), rng.choice([True, None]), True) for _ in range(n)], FINDING_ROW)
    a, b = made(40), made(30)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    for exactly in (False, True):
        columns = [*collection.IDENTITY, "line_number", "is_secret", "is_verified"] if exactly else collection.IDENTITY
        x, y = (d.select(*columns) if exactly else d.select(*columns).distinct() for d in (a, b))
        want = x.exceptAll(y).withColumn("side", F.lit("left")).union(y.exceptAll(x).withColumn("side", F.lit("right")))
        found = collection.difference(a, b, exactly)
        assert rows(found) == rows(want) and found.columns == want.columns
        assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hash") == 1
    x, y = collection.dedup(a), collection.dedup(b)
    new = y.join(x.select(*collection.IDENTITY), collection.IDENTITY, "left_anti").withColumn("change", F.lit("added"))
    want = new.unionByName(x.join(y.select(*collection.IDENTITY), collection.IDENTITY, "left_anti").withColumn("change", F.lit("removed")))
    found = audit.diff(a, b)
    assert rows(found) == rows(want.select(*found.columns)) and len(rows(found)) > 2
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Join") == 1


def test_files_below_are_those_of_a_walk(spark, tmp_path, monkeypatch):
    """Hidden folders, links, empty folders, names of any kind; without a list on the driver."""
    from cindersift import queries
    from cindersift.sources import files

    assert not hasattr(queries, "files_to_scan")

    root = tmp_path / "root"
    for place in ("", "a", "a/b", "a/b/c", ".git", "a/.x", "empty", "ñ d", "link-to-dir"):
        (root / place).mkdir(parents=True, exist_ok=True)
        for name in ("1.txt", ".hidden", "x y.py", "ñ.md") if place != "empty" else ():
            (root / place / name).write_text("AKIA" + "B" * 16)
    (root / "to-file").symlink_to(root / "a" / "1.txt")
    (root / "to-dir").symlink_to(root / "a")
    (root / "gone").symlink_to(root / "nothing")
    (root / "not-utf8-\udcff.txt").write_text("x")
    want = [n for n in files.files_to_scan([], True, str(root)) if n.isprintable()]
    assert "to-file" in want and "a/b/c/ñ.md" in want and not any(n.startswith(".git") for n in want)
    for given in (str(root), f"{root}/../root/"):
        assert sorted(r["filename"] for r in files.files_below(spark, given).collect()) == want
    assert files.files_below(spark, str(root / "empty")).count() == files.files_below(spark, str(root / "none")).count() == 0
    folders = files._folders
    for wanted in (1, 3, 1000):
        monkeypatch.setattr(files, "_folders", lambda base, _, wanted=wanted: folders(base, wanted))
        assert sorted(r["filename"] for r in files.files_below(spark, str(root)).collect()) == want
