"""Every operator on ids that are texts, nulls, empty and very long texts, repeated rows, clashing names and empty tables."""

import random

import pytest

from cindersift.llm import bpe, htmltree, linededup, media, minhash, mixing, quality, records, topk, warc

CLASHES = ["id", "doc", "mark", "words", "sig", "node", "root", "line", "no", "h", "g", "at", "of", "key", "tokens", "n_tokens", "intact", "decoded", "quality", "slot", "window", "page_id", "html", "url", "item_id", "rank", "score", "drops", "own", "tile", "image", "data", "__cs_id", "part", "row"]
WORDS = "amber birch cedar delta ember flint grove heron iris juniper".split()


def table(spark):
    r = random.Random(1)
    plain = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(60))
    long = "\n".join(" ".join(r.choice(WORDS) + str(r.randrange(9999)) for _ in range(40)) for _ in range(6000))  # 2 MB
    rows = [("doc-a1", plain), ("doc-a2", plain), ("doc-a2", plain), (None, plain), ("e", ""), ("n", None), ("s", "  \n\t"), ("x", long), ("y", "x" * 300_000), ("1", "7"), ("ü", "!?")]
    docs = spark.createDataFrame([(i, t, "en", ["s", None][k % 2], 1) for k, (i, t) in enumerate(rows)], "doc_id string, text string, lang string, source string, n_chars int")
    for name in CLASHES:
        docs = docs.selectExpr("*", f"'clash' as `{name}`")
    return docs


def ids(found, column="doc_id"):
    return sorted((r[column] for r in found.select(column).collect()), key=str)


OPERATORS = {
    "topk": lambda d: topk.search(d, d, query_id="doc_id", query_text="text"),
    "html": lambda d: htmltree.extract(d, htmltree.fit(d, html_col="text"), id_col="doc_id", html_col="text"),
    "mixing": lambda d: mixing.schedule(d, block_tokens=64),
    "mixed": lambda d: mixing.mixed(d, block_tokens=64),
    "quality": lambda d: quality.scored(d),
    "good": lambda d: quality.good_documents(d),
    "bpe": lambda d: bpe.encoded(d, check=True),
    "warc": lambda d: warc.pages_of(warc.read_archives(warc.write_archives(d, id_col="doc_id", url_col="source", text_col="text", damage={"torn": (2, 1), "flipped": (3, 1), "cut": (5, 1)})), "string"),
    "media": lambda d: media.tiles(media.pictures(d)),
    "records": lambda d: records.read_records(*records.write_records(bpe.encoded(d.select("doc_id", "text"))), seed=4),
    "copies": lambda d: minhash.near_duplicates(d),
    "without copies": lambda d: minhash.without_copies(d),
    "lines": lambda d: linededup.repeated_lines(d),
    "without lines": lambda d: linededup.without_repeated_lines(d, count_col="n_chars"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    docs = table(spark)
    found = OPERATORS[name](docs)
    rows = found.collect()
    assert OPERATORS[name](docs.limit(0)).count() == 0
    every = ids(docs)
    if name in ("quality", "bpe"):
        assert ids(found) == every and found.columns[: len(docs.columns)] == docs.columns and len(set(found.columns)) == len(found.columns)
    if name in ("mixed", "good", "without copies", "without lines"):
        assert found.columns == docs.columns and set(ids(found)) <= set(every)
    if name == "html":
        assert ids(found, "page_id") == every
    if name == "media":
        assert ids(found, "id") == every and {r["id"] for r in rows if r["error"]} == {"n"}
    if name == "warc":
        assert sorted((r["page_id"] for r in rows if r["kind"] == "record"), key=str) == every and any(r["kind"] == "gap" for r in rows)
    if name == "records":
        assert ids(found) == sorted((i for i in every if i != "n"), key=str) and all(r["ok"] for r in rows)
    if name == "good":
        assert not {"e", "n", "s"} & {r["doc_id"] for r in rows}
    if name == "topk":
        assert {(r["item_id"], r["doc_id"]) for r in rows if r["rank"] == 1} >= {("x", "x"), ("y", "y"), ("1", "1")}
    if name == "copies":
        assert {(r["doc_id"], r["duplicate_of"]) for r in rows} == {("doc-a2", "doc-a1"), (None, "doc-a1")}
    if name == "without copies":
        assert ids(found) == sorted(["doc-a1", "e", "n", "s", "x", "y", "1", "ü"])
    if name == "lines":
        assert {(r["doc_id"], r["line_no"]) for r in rows} == {("doc-a2", 0), (None, 0)}
    if name == "without lines":
        assert ids(found) == sorted(["doc-a1", "e", "n", "s", "x", "y", "1", "ü"]) and {r["doc_id"]: r["n_chars"] for r in rows}["y"] == 300_000
    if name in ("mixing", "mixed"):
        assert {r["doc_id"] for r in rows} == {"doc-a1", "doc-a2", None, "x", "y", "1", "ü"}
