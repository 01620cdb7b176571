"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables and odd columns."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cindersift.llm import bpe, htmltree, linededup, media, minhash, mixing, quality, records, topk, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __cs_id string, key string, doc string"
WORDS = "amber birch cedar delta ember flint grove heron iris juniper kelp lotus maple nettle".split()


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    t = text(1)
    rows = [(1, t), (2, t.replace(t.split()[5], "changed", 1)), (3, text(3)), (4, None), (5, ""), (6, "  "), (7, text(7, 20000)), (None, text(8)), (3, text(3)), (9, "!?"), (10, t)]
    return spark.createDataFrame([(i, x, None, ["a", "b", None][k % 3], 0, "x", "y", "z") for k, (i, x) in enumerate(rows)], SCHEMA)


def test_minhash(spark, docs):
    found = {(r["doc_id"], r["duplicate_of"]) for r in minhash.near_duplicates(docs).collect()}
    assert found == {(2, 1), (10, 1)}
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_crowded(spark):
    # 3 passages of 100 words, each shared by many documents of 100 more words, of which planted pairs have half in common
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passages, rows = [words(100) for _ in range(3)], []
    for k in range(1500):
        passage, both = passages[k % 3], words(50)
        rows += [(2 * k + j, " ".join(passage + both + words(50))) for j in range(2)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    gone = minhash.near_duplicates(table).collect()
    assert sorted(minhash.near_duplicates(table, crowd=60).collect()) == sorted(gone)
    data = "".join(x for _, x in rows).encode()
    offsets = np.cumsum([0] + [len(x) for _, x in rows])
    gram, of, _ = minhash.shingles(np.frombuffer(data, np.uint8), offsets)
    _, sig = minhash.signatures(gram, of, len(rows))
    sig = sig.astype(np.uint32)
    # brute force: all pairs that share the first minima in any tree, verified
    group = np.arange(len(rows))
    for i in range(len(rows)):
        same = (sig == sig[i]).reshape(-1, minhash.TREES, minhash.DEPTH)
        met = np.flatnonzero(same[:, :, : minhash.ROOT].all(2).any(1))
        like = (sig[met] == sig[i]).mean(1)
        roots = np.unique(group[met[like >= minhash.THRESHOLD]])
        group[np.isin(group, roots)] = roots[0]
    assert {(x["doc_id"], x["duplicate_of"]) for x in gone} == {(k, int(g)) for k, g in enumerate(group) if k != g}
    assert sum(group[2 * k] == group[2 * k + 1] for k in range(1500)) > 1350


def test_line_dedup(spark):
    a, b = "this line is long enough to count", "this line is long enogh to count"
    rows = [(1, f"{a}\nshort\nshort"), (2, f"{a}\nshort"), (3, b), (4, None), (5, ""), (None, a)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r["doc_id"], r["line_no"]) for r in linededup.repeated_lines(d).collect()}
    assert found == {(1, 2), (2, 0), (3, 0), (None, 0)}
    assert linededup.repeated_lines(d.limit(0)).count() == 0
    left = [bytes(random.Random(i).choices(b"abc", k=30)) for i in range(40)]
    right = [x[:7] + x[8:] + bytes([97 + i % 3]) * (i % 4) for i, x in enumerate(left)]
    exact = [linededup._small(x, y) for x, y in zip(left, right)]
    assert [min(v, 3) for v in linededup.distances(left, right)] == [min(v, 3) for v in exact]


def test_quality(spark, docs):
    out = quality.scored(docs).collect()
    assert len(out) == docs.count() and all(r["quality"] == 0 for r in out if not (r["text"] or "").strip())
    assert quality.good_documents(docs).columns == docs.columns
    assert quality.good_documents(docs.limit(0)).count() == 0


def test_bpe(spark, docs):
    out = bpe.encoded(docs, check=True).collect()
    assert len(out) == docs.count() and all(r["intact"] is (None if r["text"] is None else True) for r in out)
    back = bpe.decoded(bpe.encoded(docs)).where("not (decoded <=> text)").count()
    assert back == 0 and bpe.encoded(docs.limit(0)).count() == 0
    words = bpe.vocabulary(bpe.read_vocabulary(bpe.VOCABULARY))

    def greedy(piece):
        t = [int(words.of_byte[b]) for b in piece]
        while ranked := [(words.pairs[p], i) for i, p in enumerate(zip(t, t[1:])) if p in words.pairs]:
            rank, i = min(ranked)
            t[i : i + 2] = [rank]
        return t

    for piece in (b"abracadabra" * 9, b" hello", b"a" * 70, "ünï".encode()):
        assert words.encode_long(piece) == greedy(piece)
        if len(piece) <= 64:
            tokens, _ = words.encode_narrow(np.frombuffer(piece.ljust(64, b"\0"), np.uint8)[None], np.array([len(piece)]))
            assert tokens.tolist() == greedy(piece)


def test_mixing(spark, docs):
    out = mixing.schedule(docs, block_tokens=16).collect()
    assert len({(r["source"], r["block"], r["epoch"], r["doc_id"], r["from_token"]) for r in out}) == len(out)
    assert {r["doc_id"] for r in out} == {1, 2, 3, 7, 9, 10, None}
    assert mixing.mixed(docs).columns == docs.columns and mixing.schedule(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.schedule(docs, weights={"a": 1.0})


def test_mixing_unfinished_source(spark):
    d = spark.createDataFrame([(1, "w w", "tiny"), *((k, f"w{k} " * 100, "hot") for k in range(10, 1210))], "doc_id bigint, text string, source string")
    out = mixing.schedule(d, block_tokens=2).select("doc_id", "source", "epoch").distinct().collect()
    # the end of the tiny source's first pass isn't the end of the schedule
    assert {r["epoch"] for r in out if r["source"] == "tiny"} == set(range(mixing.MAX_EPOCHS))
    assert len({r["doc_id"] for r in out if r["source"] == "hot"}) > 200


def test_mixing_keeps_all(spark):
    for parts, blocks in (([5, 90, 400, 7], [1, 40, 900, 2]), ([1, 10**9, 3], [2, 3, 50]), ([1, 10**12], [5, 7]), ([7], [3]), ([0, 3], [4, 5]), ([3, 10**9], [1, 10**5])):
        ends = mixing.edges(mixing.lowered(parts, blocks, 4))
        points = mixing.points_needed(ends, np.array(blocks))
        own, had, drawn = mixing.owners(0, points, ends), [0] * len(parts), []
        for k in own.tolist():
            if had[k] < 4 * blocks[k]:
                drawn.append((len(drawn), k, had[k] % blocks[k], had[k] // blocks[k]))
                had[k] += 1
        assert ends[-1] == mixing.UNIT and all(b <= h <= 4 * b if p else not h for h, b, p in zip(had, blocks, parts))
        laid = mixing.slots(spark, points, ends, np.array(blocks), 4)
        assert sorted(tuple(r) for r in laid.collect()) == drawn
    d = spark.createDataFrame([(1, "w w", "tiny"), (2, "w " * 40, None), *((k, f"w{k} " * 100, "hot") for k in range(10, 1210))], "doc_id bigint, text string, source string")
    out = mixing.schedule(d, block_tokens=2).select("doc_id", "source", "slot", "epoch", "block").distinct().collect()
    assert {r["doc_id"] for r in out} == {1, 2, *range(10, 1210)} and max(r["epoch"] for r in out) < mixing.MAX_EPOCHS
    assert {r["block"] for r in out if r["source"] == "hot"} == set(range(60000))
    assert {r["slot"] for r in out} == set(range(len({(r["source"], r["epoch"], r["block"]) for r in out})))
    assert {r["doc_id"] for r in mixing.mixed(d, block_tokens=2).select("doc_id").distinct().collect()} == {1, 2, *range(10, 1210)}
    assert {r["source"] for r in mixing.schedule(d, weights={"tiny": 0, None: 1e-12, "hot": 1.0}, block_tokens=2).select("source").distinct().collect()} == {None, "hot"}


def test_topk(spark):
    r = np.random.default_rng(2)
    for _ in range(30):
        n, m, k = 40, 5, 4
        lists = [np.sort(r.integers(1, 9, r.integers(1, n)))[::-1] for _ in range(m)]
        doc = np.concatenate([r.permutation(n)[: len(x)] for x in lists])
        share = np.concatenate(lists)
        whole = np.bincount(doc, share, n).astype(int)
        found, score = topk.aggregate(doc, share, np.cumsum([0, *map(len, lists)])[:-1], n, k)
        want = sorted(range(n), key=lambda d: (-whole[d], d))[:k]
        assert sorted(zip(-score, found))[:k] == [(-whole[d], d) for d in want if whole[d] > 0]
    d = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, None), (None, "red"), (4, ""), (5, "red fox")], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "Fox!"), (2, None), (3, "")], "item_id bigint, text string")
    assert [(x["item_id"], x["rank"], x["doc_id"]) for x in topk.search(q, d).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 5)]
    assert topk.search(q.limit(0), d).count() == 0 and topk.search(q, d.limit(0)).count() == 0
    assert topk.search(q, d, max_terms=1).count() == 2


def test_html(spark):
    parent = np.array([0, 0, 0, 1, 1])
    root = np.array([True, False, False, False, False])
    levels = [np.array([0]), np.array([1, 2]), np.array([3, 4])]
    r = np.random.default_rng(1)
    own, first, step = r.normal(size=(5, 2)), np.log([0.4, 0.6]), np.log([[0.8, 0.2], [0.3, 0.7]])
    total, ones = 0.0, np.zeros(5)
    for y in itertools.product((0, 1), repeat=5):
        p = math.exp(first[y[0]] + sum(own[i, y[i]] for i in range(5)) + sum(step[y[parent[i]], y[i]] for i in range(1, 5)))
        total, ones = total + p, ones + p * np.array(y)
    assert np.allclose(htmltree.marginals(parent, root, levels, own, first, step), ones / total)
    page = "<html><body><nav><a href=x>Home</a></nav><article><p>Long text, it is. And more &amp; more.<br>Next</article><footer>foot</footer>"
    pages = spark.createDataFrame([(1, page), (2, None), (3, ""), (None, page), (4, "plain")], "page_id bigint, html string")
    out = {x["page_id"]: x["text"] for x in htmltree.extract(pages, htmltree.fit(pages)).collect()}
    assert out[1] == "Long text, it is. And more & more.\nNext" and out[2] == out[3] == ""
    assert {x["text"] for x in htmltree.extract(pages.where("page_id = 4"), None).collect()} == {"plain"}


def test_warc(spark):
    pages = spark.createDataFrame([(7, "http://x/%41 b", "<p>é</p>" * 50), (8, None, None), (None, "u", "t"), (7, "http://x", "again")], "page_id bigint, url string, html string").coalesce(1)
    out = warc.pages_of(warc.read_archives(warc.write_archives(pages, damage={"torn": (50, 7)}))).collect()
    assert sorted((x["kind"], str(x["page_id"]), str(x["url"])) for x in out) == sorted([("gap", "None", "None")] * 2 + [("record", "7", "http://x/%41 b"), ("record", "8", "None"), ("record", "None", "u"), ("record", "7", "http://x")])
    assert list(warc.salvage(b"")) == [] and [x[0] for x in warc.salvage(b"junk")] == ["gap"]


def test_warc_long_url():
    url = "http://x/" + "a b" * 100_000
    one = warc.record(1, url, b"page")
    for data in (warc.member(one), one, one[:-9] + warc.member(one)):
        found = list(warc.salvage(data))
        assert [x[4] for x in found if x[0] == "record"] == [b"page"] and found[-1][3]["warc-target-uri"] == url.replace(" ", "%20")
    assert [x[0] for x in warc.salvage(one[:200_000])] == ["gap"]


def test_media(spark):
    for kind in range(1, 8):
        for n in (1, 2, 50):
            data = bytes(random.Random(n).randrange(256) for _ in range(n))
            flat = media.decode(media.picture(data, kind)).ravel()[:n].tolist()
            assert flat == (list(data) if kind not in (1, 4) else [255 * (1 - b % 2) for b in data])
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    fine = np.kron(image, np.ones((5, 5)))  # a fifth of a pixel each
    whole = fine.reshape(5, 3, 5, 4).mean((1, 3))
    assert np.allclose(media.box_sums(media.integral(image), 5, 5) / image.size, whole)
    rows = spark.createDataFrame([(1, bytearray(b"P5\n2 1\n255\n\x01\x02")), (2, None), (3, bytearray(b"P5\n9 9\n255\n")), (4, bytearray(b"?"))], "id bigint, image binary")
    out = {r["id"]: (r["width"], r["error"]) for r in media.tiles(rows).collect()}
    assert out == {1: (2, None), 2: (None, "empty"), 3: (None, "cut short"), 4: (None, "unknown kind")}


def test_records(spark, docs):
    assert [hex(x) for x in records.crc32c([b"123456789", b"", b"\0" * 32])] == ["0xe3069283", "0x0", "0x8a9136aa"]
    tokens = bpe.encoded(docs.select("doc_id", "text"))
    folder, index = records.write_records(tokens, shard_bytes=5000)
    back = records.read_records(folder, index, seed=3)
    same = lambda d: sorted((str(r["doc_id"]), r["tokens"]) for r in d.select("doc_id", "tokens").collect())
    assert same(back) == same(tokens.where("tokens is not null"))
    frames = records.frame([b"abc", b""])
    assert records.unframe([frames[0], frames[1], frames[0][:-1] + b"x", b""]) == [b"abc", b"", None, None]


def test_pipeline_columns(spark, docs):
    import corpus_pipeline

    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, plain, "").columns == plain.columns
