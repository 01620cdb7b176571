"""Whole results against brute force: all pairs, all places, one thing at a time."""

import io
import itertools
import math
import random
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import regex

from cindersift.llm import bpe, htmltree, linededup, media, minhash, mixing, quality, records, topk, warc

SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu".split()


def words(r, n):
    return [r.choice(SYLLABLES) + r.choice(SYLLABLES) + r.choice(SYLLABLES) for _ in range(n)]


def edited(r, text, n):
    for _ in range(n):
        k = r.randrange(len(text))
        text = text[:k] + r.choice(["", "q", text[k] + "x"]) + text[k + 1 :]
    return text


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return {tuple(x) for x in con.execute(sql).fetchall()}, [d[0] for d in con.description]


def line_rows(seed=5):
    r = random.Random(seed)
    base = [" ".join(words(r, r.randrange(2, 14))) for _ in range(60)]
    licence = "licensed under the terms of "
    rows = []
    for i in range(150):
        own = [edited(r, r.choice(base), r.randrange(4)) for _ in range(r.randrange(1, 6))]
        own += [edited(r, licence + " ".join(words(r, 1)), r.randrange(2)), "", "  ", "short", " ".join(words(r, 5))]
        r.shuffle(own)
        rows.append((i * 7 % 151, "\n".join(own)))
    return rows


def lines_brute(rows):
    """{(doc, line): (doc, line, edits)} of lines to remove; rows (id, text) with ids that don't repeat."""
    lines = [(i, k, x) for i, t in sorted(rows) if t for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    first, gone = {}, {}
    for i, k, x in lines:
        n = len(x.encode())
        key = (x, i if n < linededup.MIN_BYTES else None)
        if key in first:
            gone[i, k] = (*first[key], 0)
            continue
        first[key] = (i, k)
        if n < linededup.MIN_BYTES:
            continue
        for (y, own), at in list(first.items()):
            if own is None and y != x and abs(len(y.encode()) - n) <= linededup.MAX_EDITS:
                e = linededup._small(*sorted((x.encode(), y.encode()), key=len))
                if e <= linededup.tolerance(min(n, len(y.encode()))):
                    gone[i, k] = min(gone.get((i, k), (1 << 60,)), (*at, e))
    return gone


def test_lines(spark):
    rows = line_rows()
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = lines_brute(rows)
    near = sum(v[2] > 0 for v in want.values())
    assert near > 30
    for crowd in (linededup.CROWD, 6):
        found = linededup.repeated_lines(table, crowd=crowd).collect()
        assert len(found) == len(want) and {(x[0], x[1]): tuple(x[2:]) for x in found} == want
    sql, names = duck(linededup.oracle(), documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert names == ["doc_id", "line_no", "of_doc_id", "of_line_no", "edits"] and {(x[0], x[1]): x[2:] for x in sql} == want
    left = {x["doc_id"]: x["text"] for x in linededup.without_repeated_lines(table).collect()}
    for i, text in rows:
        kept = [x for k, x in enumerate(text.split("\n")) if (i, k) not in want]
        assert left.get(i) == ("\n".join(kept) if any(x.strip() for x in kept) else None)


def test_lines_by_id_and_text(spark):
    long = "one long line that is in two documents"
    rows = [("1", long), ("2", long + "\nwhat only this text says, and none else"), ("2", "first unique line of this text\nsecond"), ("2", "first unique line of this text\nsecond"), (None, long), ("3", long), ("4", "\n \n"), ("5", None)]
    table = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id string, text string, drops int")
    left = linededup.without_repeated_lines(table)
    assert left.columns == table.columns
    assert sorted(((x[0], x[1]) for x in left.collect()), key=str) == sorted([("1", long), ("2", "what only this text says, and none else"), *[("2", "first unique line of this text\nsecond")] * 2, ("4", "\n \n"), ("5", None)], key=str)


def copies_brute(rows):
    """First id of each group, by exact signatures of all pairs; rows (id, text)."""
    data = "".join(t.lower() for _, t in rows).encode()
    offsets = np.cumsum([0] + [len(t.lower().encode()) for _, t in rows])
    gram, of, whole = minhash.shingles(np.frombuffer(data, np.uint8), offsets)
    present, sig = minhash.signatures(gram, of, len(rows))
    sig, group = sig.astype(np.uint32), list(range(len(rows)))
    for x, y in itertools.combinations(range(len(present)), 2):
        i, j = int(present[x]), int(present[y])
        same = sig[x] == sig[y]
        met = same.reshape(minhash.TREES, minhash.DEPTH)[:, : minhash.ROOT].all(1).any()
        if (whole[i] == whole[j]).all() or (met and same.mean() >= minhash.THRESHOLD):
            a, b = group[i], group[j]
            group = [min(a, b) if g in (a, b) else g for g in group]
    return {rows[k][0]: rows[g][0] for k, g in enumerate(group) if g != k}


def test_copies(spark):
    r = random.Random(8)
    shared, rows = words(r, 60), []
    for i in range(120):
        own = words(r, 80)
        rows += [(10 * i, " ".join(own + shared * (i % 3 == 0))), (10 * i + 1, " ".join(edited(r, w, r.random() < 0.02 * (i % 12)) for w in own))]
    rows += [(5000, "!?"), (5001, "!?"), (5002, "a b"), (5003, "A, b!")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = copies_brute(rows)
    assert {(x[0], x[1]) for x in minhash.near_duplicates(table).collect()} == set(want.items()) and 40 < len(want) < 130
    # against exact Jaccard: what is clearly alike is found, and what is clearly not stays
    grams = {i: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for i, t in rows[:-4]}
    for i in range(120):
        a, b = grams[10 * i], grams[10 * i + 1]
        share = len(a & b) / len(a | b)
        assert share < 0.7 or want.get(10 * i + 1) == 10 * i
        assert share > 0.3 or 10 * i + 1 not in want


def test_copies_by_id_and_text(spark):
    rows = [("a", "x y z w"), ("b", "x y z w"), (None, "x y z w"), ("c", "q"), ("c", "q"), ("b", "only here"), ("d", ""), ("d", None), (None, "n n")]
    table = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id string, text string, mark int")
    assert {(x[0], x[1]) for x in minhash.near_duplicates(table).collect()} == {("b", "a"), (None, "a")}
    kept = minhash.without_copies(table)
    assert kept.columns == table.columns
    twice = spark.createDataFrame([(1, "t", "x"), (1, "t", "y"), (1, "t", "y"), (2, "u", "x")], "doc_id int, text string, source string")
    found = {tuple(r) for r in minhash.without_copies(twice).collect()}
    assert len(found) == 2 and all({tuple(r) for r in minhash.without_copies(twice.repartition(k)).collect()} == found for k in (1, 3))
    assert sorted(((x[0], x[1]) for x in kept.collect()), key=str) == sorted([("a", "x y z w"), ("c", "q"), ("b", "only here"), ("d", ""), ("d", None), (None, "n n")], key=str)


def test_schedule_sql(spark):
    rows = [(1, "w w", "tiny"), (2, "w " * 41, None), *((k, f"w{k} " * (50 + k % 60), "hot") for k in range(10, 500)), (600, "", "hot"), (601, None, "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for block in (3, 2048):
        want, names = duck(mixing.oracle(block=block), documents=pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
        got = mixing.schedule(table, block_tokens=block).select(names).collect()
        assert len(got) == len(want) and {tuple(x) for x in got} == want
        assert {x["doc_id"] for x in got} == {i for i, t, _ in rows if t and t.strip()} and max(x["epoch"] for x in got) < mixing.MAX_EPOCHS


def test_topk_sql(spark):
    r = random.Random(4)
    docs = [(i, " ".join(words(r, r.randrange(1, 40))) + " und " * (i % 3)) for i in range(300)] + [(400, None), (401, "")]
    asked = [(i, " ".join(words(r, 3))) for i in range(20)] + [(20, " ".join(words(r, 4000))), (21, None), (22, "?")]
    want, names = duck(topk.oracle(), documents=pd.DataFrame(docs, columns=["doc_id", "text"]), benchmark=pd.DataFrame(asked, columns=["item_id", "text"]))
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), spark.createDataFrame(asked, "item_id bigint, text string")
    assert {tuple(x) for x in topk.search(q, d).select(names).collect()} == want
    assert {tuple(x) for x in topk.search(q, d, max_terms=500).select(names).collect()} == want
    text = topk.search(q.selectExpr("concat('q', item_id) item_id", "text"), d.selectExpr("concat('d', lpad(doc_id, 4, '0')) doc_id", "text")).collect()
    assert {(int(x["item_id"][1:]), x["rank"], int(x["doc_id"][1:]), x["score"]) for x in text} == {tuple(row[names.index(n)] for n in ("item_id", "rank", "doc_id", "score")) for row in want}


PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def greedy(vocabulary, piece):
    t = [int(vocabulary.of_byte[b]) for b in piece]
    while ranked := [(vocabulary.pairs[p], i) for i, p in enumerate(zip(t, t[1:])) if p in vocabulary.pairs]:
        rank, i = min(ranked)
        t[i : i + 2] = [rank]
    return t


def packed(rows):
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0] + [len(x) for x in rows])


def test_bpe_against_regex_and_greedy():
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(bpe.VOCABULARY))
    r = random.Random(6)
    alphabets = ["abc xyz  \n\t'sdmtlvre", "äöüß éñç", "привет мир ", "你好 世界。", "สวัสดี ", "0123 ٣٤ ½²", "!?.,;-—“”", "👍🏽 ‍ 　", "ABC's WE'LL"]
    rows = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(120))).encode() for _ in range(400)]
    rows += [("word" * n).encode() for n in (20, 60, 129, 200)] + [b"", b"'", b" ", "ü".encode() * 300]
    tokens, counts = vocabulary.encode(*packed(rows))
    ends = np.concatenate(([0], np.cumsum(counts)))
    for i, row in enumerate(rows):
        pieces = [x.encode() for x in PIECE.findall(row.decode())]
        assert b"".join(pieces) == row
        assert tokens[ends[i] : ends[i + 1]].tolist() == [t for p in pieces for t in greedy(vocabulary, p)]
    again, _ = vocabulary.encode(*packed(rows))
    assert again.tolist() == tokens.tolist()


def test_bpe_colliding_pieces(spark):
    # Thue-Morse strings collide under every polynomial hash modulo 2 ** 64
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    vocabulary = bpe.Vocabulary(bpe.read_vocabulary(bpe.VOCABULARY))
    for rows in ([one, other], [other], [one, "x", other]):
        data, offsets = packed([x.encode() for x in rows])
        tokens, counts = vocabulary.encode(data, offsets)
        assert vocabulary.decode(tokens, counts)[0].tobytes() == data.tobytes()
        assert tokens.tolist() == [t for x in rows for t in vocabulary.encode_long(x.encode())]
    table = spark.createDataFrame([(1, one, 3), (2, other, 4), (3, "a" * 200_000, 5), (4, None, 6)], "doc_id int, text string, tokens int")
    out = bpe.encoded(table, check=True)
    assert out.columns == ["doc_id", "text", "tokens", "tokens_", "n_tokens", "intact"] and all(x["intact"] is (None if x["doc_id"] == 4 else True) for x in out.collect())
    assert bpe.decoded(out.withColumnRenamed("intact", "decoded"), "tokens_").where("decoded_ <=> text").count() == 4


def test_labellers():
    m = len(quality.LABELLERS)
    r = np.random.default_rng(3)
    patterns = np.unique(r.choice([0, 1, 2], (60, m), p=[0.1, 0.2, 0.7]), axis=0)
    counts = r.integers(1, 500, len(patterns)).astype(float)
    good, right, share = quality.fit_labellers(patterns, counts)
    # one pattern, class and labeller at a time
    of = []
    for p in patterns:
        bad = [k for k in range(m) if p[k] == 0]
        of.append([0.05 if bad else 1.0] + [0.95 / len(bad) if k in bad else 0.0 for k in range(m)])
    for _ in range(200):
        size = [sum(n * o[c] for n, o in zip(counts, of)) / counts.sum() for c in range(m + 1)]
        says = []
        for c in range(m + 1):
            row = []
            for k in range(m):
                no = 0.5 + sum(n * o[c] for n, o, p in zip(counts, of, patterns) if p[k] == 0)
                yes = 0.5 + sum(n * o[c] for n, o, p in zip(counts, of, patterns) if p[k] == 2)
                no, yes = no / (no + yes), yes / (no + yes)
                if c == 0:
                    no, yes = min(no, quality.FALSE_ALARMS), max(yes, 1 - quality.FALSE_ALARMS)
                elif c == k + 1:
                    no, yes = max(no, 0.5), min(yes, 0.5)
                row.append((no, yes))
            says.append(row)
        new = []
        for p in patterns:
            odds = [max(size[c], 1e-300) * math.prod(says[c][k][0 if p[k] == 0 else 1] for k in range(m) if p[k] != 1) for c in range(m + 1)]
            new.append([x / sum(odds) for x in odds])
        moved, of = max(abs(a - b) for x, y in zip(of, new) for a, b in zip(x, y)), new
        if moved < 1e-9:
            break
    assert np.allclose(good, [x[0] for x in of], atol=1e-6) and 0 < share < 1 and len(right) == m


def statistics_brute(text):
    solid = [b for b in text if b not in b" \t\r\n\x0b\x0c"]
    parts = [x for x in regex.split(rb"[ \t\r\n\x0b\x0c]+", text) if x]
    letters = [b for b in text if chr(b).isascii() and chr(b).isalpha()]
    word = lambda b: b >= 128 or chr(b).isalnum()
    n, s = max(len(parts), 1), max(len(solid), 1)
    return {
        "words": len(parts), "symbol_share": sum(b in b"#$%&*|@^~=<>{}[]\\+_" for b in text) / s, "capital_share": sum(65 <= b <= 90 for b in text) / max(len(letters), 1),
        "echo_share": sum(a == b for a, b in zip(parts, parts[1:])) / n, "shout_rate": text.count(b"!") / n, "ragged_share": sum(len(x) >= 3 and not word(x[-1]) and not word(x[-2]) for x in parts) / n,
        "bar_rate": text.count(b"|") / n, "digit_share": sum(48 <= b <= 57 for b in text) / s, "word_length": s / n,
    }


def score_brute(weights, text):
    if not text.strip(b" \t\r\n\x0b\x0c"):
        return 0.0
    stats = statistics_brute(text)
    grams = [((text[k] << 16 | text[k + 1] << 8 | text[k + 2]) * 2654435761 & 0xFFFFFFFF) >> 32 - quality.BITS for k in range(len(text) - 2)]
    odds = weights[quality.SIZE] + quality._GRAM_SCALE * sum(weights[g] for g in grams) / max(len(grams), 1)
    for k, name in enumerate(quality.STATISTICS):
        odds += 0.5 * weights[(1 << quality.BITS) + 16 * k + min(15, int(math.sqrt(min(1, stats[name] / (40 if name == "word_length" else 1))) * 15))]
    return 1 / (1 + math.exp(-max(-40, min(40, odds))))


def test_quality_scores(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab AB 1!|#é.,\n  ") for _ in range(r.randrange(300))).encode() for _ in range(150)] + [b"", b" \n", b"ab", b"!!! !!! !!!"]
    data, offsets = packed(texts)
    stats = quality.statistics(data, offsets)
    for i, t in enumerate(texts):
        assert all(stats[k][i] == pytest.approx(v) for k, v in statistics_brute(t).items() if k != "word_length" or t.strip())
    weights = np.random.default_rng(1).normal(size=quality.SIZE + 1)
    assert np.allclose(quality.score_texts(weights, pa.array(texts, pa.binary())), [score_brute(weights, t) for t in texts], atol=1e-5)
    # held-out accuracy: prose against symbols, shouting and echoes, from a fit without labels
    good = lambda: " ".join(words(r, 60)).capitalize() + "."
    kinds = [lambda: "".join(r.choice("#$%&*|@^~") for _ in range(200)), lambda: "BUY NOW!!! " * 20 + " ".join(words(r, 5)).upper() + "!!!", lambda: " ".join(w for x in words(r, 30) for w in (x, x))]
    rows = [(i, good() if i % 3 else r.choice(kinds)(), 7.0, i % 3 > 0) for i in range(900)]
    table = spark.createDataFrame(rows, "doc_id int, text string, quality double, fine boolean")
    seen, rest = table.where("doc_id < 600"), table.where("doc_id >= 600")
    scores = rest.select("fine", quality.scorer(quality.fit(seen))("text").alias("p")).collect()
    assert sum((x["p"] >= quality.THRESHOLD) == x["fine"] for x in scores) / len(scores) > 0.97
    both = quality.scored(rest)
    assert both.columns == [*table.columns, "quality_"] and both.where("quality <> 7").count() == 0


def test_html_trees():
    r = random.Random(7)
    tags = ["div", "p", "a", "ul", "li", "b", "article", "td"]

    def make(depth):
        return "".join(r.choice([f"text {r.randrange(99)}, ", f"<{(t := r.choice(tags))} class=c{r.randrange(3)}>{make(depth - 1)}</{t}>"]) for _ in range(r.randrange(1, 4))) if depth else "x."

    pages = [htmltree.parse(make(2)) for _ in range(60)]
    small = [p for p in pages if len(p.parent) <= 9]
    forest = htmltree.Forest(pages)
    for p, first in zip(pages, forest.first):
        below = [[j for j in range(len(p.parent)) if i in ancestors(p, j)] for i in range(len(p.parent))]
        linked = [any(p.tag[k] == "a" for k in ancestors(p, i)) for i in range(len(p.parent))]
        for i in range(len(p.parent)):
            size = sum(len(p.text[j]) for j in below[i])
            f = forest.features[:, first + i]
            assert f[2] == min(int(math.log2(size + 1) * 1.2), 17) and f[3] == min(int(sum(len(p.text[j]) for j in below[i] if linked[j]) / max(size, 1) * 5), 5)
            assert f[4] == min(int(sum(p.text[j].count(",") + p.text[j].count(".") for j in below[i]) / max(size, 1) * 100), 5) and f[6] == min(len(ancestors(p, i)) - 1, 11)
    assert len(small) > 8
    forest = htmltree.Forest(small)
    g = np.random.default_rng(2)
    own, root, step = g.normal(size=(len(forest.parent), 2)), np.log([0.3, 0.7]), np.log([[0.9, 0.1], [0.4, 0.6]])
    found = htmltree.marginals(forest.parent, forest.root, forest.levels, own, root, step)
    for p, first in zip(small, forest.first):
        total, ones = 0.0, np.zeros(len(p.parent))
        for y in itertools.product((0, 1), repeat=len(p.parent)):
            weight = math.exp(root[y[0]] + sum(own[first + i, y[i]] for i in range(len(y))) + sum(step[y[p.parent[i]], y[i]] for i in range(1, len(y))))
            total, ones = total + weight, ones + weight * np.array(y)
        assert np.allclose(found[first : first + len(p.parent)], ones / total)


def ancestors(page, i):
    out = [i]
    while page.parent[out[-1]] >= 0:
        out.append(page.parent[out[-1]])
    return out


def test_html_held_out(spark):
    import time

    r = random.Random(9)

    def page(i):
        menu = "".join(f"<li class=nav><a href=/{k}>{r.choice(SYLLABLES)}</a></li>" for k in range(8))
        prose = "".join(f"<p class=body>{' '.join(words(r, 30))}, {' '.join(words(r, 9))}.</p>" for _ in range(r.randrange(2, 6)))
        return f"<html><body><div class=top><ul>{menu}</ul></div><{'main' if i % 2 else 'article'}>{prose}</{'main' if i % 2 else 'article'}><div class=foot><a href=x>about us</a></div></body></html>"

    rows = [(f"p{i}", page(i)) for i in range(120)] + [(None, None), ("e", ""), ("n", "<div>" * 20_000 + "deep")]
    table = spark.createDataFrame(rows, "page_id string, html string")
    model = htmltree.fit(table.where("page_id < 'p5'"))
    for x in htmltree.extract(table, model).collect():
        source = dict(rows)[x["page_id"]]
        if source and "<p" in source:
            assert x["text"] == "\n".join(regex.findall(r"<p class=body>(.*?)</p>", source))
    for hard in ("<a " * 350_000, "<div>" * 60_000, "<b>" * 50_000 + "</i>" * 50_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000):
        began = time.perf_counter()
        htmltree.parse(hard)
        assert time.perf_counter() - began < 2


def tile_brute(image, n):
    h, w = image.shape
    fine = np.kron(image.astype(object), np.ones((n, n), object))
    sums = fine.reshape(n, h, n, w).sum((1, 3))
    return np.vectorize(lambda s: int((2 * s + h * w) // (2 * h * w)))(sums)


def test_tiles(monkeypatch):
    g = np.random.default_rng(5)
    for h, w in ((1, 1), (3, 4), (5, 2), (13, 29), (40, 7), (64, 64)):
        image = g.integers(0, 256, (h, w)).astype(np.uint8)
        small, code = media.tile_and_hash(image, 6)
        assert (small == tile_brute(image, 6)).all()
        cells = np.kron(image.astype(np.int64), np.ones((8, 9), np.int64)).reshape(8, h, 9, w).sum((1, 3))
        bits = "".join("1" if cells[i, j] < cells[i, j + 1] else "0" for i in range(8) for j in range(8))
        assert code % (1 << 64) == int(bits, 2)
        monkeypatch.setattr(media, "_BAND", 8)
        banded, same = media.tile_and_hash(image, 6)
        monkeypatch.undo()
        assert (banded == small).all() and same == code
        assert (np.load(io.BytesIO(media.npy(small))) == small).all()
    colour = g.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    want = [[(299 * int(p[0]) + 587 * int(p[1]) + 114 * int(p[2])) // 1000 for p in row] for row in colour]
    assert media.grey(colour).tolist() == want


def bmp(width, height, bits, packed, body, extra=b"", size=40, start=None):
    head = struct.pack("<IiiHHIIiiII", size, width, height, 1, bits, packed, len(body), 0, 0, 0, 0)
    start = start or 14 + len(head) + len(extra)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + head + extra + body


def test_bmp_kinds():
    palette = b"".join(bytes([i, 2 * i, 3 * i, 0]) for i in range(4)) + bytes(4 * 12)
    want = [[0, 1, 2], [3, 2, 1]]
    colour = [[[3 * i, 2 * i, i] for i in row] for row in want]
    four = bytes([0x32, 0x10, 0, 0, 0x01, 0x20, 0, 0])
    assert media.decode(bmp(3, 2, 4, 0, four, palette)).tolist() == colour
    assert media.decode(bmp(3, 2, 4, 2, bytes([0, 3, 0x32, 0x10, 0, 0, 3, 0x01, 0, 0, 1]), palette)).tolist() == [[[0, 0, 0], [3, 2, 1], [0, 0, 0]], [[9, 6, 3], [6, 4, 2], [3, 2, 1]]]
    eight = palette + bytes(4 * 240)
    runs = bytes([0, 3, 3, 2, 1, 0, 0, 0, 1, 0, 2, 1, 0, 1])  # 3 2 1 as they are, next line, 0, then twice 1
    assert media.decode(bmp(3, 2, 8, 1, runs, eight)).tolist() == [[[0, 0, 0], [3, 2, 1], [3, 2, 1]], [[9, 6, 3], [6, 4, 2], [3, 2, 1]]]
    masks = struct.pack("<III", 0xFF, 0xFF00, 0xFF0000)
    assert media.decode(bmp(1, 1, 32, 3, bytes([10, 20, 30, 0]), masks)).tolist() == [[[10, 20, 30]]]
    assert media.decode(bmp(1, 1, 16, 3, struct.pack("<H", 0xF81F) + bytes(2), struct.pack("<III", 0xF800, 0x07E0, 0x001F))).tolist() == [[[255, 0, 255]]]
    assert media.decode(bmp(1, 1, 16, 0, struct.pack("<H", 0x03E0) + bytes(2))).tolist() == [[[0, 255, 0]]]
    core = b"BM" + struct.pack("<IHHI", 0, 0, 0, 26) + struct.pack("<IHHHH", 12, 1, 1, 1, 24) + bytes([1, 2, 3, 0])
    assert media.decode(core).tolist() == [[[3, 2, 1]]]
    for bad in (b"BM", bmp(3, 2, 4, 0, four[:3], palette), bmp(0, 2, 4, 0, four, palette), bmp(3, 2, 5, 0, four, palette)):
        with pytest.raises(media.BadImage):
            media.decode(bad)


def crc_brute(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def test_checksums(monkeypatch):
    r = random.Random(1)
    blobs = [r.randbytes(n) for n in [*range(141), 255, 256, 257, 1000, 20_001]]
    r.shuffle(blobs)
    want = [crc_brute(b) for b in blobs]
    assert records.crc32c(blobs).tolist() == want
    monkeypatch.setattr(records, "_CELLS", 300)
    assert records.crc32c(blobs).tolist() == want and records.crc32c([]).tolist() == []


def test_record_kinds(spark, tmp_path):
    rows = [("a", [1, 2, 70_000]), (None, [5]), ("é", []), ("a", [1, 2, 70_000]), ("n", None), ("z", list(range(300)) * 400)]
    table = spark.createDataFrame(rows, "doc_id string, tokens array<int>")
    folder, index = records.write_records(table, shard_bytes=1000)
    want = sorted(((i, t) for i, t in rows if t is not None), key=str)
    for seed in (None, 1, 2):
        back = records.read_records(folder, index, seed)
        assert sorted(((x["doc_id"], x["tokens"]) for x in back.collect()), key=str) == want and back.where("not ok or n_tokens <> size(tokens)").count() == 0
    shard = index.orderBy("length").first()
    path = f"{folder}/{shard['shard']}".removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[shard["offset"] + shard["length"] - 5] ^= 1
    open(path, "wb").write(bytes(data))
    bad = records.read_records(folder, index, 1, strict=False)
    assert bad.where("not ok and tokens is null").count() == 1 and bad.where("ok").count() == len(want) - 1
    with pytest.raises(Exception, match="damaged"):
        records.read_records(folder, index, 1).collect()


def test_salvage(spark, tmp_path):
    r = random.Random(3)
    for trial in range(150):
        blocks = [r.randbytes(r.randrange(400)) if r.random() < 0.5 else b"WARC/1.1\r\nfake " * r.randrange(9) for _ in range(8)]
        parts = [warc.record(i, None, b) for i, b in enumerate(blocks)]
        parts = [p if r.random() < 0.3 else warc.stored(p) if r.random() < 0.3 else warc.member(p) for p in parts]
        at = np.cumsum([0] + [len(p) for p in parts])
        hit = r.randrange(8)
        bad = bytearray(parts[hit])
        if trial % 2:
            bad = bad[: r.randrange(len(bad))]
        else:
            bad[r.randrange(len(bad))] ^= 1 << r.randrange(8)
        data = b"".join([*parts[:hit], bytes(bad), *parts[hit + 1 :]])
        found = list(warc.salvage(data))
        kept = [x[3].get("warc-record-id") for x in found if x[0] == "record"]
        assert {f"<urn:page:{i}>" for i in range(8) if i != hit} <= set(kept) and len(kept) <= 8
        # every byte is in a record or in a gap, in order
        whole = sorted({(x[1], x[2]) for x in found if x[2]})
        assert [a for a, _ in whole] == [0, *np.cumsum([n for _, n in whole])[:-1].tolist()] and sum(n for _, n in whole) == len(data)
        path = tmp_path / f"{trial}.warc.gz"
        path.write_bytes(data)
        with pa.OSFile(str(path)) as source:
            assert list(warc.salvage(warc.Window(source, len(data), 37))) == found
    inner = [warc.record(i, None, b"block %d" % i) for i in range(4)]
    broken = inner[:2] + [inner[2].replace(b"block 2", b"BLOCK 2")] + inner[3:]
    found = list(warc.salvage(warc.member(b"".join(broken))))
    assert [(x[0], x[4]) for x in found] == [("record", b"block 0"), ("record", b"block 1"), ("gap", None), ("record", b"block 3")]
    cut = zlib.compressobj(0, zlib.DEFLATED, 31)
    stream = (cut.compress(b"".join(inner)) + cut.flush())[:-40] + warc.member(inner[0])
    assert [x[4] for x in warc.salvage(stream) if x[0] == "record"] == [b"block 0", b"block 1", b"block 2", b"block 0"]
    out = warc.read_files(spark, [f"file://{tmp_path}/{t}.warc.gz" for t in range(3)])
    assert {x["archive"] for x in out.collect()} == {f"file://{tmp_path}/{t}.warc.gz" for t in range(3)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    shared = [" ".join(words(r, 12)) for _ in range(6)]
    rows = []
    for i in range(200):
        body = "\n".join([" ".join(words(r, 25)), r.choice(shared), " ".join(words(r, 25))])
        rows.append((i, body, "en", ["hot", "hot", "cold", None][i % 4], len(body)))
    rows += [(1000 + i, " ".join(rows[i][1].split(" ")[:-1]), "en", "hot", 9) for i in range(0, 40, 4)]
    rows += [(2000 + i, "#$%&*|@^~ " * 30, "en", "hot", 9) for i in range(9)] + [(3000, None, None, None, None), (3001, "", "en", "hot", 0), (None, " ".join(words(r, 40)), "en", "x", 5), (7, rows[7][1], "en", None, 9)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars int")
    table.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # brute force of each stage
    weights = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    docs = [(i, t, s) for i, t, _, s, _ in rows if t and score_brute(weights, t.encode()) >= quality.THRESHOLD]
    docs = sorted(set(docs), key=lambda x: (x[0] is None, x[0] or 0))
    numbered = list(enumerate(docs))
    gone, _ = duck(linededup.oracle(), documents=pd.DataFrame([(k, t) for k, (_, t, _) in numbered], columns=["doc_id", "text"]))
    gone = {x[:2] for x in gone}
    kept = []
    for k, (i, t, s) in numbered:
        left = [x for n, x in enumerate(t.split("\n")) if (k, n) not in gone]
        if any(x.strip() for x in left):
            kept.append((k, i, "\n".join(left), s))
    twice = copies_brute([(k, t) for k, _, t, _ in kept])
    kept = [x for x in kept if x[0] not in twice]
    frame = pd.DataFrame([(i, t, s) for _, i, t, s in kept], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    slots, names = duck(mixing.oracle(), documents=frame)
    vocabulary = bpe.vocabulary(bpe.read_vocabulary(bpe.VOCABULARY))
    tokens = {i: vocabulary.encode(*packed([t.encode()]))[0].tolist() for _, i, t, _ in kept}
    begins = sorted((x[names.index("slot")], x[names.index("doc_id")]) for x in slots if x[names.index("from_token")] == 0 and x[names.index("doc_id")] is not None)
    assert len(kept) < len(docs) < len(rows)
    mine = [(x["doc_id"], x["tokens"]) for x in out if x["doc_id"] is not None]
    assert sorted(mine) == sorted((i, tokens[i]) for _, i in begins) and all(x["intact"] for x in out)
    # in the order of the schedule: (part, row) against the slots
    order = [x["doc_id"] for x in sorted(out, key=lambda x: (x["part"], x["row"])) if x["doc_id"] is not None]
    slot_of = {}
    for s, i in begins:
        slot_of.setdefault(i, []).append(s)
    places = [slot_of[i].pop(0) for i in order]
    assert places == sorted(places)
