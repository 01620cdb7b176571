"""Near-duplicate documents by MinHash and an LSH forest.

Each document is the set of its word ``SHINGLE``-grams (lower case, punctuation dropped). Its signature holds
``TREES * DEPTH`` minima. Every tree of the forest orders all documents by ``DEPTH`` of them, so those whose labels
begin with the same ``ROOT`` values lie side by side, as a region. All members of a region meet, however many they
are, and are verified there by the share of equal minima, so no pairs are shuffled; only members of regions of two and
more get there with their signatures. Equal signatures are one member, and what is connected already isn't compared
again: copies take work in proportion to their number. A region gives edges that connect what all its verified pairs
would. One of more than ``CROWD`` members is dealt out in blocks, every two of which meet in a task of their own. Groups
are the connected components.

Documents with the same words in the same order are one from the start; they are told by a 128-bit BLAKE2 hash of those.

Defined results: a document that is null, empty or white space is in no group. One without a word but with other
characters is in a group with its exact copies. Ids are of any type that has an order; a null id is one, after the
others. Rows that repeat id and text are one document; of two texts with one id the order goes by a hash of the text.
Other columns of the input are never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import drop_written, small_batches, written
from . import columnar as C

SHINGLE = 3
TREES = 16
DEPTH = 8
ROOT = 2
#: Regions of up to so many members are worked on together, larger ones each on its own.
SMALL = 16
#: Regions of more members than this are split into blocks of about half as many.
CROWD = 4096
_PAIRS = 1 << 13
THRESHOLD = 0.5

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)


def _whole(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, bare: np.ndarray) -> np.ndarray:
    """Hashes of 16 bytes: of each row's words in order, or of all its bytes where it has none but isn't blank."""
    size = end - start + 1
    text = data[np.minimum(C.spread(start, size), len(data) - 1)] if len(start) else np.zeros(0, np.uint8)
    text[np.cumsum(size) - 1] = 32
    ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))].tolist()
    view, out = memoryview(text.tobytes()), bytearray(16 * len(count))
    for i in np.flatnonzero(count).tolist():
        out[16 * i : 16 * i + 16] = hashlib.blake2b(view[ends[i] : ends[i + 1]], digest_size=16).digest()
    for i in bare.tolist():
        out[16 * i : 16 * i + 16] = hashlib.blake2b(data[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16, person=b"bytes").digest()
    return np.frombuffer(bytes(out), np.uint8).reshape(-1, 16)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of word n-grams, the row of each, and a 128-bit hash of each row's words (0 without content).

    A row of fewer than n words has one shingle of all its words; one without words has one of its bytes,
    unless they are white space.
    """
    data = C.LOWER[data]
    rows = len(offsets) - 1
    start, end, row = C.words(data, offsets)
    each = C.span_hashes(C.prefix_hashes(data), start, end)
    count = np.bincount(row, minlength=rows)
    bare = np.flatnonzero((count == 0) & (np.diff(offsets) > 0))
    blank = np.array([not data[offsets[i] : offsets[i + 1]].tobytes().strip() for i in bare], bool)
    bare = bare[~blank]
    whole = _whole(data, offsets, start, end, count, bare)
    if len(each) >= n:
        gram = each[: len(each) - n + 1].copy()
        for i in range(1, n):
            gram = C.mix(gram * np.uint64(3) + each[i : len(each) - n + 1 + i])
        fits = row[: len(gram)] == row[n - 1 :]
        gram, of = gram[fits], row[: len(gram)][fits]
    else:
        gram, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.concatenate((np.flatnonzero((count > 0) & (count < n)), bare))
    gram, of = np.concatenate((gram, np.ascontiguousarray(whole[short, :8]).view(np.uint64).ravel())), np.concatenate((of, short))
    order = np.argsort(of, kind="stable")
    return gram[order], of[order], whole


def signatures(gram: np.ndarray, of: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have shingles, and for each of them its minima as 32-bit integers."""
    present, first = np.unique(of, return_index=True)
    out = np.empty((len(present), len(_MUL)), ">u4")
    if len(present):
        step = 1 << 14  # shingles at a time, in cache
        lead = np.searchsorted(first, np.arange(0, len(gram), step), "right") - 1
        out[:] = 0xFFFFFFFF
        low = np.full((len(_MUL), len(present)), np.uint64(0xFFFFFFFFFFFFFFFF))
        for at, seg in zip(range(0, len(gram), step), lead):
            x = gram[at : at + step]
            last = int(np.searchsorted(first, at + len(x), "left"))
            cut = np.maximum(first[seg:last] - at, 0)
            for k in range(len(_MUL)):
                np.minimum(low[k, seg:last], np.minimum.reduceat(x * _MUL[k] + _ADD[k], cut), out=low[k, seg:last])
        out[:] = (low >> np.uint64(32)).T
    return present, out


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    at = pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, at, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = C.utf8(batch.column("text"))
        for a, b in C.chunks(offsets):
            own = offsets[a : b + 1] - offsets[a]
            gram, of, whole = shingles(data[offsets[a] : offsets[b]], own)
            present, sig = signatures(gram, of, b - a)
            some = pa.array(present + a)
            columns = [batch.column("doc").take(some), batch.column("mark").take(some), _binary(whole[present]), _binary(sig.view("u1"))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "mark", "words", "sig"])


def _alike(equal: np.ndarray) -> np.ndarray:
    return equal / (TREES * DEPTH)


def _joined(sig: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of a region, the first row that it is connected to by pairs of at least ``threshold``."""
    _, first, copy = np.unique(np.ascontiguousarray(sig).view(f"V{4 * sig.shape[1]}").ravel(), return_index=True, return_inverse=True)
    columns = np.ascontiguousarray(sig[first].T)
    n = len(first)
    root = np.arange(n)
    step = 64
    for at in range(0, n, step):
        own = np.arange(at, min(at + step, n))
        others = np.arange(at + 1, n)
        if (root[own] == root[at]).all():
            others = others[root[others] != root[at]]
        for lead in range(0, len(others), 1 << 12):
            with_ = others[lead : lead + (1 << 12)]
            equal = np.zeros((len(own), len(with_)), np.uint8)
            for c in columns:
                equal += c[own][:, None] == c[with_][None, :]
            near = _alike(equal) >= threshold
            near &= root[own][:, None] != root[with_][None, :]
            for i in np.flatnonzero(near.any(1)):
                roots = np.unique(np.append(root[with_[near[i]]], root[own[i]]))
                if len(roots) > 1:
                    root[np.isin(root, roots)] = roots[0]
    # the first row of each component, in the order of the input
    least = np.full(n, len(sig))
    np.minimum.at(least, root[copy], np.arange(len(sig)))
    return least[root[copy]]


def _meet(threshold: float):
    """Edges (a, b) within the regions of rows sorted by root."""

    def edges(root: np.ndarray, node: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of whole regions."""
        first = np.flatnonzero(np.append(True, root[1:] != root[:-1]))
        size = np.diff(np.append(first, len(root)))
        end = np.repeat(first + size, size)
        small = np.repeat(size <= SMALL, size)
        for step in range(1, SMALL):
            left = np.flatnonzero(small & (np.arange(len(root)) + step < end))
            for at in range(0, len(left), _PAIRS):
                x = left[at : at + _PAIRS]
                x = x[_alike((sig[x] == sig[x + step]).sum(1)) >= threshold]
                yield joined(node[x], node[x + step])
        for k in np.flatnonzero(size > SMALL):
            own = np.arange(first[k], first[k] + size[k])
            to = own[_joined(sig[own], threshold)]
            yield joined(node[own[own != to]], node[to[own != to]])

    def joined(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_binary(x), _binary(y)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # the region that the rows so far end with
        for batch in batches:
            if not batch.num_rows:
                continue
            data = C.utf8(batch.column("root"))[0].reshape(batch.num_rows, -1)
            root = np.ascontiguousarray(data).view(f"V{data.shape[1]}").ravel()
            node, sig = (np.ascontiguousarray(C.utf8(batch.column(c))[0].reshape(batch.num_rows, -1)) for c in ("node", "sig"))
            rows = root, node, sig.view(np.uint32)
            other = np.flatnonzero(root != root[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            if held and root[0] != now:
                yield from edges(*(np.concatenate(v) for v in zip(*held)))
                held = []
            if cut:
                yield from edges(*(np.concatenate(v) for v in zip(*held, tuple(x[:cut] for x in rows))))
                held = []
            now = root[-1]
            held.append(tuple(x[cut:].copy() for x in rows))
        if held:
            yield from edges(*(np.concatenate(v) for v in zip(*held)))

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node of its component.

    Alternates large-star and small-star, each a minimum by one end of the edges joined to them again, until nothing
    changes; every round is written to the shared folder.
    """
    now, mark = written(edges.select("a", "b").where("a <> b").distinct(), name), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.join(down.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = least.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).where("a <> b").distinct()
        after = written(small, name)
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        drop_written(now)
        if sign == mark:
            return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now, mark = after, sign


def linked(reps: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """(a, b): edges that connect the documents (words, sig) which are alike and meet in some tree."""
    short = written(reps.mapInArrow(C.tidy(_rooted), "node binary, roots binary, sig binary"), "minhash-short")
    width = ROOT * 4
    root = F.explode(F.array([F.concat(F.lit(bytes([t])), F.substring("roots", t * width + 1, width)) for t in range(TREES)])).alias("root")
    rows = short.select(root, "node")
    sizes = rows.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    # every two blocks of a crowded region meet, as a region of their own
    blocks = (F.floor(F.col("n") / (crowd // 2)) + 1).cast("int")
    met = rows.join(sizes, "root").withColumn("of", F.when(F.col("n") <= crowd, 1).otherwise(blocks)).withColumn("own", F.pmod(F.xxhash64("node"), "of").cast("int"))

    def region(other: F.Column) -> F.Column:
        return F.concat("root", *(F.unhex(F.lpad(F.hex(f("own", other)), 8, "0")) for f in (F.least, F.greatest)))

    members = met.select(F.explode(F.transform(F.sequence(F.lit(0), F.col("of") - 1), region)).alias("root"), "node")
    signed = members.join(short.select("node", "sig"), "node")
    return signed.repartition("root").sortWithinPartitions("root", "node").mapInArrow(C.tidy(_meet(threshold)), "a binary, b binary")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """(doc, mark, first, first_mark): each document that repeats another, and the first of its group; mark is a hash of the text."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    pick = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"), F.lower(text).alias("text")).where("text is not null")
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("mark", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("sig", T.BinaryType())])
    signed = written(pick.mapInArrow(C.tidy(_sign), schema), "signatures")
    # copies of the same words are one document from here on
    roots = components(linked(signed.groupBy("words").agg(F.first("sig").alias("sig")), threshold, crowd))
    keyed = signed.select("words", F.struct(F.col("doc").isNull().alias("last"), "doc", "mark").alias("own")).join(roots, F.col("words") == F.col("node"), "left").select("own", F.coalesce("root", "words").alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("own").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = keyed.join(firsts, "key").where("own <> first")
    return found.select("own.doc", "own.mark", F.col("first.doc").alias("first"), F.col("first.mark").alias("first_mark")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """(doc_id, duplicate_of): each document that repeats another, with the first id of its group.

    Documents in no group and the first of each group have no row.
    """
    found = copies(docs, id_col, text_col, threshold, crowd).where("not (doc <=> first)")
    return found.select(F.col("doc").alias("doc_id"), F.col("first").alias("duplicate_of")).distinct()


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The input without documents that repeat another, and with one of the rows that repeat an id and a text.

    Where those differ in other columns the one with the least hash of all its columns stays.
    """
    mark, doc, own = (C.free(f"__cs_{n}", docs.columns) for n in ("mark", "doc", "own"))
    text = F.xxhash64(F.col(text_col).cast("string"))
    gone = copies(docs, id_col, text_col, threshold).select(F.col("doc").alias(doc), F.col("mark").alias(mark))
    rows = docs.withColumn(own, text)
    same = (F.col(own) == F.col(mark)) & F.col(f"`{id_col}`").eqNullSafe(F.col(doc))
    kept = rows.join(gone, same, "left_anti")
    twice = written(docs.select(F.col(id_col).alias(doc), text.alias(mark)).where(F.col(text_col).isNotNull()).groupBy(doc, mark).count().where("count > 1").drop("count"), "minhash-twice")
    if not twice.isEmpty():
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        by = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))
        alone = kept.join(twice, same, "left_semi").groupBy(F.col(own).alias(mark), F.col(f"`{id_col}`").alias(doc)).agg(F.min_by(whole, by).alias(own)).select(f"{own}.*")
        kept = kept.join(twice, same, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(alone)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first ROOT minima of each tree beside the signature."""
    for batch in batches:
        n = batch.num_rows
        sig = C.utf8(batch.column("sig"))[0].reshape(n, TREES * DEPTH * 4)
        roots = sig.reshape(n, TREES, DEPTH * 4)[:, :, : ROOT * 4].reshape(n, TREES * ROOT * 4)
        yield pa.RecordBatch.from_arrays([batch.column("words"), _binary(roots), batch.column("sig")], names=["node", "roots", "sig"])
