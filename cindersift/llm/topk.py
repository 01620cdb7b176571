"""Exact top-k search by no-random-access aggregation.

Every query is a text; each of its distinct words has a list of the documents that hold it, sorted by the word's
share of the score (BM25, as an integer in millionths). The lists are read in parallel from the top, never looked up
by document. What was read gives each document a lower bound of its score; the last share read of each list that has
not shown the document adds up to its upper bound. Reading stops when nobody outside the best k, seen or unseen, can
reach the k-th lower bound; the scores of those that remain are then resolved by reading on for them alone.

Documents stay where they are read: every task makes the lists of a stretch of its documents, keeps the best k of
each query, whose k-th score prunes the next stretch, and sends only those on. Document counts and lengths are of all
documents. Queries whose words don't fit ``MAX_TERMS`` are answered in groups, a pass over the documents for each.

Defined results: words are runs of letters and digits, lower case. Documents with a null id or text don't count;
repeated rows count each. Only documents that share a word with the query have a rank; equal scores are ranked by
id. Null, empty and wordless queries have no result. Rows with equal query ids are one query of all their words.
Ids are of any type that has an order; other columns are never read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches, written
from . import columnar as C

K = 10
K1, B = 1.2, 0.75
#: Words of queries that travel with each task at a time: 8 bytes each, and a few for each query that has them.
MAX_TERMS = 2_000_000
_STRETCH = 4 << 20
_FIRST_READ = 16


def _terms(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word and count of each word of the vocabulary in each row, and how many words each row has."""
    rows = len(offsets) - 1
    data = C.LOWER[data]
    start, end, row = C.words(data, offsets)
    length = np.bincount(row, minlength=rows)
    hashes = C.span_hashes(C.prefix_hashes(data), start, end)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    hit = vocabulary[at] == hashes
    key, count = np.unique(row[hit] * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count, length


def _stretches(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = C.utf8(batch.column("text"))
        for a, b in C.chunks(offsets, _STRETCH):
            yield batch.column(name).slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _query_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, data, offsets in _stretches(batches, "id"):
        low = C.LOWER[data]
        start, end, row = C.words(low, offsets)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(C.span_hashes(C.prefix_hashes(low), start, end).view(np.int64))], names=["id", "word"])


def _tally(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, words = np.zeros(len(vocabulary), np.int64), 0, 0
        for ids, data, offsets in _stretches(batches, "doc"):
            _, term, _, length = _terms(data, offsets, vocabulary)
            held += np.bincount(term, minlength=len(vocabulary))
            docs += len(ids)
            words += int(length.sum())
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], some)).astype(np.int64)), pa.array(np.concatenate(([words, docs], held[some])).astype(np.int64))], names=["term", "n"])

    return run


def shares(tf: np.ndarray, df: np.ndarray, length: np.ndarray, docs: int, words: int) -> np.ndarray:
    """A word's share of the score, in millionths."""
    idf = np.log(1 + (docs - df + 0.5) / (df + 0.5))
    return np.floor(idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * (length / (words / docs))))) * 1e6 + 0.5).astype(np.int64)


def aggregate(doc: np.ndarray, share: np.ndarray, starts: np.ndarray, n: int, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All documents (below n) that may be in the best k or reach ``floor``, with their whole scores.

    ``doc`` and ``share`` hold the lists one behind the other, each sorted by falling share; list j begins at starts[j].
    """
    m = len(starts)
    size = np.diff(np.append(starts, len(doc)))
    depth = np.arange(len(doc)) - np.repeat(starts, size)
    which = np.repeat(np.arange(m), size)
    order = np.argsort(depth, kind="stable")  # the order in which entries are read, a row of all lists at a time
    doc_r, share_r, which_r, depth_r = doc[order], share[order].astype(float), which[order], depth[order]
    low = np.zeros(n)
    at, deep, longest = 0, _FIRST_READ, int(size.max(initial=0))
    while True:
        stop = int(np.searchsorted(depth_r, deep))
        low += np.bincount(doc_r[at:stop], share_r[at:stop], n)
        at = stop
        if deep >= longest:
            break
        heads = np.where(size > deep, share[np.minimum(starts + deep - 1, len(share) - 1)], 0).astype(float)
        high = low + heads.sum() - np.bincount(doc_r[:at], heads[which_r[:at]], n)  # of lists that have shown it nothing more comes
        best = max(float(floor), np.partition(low, n - k)[n - k] if n >= k else 0.0)
        if best > 0 and np.count_nonzero(high >= best) <= k and heads.sum() < best:
            break
        deep *= 2
    if deep < longest:
        alive = high >= best
        rest = np.flatnonzero(alive[doc_r[at:]]) + at
        low += np.bincount(doc_r[rest], share_r[rest], n)
        found = np.flatnonzero(alive & (low > 0))
    else:
        found = np.flatnonzero(low > 0)
    return found, low[found].astype(np.int64)


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    by_id = np.argsort(ids, kind="stable")
    return by_id[np.argsort(-score[by_id], kind="stable")][:k]


def _search(vocabulary: np.ndarray, df: np.ndarray, docs: int, words: int, query: np.ndarray, query_words: np.ndarray, k: int, asked: pa.DataType):
    first = np.append(np.flatnonzero(np.append(True, query[1:] != query[:-1])), len(query))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_ids: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(first) - 1)
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * (len(first) - 1)
        kind = pa.int64()
        for ids, data, offsets in _stretches(batches, "doc"):
            kind, names = ids.type, ids.to_numpy(zero_copy_only=False)
            row, term, tf, length = _terms(data, offsets, vocabulary)
            share = shares(tf, df[term], length[row], docs, words)
            order = np.lexsort((-share, term))
            row, term, share = row[order], term[order], share[order]
            edge = np.searchsorted(term, np.arange(len(vocabulary) + 1))
            for q in range(len(first) - 1):
                own = query_words[first[q] : first[q + 1]]
                own = own[edge[own + 1] > edge[own]]
                if not len(own):
                    continue
                floor = int(best[q][-1]) if len(best[q]) == k else 0
                size = edge[own + 1] - edge[own]
                starts = np.cumsum(size) - size
                entry = np.repeat(edge[own] - starts, size) + np.arange(size.sum())
                found, score = aggregate(row[entry], share[entry], starts, len(ids), k, floor)
                reach = score >= floor
                new = names[found[reach]]
                some_ids, some = np.concatenate((best_ids[q], new)) if len(best[q]) else new, np.concatenate((best[q], score[reach]))
                top = _best(some_ids, some, k)
                best_ids[q], best[q] = some_ids[top], some[top]
        some = [q for q in range(len(best)) if len(best[q])]
        if some:
            who = np.repeat(query[first[some]], [len(best[q]) for q in some])
            yield pa.RecordBatch.from_arrays([pa.array(who, asked), pa.array(np.concatenate([best_ids[q] for q in some]), kind), pa.array(np.concatenate([best[q] for q in some]))], names=["query", "doc", "score"])

    return run


def search(queries: DataFrame, docs: DataFrame, k: int = K, query_id: str = "item_id", query_text: str = "text", id_col: str = "doc_id", text_col: str = "text", max_terms: int = MAX_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query."""
    small_batches(docs.sparkSession)
    query_type, doc_type = queries.schema[query_id].dataType, docs.schema[id_col].dataType
    asked = queries.select(F.col(query_id).alias("id"), F.lower(F.col(query_text).cast("string")).alias("text")).where("id is not null and text is not null")
    pairs = asked.mapInArrow(C.tidy(_query_words), T.StructType([T.StructField("id", query_type), T.StructField("word", T.LongType())])).distinct()
    pairs = written(pairs, "topk-queries")
    texts = docs.select(F.col(id_col).alias("doc"), F.lower(F.col(text_col).cast("string")).alias("text")).where("doc is not null and text is not null")
    groups = -(-pairs.count() // max_terms)
    found_type = T.StructType([T.StructField("query", query_type), T.StructField("doc", doc_type), T.StructField("score", T.LongType())])
    parts = []
    for group in range(groups):
        own = pairs.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == group).toArrow()
        if not own.num_rows:
            continue
        ids, hashes = own["id"].to_numpy(), own["word"].to_numpy().view(np.uint64)
        vocabulary, at = np.unique(hashes, return_inverse=True)
        asking, which = np.unique(ids, return_inverse=True)
        order = np.lexsort((at, which))
        ids, at = asking[which[order]], at[order]
        counted = {r["term"]: r["n"] for r in texts.mapInArrow(C.tidy(_tally(vocabulary)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        total_words, total = counted.pop(-2, 0), counted.pop(-1, 0)
        if not total or not total_words:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        df[list(counted)] = list(counted.values())
        parts.append(texts.mapInArrow(C.tidy(_search(vocabulary, df, total, total_words, ids, at, k, own["id"].type)), found_type))
    if not parts:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField("item_id", query_type), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]))
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def oracle(k: int = K) -> str:
    """DuckDB SQL for :func:`search` of benchmark in documents: every score, no bounds."""
    words = "unnest(regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+'))"
    return f"""
WITH q AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
n AS (SELECT count(*) AS docs FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, count(*) AS len FROM d GROUP BY doc_id),
a AS (SELECT sum(len) AS words FROM l),
t AS (SELECT doc_id, w, count(*) AS tf FROM d GROUP BY doc_id, w),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
s AS (SELECT t.doc_id, t.w, CAST(floor(ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * ({K1}::DOUBLE + 1) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * (len::DOUBLE / (words::DOUBLE / docs))))) * 1e6::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS share
      FROM t JOIN f USING (w) JOIN l USING (doc_id), n, a WHERE w IN (SELECT w FROM q)),
r AS (SELECT item_id, doc_id, CAST(sum(share) AS BIGINT) AS score FROM q JOIN s USING (w) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= {k}"""
