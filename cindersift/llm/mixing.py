"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source stand in a shuffled order (by the MD5 of seed and id) as one stream of tokens, which is cut
into blocks of ``BLOCK_TOKENS``; only the last block of a source is shorter. Slot i of the schedule has the point
``i * GOLDEN mod 2**31``, the golden-ratio sequence in integers; the cumulative weights, scaled to 2**31, say whose slot
it is. The r-th slot of a source takes its block ``r mod blocks``, so shares are met closely in every stretch of the
schedule and a source that runs out begins again. The schedule ends as soon as every block has had a slot. Without
given weights a source weighs tokens ** ``ALPHA``.

While the source that lasts longest has its one pass, the others have as many as their weights say, and none more than
``max_epochs``: a larger weight is lowered to what gives so many, and points beyond them are passed over. No weight
above 0 is so small that it gets no points at all.

The running count of tokens is a two-level prefix sum: within a bucket, and over the few buckets' totals. So no task
has a whole source, however large. The running count of points in a range has a closed form, a sum of floors, so the
driver finds the end without drawing the slots, and tasks draw theirs without the ones before.

Defined results: null is a source like any other; documents without tokens have no place in the schedule; rows that
repeat id, source and text are one document; a null id is an id. An empty table gives an empty schedule. Weights name
all sources with tokens, else ValueError; a weight of 0 leaves a source out. More than ``MAX_SOURCES`` sources are a
ValueError, as the driver plans them one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_batches, written
from . import columnar as C

BLOCK_TOKENS = 2048
ALPHA = 0.8
MAX_EPOCHS = 4
SEED = "mix"
#: Sources are planned on the driver, some 100 bytes each, so their number is checked; up to BROADCAST_SOURCES are broadcast.
MAX_SOURCES = 2_000_000
BROADCAST_SOURCES = 100_000
BUCKET_DOCS = 50_000
CHUNK_SLOTS = 1 << 16
UNIT = 1 << 31
GOLDEN = 1327217885
TOKEN = "[^ \\t\\n\\r]+"


def _parts(totals: list[tuple[str | None, int]], weights: dict[str | None, float] | None, alpha: float) -> list[int]:
    """Weights of the sources as integers."""
    if weights is None:
        return [math.floor(math.pow(n, alpha) * 1000) for _, n in totals]
    if missing := [s for s, _ in totals if s not in weights]:
        raise ValueError(f"no weight for source {missing[0]!r}")
    if any(weights[s] < 0 for s, _ in totals):
        raise ValueError("a weight is negative")
    top = max((weights[s] for s, _ in totals), default=0)
    # a weight above 0 is never rounded to 0, which would leave the source out
    return [max(1, round(weights[s] / top * 1_000_000_000)) if weights[s] else 0 for s, _ in totals]


def positions(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """(doc_id, source, mark, tokens, first_token) of each document in its source's stream, and the tokens of each source."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        F.md5(F.concat(F.lit(SEED + "/"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        F.md5(F.col(text_col).cast("string")).alias("mark"), F.regexp_count(F.col(text_col).cast("string"), F.lit(TOKEN)).cast("bigint").alias("tokens"),
    ).where("tokens > 0").distinct()
    rows = written(rows, "mix-rows")
    found = rows.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(((r["source"], r["t"]) for r in found), key=lambda x: (x[0] is not None, x[0] or ""))
    digits = max(1, math.ceil(math.log(max([r["n"] for r in found], default=1) / BUCKET_DOCS + 1, 16)))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("t")).select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = rows.join(base, rows.source.eqNullSafe(base.s) & (rows.bucket == base.b)).select("doc_id", "source", "mark", "tokens", (F.col("base") + F.col("inside")).alias("first_token"))
    return placed, totals


def owners(first: int, last: int, cumulative: np.ndarray) -> np.ndarray:
    """Which source has each slot from first up to last."""
    points = (np.arange(first, last, dtype=np.int64) % UNIT * GOLDEN) % UNIT
    return np.searchsorted(cumulative, points, "right")


def _floors(n: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of (GOLDEN * i + b) // UNIT over i below n, for n and b up to UNIT."""
    out, a, m = np.zeros(len(n), np.int64), GOLDEN, UNIT
    n, b = n.astype(np.int64), b.astype(np.int64)
    while n.any():
        out += n * (n - 1) // 2 * (a // m) + n * (b // m)
        a, b = a % m, b % m
        y = a * n + b
        n, b = y // m, y % m
        a, m = m, a
        if not m:
            break
    return out


def counts(n: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """How many of the first n points lie from low up to high."""
    rounds, n = n // UNIT, n % UNIT  # each UNIT points are all integers below UNIT
    return rounds * (high - low) + _floors(n, UNIT - low) - _floors(n, UNIT - high)


def _reach(ranks: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The slot in which each (not empty) range has its point number ``ranks``, from 0."""
    under, upto = np.zeros(len(ranks), np.int64), (ranks // (high - low) + 1) * UNIT
    while (under < upto).any():
        middle = (under + upto) // 2
        enough = counts(middle + 1, low, high) > ranks
        under, upto = np.where(enough, under, np.minimum(middle + 1, upto)), np.where(enough, middle, upto)
    return under


def _ranks(own: np.ndarray) -> np.ndarray:
    order = np.argsort(own, kind="stable")
    sizes = np.bincount(own)
    rank = np.empty(len(own), np.int64)
    rank[order] = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rank


def lowered(parts: list[int], blocks: list[int], max_epochs: int) -> list[int]:
    """The weights, none of them more than ``max_epochs`` times what a source of its size has that is never repeated."""
    some = [k for k, p in enumerate(parts) if p]
    if not some:
        return parts
    least = min(some, key=lambda k: (parts[k] / blocks[k], k))
    return [min(p, max(1, max_epochs * b * parts[least] // blocks[least])) if p else 0 for p, b in zip(parts, blocks)]


def edges(parts: list[int]) -> np.ndarray:
    """Where the range of points of each source ends; ranges are of at least 1, and the first heaviest source has the rest."""
    some, whole = sum(p > 0 for p in parts), sum(parts)
    wide = np.array([max(1, p * (UNIT - some) // whole) if p else 0 for p in parts], np.int64)
    if some:
        wide[max(range(len(parts)), key=lambda k: (parts[k], -k))] += UNIT - int(wide.sum())
    return np.cumsum(wide)


def points_needed(ends: np.ndarray, blocks: np.ndarray) -> int:
    """How many points until every block of a source with a range has had a slot."""
    low = np.append(0, ends[:-1])
    own = np.flatnonzero(ends > low)
    return int(_reach(blocks[own] - 1, low[own], ends[own]).max()) + 1 if len(own) else 0


def slots(spark, points: int, ends: np.ndarray, blocks: np.ndarray, max_epochs: int) -> DataFrame:
    """(slot, idx, block, epoch) of the first points."""
    low, most = np.append(0, ends[:-1]), blocks * max_epochs

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                first = c * CHUNK_SLOTS
                own = owners(first, min(first + CHUNK_SLOTS, points), ends)
                seen = counts(np.full(len(ends), first), low, ends)
                begin = int(np.minimum(seen, most).sum())
                rank = seen[own] + _ranks(own)
                kept = rank < most[own]
                own, rank = own[kept], rank[kept]
                yield pa.RecordBatch.from_arrays([pa.array(begin + np.arange(len(own), dtype=np.int64)), pa.array(own.astype(np.int64)), pa.array(rank % blocks[own]), pa.array(rank // blocks[own])], names=["slot", "idx", "block", "epoch"])

    return spark.range(-(-points // CHUNK_SLOTS)).mapInArrow(C.tidy(lay), "slot bigint, idx bigint, block bigint, epoch bigint")


def _plan(placed: DataFrame, totals, weights, alpha, block_tokens, max_epochs) -> tuple[DataFrame, DataFrame]:
    """The slots with (slot, idx, block, epoch), and (idx, s) with the sources' names."""
    spark = placed.sparkSession
    small_batches(spark)
    blocks = [-(-t // block_tokens) for _, t in totals]
    ends, size = edges(lowered(_parts(totals, weights, alpha), blocks, max_epochs)), np.array(blocks, np.int64)
    names = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(totals)], "idx bigint, s string")
    # written, as Spark would take the slots for as few as their chunks and broadcast them
    return written(slots(spark, points_needed(ends, size), ends, size, max_epochs), "mix-slots"), F.broadcast(names) if len(blocks) <= BROADCAST_SOURCES else names


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(slot, source, block, epoch, doc_id, from_token, tokens): the stretches of documents that fill each slot's block."""
    placed, totals = positions(docs, id_col, text_col, source_col)
    drawn, names = _plan(placed, totals, weights, alpha, block_tokens, max_epochs)
    b = F.lit(block_tokens)
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_token") / b), F.floor((F.col("first_token") + F.col("tokens") - 1) / b))))
    start, end = F.greatest("first_token", F.col("block") * b), F.least(F.col("first_token") + F.col("tokens"), (F.col("block") + 1) * b)
    cut = cut.select("source", "block", "doc_id", (start - F.col("first_token")).alias("from_token"), (end - start).alias("tokens"))
    cut = cut.join(names, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return drawn.join(cut, ["idx", "block"]).select("slot", "source", "block", "epoch", "doc_id", "from_token", "tokens")


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, alpha: float = ALPHA, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The input's rows in the order of the schedule, each with the slots of the block in which it begins; again in each epoch."""
    placed, totals = positions(docs, id_col, text_col, source_col)
    drawn, names = _plan(placed, totals, weights, alpha, block_tokens, max_epochs)
    at = placed.join(names, F.col("source").eqNullSafe(F.col("s")))
    ids, sources, marks, md5, places = (C.free(f"__cs_{n}", docs.columns) for n in ("id", "source", "mark", "md5", "at"))
    at = at.select("idx", F.floor(F.col("first_token") / block_tokens).alias("block"), F.col("doc_id").alias(ids), F.col("source").alias(sources), F.col("mark").alias(marks), "first_token")
    order = drawn.join(at, ["idx", "block"]).groupBy(ids, sources, marks).agg(F.collect_list(F.struct("slot", "first_token")).alias(places))
    found = docs.withColumn(md5, F.md5(F.col(text_col).cast("string")))
    same = F.col(md5).eqNullSafe(F.col(marks)) & F.col(id_col).eqNullSafe(F.col(ids)) & F.col(source_col).eqNullSafe(F.col(sources))
    rows = found.join(order, same).withColumn(places, F.explode(places))
    return rows.orderBy(f"{places}.slot", f"{places}.first_token").select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle(table: str = "documents", block: int = BLOCK_TOKENS, alpha: float = ALPHA, epochs: int = MAX_EPOCHS) -> str:
    """DuckDB SQL for :func:`schedule` with its default weights."""
    return f"""
WITH d AS (SELECT DISTINCT doc_id, source, md5('{SEED}/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key, md5(text) AS mark,
             len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS tokens FROM {table} WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) > 0),
p AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM d),
t AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY source),
w AS (SELECT source, (total + {block} - 1) // {block} AS blocks, CAST(floor(pow(total, {alpha}) * 1000) AS BIGINT) AS part FROM t),
least AS (SELECT CAST(part AS HUGEINT) AS p, CAST(blocks AS HUGEINT) AS b FROM w ORDER BY part::DOUBLE / blocks, source NULLS FIRST LIMIT 1),
v AS (SELECT source, blocks, least(CAST(part AS HUGEINT), greatest(1, {epochs} * blocks * p // b)) AS part FROM w, least),
n AS (SELECT source, blocks, greatest(1, part * ({UNIT} - count(*) OVER ()) // sum(part) OVER ()) AS wide, row_number() OVER (ORDER BY part DESC, source NULLS FIRST) AS heavy FROM v),
c AS (SELECT source, blocks, wide + CASE WHEN heavy = 1 THEN {UNIT} - sum(wide) OVER () ELSE 0 END AS wide FROM n),
h AS (SELECT source, blocks, CAST(sum(wide) OVER (ORDER BY source NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi, CAST(wide AS BIGINT) AS wide FROM c),
s AS (SELECT source, blocks, hi, hi - wide AS lo, wide FROM h),
i AS (SELECT unnest(range(CAST((SELECT max(((blocks + 4) * {UNIT} + wide - 1) // wide) FROM s) AS BIGINT))) AS i),
o AS (SELECT i.i, s.source, s.blocks, row_number() OVER (PARTITION BY s.source ORDER BY i.i) - 1 AS rank
      FROM i JOIN s ON (i.i % {UNIT} * {GOLDEN}) % {UNIT} >= s.lo AND (i.i % {UNIT} * {GOLDEN}) % {UNIT} < s.hi),
e AS (SELECT *, row_number() OVER (ORDER BY i) - 1 AS slot FROM o WHERE rank < {epochs} * blocks AND i <= (SELECT max(i) FROM o WHERE rank = blocks - 1)),
x AS (SELECT doc_id, source, first, tokens, unnest(range(first // {block}, (first + tokens - 1) // {block} + 1)) AS block FROM p)
SELECT e.slot, e.source, x.block, CAST(e.rank // e.blocks AS BIGINT) AS epoch, x.doc_id,
       CAST(greatest(x.first, x.block * {block}) - x.first AS BIGINT) AS from_token,
       CAST(least(x.first + x.tokens, (x.block + 1) * {block}) - greatest(x.first, x.block * {block}) AS BIGINT) AS tokens
FROM e JOIN x ON e.source IS NOT DISTINCT FROM x.source AND e.rank % e.blocks = x.block"""
