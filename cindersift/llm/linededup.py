"""Line deduplication by a segment-partition edit join.

A line is removed when a line before it (smaller document id, then smaller line number) says the same:

* the same bytes, in the same document, or anywhere when it has at least ``MIN_BYTES`` of them; or
* a text within ``tolerance(n)`` byte edits, n being the length of the shorter one: 0 below ``MIN_BYTES``,
  1 below ``2 * MIN_BYTES``, else 2.

Lines within t edits of each other agree in one of the t + 1 segments of the shorter one, at a place that is shifted
by no more than t. So every line puts its segments into an index under (length, segment number, content), and probes
it with the substrings that could match a segment of a line of its own length or of up to t less. What meets is
verified with a banded bit-parallel edit distance over whole lines.

A segment that very many lines share (a licence's first words) would have all of them meet. What is left of two such
lines without the segment is still within t edits, so a crowded key is split in the same way by the segments of the
rest, and again up to ``LEVELS`` times; no pair is lost by that.

Segment entries are many and small: Python packs them in blocks by hash bucket, so the shuffle moves a few thousand
rows of bytes, and each bucket is sorted as one array.

Defined results: a null or empty text has no lines; blank lines stay; lines are split at ``\\n`` alone. A document is an
id, of any type that has an order, and a text: rows that repeat both are one document whose equal line numbers are the
same line; of two texts with one id the order goes by a hash of the text; a null id is an id and comes after the others.
Nothing else of the input is read by the search, so other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches, written
from . import columnar as C

MIN_BYTES = 20
MAX_EDITS = 2
#: Entries to a bucket, about; there are as many buckets as the input needs.
BUCKET_ENTRIES = 250_000
#: Buckets are dealt out to no more tasks than this.
MAX_TASKS = 20_000
#: Up to so many candidate lines are broadcast to fetch their texts, about 10 MB; more are joined by a shuffle.
BROADCAST_LINES = 100_000
#: A key of more entries than this is crowded, and split; of more when there could be over MAX_CROWDED of them.
CROWD = 1000
#: Crowded keys travel with each task, 8 bytes each.
MAX_CROWDED = 2_000_000
LEVELS = 3
_FLUSH = 1 << 18
_PAIRS = 1 << 18
_INDEX, _PROBE = 1, 2


def tolerance(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.asarray(n) // MIN_BYTES, MAX_EDITS)


def probes(t: int) -> list[tuple[int, int, int]]:
    """(length difference, segment, shift) of the substrings that may match a segment of a line with tolerance t."""
    found = []
    for less in range(t + 1):
        for i in range(1, t + 2):
            low, high = max(-(i - 1), less - (t + 1 - i)), min(i - 1, less + (t + 1 - i))
            found += [(less, i - 1, shift) for shift in range(low, high + 1)]
    return found


@dataclass
class Strings:
    """Strings to be cut into segments: where they are in ``data``, and of each the length n of the shorter one of a pair
    (its own less ``less``), the edits t, the key of what has matched so far, its roles and its line."""

    data: np.ndarray
    start: np.ndarray
    size: np.ndarray
    n: np.ndarray
    less: np.ndarray
    t: np.ndarray
    key: np.ndarray
    role: np.ndarray
    line: np.ndarray


def strings(data: np.ndarray, offsets: np.ndarray) -> Strings:
    """Whole lines, as the longer or equal one of pairs with each length that the other could have."""
    size = np.diff(offsets)
    parts = []
    for less in range(MAX_EDITS + 1):
        t = tolerance(size - less)
        own = np.flatnonzero((size - less >= MIN_BYTES) & (t >= less))
        parts.append((own, np.full(len(own), less), t[own]))
    line, less, t = (np.concatenate(x) for x in zip(*parts))
    n = size[line] - less
    role = np.where(less == 0, _INDEX | _PROBE, _PROBE).astype(np.uint8)
    return Strings(data, offsets[:-1][line], size[line], n, less, t, C.mix(n.astype(np.uint64)), role, line)


def entries(s: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key and role of every index and probe entry, the string it is of, and the segment's place in that."""
    sums = C.prefix_hashes(s.data)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.uint8), *[np.zeros(0, np.int64)] * 3)]
    for t in range(1, MAX_EDITS + 1):
        of = {less: np.flatnonzero((s.t == t) & (s.less == less)) for less in range(t + 1)}
        for less, i, shift in probes(t):
            own = of[less]
            n = s.n[own]
            a, b = i * n // (t + 1) + shift, (i + 1) * n // (t + 1) + shift
            fits = (a >= 0) & (b <= s.size[own])
            own, a, b = own[fits], a[fits], b[fits]
            spans = C.span_hashes(sums, s.start[own] + a, s.start[own] + b)
            role = s.role[own] if less == shift == 0 else np.full(len(own), _PROBE, np.uint8)
            found.append((C.mix(spans + C.mix(s.key[own] + np.uint64(i + 1))), role, own, a, b))
    return tuple(np.concatenate(x) for x in zip(*found))


def rests(s: Strings, crowded: np.ndarray) -> Strings:
    """What is left of the strings without a segment whose key is crowded (a sorted array), for each such entry."""
    key, role, of, a, b = entries(s)
    at = np.minimum(np.searchsorted(crowded, key), len(crowded) - 1)
    some = crowded[at] == key
    key, role, of, a, b = key[some], role[some], of[some], a[some], b[some]
    first, size = s.start[of], s.size[of]
    both = np.stack((first, first + b), 1).ravel(), np.stack((a, size - b), 1).ravel()
    left = size - (b - a)
    return Strings(s.data[C.spread(*both)], np.cumsum(left) - left, left, s.n[of] - (b - a), s.less[of], s.t[of], key, role, s.line[of])


def _pack(buckets: int, crowded: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush() -> pa.RecordBatch:
            key, line, role = (np.concatenate(x) for x in zip(*held))
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            key, line, role, bucket = key[order], line[order], role[order], bucket[order]
            which, first = np.unique(bucket, return_index=True)
            ends = np.append(first[1:], len(key))
            blobs = [key[a:b].tobytes() + line[a:b].tobytes() + role[a:b].tobytes() for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            line = batch.column("h").to_numpy()
            _, once = np.unique(line, return_index=True)
            batch, line = batch.take(pa.array(once)), line[once].view(np.uint64)
            data, offsets = C.utf8(batch.column("line"))
            for a, b in C.chunks(offsets):
                own = strings(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for keys in crowded:
                    own = rests(own, keys)
                key, role, of, _, _ = entries(own)
                held.append((key, line[a:b][own.line[of]], role))
                count += len(key)
                if count >= _FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def meetings(key: np.ndarray, line: np.ndarray, role: np.ndarray, crowd: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different lines of which one's index entry has the key of the other's probe, in pieces of bounded size.

    Of a key that more than ``crowd`` lines have there are none, but (no lines, the keys).
    """
    order = np.argsort(key)
    key = key[order]
    shared = np.zeros(len(key), bool)
    equal = key[1:] == key[:-1]
    shared[1:] |= equal
    shared[:-1] |= equal
    order, key = order[shared], key[shared]
    line, role = line[order], role[order]
    if not len(key):
        return
    order = np.lexsort((line, key))
    key, line, role = key[order], line[order], role[order]
    # an entry of each line and key, with all its roles
    new = np.append(True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]))
    role = np.bitwise_or.reduceat(role, np.flatnonzero(new))
    key, line = key[new], line[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(first, len(key)))
    if (many := size > crowd).any():
        yield np.zeros(0, np.uint64), key[first[many]]
        few = np.repeat(~many, size)
        key, line, role, size = key[few], line[few], role[few], size[~many]
        first = np.cumsum(size) - size
    end = np.repeat(first + size, size)
    after = end - np.arange(len(key)) - 1  # how many of the group follow each entry
    at = 0
    total = np.concatenate(([0], np.cumsum(after)))
    while at < len(key):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS, "right")) - 1)
        n = after[at:stop]
        left = np.repeat(np.arange(at, stop), n)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        useful = ((role[left] & _INDEX > 0) & (role[right] & _PROBE > 0)) | ((role[left] & _PROBE > 0) & (role[right] & _INDEX > 0))
        if useful.any():
            yield line[left[useful]], line[right[useful]]  # lines ascend within a group
        at = stop


def _candidates(crowd: int):
    """Pairs of line hashes out of blocks sorted by bucket; a crowded key comes with no second one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            parts = []
            for block in held:
                n = len(block) // 17
                parts.append((np.frombuffer(block, np.uint64, n), np.frombuffer(block, np.uint64, n, 8 * n), np.frombuffer(block, np.uint8, n, 16 * n)))
            for x, y in meetings(*(np.concatenate(p) for p in zip(*parts)), crowd):
                if len(x):
                    pair = np.unique(np.rec.fromarrays([x.view(np.int64), y.view(np.int64)]))
                    columns = [pa.array(np.ascontiguousarray(pair["f0"])), pa.array(np.ascontiguousarray(pair["f1"]))]
                else:
                    columns = [pa.array(y.view(np.int64)), pa.nulls(len(y), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["x", "y"])

        for batch in batches:
            for bucket, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist()):
                if bucket != now:
                    if held:
                        yield from done()
                    now, held = bucket, []
                held.append(block)
        if held:
            yield from done()

    return run


def banded(a: np.ndarray, b: np.ndarray, t: int = MAX_EDITS) -> np.ndarray:
    """Edit distances of the rows of two matrices, exact up to t and larger than t beyond.

    The rows of ``b`` are 0 to t longer than those of ``a``, which have more than t. Each column of the band of
    2t + 1 diagonals is a few bits of one byte; all rows advance by one column with a handful of bitwise operations.
    """
    rows, n = a.shape
    m = b.shape[1]
    width = 2 * t + 1
    full = np.uint16((1 << width) - 1)
    vp = np.full(rows, full & ~np.uint16((1 << t) - 1), np.uint16)
    vn = np.zeros(rows, np.uint16)
    score = np.full(rows, t, np.int32)
    cols = np.ascontiguousarray(a.T)
    text = np.ascontiguousarray(b.T)
    for j in range(1, m + 1):
        x = np.zeros(rows, np.uint16)
        c = text[j - 1]
        for k in range(width):
            i = j + k - t
            if 1 <= i <= n:
                x |= (cols[i - 1] == c).astype(np.uint16) << np.uint16(k)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j <= n - t:
            score += (d0 >> np.uint16(width - 1) & 1) == 0
        else:
            k = np.uint16(n - j + t)
            score += (hp >> k & 1).astype(np.int32) - (hn >> k & 1).astype(np.int32)
        d0 >>= np.uint16(1)
        vp = (hn | ~(d0 | hp)) & full
        vn = d0 & hp
    return score


def distances(left: list[bytes], right: list[bytes], t: int = MAX_EDITS, cells: int = 1 << 22) -> np.ndarray:
    """Edit distance of each pair, exact up to t; what is larger, or surely so by the lengths, is above t.

    Common beginnings and ends don't count, so only what lies between is compared; pairs of similar length
    are padded at the end with the same sign and advance together.
    """
    out = np.full(len(left), t + 1, np.int32)
    todo: dict[int, list[tuple[int, bytes, bytes]]] = {}
    for i, (x, y) in enumerate(zip(left, right)):
        if len(x) > len(y):
            x, y = y, x
        if len(y) - len(x) > t:
            continue
        if x == y:
            out[i] = 0
            continue
        if len(x) <= t:
            out[i] = _small(x, y)
            continue
        p, q = _common(x, y)
        s, _ = _common(x[::-1], y[::-1])
        most = len(x) - t - 1
        p = min(p, most)
        s = min(s, most - p)
        todo.setdefault(len(y) - len(x), []).append((i, x[p : len(x) - s], y[p : len(y) - s]))
    for more, items in todo.items():
        items.sort(key=lambda v: len(v[1]))
        at = 0
        while at < len(items):
            stop, width = at + 1, len(items[at][1])
            while stop < len(items) and (stop - at + 1) * len(items[stop][1]) <= cells and len(items[stop][1]) <= 2 * width + 64:
                stop += 1
            n = len(items[stop - 1][1])
            a, b = np.full((stop - at, n), -1, np.int16), np.full((stop - at, n + more), -1, np.int16)
            for r, (_, x, y) in enumerate(items[at:stop]):
                a[r, : len(x)] = np.frombuffer(x, np.uint8)
                b[r, : len(y)] = np.frombuffer(y, np.uint8)
            out[[v[0] for v in items[at:stop]]] = banded(a, b, t)
            at = stop
    return out


def _common(x: bytes, y: bytes) -> tuple[int, int]:
    """Length of the common beginning."""
    n = min(len(x), len(y))
    differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
    at = int(differ.argmax()) if n else 0
    return (at if n and differ[at] else n), n


def _small(x: bytes, y: bytes) -> int:
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("xt", "yt"))
        edits = distances(left, right)
        most = tolerance(np.minimum([len(v) for v in left], [len(v) for v in right])) if left else edits
        yes = pa.array((edits <= most) & (edits > 0))
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(yes) for c in ("x", "y")), pa.array(edits).filter(yes)], names=["x", "y", "edits"])


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(at, line, n, h, g): the lines that aren't blank, with their place, their bytes counted and hashed twice.

    A place is (whether the id is null, id, hash of the text, line number), so places have the order of lines.
    """
    text = F.col(text_col).cast("string")
    split = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("no", "line")).where("trim(both ' \t\r' from line) <> ''")
    at = F.struct(F.col("doc").isNull().alias("last"), "doc", "mark", "no").alias("at")
    return split.select(at, "line", F.octet_length("line").alias("n"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"))


def candidate_pairs(texts: DataFrame, lines: int, crowd: int = CROWD, levels: int = LEVELS) -> DataFrame:
    """(x, y): hashes of lines (h, line) that share a segment, each pair once; ``lines`` is about how many there are."""
    total = lines * len(probes(MAX_EDITS))
    buckets, crowd = max(16, -(-total // BUCKET_ENTRIES)), max(crowd, total // MAX_CROWDED)
    parts: list[DataFrame] = []
    crowded: list[np.ndarray] = []
    while True:
        last = len(crowded) == levels
        blocks = texts.select("h", "line").mapInArrow(C.tidy(_pack(buckets, crowded)), "bucket bigint, block binary")
        made = blocks.repartition(min(buckets, MAX_TASKS), "bucket").sortWithinPartitions("bucket").mapInArrow(C.tidy(_candidates(1 << 62 if last else crowd)), "x bigint, y bigint")
        found = written(made.distinct(), "line-pairs")
        parts.append(found.where("y is not null"))
        keys = found.where("y is null").select("x").toArrow()["x"].to_numpy() if not last else []
        if not len(keys):
            break
        crowded.append(np.sort(keys.view(np.uint64)))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.union(part)
    return pairs.distinct() if parts[1:] else pairs


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(at, of, edits): the place of each line to remove, and of the first line that it repeats."""
    small_batches(docs.sparkSession)
    lines = lines_of(docs, id_col, text_col)
    seen = written(lines.select("at", "n", "h", "g", F.when(F.col("n") < MIN_BYTES, F.xxhash64("at.doc", "at.mark")).otherwise(F.lit(-1)).alias("own")), "lines")
    firsts = seen.groupBy("h", "g", "own").agg(F.min("at").alias("of"), F.count("*").alias("times"), F.first("n").alias("n"))
    firsts = written(firsts, "line-firsts")
    heads = firsts.where("times > 1").select("h", "g", "own", "of")
    exact = seen.select("at", "h", "g", "own").join(heads, ["h", "g", "own"]).where("at <> of").select("at", "of", F.lit(0).alias("edits"))
    long = firsts.where(F.col("n") >= MIN_BYTES)
    texts = lines.where(F.col("n") >= MIN_BYTES)
    pairs = candidate_pairs(texts, long.count(), crowd)
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("h")).distinct().join(long.select("h", "g", "of"), "h")
    # a text and a line number say which line it is, whoever has the text
    wanted = written(wanted.select("h", "g", "of", F.col("of.mark").alias("mark"), F.col("of.no").alias("no")), "line-wanted")
    small = wanted.count() <= BROADCAST_LINES
    found = texts.select("h", "g", F.col("at.mark").alias("mark"), F.col("at.no").alias("no"), "line").join(F.broadcast(wanted) if small else wanted, ["h", "g", "mark", "no"])
    found = written(found.groupBy("h", "of").agg(F.first("line").alias("line")), "line-texts")
    x = found.select(F.col("h").alias("xh"), F.col("of").alias("x"), F.col("line").alias("xt"))
    y = found.select(F.col("h").alias("yh"), F.col("of").alias("y"), F.col("line").alias("yt"))
    met = pairs.toDF("xh", "yh").join(x, "xh").join(y, "yh").select("x", "y", "xt", "yt")
    place = firsts.schema["of"].dataType
    met = met.mapInArrow(C.tidy(_verify), T.StructType([T.StructField("x", place), T.StructField("y", place), T.StructField("edits", T.IntegerType())]))
    near = met.select(F.greatest("x", "y").alias("at"), F.struct(F.least("x", "y").alias("of"), "edits").alias("early")).groupBy("at").agg(F.min("early").alias("early"))
    return exact.union(near.select("at", "early.of", "early.edits")).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """(doc_id, line_no, of_doc_id, of_line_no, edits): each line to remove and the first line that it repeats.

    Line numbers begin at 0. Of several lines within the tolerance the earliest is named.
    """
    found = repeats(docs, id_col, text_col, crowd)
    return found.select(F.col("at.doc").alias("doc_id"), F.col("at.no").cast("int").alias("line_no"), F.col("of.doc").alias("of_doc_id"), F.col("of.no").cast("int").alias("of_line_no"), "edits")


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The input with repeated lines taken out of its texts and all its columns; ``count_col`` gets the new length.

    A document that loses every line it had goes; one that had none stays as it is.
    """
    drops, own, mark, doc, left = (C.free(f"__cs_{n}", docs.columns) for n in ("drops", "own", "mark", "doc", "left"))
    gone = repeats(docs, id_col, text_col).groupBy(F.col("at.doc").alias(doc), F.col("at.mark").alias(mark)).agg(F.collect_set("at.no").alias(drops))
    text = F.col(text_col).cast("string")
    marked = docs.withColumn(own, F.xxhash64(text))
    joined = marked.join(gone, (F.col(own) == F.col(mark)) & F.col(f"`{id_col}`").eqNullSafe(F.col(doc)), "left")
    # bound step by step and exploded, so that nothing is worked out twice; of a document that loses all there is nothing to explode
    lines = F.transform(F.array(F.split(text, "\n")), lambda ls: F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(drops)), lambda i: F.get(ls, i)))
    some = F.filter(lines, lambda ls: F.exists(ls, lambda x: F.trim(x, F.lit(" \t\r")) != ""))
    new = F.when(F.col(drops).isNull(), F.array(text)).otherwise(F.transform(some, lambda ls: F.array_join(ls, "\n")))
    kept = joined.select(*(F.col(f"`{c}`") for c in docs.columns if c != text_col), F.explode(new).alias(left))
    out = kept.select(*((F.col(left).cast(docs.schema[c].dataType) if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns))
    return out.withColumn(count_col, F.length(text_col).cast(docs.schema[count_col].dataType)) if count_col else out


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for :func:`repeated_lines`, where ids are not null and don't repeat: all pairs of lines, none by segments."""
    most = f"least(least(a.n, b.n) // {MIN_BYTES}, {MAX_EDITS})"
    return f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {table} WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS no, ls[i] AS line, strlen(ls[i]) AS n FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s) WHERE trim(ls[i], concat(' ', chr(9), chr(13))) <> ''),
f AS MATERIALIZED (SELECT line, n, CASE WHEN n < {MIN_BYTES} THEN doc_id END AS own, min({{'d': doc_id, 'k': no}}) AS p FROM l GROUP BY ALL),
exact AS (SELECT l.doc_id, l.no, f.p.d AS of_doc, f.p.k AS of_no, 0 AS edits FROM l JOIN f ON l.line = f.line AND f.own IS NOT DISTINCT FROM CASE WHEN l.n < {MIN_BYTES} THEN l.doc_id END WHERE l.doc_id <> f.p.d OR l.no <> f.p.k),
m AS (SELECT a.p AS p, b.p AS late, levenshtein(a.line, b.line) AS edits, {most} AS most FROM f a JOIN f b ON b.n BETWEEN a.n - {MAX_EDITS} AND a.n + {MAX_EDITS} AND a.p < b.p WHERE a.n >= {MIN_BYTES} AND b.n >= {MIN_BYTES}),
near AS (SELECT late, min({{'d': p.d, 'k': p.k, 'e': edits}}) AS early FROM m WHERE edits <= most GROUP BY late)
SELECT doc_id, CAST(no AS INTEGER) AS line_no, of_doc AS of_doc_id, CAST(of_no AS INTEGER) AS of_line_no, edits FROM exact
UNION ALL SELECT late.d, CAST(late.k AS INTEGER), early.d, CAST(early.k AS INTEGER), CAST(early.e AS INTEGER) FROM near"""
