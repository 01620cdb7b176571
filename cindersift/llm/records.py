"""Token ids as length-delimited binary records with masked checksums, and a separate offset index.

A record is framed as the length in 8 bytes, the masked CRC-32C of those, the payload, and its masked CRC-32C, all
little-endian. A payload is a flag byte (0: the id is an integer in 8 bytes; 1: it is null; 2: it is a text, its length
in 8 bytes and then its bytes), a byte with the width of a token (2, or 4 where one needs it), the id, and the tokens.
Tasks write shards of about ``SHARD_BYTES`` straight to the shared folder, under names of their own, so a task that runs
again leaves whole files; the index, an ordinary table, names only those of tasks that counted.

A shuffled read cuts shards into stretches of ``STRETCH_BYTES``, deals these out to windows of ``WINDOW_BYTES`` by a hash
of the seed, and orders the records of a window by another. A task reads the stretches of a window whole, from wherever
they are, so it makes few reads, of neighbouring records, however many records and shards there are.

Defined results: a row without tokens (null) has no record; an empty list has a record without tokens; null ids come
back as null, ids that aren't integers as the texts that Spark casts them to; repeated rows are records of their own;
other columns are never read. A record whose length, checksum or frame is wrong raises ValueError, with
``strict=False`` it comes back with ``ok`` false and null tokens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import fresh_path, small_batches, written
from . import columnar as C

SHARD_BYTES = 64 << 20
STRETCH_BYTES = 1 << 20
#: A shuffled read holds so many bytes of records at a time; they are checked and passed on so many at a time.
WINDOW_BYTES, READ_BYTES = 16 << 20, 4 << 20
MAX_TASKS = 20_000
#: Records with less than this between them are fetched together.
_NEAR = 4 << 10
_HEAD, _HEAD_BYTES = "<BBq", 10
_CELLS = 1 << 23


def _tables() -> np.ndarray:
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> np.uint32(1) ^ np.uint32(0x82F63B78), one >> np.uint32(1))
    each = [one]
    for _ in range(7):
        each.append(one[each[-1] & 0xFF] ^ each[-1] >> np.uint32(8))
    # two bytes at a time: four tables of 2 ** 16
    low, high = np.arange(1 << 16) & 0xFF, np.arange(1 << 16) >> 8
    return np.stack([each[7 - 2 * k][low] ^ each[6 - 2 * k][high] for k in range(4)])


_T = _tables()


def _linear(images: np.ndarray) -> np.ndarray:
    """Four tables of 256 for the linear map of 32 bits that takes bit k to images[k]."""
    tables = np.zeros((4, 256), np.uint32)
    for k in range(32):
        own = np.arange(256) >> (k % 8) & 1 == 1
        tables[k // 8, own] ^= images[k]
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(255)] ^ tables[1][x >> np.uint32(8) & np.uint32(255)] ^ tables[2][x >> np.uint32(16) & np.uint32(255)] ^ tables[3][x >> np.uint32(24)]


_shifts: dict[int, np.ndarray] = {}


def _shift(size: int) -> np.ndarray:
    """What ``size`` (a power of two) zero bytes after a message do to its checksum, as tables."""
    if size not in _shifts:
        bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
        if size == 1:
            one = _T[3][(bits & np.uint32(255)).astype(np.int64) << 8]
            _shifts[size] = _linear(bits >> np.uint32(8) ^ one)
        else:
            half = _shift(size // 2)
            _shifts[size] = _linear(_apply(half, _apply(half, bits)))
    return _shifts[size]


def crc32c(blobs: list[bytes]) -> np.ndarray:
    """CRC-32C of each: all blocks of all of them advance together, eight bytes a step, and are joined two by two.

    Zeros ahead of a message don't change a checksum that begins with 0, so messages are padded in front; beginning with
    all ones is the same as the first four bytes inverted.
    """
    out = np.zeros(len(blobs), np.uint32)
    size = np.array([len(b) for b in blobs], np.int64)
    for i in np.flatnonzero(size < 4):
        crc = 0xFFFFFFFF
        for byte in blobs[i]:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        out[i] = crc ^ 0xFFFFFFFF
    todo = np.flatnonzero(size >= 4)
    ends = np.cumsum(size[todo])
    at = 0
    while at < len(todo):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CELLS, "right")))
        out[todo[at:stop]] = _crc([blobs[i] for i in todo[at:stop]], size[todo[at:stop]])
        at = stop
    return out


def _crc(blobs: list[bytes], size: np.ndarray) -> np.ndarray:
    block = 8 if size.max() <= 64 else 128
    count = -(-size // block)
    zeros = bytes(block)
    cells = np.frombuffer(bytearray().join(x for b, n in zip(blobs, (count * block - size).tolist()) for x in (zeros[:n], b)), np.uint8)
    begin = np.cumsum(count * block) - size
    cells[begin[:, None] + np.arange(4)] ^= 0xFF
    pairs = np.ascontiguousarray(cells.view("<u2").reshape(-1, block // 2).T)
    state = np.zeros(pairs.shape[1], np.uint32)
    for k in range(0, len(pairs), 4):
        state = _T[0][pairs[k] ^ (state & np.uint32(0xFFFF)).astype(np.uint16)] ^ _T[1][pairs[k + 1] ^ (state >> np.uint32(16)).astype(np.uint16)] ^ _T[2][pairs[k + 2]] ^ _T[3][pairs[k + 3]]
    while count.max() > 1:
        # the last two blocks of each, and so on; the first alone where their number is odd
        half = (count + 1) // 2
        first = np.cumsum(count) - count
        place = np.arange(int(half.sum())) - np.repeat(np.cumsum(half) - half, half)
        right = np.repeat(first + count - 1, half) - 2 * (np.repeat(half, half) - 1 - place)
        both = right > np.repeat(first, half)
        joined = state[right]
        joined[both] ^= _apply(_shift(block), state[right[both] - 1])
        state, count, block = joined, half, 2 * block
    return ~state


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(0xA282EAD8)


def frame(bodies: list[bytes]) -> list[bytes]:
    """Each payload with its lengths and masked checksums."""
    lengths = [struct.pack("<Q", len(p)) for p in bodies]
    a, b = masked(crc32c(lengths)), masked(crc32c(bodies))
    return [n + struct.pack("<I", x) + p + struct.pack("<I", y) for n, x, p, y in zip(lengths, a.tolist(), bodies, b.tolist())]


def unframe(frames: list[bytes]) -> list[bytes | None]:
    """The payload of each frame; None where the frame is wrong."""
    whole = [f if len(f) >= 16 and len(f) - 16 == int.from_bytes(f[:8], "little") else None for f in frames]
    kept = [f for f in whole if f is not None]
    a, b = masked(crc32c([f[:8] for f in kept])), masked(crc32c([f[12:-4] for f in kept]))
    good = iter([f[12:-4] if int.from_bytes(f[8:12], "little") == x and int.from_bytes(f[-4:], "little") == y else None for f, x, y in zip(kept, a.tolist(), b.tolist())])
    return [None if f is None else next(good) for f in whole]


def payloads(ids: list, values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """What the records of some ids hold, the tokens of row k being values[ends[k]:ends[k + 1]]."""
    if len(values) and (values.min() < 0 or values.max() >= 1 << 32):
        raise ValueError("a token does not fit 4 bytes")
    narrow, wide = values.astype("<u2").tobytes(), None
    out = []
    for k, i in enumerate(ids):
        a, b = int(ends[k]), int(ends[k + 1])
        if a == b or values[a:b].max() < 1 << 16:
            width, body = 2, narrow[2 * a : 2 * b]
        else:
            wide = wide or values.astype("<u4").tobytes()
            width, body = 4, wide[4 * a : 4 * b]
        text = i.encode() if isinstance(i, str) else b""
        out.append(struct.pack(_HEAD, 1 if i is None else 2 if isinstance(i, str) else 0, width, len(text) if isinstance(i, str) else i or 0) + text + body)
    return out


def payload_parts(payload: bytes) -> tuple[int | str | None, np.ndarray]:
    """Id and tokens."""
    flag, width, number = struct.unpack_from(_HEAD, payload)
    at = _HEAD_BYTES + (number if flag == 2 else 0)
    i = None if flag == 1 else payload[_HEAD_BYTES:at].decode() if flag == 2 else number
    return i, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=at)


def _write(folder: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, 2000):
                    part = batch.slice(first, 2000)
                    lists = part.column("tokens")
                    ids = part.column("doc_id").to_pylist()
                    ends = np.concatenate(([0], np.cumsum(np.diff(lists.offsets.to_numpy()))))
                    values = lists.flatten().to_numpy(zero_copy_only=False)
                    names, offsets, lengths = [], [], []
                    for record in frame(payloads(ids, values, ends)):
                        if out is None:
                            name, at = f"{uuid.uuid4().hex}.rec", 0
                            out = fs.open_output_stream(f"{root}/{name}")
                        out.write(record)
                        names.append(name)
                        offsets.append(at)
                        lengths.append(len(record))
                        at += len(record)
                        if at >= shard_bytes:
                            out.close()
                            out = None
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["doc_id", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    return run


def _id_type(kind: T.DataType) -> T.DataType:
    return T.LongType() if isinstance(kind, T.IntegralType) else T.StringType()


def write_records(tokens: DataFrame, folder: str | None = None, id_col: str = "doc_id", tokens_col: str = "tokens", shard_bytes: int = SHARD_BYTES) -> tuple[str, DataFrame]:
    """Writes shards to ``folder`` and returns it with the index (doc_id, shard, offset, length), itself a written table."""
    small_batches(tokens.sparkSession)
    folder = folder or fresh_path(tokens.sparkSession, "records")
    kind = _id_type(tokens.schema[id_col].dataType)
    rows = tokens.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(tokens_col).alias("tokens")).where("tokens is not null")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    return folder, written(rows.mapInArrow(C.tidy(_write(folder, shard_bytes)), schema), "record-index")


def _fetch(fs: pafs.FileSystem, root: str, shards: list[str], offsets: list[int], lengths: list[int]) -> list[bytes]:
    """The frames at some places, by stretches of each shard."""
    out: list[bytes] = [b""] * len(shards)
    order = sorted(range(len(shards)), key=lambda i: (shards[i], offsets[i]))
    at = 0
    now, source = None, None
    while at < len(order):
        first = order[at]
        stop, end = at + 1, offsets[first] + lengths[first]
        while stop < len(order) and shards[order[stop]] == shards[first] and offsets[order[stop]] <= end + _NEAR:
            end = max(end, offsets[order[stop]] + lengths[order[stop]])
            stop += 1
        if shards[first] != now:
            if source:
                source.close()
            now, source = shards[first], fs.open_input_file(f"{root}/{shards[first]}")
        data = source.read_at(end - offsets[first], offsets[first])
        for i in order[at:stop]:
            a = offsets[i] - offsets[first]
            out[i] = data[a : a + lengths[i]]
        at = stop
    if source:
        source.close()
    return out


def _read(folder: str, strict: bool, kind: pa.DataType, shuffled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            window = batch.column("window").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(window[1:] != window[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and (not shuffled or held[-1].column("window")[-1] != batch.column("window")[a]):
                    yield from pieces(fs, root, held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from pieces(fs, root, held)

    def pieces(fs: pafs.FileSystem, root: str, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        size = np.cumsum(rows.column("length").to_numpy())
        whole = _fetch(fs, root, *(rows.column(c).to_pylist() for c in ("shard", "offset", "length"))) if shuffled else None
        first = 0
        while first < rows.num_rows:
            before = int(size[first - 1]) if first else 0
            stop = max(first + 1, int(np.searchsorted(size, before + READ_BYTES, "right")))
            yield one(fs, root, rows.slice(first, stop - first), whole[first:stop] if whole else None)
            first = stop

    def one(fs: pafs.FileSystem, root: str, batch: pa.RecordBatch, frames: list[bytes] | None) -> pa.RecordBatch:
        shards, offsets, lengths = (batch.column(c).to_pylist() for c in ("shard", "offset", "length"))
        found = unframe(_fetch(fs, root, shards, offsets, lengths) if frames is None else frames)
        if strict and None in found:
            i = found.index(None)
            raise ValueError(f"record at {offsets[i]} of {shards[i]} is damaged")
        both = [(None, None) if p is None else payload_parts(p) for p in found]
        parts = [p for _, p in both]
        counts = np.array([0 if p is None else len(p) for p in parts])
        values = np.concatenate([p.astype(np.int32) for p in parts if p is not None] or [np.zeros(0, np.int32)])
        ok = np.array([p is not None for p in parts], bool)
        ends = pa.py_buffer(np.concatenate(([0], np.cumsum(counts))).astype(np.int32).tobytes())
        lists = pa.Array.from_buffers(pa.list_(pa.int32()), len(ok), [None if ok.all() else pa.array(ok).buffers()[1], ends], children=[pa.array(values, pa.int32())])
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in both], kind), lists, pa.array(counts, pa.int32(), mask=~ok), batch.column("length"), pa.array(ok)], names=["doc_id", "tokens", "n_tokens", "length", "ok"])

    return run


def read_records(folder: str, index: DataFrame, seed: int | None = None, strict: bool = True) -> DataFrame:
    """(doc_id, tokens, n_tokens, length, ok) of each record of the index; with a seed in an order shuffled by it."""
    small_batches(index.sparkSession)
    kind = index.schema["doc_id"].dataType
    if seed is not None:
        windows = int(-(-(index.agg(F.sum("length").alias("n")).first()["n"] or 0) // WINDOW_BYTES)) or 1
        window = F.pmod(F.xxhash64(F.lit(seed), "shard", F.floor(F.col("offset") / STRETCH_BYTES)), F.lit(windows))
        order = F.xxhash64(F.lit(seed + 1), "shard", "offset")
        tasks = min(windows, MAX_TASKS)
        index = index.select("*", window.alias("window"), order.alias("order")).repartitionById(tasks, F.pmod(F.col("window"), F.lit(tasks)).cast("int")).sortWithinPartitions("window", "order", "shard", "offset")
    else:
        index = index.withColumn("window", F.lit(0))
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("length", T.LongType()), T.StructField("ok", T.BooleanType())])
    return index.select("shard", "offset", "length", "window").mapInArrow(C.tidy(_read(folder, strict, pa.int64() if kind == T.LongType() else pa.string(), seed is not None)), schema)
