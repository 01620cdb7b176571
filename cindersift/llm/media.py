"""Media columns: Netpbm (P1 to P6) and BMP images as numpy arrays, area-resized tiles and difference hashes.

Pictures are resized by area: each cell of the result is the mean of the box of the picture that it covers, with
parts of pixels at the edges. The sums come from an integral image, read between its entries at fractional places;
everything is in integers, so results are exact: tiles are rounded half up, hashes compare unrounded sums. A tile is
a whole NPY file of ``TILE`` x ``TILE`` grey values. The hash has a bit for each of 8 x 8 cells: whether the cell is
darker than the one to its right.

Large pictures go through in bands of rows, of which only the sums at the edges of cells are kept.

Defined results: null, empty or damaged images, and such of no pixels or a kind that isn't known, have null results
and the reason in ``error``; so no row is lost. Equal images have equal results; ids are passed through, whatever
their type. Of a Netpbm file that holds several pictures the first counts. BMP may have 1, 4, 8, 16, 24 or 32 bits,
run lengths, colour masks and the short header; transparency is ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from . import columnar as C

TILE = 32
#: Samples of the largest picture that is decoded, those of a cell of 2 GiB; what claims more is reported as an error.
LARGEST = (1 << 31) - 1
_BAND = 1 << 22
_SPACE = b" \t\r\n\x0b\x0c"
_TOKEN = re.compile(rb"(?:[ \t\r\n\x0b\x0c]|#[^\n]*(?:\n|$))*([0-9]+)")
_COMMENT = re.compile(rb"#[^\n]*")


class BadImage(ValueError):
    pass


def _netpbm(data: bytes) -> np.ndarray:
    kind = data[1:2]
    at, head = 2, []
    for _ in range(2 if kind in b"14" else 3):
        found = _TOKEN.match(data, at)
        if not found or len(found[1]) > 9:
            raise BadImage("bad header")
        head.append(int(found[1]))
        at = found.end()
    width, height, top = head[0], head[1], head[2] if len(head) > 2 else 1
    planes = 3 if kind in b"36" else 1
    need = width * height * planes
    if not need:
        raise BadImage("no pixels")
    if need > LARGEST:
        raise BadImage("too large")
    if not 0 < top < 65536:
        raise BadImage("bad maximum")
    if kind in b"123":
        body = _COMMENT.sub(b"", data[at:]) if b"#" in data[at:] else data[at:]
        if kind == b"1":
            values = np.frombuffer(body.translate(None, _SPACE), np.uint8)[:need].astype(np.int64) - 48
            if len(values) < need or values.min() < 0 or values.max() > 1:
                raise BadImage("bad samples")
        else:
            if body.translate(None, _SPACE + b"0123456789"):
                raise BadImage("bad samples")
            values = np.fromstring(body, np.int64, need, sep=" ") if body.strip(_SPACE) else np.zeros(0, np.int64)
            if len(values) < need:
                raise BadImage("cut short")
    else:
        if data[at : at + 1] not in [bytes([c]) for c in _SPACE]:
            raise BadImage("bad header")
        at += 1
        if kind == b"4":
            row = -(-width // 8)
            raw = np.frombuffer(data, np.uint8, min(row * height, len(data) - at), at)
            if len(raw) < row * height:
                raise BadImage("cut short")
            values = np.unpackbits(raw.reshape(height, row), axis=1)[:, :width].ravel()
        else:
            wide = np.dtype(">u2" if top > 255 else np.uint8)
            if len(data) - at < need * wide.itemsize:
                raise BadImage("cut short")
            values = np.frombuffer(data, wide, need, at)
    if kind in b"14":
        values = 255 * (1 - values.astype(np.int64))
    else:
        if int(values.max()) > top:
            raise BadImage("a sample over the maximum")
        if top != 255:
            values = (values.astype(np.int64) * 255 * 2 + top) // (2 * top)
    shaped = values.astype(np.uint8).reshape(height, width, planes)
    return shaped[:, :, 0] if planes == 1 else shaped


def _bmp(data: bytes) -> np.ndarray:
    if len(data) < 26:
        raise BadImage("bad header")
    start, size = struct.unpack_from("<II", data, 10)
    if size == 12:
        width, height, planes, bits = struct.unpack_from("<HHHH", data, 18)
        packed, entry, used = 0, 3, 0
    elif size >= 40 and len(data) >= 54:
        width, height, planes, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        entry, used = 4, struct.unpack_from("<I", data, 46)[0]
    else:
        raise BadImage("bad header")
    if planes != 1:
        raise BadImage("bad header")
    if (bits, packed) not in {*((b, 0) for b in (1, 4, 8, 16, 24, 32)), (8, 1), (4, 2), (16, 3), (32, 3), (16, 6), (32, 6)}:
        raise BadImage("unsupported BMP")
    upward, height = height > 0, abs(height)
    if width <= 0 or not height:
        raise BadImage("no pixels")
    if width * height * 3 > LARGEST:
        raise BadImage("too large")
    row = (width * bits + 31) // 32 * 4
    if packed not in (1, 2) and len(data) < start + row * height:
        raise BadImage("cut short")
    if packed not in (1, 2):
        raw = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
        raw = raw[::-1] if upward else raw
    if bits == 16 or packed in (3, 6):
        masks = struct.unpack_from("<III", data, 54) if packed and len(data) >= 66 else (0x7C00, 0x03E0, 0x001F)
        words = np.ascontiguousarray(raw[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.int64)
        return np.stack([_channel(words, m) for m in masks], 2)
    if bits >= 24:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1])
    used = used or 1 << bits
    at = 14 + size
    if used > 1 << bits or at + entry * used > len(data):
        raise BadImage("bad palette")
    palette = np.frombuffer(data, np.uint8, entry * used, at).reshape(used, entry)[:, 2::-1]
    index = _runs(data, start, width, height, bits)[:: -1 if upward else 1] if packed else raw[:, :width] if bits == 8 else np.unpackbits(raw, axis=1)[:, :width] if bits == 1 else np.stack((raw >> 4, raw & 15), 2).reshape(height, -1)[:, :width]
    if int(index.max()) >= used:
        raise BadImage("bad palette")
    return palette[index]


def _channel(words: np.ndarray, mask: int) -> np.ndarray:
    """The bits under a mask, scaled to a byte."""
    if not mask:
        return np.zeros(words.shape, np.uint8)
    low = mask & -mask
    top = mask // low
    return (((words & mask) // low * 255 * 2 + top) // (2 * top)).astype(np.uint8)


def _runs(data: bytes, at: int, width: int, height: int, bits: int) -> np.ndarray:
    """Palette indices out of run lengths, the first row first; what isn't set is 0."""
    out = np.zeros((height, width), np.uint8)
    x = y = 0
    while at + 1 < len(data) and y < height:
        n, c = data[at], data[at + 1]
        at += 2
        if n or c > 2:
            if n:
                cells = np.full(n, c, np.uint8) if bits == 8 else np.resize(np.array([c >> 4, c & 15], np.uint8), n)
            else:
                size = c if bits == 8 else (c + 1) // 2
                raw = np.frombuffer(data[at : at + size], np.uint8)
                cells = (raw if bits == 8 else np.stack((raw >> 4, raw & 15), 1).ravel())[:c]
                at += size + size % 2
            cells = cells[: max(0, width - x)]
            out[y, x : x + len(cells)] = cells
            x += n or c
        elif c == 0:
            x, y = 0, y + 1
        elif c == 1:
            break
        elif at + 1 < len(data):
            x, y, at = x + data[at], y + data[at + 1], at + 2
    return out


def decode(data: bytes | None) -> np.ndarray:
    """Rows by columns of grey, or with red, green and blue, as bytes."""
    if not data:
        raise BadImage("empty")
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise BadImage("unknown kind")


def grey(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    x = image.astype(np.uint32)
    return ((x[:, :, 0] * 299 + x[:, :, 1] * 587 + x[:, :, 2] * 114) // 1000).astype(np.uint8)


def _between(sums: np.ndarray, cells: int) -> np.ndarray:
    """``cells`` times the integral along the first axis at each of the cells + 1 edges."""
    n = len(sums) - 1
    whole, part = np.divmod(np.arange(cells + 1, dtype=np.int64) * n, cells)
    low = sums[whole]
    part = part.reshape(-1, *[1] * (sums.ndim - 1))
    return low * cells + (sums[np.minimum(whole + 1, n)] - low) * part


def box_sums(integral: np.ndarray, height: int, width: int) -> np.ndarray:
    """For each cell its mean times the pixels of the whole picture, exactly; from the integral image."""
    rows = np.diff(_between(integral, height), axis=0)
    return np.diff(_between(rows.T, width), axis=0).T


def integral(image: np.ndarray) -> np.ndarray:
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(image, axis=0, dtype=np.int64), axis=1, out=out[1:, 1:])
    return out


def band_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The same as :func:`box_sums` of the integral image, of which no more than a band is there at a time."""
    n, columns = image.shape
    whole, part = np.divmod(np.arange(height + 1, dtype=np.int64) * n, height)
    need = np.unique(np.concatenate((whole, np.minimum(whole + 1, n))))
    sums, total, step = np.zeros((len(need), width + 1), np.int64), np.zeros(width + 1, np.int64), max(1, _BAND // columns)
    for first in range(0, n, step):
        band = image[first : first + step]
        across = np.zeros((columns + 1, len(band)), np.int64)
        np.cumsum(band.T, axis=0, dtype=np.int64, out=across[1:])
        run = total + np.concatenate((np.zeros((1, width + 1), np.int64), np.cumsum(_between(across, width).T, axis=0)))
        inside = (need >= first) & (need <= first + len(band))
        sums[inside] = run[need[inside] - first]
        total = run[-1]
    low, high = (sums[np.searchsorted(need, x)] for x in (whole, np.minimum(whole + 1, n)))
    return np.diff(np.diff(low * height + (high - low) * part[:, None], axis=0), axis=1)


def tile_and_hash(image: np.ndarray, tile: int = TILE) -> tuple[np.ndarray, int]:
    plain = grey(image)
    pixels = plain.size
    if pixels <= _BAND:
        sums = integral(plain)
        cells, boxes = box_sums(sums, 8, 9), box_sums(sums, tile, tile)
    else:
        cells, boxes = band_sums(plain, 8, 9), band_sums(plain, tile, tile)
    small = ((2 * boxes + pixels) // (2 * pixels)).astype(np.uint8)
    bits = np.packbits(cells[:, :-1] < cells[:, 1:])
    return small, int.from_bytes(bits.tobytes(), "big", signed=True)


def npy(array: np.ndarray) -> bytes:
    """The NPY file of an array of bytes."""
    head = f"{{'descr': '|u1', 'fortran_order': False, 'shape': {array.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + array.tobytes()


_DECIMAL = np.frombuffer(b"".join(b"%-4d" % i for i in range(256)), np.uint8).reshape(256, 4)


def picture(data: bytes, kind: int) -> bytes:
    """Bytes as an image with a pixel (or sample) for each, in one of seven kinds: P1 to P6, and BMP of 24 bits as 7."""
    planes = 3 if kind in (3, 6, 7) else 1
    width = max(1, int(np.ceil(np.sqrt(len(data) / planes))))
    height = max(1, -(-len(data) // (width * planes)))
    cells = np.zeros(width * height * planes, np.uint8)
    cells[: len(data)] = np.frombuffer(data, np.uint8)
    head = b"P%d\n%d %d\n" % (kind, width, height)
    if kind in (1, 4):
        bits = cells & 1
        return head + ((bits + 48).tobytes() if kind == 1 else np.packbits(bits.reshape(height, width), axis=1).tobytes())
    if kind == 7:
        row = (width * 3 + 3) // 4 * 4
        body = np.zeros((height, row), np.uint8)
        body[:, : width * 3] = cells.reshape(height, width, 3)[::-1, :, ::-1].reshape(height, -1)
        return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + body.size, 0, 0, 54, 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()
    return head + b"255\n" + (cells.tobytes() if kind > 3 else _DECIMAL[cells].tobytes())


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("data")
        for first in range(0, batch.num_rows, 200):
            ids = batch.column("id").slice(first, 200)
            made = [None if x is None else picture(x, (i if isinstance(i, int) else 0 if i is None else zlib.crc32(str(i).encode())) % 7 + 1) for i, x in zip(ids.to_pylist(), texts.slice(first, 200).to_pylist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["id", "image"])


def pictures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, image): each text drawn byte by byte, in a kind that goes by its id; null for null."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(C.tidy(_draw), T.StructType([rows.schema["id"], T.StructField("image", T.BinaryType())]))


def _decode(tile: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("image"):
                try:
                    image = decode(data.as_py())
                    small, code = tile_and_hash(image, tile)
                    rows.append((image.shape[1], image.shape[0], 1 if image.ndim == 2 else 3, npy(small), code, None))
                except BadImage as error:
                    rows.append((None, None, None, None, None, str(error)))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", "width", "height", "planes", "tile", "dhash", "error"])

    return run


def tiles(images: DataFrame, id_col: str = "id", image_col: str = "image", tile: int = TILE) -> DataFrame:
    """(id, width, height, planes, tile, dhash, error) of each encoded image."""
    small_batches(images.sparkSession)
    rows = images.select(F.col(id_col).alias("id"), F.col(image_col).alias("image"))
    kinds = [*((n, T.IntegerType()) for n in ("width", "height", "planes")), ("tile", T.BinaryType()), ("dhash", T.LongType()), ("error", T.StringType())]
    return rows.mapInArrow(C.tidy(_decode(tile)), T.StructType([rows.schema["id"], *(T.StructField(n, k) for n, k in kinds)]))
