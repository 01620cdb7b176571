"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut into pieces as the usual pattern of byte-level vocabularies does (contractions, letters, digits, other
signs, white space; a single space before a piece belongs to it). Within a piece every pair of neighbours is a leaf of
a segment tree that holds (rank, place) and each node the least of its children. The root is the leftmost pair of the
lowest rank; merging it changes three leaves and the nodes above them, until no pair is in the vocabulary. Pieces of
up to ``WIDE`` bytes go through their trees side by side, a numpy operation for each step of all trees; longer ones
one by one. What pieces a worker has encoded it remembers by a hash, in two tables of ``SLOTS``; the tokens found for a
stretch of text are decoded again, and where that isn't the text (a hash has met another) it is encoded without hashes.

Defined results: null has null tokens; an empty text has none; bytes that aren't UTF-8 are pieces of other signs;
texts of any length are encoded whole. Rows pass through in place, so null ids, repeated rows and other columns stay.
New columns whose names the input has already get underscores at the end.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import small_batches
from . import columnar as C

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WIDE = 512
SLOTS = 1 << 19
#: Tokens of remembered pieces; beyond that a worker begins to remember anew.
REMEMBERED = 3_000_000
#: A vocabulary travels with every task, so its size is checked.
LARGEST_VOCABULARY = 16 << 20
_CHUNK = 1 << 19
_NONE = np.int64(1 << 60)

_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        # no letter or number lies beyond the last plane of ideographs
        major = "".join(unicodedata.category(chr(i))[0] for i in range(0x40000)).ljust(0x110000, "C")
        kinds = np.frombuffer(major.encode(), np.uint8)
        _classes = np.full(0x110000, _OTHER, np.uint8)
        _classes[kinds == ord("L")] = _LETTER
        _classes[kinds == ord("N")] = _DIGIT
        _classes[_SPACES] = _SPACE
    return _classes


def pieces(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all rows begin, in bytes; each ends where the next begins, or with its row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    head = (data & 0xC0) != 0x80
    edges = offsets[:-1][np.diff(offsets) > 0]
    head[edges] = True
    at = np.flatnonzero(head)
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    first = data[at].astype(np.uint32)
    code = first.copy()
    for size, low, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        own = np.flatnonzero((first >= low) & (first < (0xE0, 0xF0, 0x100)[size - 2]))
        if len(own):
            value = first[own] & mask
            for k in range(1, size):
                value = value << np.uint32(6) | (padded[at[own] + k] & 0x3F)
            code[own] = np.minimum(value, 0x10FFFF)
    kind = _class_table()[code]
    kind[(first >= 0x80) & (first < 0xC0)] = _OTHER
    begins = np.zeros(len(at), bool)  # of a row
    begins[np.searchsorted(at, edges)] = True
    run = begins.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last of some white space before something else stands alone, or goes with what follows if it is a space
    before = np.flatnonzero(run[1:] & ~begins[1:] & (kind[:-1] == _SPACE))
    start[before] = True
    joined = before[code[before] == 32]
    start[joined + 1] = False
    # contractions: an apostrophe that begins a piece, and what follows
    tick = np.flatnonzero((code == 39) & start)
    tick = tick[tick + 1 < len(at)]
    tick = tick[~begins[tick + 1]]
    if len(tick):
        wide = np.concatenate((code, np.zeros(2, np.uint32)))
        b, c = wide[tick + 1], wide[tick + 2]
        later = np.concatenate((begins, [True, True]))
        one = np.isin(b, [ord(x) for x in "sdmt"])
        two = ~one & ~later[tick + 2] & (((b == 108) & (c == 108)) | ((b == 118) & (c == 101)) | ((b == 114) & (c == 101)))
        start[tick[one | two] + 1] = False
        for end in (tick[one] + 2, tick[two] + 3):
            start[end[end < len(at)]] = True
    return at[start]


class Vocabulary:
    """Tokens by rank, and which pairs of tokens make another."""

    def __init__(self, blob: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in blob.splitlines() if line.strip())}
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        if missing := [i for i in range(256) if bytes([i]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.array(list(pairs.values()), np.int64)
        # hash tables, each for the pairs whose places were taken in those before
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        seed = 0x9E3779B97F4A7C15
        while len(keys):
            bits = max(10, int(len(keys)).bit_length() + 2)
            shift, of_key, of_rank = np.uint64(64 - bits), np.full(1 << bits, -1), np.full(1 << bits, -1)
            place = (keys.view(np.uint64) * np.uint64(seed | 1)) >> shift
            _, first = np.unique(place, return_index=True)
            of_key[place[first]], of_rank[place[first]] = keys[first], ranks[first]
            self.tables.append((np.uint64(seed | 1), shift, of_key, of_rank))
            keys, ranks = np.delete(keys, first), np.delete(ranks, first)
            seed = seed * 0xBF58476D1CE4E5B9 % (1 << 64)
        self.forget()

    def forget(self) -> None:
        self.slots = [(np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)) for _ in range(2)]  # hash, place, number of tokens
        self.store, self.used = np.zeros(1 << 16, np.int32), 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair makes; -1 for none."""
        key = a << 32 | b
        out = np.full(key.shape, -1)
        for factor, shift, of_key, of_rank in self.tables:
            at = (key.view(np.uint64) * factor) >> shift
            out = np.where(of_key[at] == key, of_rank[at], out)
        return out

    def encode_narrow(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the rows of a matrix of bytes, padded to a power of two columns: all in a row, and how many each has."""
        count, width = rows.shape
        token = np.concatenate((self.of_byte[rows], np.zeros((count, 1), np.int64)), 1)
        place = np.arange(width)
        live = place < size[:, None]
        after = np.where(place + 1 < size[:, None], place + 1, width)
        after = np.concatenate((after, np.full((count, 1), width)), 1)
        ahead = np.broadcast_to(np.arange(-1, width), (count, width + 1)).copy()
        tree = np.full((count, 2 * width), _NONE)
        r, c = np.nonzero(place + 1 < size[:, None])
        made = self.rank(token[r, c], token[r, c + 1])
        tree[r, width + c] = np.where(made >= 0, made * width + c, _NONE)
        step = width >> 1
        while step:
            tree[:, step : 2 * step] = np.minimum(tree[:, 2 * step : 4 * step : 2], tree[:, 2 * step + 1 : 4 * step : 2])
            step >>= 1
        row = np.flatnonzero(tree[:, 1] < _NONE)
        while len(row):
            root = tree[row, 1]
            at, new = root % width, root // width
            gone = after[row, at]
            follow = after[row, gone]
            token[row, at] = new
            live[row, gone] = False
            after[row, at] = follow
            ahead[row, follow] = at
            prior = ahead[row, at]
            right = np.where(follow < width, self.rank(new, token[row, follow]), -1)
            left = np.where(prior >= 0, self.rank(token[row, prior], new), -1)
            tree[row, width + gone] = _NONE
            tree[row, width + at] = np.where(right >= 0, right * width + at, _NONE)
            known = prior >= 0
            tree[row[known], width + prior[known]] = np.where(left >= 0, left * width + prior, _NONE)[known]
            node = np.stack((width + gone, width + at, width + np.where(known, prior, gone))) >> 1
            all_rows = np.broadcast_to(row, node.shape)
            while node[0, 0] if len(row) else 0:
                tree[all_rows, node] = np.minimum(tree[all_rows, 2 * node], tree[all_rows, 2 * node + 1])
                node >>= 1
            row = row[tree[row, 1] < _NONE]
        return token[:, :width][live], live.sum(1)

    def encode_long(self, piece: bytes) -> list[int]:
        """Tokens of one piece of any length, by the same tree in lists."""
        n = len(piece)
        token = [int(self.of_byte[b]) for b in piece]
        width = 1 << max(n - 1, 1).bit_length()
        none = (1 << 60, 0)
        tree = [none] * (2 * width)
        find = self.pairs.get
        for i in range(n - 1):
            if (made := find((token[i], token[i + 1]))) is not None:
                tree[width + i] = (made, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        after, ahead = [*range(1, n + 1)], [*range(-1, n - 1)]
        while tree[1] is not none:
            new, at = tree[1]
            gone = after[at]
            follow, prior = after[gone], ahead[at]
            token[at], token[gone], after[at] = new, -1, follow
            changed = [(gone, none), (at, none), (prior, none)]
            if follow < n:
                ahead[follow] = at
                if (made := find((new, token[follow]))) is not None:
                    changed[1] = (at, (made, at))
            if prior >= 0 and (made := find((token[prior], new))) is not None:
                changed[2] = (prior, (made, prior))
            for leaf, value in changed:
                if leaf < 0:
                    continue
                k = width + leaf
                tree[k] = value
                k >>= 1
                while k:
                    x, y = tree[2 * k], tree[2 * k + 1]
                    best = x if x <= y else y
                    if tree[k] == best:
                        break
                    tree[k] = best
                    k >>= 1
        return [t for t in token if t >= 0]

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes pieces and puts their tokens in store: where, and how many."""
        where, many = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        found: list[np.ndarray] = []
        at = self.used
        width, lower, alone = 2, 0, np.zeros(0, np.int64)
        while width <= WIDE:
            own = np.flatnonzero((size > lower) & (size <= width))
            if width > 64 and len(own) < 4:  # too few to go side by side
                own, alone = own[:0], np.append(alone, own)
            lower, step = width, max(1, (1 << 19) // width)
            for k in range(0, len(own), step):
                these = own[k : k + step]
                reach = np.minimum(start[these][:, None] + np.arange(width), len(data) - 1)
                tokens, counts = self.encode_narrow(data[reach], size[these])
                where[these] = at + np.cumsum(counts) - counts
                many[these] = counts
                at += len(tokens)
                found.append(tokens)
            width *= 2
        for i in np.concatenate((alone, np.flatnonzero(size > WIDE))).astype(np.int64):
            tokens = self.encode_long(data[start[i] : start[i] + size[i]].tobytes())
            where[i], many[i] = at, len(tokens)
            at += len(tokens)
            found.append(np.array(tokens, np.int64))
        if at > len(self.store):
            self.store = np.concatenate((self.store[: self.used], np.zeros(max(at, 2 * len(self.store)) - self.used, np.int32)))
        for tokens in found:
            self.store[self.used : self.used + len(tokens)] = tokens
            self.used += len(tokens)
        return where, many

    @staticmethod
    def _slot(hashes: np.ndarray, second: bool) -> np.ndarray:
        if second:
            hashes = hashes * np.uint64(0xD6E8FEB86659FD93)
        return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in store the tokens of each piece are, and how many; pieces that aren't known are learnt."""
        if self.used > REMEMBERED:
            self.forget()
        hashes = C.span_hashes(C.prefix_hashes(data), start, end)
        (key, place, number), other = self.slots
        slot = self._slot(hashes, False)
        where, many = place[slot], number[slot]
        miss = np.flatnonzero(key[slot] != hashes)
        if len(miss):
            own = hashes[miss]
            slot = self._slot(own, True)
            where[miss], many[miss] = other[1][slot], other[2][slot]
            miss = miss[other[0][slot] != own]
        if len(miss):
            unique, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            first = miss[first]
            new = self._learn(data, start[first], (end - start)[first])
            where[miss], many[miss] = new[0][inverse], new[1][inverse]
            slot = self._slot(unique, False)
            free = key[slot] == 0
            for table, at, some in ((self.slots[0], slot[free], free), (other, self._slot(unique[~free], True), ~free)):
                at, last = np.unique(at[::-1], return_index=True)  # of several for a slot one stays
                for part, value in zip(table, (unique, *new)):
                    part[at] = value[some][::-1][last]
        return where, many

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all rows, and how many each row has."""
        start = pieces(data, offsets)
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)  # piece of each row
        where, many = self._places(data, start, end)
        tokens = self.store[C.spread(where, many)]
        counts = np.diff(np.concatenate(([0], np.cumsum(many, dtype=np.int64)))[first])
        back, ends = self.decode(tokens, counts)
        if not (np.array_equal(back, data) and np.array_equal(ends, offsets)):
            each = self._exactly(data, start, end)
            tokens = np.array([t for x in each for t in x], np.int32)
            counts = np.diff(np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))[first])
        return tokens, counts

    def _exactly(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[list[int]]:
        """Tokens of each piece, told by its bytes."""
        known: dict[bytes, list[int]] = {}
        out = []
        for a, b in zip(start.tolist(), end.tolist()):
            piece = data[a:b].tobytes()
            if piece not in known:
                known[piece] = self.encode_long(piece)
            out.append(known[piece])
        return out

    def decode(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, and the offsets of the rows in them."""
        size = self.lengths[tokens]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[C.spread(self.starts[tokens], size)], ends[np.concatenate(([0], np.cumsum(counts)))]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(blob: bytes) -> Vocabulary:
    """A vocabulary, made once in each worker."""
    key = hashlib.sha256(blob).hexdigest()
    if key not in _loaded:
        _loaded[key] = Vocabulary(blob)
    return _loaded[key]


def read_vocabulary(path: str) -> bytes:
    """The file at ``path``, read on the driver: executors need not see it."""
    blob = Path(path).read_bytes()
    if len(blob) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} has {len(blob)} bytes, over {LARGEST_VOCABULARY}")
    return blob


def _lists(values: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    mask = None if valid.all() else pa.array(valid).buffers()[1]
    items = pa.array(values.astype(np.int32, copy=False), pa.int32())
    return pa.Array.from_buffers(pa.list_(pa.int32()), len(counts), [mask, pa.py_buffer(ends.tobytes())], children=[items])


def _encode(blob: bytes, column: int, check: bool, new: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(blob)
        for batch in batches:
            valid = batch.column(column).is_valid().to_numpy(zero_copy_only=False)
            data, offsets = C.utf8(batch.column(column))
            for a, b in C.chunks(offsets, _CHUNK):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                tokens, counts = words.encode(own, at)
                part = batch.slice(a, b - a)
                ok = valid[a:b]
                columns = [*part.columns, _lists(tokens, counts, ok), pa.array(counts, pa.int32(), mask=~ok)]
                if check:
                    back, ends = words.decode(tokens, counts)
                    same = np.array_equal(back, own) and np.array_equal(ends, at)
                    intact = np.full(b - a, True) if same else np.array([back[ends[i] : ends[i + 1]].tobytes() == own[at[i] : at[i + 1]].tobytes() for i in range(b - a)])
                    columns.append(pa.array(intact, pa.bool_(), mask=~ok))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *new])

    return run


def encoded(docs: DataFrame, text_col: str = "text", vocabulary_path: str = VOCABULARY, check: bool = False, keep_text: bool = True) -> DataFrame:
    """The input with ``tokens`` and ``n_tokens``, and with ``check`` also ``intact``: they decode to the very text.

    Without ``keep_text`` the text column is left out of the result.
    """
    small_batches(docs.sparkSession)
    new = [C.free(n, docs.columns) for n in ("tokens", "n_tokens", *(["intact"] if check else []))]
    kinds = [T.ArrayType(T.IntegerType()), T.IntegerType(), T.BooleanType()]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds))])
    made = docs.mapInArrow(C.tidy(_encode(read_vocabulary(vocabulary_path), docs.columns.index(text_col), check, new)), schema)
    return made if keep_text else made.drop(text_col)


def _decode(blob: bytes, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(blob)
        for batch in batches:
            lists = batch.column(column)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            counts = np.where(valid, np.diff(lists.offsets.to_numpy()), 0)
            tokens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(tokens) and (tokens.min() < 0 or tokens.max() >= words.size):
                raise ValueError("a token is not in the vocabulary")
            data, ends = words.decode(tokens, counts)
            texts = [data[ends[i] : ends[i + 1]].tobytes() if ok else None for i, ok in enumerate(valid)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, C.free("decoded", batch.schema.names)])

    return run


def decoded(tokens: DataFrame, tokens_col: str = "tokens", vocabulary_path: str = VOCABULARY) -> DataFrame:
    """The input with ``decoded``: the text of each row's tokens; null for null."""
    small_batches(tokens.sparkSession)
    schema = T.StructType([*tokens.schema.fields, T.StructField(C.free("decoded", tokens.columns), T.StringType())])
    return tokens.mapInArrow(C.tidy(_decode(read_vocabulary(vocabulary_path), tokens.columns.index(tokens_col))), schema)
