"""Shannon entropy of strings, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon(value: Column, charset: str | None = None) -> Column:
    """Bits per byte over the characters of ``charset`` (a regex class; all if None); 0 for an empty string."""
    size = F.octet_length(value).cast("double")
    chars = F.array_distinct(F.split(value if charset is None else F.regexp_replace(value, f"[^{charset}]", ""), ""))
    chars = F.filter(chars, lambda c: c != "")

    def add(total: Column, c: Column) -> Column:
        p = (F.length(value) - F.length(F.replace(value, c, F.lit("")))) / size
        return total - p * F.log2(p)

    return F.when(size > 0, F.aggregate(chars, F.lit(0.0), add)).otherwise(F.lit(0.0))


def hex_shannon(value: Column, charset: str | None = "0-9A-Fa-f") -> Column:
    """Entropy as hexadecimal; numbers of two and more digits count less the shorter they are."""
    plain = shannon(value, charset)
    return F.when((F.length(value) > 1) & value.rlike("\\A[0-9]+\\z"), plain - 1.2 / F.log2(F.length(value))).otherwise(plain)


def _entropies(size: int, chars: list[int] | None = None):
    """A function of the lengths and the bytes of ASCII strings that lie one after the other: their entropies.

    ``which`` are measured as hexadecimal. Bytes are counted ``size`` at a time, in a column for each of ``chars``, of which
    all strings are (all of ASCII if None).
    """

    def entropies(lengths, data, which):
        import numpy as np

        columns = np.arange(128) if chars is None else np.array(chars)
        code, width = np.zeros(256, np.int64), len(columns)
        code[columns] = np.arange(width)
        ends = np.cumsum(lengths)
        starts, counts = ends - lengths, np.zeros((len(lengths), width), np.int32)
        for low in range(0, len(data), size):
            high = min(low + size, len(data))
            i, j = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high - 1, "right") + 1
            within = np.minimum(ends[i:j], high) - np.maximum(starts[i:j], low)
            cells = np.repeat(np.arange(j - i) * width, within) + code[data[low:high]]
            counts[i:j] += np.bincount(cells, minlength=(j - i) * width).reshape(j - i, width).astype(np.int32)

        def terms(n):
            return n * np.log2(np.maximum(n, 1))

        # most counts are small and come again and again
        few = int(counts.max(initial=0)) < 1 << 16
        each = terms(np.arange(counts.max(initial=0) + 1).astype(float))[counts] if few else terms(counts.astype(float))
        n = np.maximum(lengths, 1).astype(float)
        plain = np.log2(n) - each.sum(axis=1) / n
        digits = which & (lengths > 1) & (counts[:, (columns >= 48) & (columns < 58)].sum(axis=1) == lengths)
        return np.where(digits, plain - 1.2 / np.log2(np.maximum(n, 2)), plain)

    return entropies


def strong_ones(values: int = 1 << 14, size: int = 4 << 20):
    """A function of (quoted, bare, limit, of_hex): the quoted strings above the limit, or else the bare ones above it.

    Strings are ASCII, as all charsets are. As expressions the count of each character costs a pass over the string for each
    other character; here bytes are counted once, for ``values`` strings and ``size`` bytes at a time however many there are.
    """
    entropies = _entropies(size)

    @F.arrow_udf("array<string>")
    def pick(quoted, bare, limit, of_hex):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def strong(lists):
            """The strings above the limit, and the rows that they are of."""
            rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            flat = lists.flatten().cast("large_binary")
            keep = np.zeros(len(flat), bool)
            for k in range(0, len(flat), values):
                part, at = flat.slice(k, values), rows[k : k + values]
                ends = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
                data = np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
                keep[k : k + values] = np.round(entropies(np.diff(ends), data, hexes[at]), 12) > limits[at]
            return rows[keep], flat.filter(pa.array(keep)).cast("string")

        limits, hexes = limit.to_numpy(zero_copy_only=False), pc.fill_null(of_hex, False).to_numpy(zero_copy_only=False)
        q_rows, q = strong(quoted)
        b_rows, b = strong(bare)
        alone = ~np.isin(b_rows, q_rows)
        rows, found = np.concatenate([q_rows, b_rows[alone]]), pa.concat_arrays([q, b.filter(pa.array(alone))])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(limits)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), found.take(pa.array(np.argsort(rows, kind="stable"))))

    return pick


def strong_in(charset: str, limit: float, of_hex: bool, eager: bool = True, values: int = 1 << 14, size: int = 1 << 20):
    """A function of lines: their strings of the charset (a regex class of ASCII) above the limit, in quotes, or else bare ones.

    It does what the patterns ``"([charset]+)"``, the same in single quotes, and ``[charset]+`` do one line after another, for
    all lines of about ``size`` bytes at once; a longer line is taken by itself.
    """
    import re

    member = [re.fullmatch(f"[{charset}]", chr(c)) is not None for c in range(128)] + [False] * 128
    entropies, least = _entropies(size, [c for c in range(128) if member[c]]), least_length(limit)

    @F.arrow_udf("array<string>")
    def pick(lines):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = np.array(member)

        def strong(data, starts, ends):
            """Which strings are above the limit."""
            lengths, keep = ends - starts, np.zeros(len(starts), bool)
            total, i = np.cumsum(lengths), 0
            while i < len(starts):
                j = min(max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + size, "right"))), i + values)
                n = lengths[i:j]
                flat = data[np.repeat(starts[i:j] - (np.cumsum(n) - n), n) + np.arange(n.sum())] if j > i + 1 else data[starts[i] : ends[i]]
                keep[i:j] = np.round(entropies(n, flat, of_hex), 12) > limit
                i = j
            return keep

        def look(data, edges):
            """Rows, starts and ends of what is found in lines that lie between edges."""
            inside = table[data]
            first, last = inside.copy(), inside.copy()
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            cut = edges[:-1][edges[:-1] < len(data)]
            first[cut] = inside[cut]
            cut = edges[1:][edges[1:] > 0] - 1
            last[cut] = inside[cut]
            starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
            out = []
            for quote in b"\"'":
                s = np.flatnonzero((data[starts - 1] == quote) & (data[np.minimum(ends, len(data) - 1)] == quote)) if len(starts) else starts
                row = np.searchsorted(edges, starts[s], "right") - 1
                s = s[(starts[s] > edges[row]) & (ends[s] < edges[row + 1])]
                # of strings that share a quote, what the one before has taken isn't there for the next
                n = np.arange(len(s))
                alone = np.ones(len(s), bool)
                alone[1:] = starts[s[1:]] != ends[s[:-1]] + 1
                s = s[(n - np.maximum.accumulate(np.where(alone, n, 0))) % 2 == 0]
                s = s[ends[s] - starts[s] >= least]
                out.append(s[strong(data, starts[s], ends[s])])
            s = np.concatenate(out)
            rows = np.searchsorted(edges, starts[s], "right") - 1
            if eager:
                b = np.flatnonzero(ends - starts >= least)
                at = np.searchsorted(edges, starts[b], "right") - 1
                b, at = b[(alone := ~np.isin(at, rows))], at[alone]
                good = strong(data, starts[b], ends[b])
                s, rows = np.concatenate([s, b[good]]), np.concatenate([rows, at[good]])
            order = np.argsort(rows, kind="stable")
            return rows[order], starts[s[order]], ends[s[order]]

        whole = pc.fill_null(lines.cast("large_string"), "").cast("large_binary")
        edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        counts, parts, i = np.zeros(len(whole), np.int64), [pa.array([], "string")], 0
        while i < len(whole):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + size, "right")) - 1)
            if edges[j] > edges[i]:
                data = np.frombuffer(whole.buffers()[2], np.uint8)[edges[i] : edges[j]]
                rows, starts, ends = look(data, edges[i : j + 1] - edges[i])
                counts[i:j] = np.bincount(rows, minlength=j - i)
                lengths = ends - starts
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                flat = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
                parts.append(pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))).cast("string"))
            i = j
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(parts))

    return pick


def least_length(limit: float) -> int:
    """Shorter strings can't exceed the limit: entropy is at most log2 of the length."""
    return max(1, math.floor(2**limit) + 1)


def above(entropy: Column, limit: float) -> Column:
    """Strictly, apart from the last digits that depend on the order of summation."""
    return F.round(entropy, 12) > limit
