"""Texts to lines: numbered from 1, each with the line before it, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches


def split_lines(text: Column) -> Column:
    """Lines end at LF or CRLF; a lone CR stays, and nothing follows a final line end."""
    cut = [F.when(text.endswith(end), F.substring(text, F.lit(1), F.length(text) - len(end))) for end in ("\r\n", "\n")]
    # by one character, which needs no pattern, and once
    parts = F.split(F.replace(F.coalesce(*cut, text), F.lit("\r\n"), F.lit("\n")), "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(parts)


_LINE = "struct<line_number:bigint,line:string,previous:string>"


def lines_with(sign: str, size: int = 4 << 20):
    """A function of texts: those of their lines, as :func:`split_lines` makes them, in which a pattern for RE2 is found.

    Texts of about ``size`` bytes are searched at once, where they lie; a longer one by itself. Bytes are Latin-1 for the
    pattern, which sees a line with its end. Other lines aren't made.
    """

    @F.arrow_udf(f"array<{_LINE}>")
    def pick(texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def strings(data, starts, lengths):
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            flat = data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])]
            return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))).cast("string")

        def look(data, edges):
            """Counts for each text, and numbers, lines and those before them."""
            starts = np.union1d(edges[:-1], np.flatnonzero(data == 10) + 1)
            starts = starts[starts < len(data)]
            ends = np.append(starts[1:], len(data))
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
            at = np.flatnonzero(pc.match_substring_regex(whole, sign).to_numpy(zero_copy_only=False))
            rows = np.searchsorted(edges, starts[at], "right") - 1
            numbers = at - np.searchsorted(starts, edges[rows])
            ends -= data[ends - 1] == 10
            # a line that has lost its LF loses one CR as well
            ends -= (ends > starts) & (np.append(starts[1:], len(data)) > ends) & (data[ends - 1] == 13)
            before = np.where(numbers > 0, at - 1, at)
            lengths = np.where(numbers > 0, ends[before] - starts[before], 0)
            return np.bincount(rows, minlength=len(edges) - 1), pa.array(numbers + 1), strings(data, starts[at], ends[at] - starts[at]), strings(data, starts[before], lengths)

        whole = pc.fill_null(texts.cast("large_string"), "").cast("large_binary")
        edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        counts, parts, i = np.zeros(len(whole), np.int64), [], 0
        while i < len(whole):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + size, "right")) - 1)
            if edges[j] > edges[i]:
                data = np.frombuffer(whole.buffers()[2], np.uint8)[edges[i] : edges[j]]
                counts[i:j], *found = look(data, edges[i : j + 1] - edges[i])
                parts.append(found)
            i = j
        columns = [pa.concat_arrays([pa.array([], kind), *(p[k] for p in parts)]) for k, kind in enumerate(("int64", "string", "string"))]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["line_number", "line", "previous"]))

    return pick


def lines_of(files: DataFrame, text_col: str = "text", sign: str | None = None) -> DataFrame:
    """The input with ``line_number``, ``line`` and ``previous`` in place of its text column; with a ``sign``, those lines alone that have it."""
    others = [c for c in files.columns if c != text_col]
    if sign:
        small_batches(files.sparkSession)
        some = files.select(*others, lines_with(sign)(F.col(text_col)).alias("__some"))
        # not the column alone: for that a filter would be inferred, in which texts are searched once more
        each = F.expr(f"if(size(__some) > 0, __some, cast(array() as array<{_LINE}>))")
        return some.select(*others, F.explode(each).alias("__l")).select(*others, "__l.*")
    cut = files.select(*others, split_lines(F.col(text_col)).alias("__lines"))
    each = F.transform("__lines", lambda line, i: F.struct((i + 1).cast("bigint").alias("line_number"), line.alias("line"), F.when(i == 0, "").otherwise(F.get("__lines", i - 1)).alias("previous")))
    return cut.select(*others, F.explode(each).alias("__l")).select(*others, "__l.*")


def with_context(lines: DataFrame, n: int, key: str = "filename") -> DataFrame:
    """Each line with ``context``: up to n lines on either side of it and itself."""
    from pyspark.sql import Window

    around = Window.partitionBy(key).orderBy("line_number").rowsBetween(-n, n)
    return lines.withColumn("context", F.collect_list("line").over(around))
