"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

1. ``LABELLERS`` are overlapping heuristics over byte and word statistics of a whole text. Each votes good, bad or
   not at all, on every document. How often each pattern of votes occurs is counted over all documents.
2. Expectation-maximisation on those counts estimates, for both classes, how each labeller votes, and so the
   posterior of every pattern. There are at most 3 ** len(LABELLERS) patterns, whatever the input.
3. Documents of a sample bounded by ``TRAIN_DOCS`` with their posteriors train a logistic scorer over hashed features:
   the byte trigrams of the text and a few bucketed word statistics. It scores every document.

Defined results: a null, empty or white-space text scores 0 and is rejected; texts shorter than a trigram are scored
by their word statistics; rows with a null id are scored like others. With no document that has a vote, every text
with content scores 1. Equal texts have equal scores, and of those in the sample one is fitted on. Other columns pass
through unread; if one has the new column's name, that gets underscores at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_batches
from . import columnar as C

#: The scorer is fitted on about this many documents, chosen by a hash of their text; everything else reads all.
TRAIN_DOCS = 6000
BITS = 16
EPOCHS = 6
THRESHOLD = 0.5
FALSE_ALARMS = 0.001
_GRAM_SCALE = 20.0

#: name, statistic, bad from, good up to, least words: a labeller votes bad at or above one and good at or below the other.
LABELLERS = [
    ("symbols", "symbol_share", 0.05, 0.01, 1),
    ("capitals", "capital_share", 0.5, 0.2, 3),
    ("echoes", "echo_share", 0.2, 0.05, 8),
    ("shouting", "shout_rate", 0.25, 0.02, 3),
    ("ragged words", "ragged_share", 0.25, 0.05, 3),
    ("table bars", "bar_rate", 0.2, 0.02, 3),
    ("digits", "digit_share", 0.3, 0.1, 1),
    ("long words", "word_length", 25.0, 12.0, 3),
]
STATISTICS = sorted({x[1] for x in LABELLERS})

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|@^~=<>{}[]\\+_", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122))
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\r\n\x0b\x0c", np.uint8))
#: Counts of several kinds of bytes in one integer, each with so many bits.
_BITS = 21
_PACKED = [sum(x.astype(np.int64) << (_BITS * k) for k, x in enumerate(kinds)) for kinds in ((_SYMBOL, _UPPER, _LETTER), (~_SPACE, _DIGIT))]


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Per text: the number of words and every statistic of STATISTICS."""
    rows = len(offsets) - 1

    def counts(kinds: np.ndarray) -> list[np.ndarray]:
        """Of each kind packed in a table of bytes, how many each text has."""
        sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        for a in range(0, len(data), 1 << (_BITS - 1)):
            run = np.concatenate(([0], np.cumsum(kinds[data[a : a + (1 << (_BITS - 1))]])))
            own = np.diff(run[np.clip(offsets - a, 0, len(run) - 1)])
            for k, out in enumerate(sums):
                out += own >> (_BITS * k) & ((1 << _BITS) - 1)
        return [x.astype(float) for x in sums]

    def few(byte: int) -> np.ndarray:
        return np.bincount(np.searchsorted(offsets, np.flatnonzero(data == byte), "right") - 1, minlength=rows)

    start, end, row = C.words(data, offsets, ~_SPACE)
    words = np.bincount(row, minlength=rows).astype(float)
    symbols, capitals, letters = counts(_PACKED[0])
    solid, digits, _ = counts(_PACKED[1])
    hashes = C.span_hashes(C.prefix_hashes(data), start, end)
    echo = np.append(False, (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])) if len(row) else np.zeros(0, bool)
    # a word that ends in two or more signs
    tail = (end - start >= 3) & ~C.WORD[data[end - 1]] & ~C.WORD[data[np.maximum(end - 2, 0)]] if len(row) else np.zeros(0, bool)
    some, solids = np.maximum(words, 1), np.maximum(solid, 1)
    return {
        "words": words,
        "solid": solid,
        "symbol_share": symbols / solids,
        "capital_share": capitals / np.maximum(letters, 1),
        "echo_share": np.bincount(row, echo, rows) / some,
        "shout_rate": few(33) / some,
        "ragged_share": np.bincount(row, tail, rows) / some,
        "bar_rate": few(124) / some,
        "digit_share": digits / solids,
        "word_length": solid / some,
    }


def votes(stats: dict[str, np.ndarray]) -> np.ndarray:
    """A row per text and a column per labeller: 2 good, 0 bad, 1 no vote."""
    out = np.ones((len(stats["words"]), len(LABELLERS)), np.int64)
    for k, (_, name, bad, good, least) in enumerate(LABELLERS):
        x, enough = stats[name], stats["words"] >= least
        out[enough & (x <= good), k] = 2
        out[enough & (x >= bad), k] = 0
    return out


def _each(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = C.utf8(texts)
    for a, b in C.chunks(offsets):
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _codes(texts: pa.Array) -> np.ndarray:
    base = 3 ** np.arange(len(LABELLERS))
    parts = [np.where((s := statistics(*x))["solid"] > 0, votes(s) @ base, -1) for x in _each(texts)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@F.arrow_udf(T.LongType())
def vote_code(texts: pa.Array) -> pa.Array:
    """The votes of all labellers as one number in base 3; -1 for a text without content."""
    codes = pa.array(_codes(texts), pa.int64())
    C.trim()
    return codes


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, accuracy of each labeller, and the share of good texts.

    Bad texts are bad in different ways, of which most labellers see only some. So beside the good class there is a
    bad one for each labeller, which starts with the patterns in which that labeller votes bad; votes are independent
    within a class. A labeller that alone sees a kind of bad text agrees with no other, so counts can't tell its hits
    from false alarms; the prior belief is that it accuses at most ``FALSE_ALARMS`` of the good texts. A text on
    which a labeller doesn't vote says nothing about it.
    """
    m = patterns.shape[1]
    bad, fine = (patterns == 0).astype(float), (patterns == 2).astype(float)
    of = np.zeros((m + 1, len(patterns)))
    accused = bad.sum(1)
    of[0] = np.where(accused > 0, 0.05, 1)
    of[1:] = np.where(accused > 0, 0.95 / np.maximum(accused, 1), 0) * bad.T
    for _ in range(rounds):
        weight = of * counts
        share = weight.sum(1) / max(counts.sum(), 1)
        no, yes = weight @ bad + 0.5, weight @ fine + 0.5  # class by labeller
        no, yes = no / (no + yes), yes / (no + yes)
        no[0], yes[0] = np.minimum(no[0], FALSE_ALARMS), np.maximum(yes[0], 1 - FALSE_ALARMS)
        for k in range(m):
            no[k + 1, k], yes[k + 1, k] = max(no[k + 1, k], 0.5), min(yes[k + 1, k], 0.5)
        odds = np.log(np.maximum(share, 1e-300))[:, None] + np.log(no) @ bad.T + np.log(yes) @ fine.T
        new = np.exp(odds - odds.max(0))
        new /= new.sum(0)
        moved = np.abs(new - of).max(initial=0)
        of = new
        if moved < 1e-9:
            break
    good = of[0]
    right = counts @ (fine * good[:, None] + bad * (1 - good)[:, None])
    return good, right / np.maximum(counts @ (bad + fine), 1), float((counts * good).sum() / max(counts.sum(), 1))


def _grams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    return ((x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _buckets(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Hashed places of the bucketed word statistics, beyond those of the trigrams: a column for each."""
    cols = [(1 << BITS) + 16 * k + np.minimum(np.sqrt(np.clip(stats[s] / (40 if s == "word_length" else 1), 0, 1)) * 15, 15).astype(np.int64) for k, s in enumerate(STATISTICS)]
    return np.stack(cols, 1)


SIZE = (1 << BITS) + 16 * len(STATISTICS)


def fit_scorer(texts: list[bytes], target: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer, by AdaGrad on soft targets."""
    weights, squares = np.zeros(SIZE + 1), np.full(SIZE + 1, 1e-8)
    features = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        own = _buckets(statistics(data, np.array([0, len(data)])))[0]
        place, n = np.unique(_grams(data), return_counts=True) if len(data) >= 3 else (np.zeros(0, np.int64), np.zeros(0))
        where = np.concatenate((place.astype(np.int64), own, [SIZE]))
        features.append((where, np.concatenate((n * (_GRAM_SCALE / max(n.sum(), 1)), np.full(len(own), 0.5), [1.0]))))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(features)):
            where, value = features[i]
            step = (1 / (1 + np.exp(-np.clip(weights[where] @ value, -40, 40))) - target[i]) * value
            squares[where] += step**2
            weights[where] -= 0.1 * step / np.sqrt(squares[where])
    return weights


def score_texts(weights: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Probability that each text is good; 0 without content."""
    parts = []
    grams = weights[: 1 << BITS].astype(np.float32)
    for data, offsets in _each(texts):
        stats = statistics(data, offsets)
        size = np.diff(offsets)
        total = np.zeros(len(size))
        if len(data) >= 3:
            each = np.concatenate(([0.0], np.cumsum(grams[_grams(data)], dtype=float)))
            last = np.maximum(offsets[1:] - 2, offsets[:-1])
            total = np.where(size >= 3, (each[np.minimum(last, len(each) - 1)] - each[np.minimum(offsets[:-1], len(each) - 1)]) / np.maximum(size - 2, 1), 0)
        odds = total * _GRAM_SCALE + 0.5 * weights[_buckets(stats)].sum(1) + weights[SIZE]
        parts.append(np.where(stats["solid"] > 0, 1 / (1 + np.exp(-np.clip(odds, -40, 40))), 0.0))
    return np.concatenate(parts) if parts else np.zeros(0)


def _train(table: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, target = [], []
        for batch in batches:
            texts += batch.column("text").cast(pa.binary()).to_pylist()
            target += [table[x] for x in batch.column("code").to_pylist()]
        # the order in which rows arrive must not matter
        order = sorted(range(len(texts)), key=lambda i: texts[i])
        weights = fit_scorer([texts[i] for i in order], np.array([target[i] for i in order])) if texts else None
        if weights is not None:
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], names=["weights"])

    return run


def fit(docs: DataFrame, text_col: str = "text", train_docs: int = TRAIN_DOCS) -> np.ndarray:
    """The scorer's weights for these documents: votes counted over all of them, the scorer fitted on a bounded sample."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    counted = texts.select(vote_code("text").alias("code")).where("code >= 0").groupBy("code").count().collect()
    if not counted:
        return np.append(np.zeros(SIZE), 40.0)
    codes, counts = np.array([r["code"] for r in counted]), np.array([r["count"] for r in counted], float)
    good, _, _ = fit_labellers(codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, counts)
    table = dict(zip(codes.tolist(), good.tolist()))
    share = min(1.0, train_docs / counts.sum())
    chosen = texts.where((F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))) < int(share * (1 << 40)))
    # each text once: copies, however many, are one task's partial result
    coded = chosen.distinct().select("text", vote_code("text").alias("code")).where("code >= 0")
    found = coded.repartition(1).mapInArrow(C.tidy(_train(table)), "weights binary").collect()
    return np.frombuffer(found[0]["weights"]) if found else np.append(np.zeros(SIZE), 40.0)


def scorer(weights: np.ndarray):
    """A column function: text -> probability of good."""

    @F.arrow_udf(T.DoubleType())
    def quality(texts: pa.Array) -> pa.Array:
        scores = pa.array(score_texts(weights, texts), pa.float64())
        C.trim()
        return scores

    return quality


def scored(docs: DataFrame, text_col: str = "text", name: str = "quality", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The input with the probability of good beside its columns."""
    score: Column = scorer(fit(docs, text_col, train_docs))(F.col(text_col).cast("string"))
    return docs.withColumn(C.free(name, docs.columns), score)


def good_documents(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The documents that the classifier keeps, with the columns of the input."""
    name = C.free("__cs_quality", docs.columns)
    return scored(docs, text_col, name, train_docs).where(F.col(name) >= threshold).drop(name)
