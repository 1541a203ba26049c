"""Quality rules judged by an isolation forest.

Rule statistics of each text (symbols, repeated lines and words, capitals, exclamation marks, word lengths) go into
an isolation forest: trees of random splits, in which a document that is unlike the others comes
to stand alone after few splits. The anomaly score is 2 to the power of minus the mean path length over that expected.
The forest is grown on the good rows among at most ``SAMPLE`` labelled documents, within the box that all of these
span: where bad rows are as common as one in ten, a forest grown on all rows takes them for a group and isolates none. The cut is set on their
labels, a rejected good document counting as ``FALSE_COST`` missed bad ones. Hard limits (``base_failed``) come before it.

One pass over whole texts without a shuffle; only the sampled rows' statistics reach the driver.

Behaviour: a null or empty text has no words and fails the base; repeated rows are judged alike; without
labelled rows of both kinds the forest rejects nothing; an empty table gives an empty result; other columns pass
through, one named like an added column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACES, appended, labelled_sample
from .linear import best_threshold

SAMPLE = 20_000
TREES, TREE_ROWS = 200, 256
LEAST_WORDS, MOST_REPEATED = 20, 30
REPEAT_WINDOW = 8
FALSE_COST = 4.0

_SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(_SYMBOLS)).astype(np.int64)
_IN_WORD = (~np.isin(np.arange(256), list(SPACES)) & (np.arange(256) & 0xC0 != 0x80)).astype(np.int64)
_UPPER = ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.int64)
_LOWER = ((np.arange(256) >= 97) & (np.arange(256) <= 122)).astype(np.int64)

#: The statistics that the forest splits on.
RATES = ("symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "bang_rate", "word_length")


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words within a window of ``window`` words that occurs at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    h = ids * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    whole = np.zeros(n, np.uint64)
    for i in range(window):
        whole = whole * np.uint64(0xD6E8FEB86659FD93) + h[i : i + n]
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.flatnonzero(twice), 1)
    np.add.at(step, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def rule_statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the rates of one text."""
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    chars, symbols = int(histogram @ _IN_WORD), int(histogram @ _IS_SYMBOL)
    upper, lower = int(histogram @ _UPPER), int(histogram @ _LOWER)
    n_repeat = repeated_words(words)
    n = max(1, len(words))
    rates = [
        math.sqrt(symbols / max(1, chars)),
        n_repeat / n,
        n_dup / max(1, len(lines)),
        upper / max(1, upper + lower),
        math.sqrt(int(histogram[33]) / max(1, chars)),
        chars / n,
    ]
    return (len(words), chars, symbols, n_dup, n_repeat), rates


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat > MOST_REPEATED * n_words


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as arrays: split column (-1 in a leaf), split value, left child (the right one follows), path length."""

    column: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    scale: float
    cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for column, value, left, path in zip(self.column, self.value, self.left, self.path):
            at = np.zeros(len(x), np.int64)
            for _ in range(64):
                c = column[at]
                if (c < 0).all():
                    break
                at = np.where(c < 0, at, left[at] + (x[rows, np.maximum(c, 0)] >= value[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.column) / self.scale)


def grow_forest(x: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 11, trees: int = TREES, tree_rows: int = TREE_ROWS) -> Forest:
    """Trees of random columns and split values, each on a random part of the rows ``x``.

    Columns are drawn evenly. Split values are uniform over the box that a node covers, which is [low, high] at the root: so
    a tree also cuts through regions that hold none of the rows, and what falls there is isolated early.
    """
    rng = np.random.default_rng(seed)
    size = min(tree_rows, len(x))
    depth = max(1, math.ceil(math.log2(max(2, size))))
    built = []
    for _ in range(trees):
        nodes: list[list[float]] = [[-1, 0.0, 0, 0.0]]
        todo = [(x[rng.choice(len(x), size, replace=False)], low, high, 0, 0)]
        while todo:
            part, a, b, level, at = todo.pop()
            open_ = np.flatnonzero(b > a)
            if level >= depth or len(part) < 2 or len(open_) == 0:
                nodes[at] = [-1, 0.0, 0, level + expected_path(len(part))]
                continue
            c = int(rng.choice(open_))
            v = float(rng.uniform(a[c], b[c]))
            right = part[:, c] >= v
            nodes[at] = [c, v, len(nodes), 0.0]
            below, above = b.copy(), a.copy()
            below[c] = above[c] = v
            todo += [(part[~right], a, below, level + 1, len(nodes)), (part[right], above, b, level + 1, len(nodes) + 1)]
            nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
        built.append(np.array(nodes))
    most = max(map(len, built))
    stacked = np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), constant_values=-1) for b in built])
    return Forest(stacked[:, :, 0].astype(np.int64), stacked[:, :, 1], stacked[:, :, 2].astype(np.int64), stacked[:, :, 3], max(expected_path(size), 1e-9), float("inf"))


def fit_forest(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, seed: int = 3) -> Forest | None:
    """A forest from labelled rows (label 0: bad); None if there are not both kinds."""
    some = labelled_sample(docs, labels, (label,), sample, seed).select("text", label)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rule_statistics(t) for t in batch.column(0).to_pylist()]
            failed = [base_failed(s[0], s[4]) for s, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([r for _, r in found], pa.list_(pa.float64())), pa.array(failed, pa.bool_()), batch.column(1).cast(pa.int32())], names=["rates", "failed", "good"])

    rows = [r for r in some.mapInArrow(encode, "rates array<double>, failed boolean, good int").collect() if not r.failed]  # bounded by sample
    rows.sort(key=lambda r: (r.rates, r.good))
    bad = np.array([r.good == 0 for r in rows], bool)
    if not 0 < bad.sum() < len(bad):
        return None
    x = np.array([r.rates for r in rows])
    forest = grow_forest(x[~bad], x.min(0), x.max(0), seed)
    forest.cut = best_threshold(forest.scores(x), bad, FALSE_COST)
    return forest


ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, kept boolean"


def judge_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``docs`` and its statistics, base_failed, anomaly (0 to 1; 0 without a forest) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_forest(docs, labels, label))  # TREES of at most 2 * TREE_ROWS nodes

    def start():
        forest: Forest | None = shared.value

        def make(text: pa.Array) -> list[pa.Array]:
            found = [rule_statistics(t) for t in text.to_pylist()]
            if not found:
                return [pa.array([], t) for t in (*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_())]
            counts = np.array([s for s, _ in found], np.int64)
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            anomaly = forest.scores(np.array([r for _, r in found])) if forest else np.zeros(len(found))
            rejected = anomaly >= forest.cut if forest else np.zeros(len(found), bool)
            return [*(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(anomaly), pa.array(~failed & ~rejected)]

        return make

    return appended(docs, ["text"], ADDED, start)
