"""Toxicity by a classifier chain.

Categories are predicted one after the other: each has a logistic regression on the words and word
beginnings of a text, and each after the first also sees the probabilities of the categories
before it. In training these come from out-of-fold predictions, so a later model learns from
probabilities as good as those it will meet.

The models are fitted on a sample of at most ``SAMPLE`` labelled documents (folds by hash of the text,
so copies share a fold); features are the ``FEATURES`` with the strongest association with a
category among those of ``LEAST_ROWS`` rows or more, if it gains ``LEAST_GAIN`` in log-likelihood. A fold's out-of-fold predictions
come from features chosen and weights fitted without its rows, and the cut that flags a category is set on them.
Prediction is one pass over whole texts without a shuffle.

Behaviour: null and empty texts have no features; with no labelled rows, or none of a
category, nothing is flagged and the probability is 0; repeated rows are scored alike; an empty
table gives an empty result; other columns pass through, one named like an added column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, discard, labelled_sample, settled
from .linear import Rows, best_threshold, fit_logistic, sigmoid

SAMPLE = 12_000
FEATURES = 3000
FOLDS = 4
BEGINNINGS = range(4, 9)
LEAST_ROWS = 3
#: Log-likelihood that a feature must gain; chance alone reaches it in few of thousands of features.
LEAST_GAIN = 6.0
#: A clean document flagged costs as much as so many toxic ones missed.
FALSE_COST = 2.0

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(word[:k] for k in BEGINNINGS if k <= len(word))]


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def _fold(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "").encode(), 7) % FOLDS


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of each feature by labels and fold, summed up within a task as far as memory allows; one without a name counts the documents."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(held)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], names=["feature", "labels", "fold", "n"])
        held.clear()
        return out

    for batch in batches:
        for text, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fold = _fold(text)
            held.update((f, labels, fold) for f in {"", *(f for w in text_words(text) for f in word_features(w))})
            if len(held) > 400_000:
                yield flush()
    if held:
        yield flush()


def strongest_features(sample: DataFrame, n_labels: int, most: int) -> list[list[str]]:
    """The features most associated with a label, by the likelihood ratio of presence: over all rows, then without each fold's."""
    packed = sample.select("text", sum((F.col(f"_y{i}").cast("int") * 2**i for i in range(n_labels)), F.lit(0)).alias("labels"))
    counts = packed.mapInArrow(_counts, "feature string, labels int, fold int, n long")
    of = lambda wanted: F.sum(F.when(wanted, F.col("n")).otherwise(0))
    has = lambda i: F.col("labels").bitwiseAND(F.lit(2**i)) != 0
    parts = [(-1, F.lit(True)), *((k, F.col("fold") != k) for k in range(FOLDS))]
    sums = [of(rows).alias(f"n{k}") for k, rows in parts] + [of(rows & has(i)).alias(f"n{k}_{i}") for k, rows in parts for i in range(n_labels)]
    table = settled(counts.groupBy("feature").agg(*sums).filter(F.col("n-1") >= LEAST_ROWS))
    sizes = table.filter("feature = ''").first()
    found = []
    for k, _ in parts:
        n, total, gains = F.col(f"n{k}"), sizes[f"n{k}"] if sizes else 0, []
        for i in range(n_labels):
            positive = sizes[f"n{k}_{i}"] if sizes else 0
            if 0 < positive < total:
                a, b = F.col(f"n{k}_{i}"), n - F.col(f"n{k}_{i}")
                rate = n / total
                part = lambda x, e: F.when((x > 0) & (e > 0), x * F.ln(x / e)).otherwise(0.0)
                gains.append(part(a, rate * positive) + part(b, rate * (total - positive)) + part(positive - a, (1 - rate) * positive + 1e-9) + part(total - positive - b, (1 - rate) * (total - positive) + 1e-9))
        ranked = table.select("feature", F.greatest(*gains, F.lit(0.0), F.lit(0.0)).alias("gain")).filter((n >= LEAST_ROWS) & (F.col("gain") >= LEAST_GAIN) & (F.col("feature") != ""))
        found.append([r.feature for r in ranked.orderBy(F.desc("gain"), "feature").limit(most).collect()] if gains else [])
    discard(table)
    return found


def _present(features: dict[str, int]):
    known: dict[str, tuple[int, ...]] = {}

    def columns(text: str | None) -> list[int]:
        out: set[int] = set()
        for w in text_words(text):
            found = known.get(w)
            if found is None:
                if len(known) > 200_000:
                    known.clear()
                found = known[w] = tuple(features[f] for f in word_features(w) if f in features)
            if found:
                out.update(found)
        return sorted(out)

    return columns


@dataclass
class Chain:
    """The fitted models: features, and for each category its weights (features, earlier categories, intercept) and cut."""

    categories: tuple[str, ...]
    features: dict[str, int]
    weights: list[np.ndarray]
    cuts: list[float]

    def probabilities(self, rows: Rows) -> np.ndarray:
        found = np.zeros((rows.n, len(self.categories)))
        for j, w in enumerate(self.weights):
            if len(w):
                found[:, j] = sigmoid(rows.dot(w) + found[:, :j] @ w[rows.width : rows.width + j] + w[-1])
        return found


def fit_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int = SAMPLE, features: int = FEATURES, seed: int = 5) -> Chain:
    """A chain over the label columns ``categories`` (over 0: yes), in their order."""
    some = settled(labelled_sample(docs, labels, categories, sample, seed).select("text", *((F.col(c) > 0).alias(f"_y{i}") for i, c in enumerate(categories))))
    names, *by_fold = strongest_features(some, len(categories), features)
    known = {f: i for i, f in enumerate(dict.fromkeys(f for own in (names, *by_fold) for f in own))}
    own = [np.isin(np.arange(len(known)), [known[f] for f in chosen]) for chosen in (names, *by_fold)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _present(known)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([columns(t) for t in texts], pa.list_(pa.int32())), pa.array([_fold(t) for t in texts], pa.int32()), *batch.columns[1:]], names=["columns", "fold", *batch.schema.names[1:]])

    found = some.mapInArrow(encode, "columns array<int>, fold int, " + ", ".join(f"_y{i} boolean" for i in range(len(categories)))).collect()  # a row for each of the sampled documents
    discard(some)
    found.sort(key=lambda r: (r.fold, r.columns, *r[2:]))
    rows = Rows([r.columns for r in found], len(known))
    fold = np.array([r.fold for r in found], np.int64)
    chain = Chain(categories, {f: known[f] for f in names}, [], [])
    held_out = np.zeros((rows.n, len(categories)))
    for j in range(len(categories)):
        y = np.array([r[2 + j] for r in found], bool)
        if not 0 < y.sum() < len(y):
            chain.weights.append(np.zeros(0))
            chain.cuts.append(float("inf"))
            continue
        before = held_out[:, :j]
        for k in range(FOLDS):
            w = fit_logistic(rows, before, y, fold != k, own[k + 1])
            z = rows.dot(w) + before @ w[rows.width : rows.width + j] + w[-1]
            held_out[fold == k, j] = sigmoid(z)[fold == k]
        w = fit_logistic(rows, before, y, np.ones(rows.n, bool), own[0])
        chain.weights.append(np.concatenate((w[: len(names)], w[rows.width :])))  # features of all rows come first
        chain.cuts.append(best_threshold(held_out[:, j], y, FALSE_COST))
    return chain


def score_toxicity(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` and for each category its probability ``p_<category>`` and verdict ``is_<category>``."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # bounded by the number of features
    added = ", ".join(f"p_{c} double, is_{c} boolean" for c in chain.categories)

    def start():
        model: Chain = shared.value
        columns = _present(model.features)

        def make(text: pa.Array) -> list[pa.Array]:
            p = model.probabilities(Rows([columns(t) for t in text.to_pylist()], len(model.features)))
            return [x for j, cut in enumerate(model.cuts) for x in (pa.array(p[:, j]), pa.array(p[:, j] >= cut))]

        return make

    return appended(docs, ["text"], added, start)
