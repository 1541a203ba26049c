"""Language identification of documents that may mix languages.

Each language is a distribution over hashed character n-grams (one to three characters, words
apart by one blank), counted over all training documents and smoothed. A text is taken as a mixture of languages:
expectation-maximisation estimates the proportions from the n-grams' likelihoods, and the set of
languages grows from the likeliest as long as the likelihood gains more than a penalty per language.

Training is one pass with per-task counts, summed in a shuffle whose size is languages times
buckets; prediction is one pass without a shuffle.

Behaviour: a null text, or one without a letter, is ``und`` with score 0 and no languages; without training
rows every text is; equal proportions go to the language that is first in the alphabet; repeated rows are
predicted alike; an empty table gives an empty result; other columns pass through, one
named like an added column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended

BUCKETS = 1 << 14
ORDERS = 3
SMOOTHING = 0.5
ROUNDS = 12
#: Log-likelihood that one more language must gain, times the logarithm of the number of n-grams.
PENALTY = 3.0
UNDETERMINED = "und"

_BETWEEN = re.compile(r"[\W\d_]+")


def gram_buckets(text: str | None) -> np.ndarray:
    """The bucket of each n-gram of a text; none if it has no letter."""
    plain = _BETWEEN.sub(" ", (text or "").lower()).strip()
    if not plain:
        return np.empty(0, np.int64)
    a = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    out, code = [], np.zeros(len(a), np.uint32)
    for order in range(ORDERS):
        if len(a) <= order:
            break
        code = (code[: len(a) - order] + a[order:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        code = code ^ (code >> np.uint32(15))
        out.append((code >> np.uint32(3)) % np.uint32(BUCKETS) + np.uint32(order * BUCKETS))
    return np.concatenate(out).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            grams = gram_buckets(text.as_py())
            if len(grams):
                held.setdefault(lang.as_py(), np.zeros(ORDERS * BUCKETS, np.int64))
                held[lang.as_py()] += np.bincount(grams, minlength=ORDERS * BUCKETS)
        if len(held) > 64:
            yield from flush()
    yield from flush()


def fit_languages(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log probability of each bucket in each; training: text, lang."""
    rows = training.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(_train_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = counts.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).orderBy("lang").toArrow()  # languages times buckets
    names = by_lang.column("lang").to_pylist()
    table = np.full((len(names), ORDERS * BUCKETS), SMOOTHING)
    for i, (at, n) in enumerate(zip(by_lang.column("buckets"), by_lang.column("n"))):
        table[i, at.values.to_numpy()] += n.values.to_numpy()
    for order in range(ORDERS):
        part = table[:, order * BUCKETS : (order + 1) * BUCKETS]
        part /= part.sum(1, keepdims=True)
    return names, np.log(table).astype(np.float32)


def _mixture(p: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (likelihoods, language by n-gram) and the log-likelihood."""
    share = np.full(len(p), 1 / len(p))
    total = counts.sum()
    for _ in range(rounds):
        mixed = share @ p
        share = share * (p @ (counts / mixed)) / total
    return share, float(counts @ np.log(share @ p))


def infer(grams: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions) of one text, the largest first."""
    counts = np.bincount(grams, minlength=logs.shape[1])
    at = np.flatnonzero(counts)
    counts = counts[at].astype(np.float64)
    part = logs[:, at]
    peak = part.max(0)
    p = np.exp(part - peak).astype(np.float64)
    single = part @ counts
    chosen = np.array([int(np.argmax(single))])
    share, best = np.ones(1), float(single[chosen[0]] - counts @ peak)
    if len(logs) == 1:
        return chosen, share
    slope = p @ (counts / p[chosen[0]])
    if slope.max() <= counts.sum() * (1 + 1e-9):  # the likelihood is concave: no mixture does better
        return chosen, share
    penalty = PENALTY * np.log(counts.sum())
    full, _ = _mixture(p, counts, ROUNDS)
    for one in np.argsort(-full, kind="stable"):
        if one == chosen[0] or full[one] < 0.02:
            continue
        tried = np.append(chosen, one)
        tried_share, gained = _mixture(p[tried], counts, ROUNDS)
        if gained - best <= penalty:
            break
        chosen, share, best = tried, tried_share, gained
    order = np.lexsort((chosen, -share))
    return chosen[order], share[order]


ADDED = "lang_pred string, score double, languages array<string>, proportions array<double>"


def predict_languages(docs: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """``docs`` and lang_pred, score (its proportion), languages and proportions of the selected set."""
    shared = docs.sparkSession.sparkContext.broadcast((names, logs))  # languages times buckets

    def start():
        names, logs = shared.value

        def one(text: str | None):
            grams = gram_buckets(text) if names and has_letter(text) else ()
            if not len(grams):
                return UNDETERMINED, 0.0, [], []
            chosen, share = infer(grams, logs)
            return names[chosen[0]], min(1.0, float(share[0])), [names[i] for i in chosen], share.tolist()

        def make(text: pa.Array) -> list[pa.Array]:
            rows = [one(t.as_py()) for t in text]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64()))
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return make

    return appended(docs, ["text"], ADDED, start)
