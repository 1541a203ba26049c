"""Product quantization of vectors in whole numbers: exact, so the codes are the same in every run and under any partitioning.

Each component x becomes floor(1024 x); vectors are cut into parts, each with a codebook of at most 256 entries that starts as the parts of the
smallest ids. A round assigns every part to its nearest entry and replaces each entry by its parts' floored mean.

Codebooks are broadcast: 256 entries of one vector's length in all, whatever the table's size. Batches compute all distances as
|x|^2 - 2xc + |c|^2 with an int64 matrix product and take the first least one. A task sums up its parts by entry, so a round
shuffles at most one row for each task, entry and component. Vectors are read again in each round, nothing but sums is kept.

Behaviour: rows whose vector is null or holds a null, NaN or infinite component are dropped; of equal ids the smaller vector comes first, null ids
come last; fewer than 256 vectors give as many entries; the first vector's length is the length, and vectors of another one get null
code and error; a length that parts don't divide makes later parts the longer ones; whole numbers whose squares could pass 64 bits are
computed with Python's, and errors past a long come as the largest; null labels are one label; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, settled

SCALE = 1024
#: Vectors whose distances to all entries are held at a time.
BLOCK = 1024
LONGEST, LIMB = 2**63 - 1, 40


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part: arrays (entries, components) of int64, or of Python's numbers where those could overflow."""

    parts: tuple[np.ndarray, ...]

    @property
    def bounds(self) -> list[int]:
        return np.cumsum([0, *(p.shape[1] for p in self.parts)]).tolist()

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for x in p.ravel().tolist()).encode()).hexdigest()


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), exactly; Python's numbers from 2^27 on, so that int64 holds every distance of up to 256 components."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not len(scaled) or np.abs(scaled).max() < 2**27:
        return scaled.astype(np.int64)
    exact = [int(v) if abs(v) < 1e300 else (lambda n, d: n * SCALE // d)(*float(x).as_integer_ratio()) for v, x in zip(scaled.tolist(), values.tolist())]
    return np.array(exact, object)


def _safe(*arrays: np.ndarray) -> tuple[np.ndarray, ...]:
    """The arrays in int64 if that holds their distances, or else all in Python's numbers."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    kind = np.int64 if most < 2**27 and 4 * max(1, arrays[0].shape[1]) * most * most < 2**63 else object
    return tuple(a.astype(kind) for a in arrays)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the first nearest entry to each row of ``x``."""
    x, entries = _safe(x, entries)
    at, far = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    norms = (entries * entries).sum(1)
    for i in range(0, len(x), BLOCK):
        part = x[i : i + BLOCK]
        rest = norms - 2 * (part @ entries.T)
        best = rest.argmin(1)
        at[i : i + BLOCK], far[i : i + BLOCK] = best, (part * part).sum(1) + rest[np.arange(len(part)), best]
    return at, far


def _sums_by_entry(at: np.ndarray, part: np.ndarray, entries: int) -> np.ndarray:
    """Sums of the rows of each entry, and in the last column their number."""
    own = np.zeros((entries, part.shape[1] + 1), part.dtype)
    own[:, -1] += np.bincount(at, minlength=entries)
    if part.dtype == object:
        np.add.at(own[:, :-1], at, part)
    else:  # a batch's sums of numbers below 2^27 are whole in floating point
        for j in range(part.shape[1]):
            own[:, j] = np.bincount(at, part[:, j], entries)
    return own


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have ``width`` components, those rows as whole numbers)."""
    lengths = np.diff(column.offsets.to_numpy())
    fits = lengths == width
    values = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, whole_numbers(values).reshape(-1, width)


def limbs(number: int) -> list[tuple[int, int]]:
    """The number in digits of ``LIMB`` bits with its sign, so that sums of any size are longs."""
    sign, number, out = (-1 if number < 0 else 1), abs(number), []
    while number or not out:
        out.append((len(out), sign * (number & (1 << LIMB) - 1)))
        number >>= LIMB
    return out


def kept_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, label if there is one, vector) of the rows with a whole, finite vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = [F.col("label")] if "label" in table.columns else [F.lit(None).cast("int").alias("label")]
    return table.filter(F.coalesce(finite, F.lit(False))).select(F.col(key).alias("id"), *label, F.col(vector).alias("vector"))


def _rounds(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to its parts' floored mean."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        bounds = now.bounds
        total = [np.zeros((len(p), p.shape[1] + 1), object) for p in now.parts]
        for batch in batches:
            _, x = _matrix(batch.column(0), bounds[-1])
            for k, entries in enumerate(now.parts):
                part = x[:, bounds[k] : bounds[k + 1]]
                at, _ = nearest(part, entries)
                total[k] += _sums_by_entry(at, part, len(entries))
        for k, own in enumerate(total):
            rows = [(k, e, j, limb, v) for e in np.flatnonzero(own[:, -1].astype(bool)).tolist() for j, number in enumerate(own[e]) for limb, v in limbs(int(number))]
            kinds = [pa.int32()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["part", "entry", "place", "limb", "total"])

    partial = vectors.select("vector").mapInArrow(sums, "part int, entry int, place int, limb int, total bigint")
    found = partial.groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total")).collect()  # a few numbers for each component of the codebooks
    shared.unpersist()
    numbers: dict[tuple[int, int, int], int] = {}
    for r in found:
        numbers[r.part, r.entry, r.place] = numbers.get((r.part, r.entry, r.place), 0) + (int(r.total) << LIMB * r.limb)
    new = [p.astype(object) for p in books.parts]
    for (part, entry, place), number in numbers.items():
        if place < new[part].shape[1]:
            new[part][entry, place] = number // numbers[part, entry, new[part].shape[1]]
    return Codebooks(tuple(_safe(p)[0] for p in new))


def fit_codebooks(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks | None:
    """Codebooks of ``vectors`` (id, vector), started from the ``entries`` smallest ids; None if there are no vectors."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()  # bounded by the codebook
    if not first:
        return None
    width = len(first[0].vector)
    start = [whole_numbers(np.array(r.vector, np.float64)) for r in first if len(r.vector) == width]
    x = np.array(start, object).reshape(len(start), width)
    bounds = [i * width // parts for i in range(parts + 1)]
    books = Codebooks(tuple(_safe(x[:, a:b])[0] for a, b in zip(bounds, bounds[1:])))
    for _ in range(rounds):
        books = _rounds(vectors, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """id, label, code (two hex digits a part) and error (squared distance in all) of ``vectors``."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        bounds = now.bounds
        for batch in batches:
            fits, x = _matrix(batch.column(2), bounds[-1])
            codes, error = np.zeros((len(x), len(now.parts)), np.uint8), np.zeros(len(x), x.dtype)
            for k, entries in enumerate(now.parts):
                codes[:, k], far = nearest(x[:, bounds[k] : bounds[k + 1]], entries)
                error = error + far
            digits = iter(zip((bytes(c).hex() for c in codes), error.tolist()))
            both = [(lambda c, e: (c, min(e, LONGEST)))(*next(digits)) if fit else (None, None) for fit in fits]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in both], pa.string()), pa.array([e for _, e in both], pa.int64())], names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.select("id", "label", "vector").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def compress(table: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``key``, label, code, error, label_error (of all rows with the same label) and codebooks_sha256 of the rows with a whole vector."""
    vectors = kept_vectors(table, key, vector)
    books = fit_codebooks(vectors, parts, entries, rounds)
    if books is None:
        return vectors.select(F.col("id").alias(key), "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    of_label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("none"))
    coded = settled(encode(vectors, books).withColumn("of", of_label))
    sums = settled(coded.groupBy("of").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST)).cast("bigint").alias("label_error"), F.count("*").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    return hot_join(coded, sums, ["of"], "n", total, by=["id"]).select(F.col("id").alias(key), "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
