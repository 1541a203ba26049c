"""Shift-resistant fingerprints by content-defined chunking.

A text's UTF-8 bytes are cut where a gear hash of the last 32 bytes has zero top bits: eight of
them up to the normal chunk size, four beyond it, so sizes gather round the normal one. A cut
depends only on the bytes before it, so an edit moves the cuts near it and no others. The
fingerprint is the set of the chunks' digests with their lengths; likeness is the share of a
text's chunk bytes that the other text holds too (containment).

Behaviour: a null text counts as empty; an empty text has an empty fingerprint, which is contained
in an empty one (1.0) and in no other (0.0); equal texts have equal fingerprints; rows of equal
doc_id follow each other in the order of their texts; a null doc_id comes first; an empty table
gives an empty result. ``fingerprints`` passes other columns through and replaces one named
``fingerprint``; ``compare_with_edits`` doesn't read them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended
from .words import parts_of

WINDOW, LEAST, NORMAL, MOST = 32, 32, 64, 256
HARD_BITS, EASY_BITS = 8, 4
#: Bytes of text that are Python objects at a time, if not one text has more.
TEXT_BYTES = 4 << 20

_GEAR = np.random.default_rng(64_32_256).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the last 32 bytes' gear values, each shifted by its distance."""
    h, width = _GEAR[data], 1
    while width < WINDOW:
        earlier = h[:-width] << np.uint32(width)
        h[width:] += earlier
        width *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``, in order."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(data, np.uint8))
    easy = np.flatnonzero(h >> np.uint32(32 - EASY_BITS) == 0)
    hard = (easy[h[easy] >> np.uint32(32 - HARD_BITS) == 0] + 1).tolist()
    easy = (easy + 1).tolist()
    ends, at = [], 0
    while n - at > LEAST:
        i = bisect_left(hard, at + LEAST)
        if i < len(hard) and hard[i] < at + NORMAL:
            at = hard[i]
        else:
            i = bisect_left(easy, at + NORMAL)
            at = min(easy[i] if i < len(easy) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> dict[str, int]:
    """The distinct chunks of a text: 14 hex digits (digest, length less one) and the length."""
    data, out, start = text.encode(), {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in chunk_ends(data):
        out[f"{digest(data[start:end]) >> 16:012x}{end - start - 1:02x}"] = end - start
        start = end
    return out


def containment(a: dict[str, int], b: dict[str, int]) -> float:
    """The share of the bytes of ``a``'s chunks that are in ``b``."""
    if not a:
        return float(not b)
    return sum([n for k, n in a.items() if k in b]) / sum(a.values())


def as_string(chunks: dict[str, int]) -> str:
    return "".join(sorted(chunks))


def from_string(fingerprint: str) -> dict[str, int]:
    return {fingerprint[i : i + 14]: int(fingerprint[i + 12 : i + 14], 16) + 1 for i in range(0, len(fingerprint), 14)}


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` and the column ``fingerprint`` of its ``text``."""
    return appended(docs, ["text"], "fingerprint string", lambda: lambda text: [pa.array([as_string(chunk_set(t or "")) for t in text.to_pylist()], pa.string())])


def with_successors(docs: DataFrame) -> DataFrame:
    """bucket, tail, doc_id, text: runs of neighbouring documents, each run ending with its successor.

    Ranks of doc_id cut the table into runs; the first document of a run is also sent to the run
    before it (the very first to the last), as its tail. So neighbours meet without one task
    seeing the whole table, and each text is shuffled once. What the driver holds is a few ids
    for each run, and the number of runs follows the number of shuffle partitions.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n), np.float64).astype(np.int64))

    @F.pandas_udf("long")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        found = np.searchsorted(cuts, doc_id.fillna(0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(doc_id.isna(), -1, found))

    firsts = rows.select("doc_id").distinct().withColumn("bucket", bucket_of(F.col("doc_id"))).groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    heads = spark.createDataFrame([(r.doc_id, firsts[i - 1].bucket) for i, r in enumerate(firsts)], "head long, to long")
    dealt = rows.select(bucket_of(F.col("doc_id")).alias("bucket"), F.lit(False).alias("tail"), "doc_id", "text")
    tails = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select(F.col("to").alias("bucket"), F.lit(True).alias("tail"), "doc_id", "text")
    return dealt.unionByName(tails).repartition("bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in (part for whole in batches for part in parts_of(whole, 3, TEXT_BYTES)):
        out = []
        for _, tail, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if tail and held is None:  # of several rows of the successor's id only the first counts
                continue
            chunks = chunk_set(text)
            if held is not None:
                id_, before, own = held
                half = len(before) // 2
                edited = before[: len(before) - half] + text[:half]
                other = chunk_set(edited)
                out.append((id_, len(before), hashlib.sha256(edited.encode()).hexdigest(), as_string(own), as_string(other), containment(own, other), containment(own, chunks)))
            held = None if tail else (doc_id, text, chunks)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*out))], names=[c.split()[0] for c in EDITED.split(", ")])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint held against that of its edited text and of the next document.

    The edited text has its last half replaced by the beginning of the next document (ascending
    doc_id; after the last comes the first).
    """
    return with_successors(docs).mapInArrow(_compare, EDITED)
