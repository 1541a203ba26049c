"""Removal of repeated passages by suffix sorting.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in the
corpus. Suffixes of all texts cannot be sorted in one place, so they are first dealt out in a
way that keeps equal strings together: every window of ``length`` bytes is named by the least
hash of its ``GRAM``-byte substrings. Equal windows have equal names, and neighbouring windows
mostly share theirs, so a text falls into runs of windows of one name.

1. Each text yields its runs: name, digest of the run's bytes, place. Runs of one name meet.
   Runs with equal bytes are all repeated, and one of them stands for the rest.
2. A name that has several different runs needs the suffix array: their bytes are fetched from
   the texts, and each block of whole names is sorted by the two-stage method
   (``suffix_order``); neighbours whose common prefix reaches ``length`` are repeated.
3. A name with more different runs than a block holds is divided: windows that hold the named bytes in
   the first half of the places possible go apart from those that do in the second, and each half is
   named anew by the bytes that all its windows share. What still is too large is divided again.

Joins on names, digests and texts deal hot keys over several tasks. Texts are told apart by a 64-bit hash of id and
text, runs by 128 bits.

Behaviour: a null text counts as empty; texts under ``length`` bytes lose nothing; rows with the
same text (repeated ids included) are copies of each other and each loses all its windows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, settled

LENGTH = 200
GRAM = 32
#: Different runs of one name that are sorted in one block, and the bytes from which a block takes no further name.
BLOCK_RUNS = 2000
BLOCK_BYTES = 1 << 19


def _gram_table() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM-byte substring: byte values, shifted and summed by doubling."""
    h, width = table[data], 1
    while width < GRAM:
        h = (h[:-width] * np.uint64((0x9E3779B97F4A7C15**width) % 2**64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(h: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbours."""
    width = 1
    while width * 2 <= size:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    rest = size - width
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def text_runs(text: bytes, length: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, last start) of each run of windows named from one place.

    Windows of one run hold that place at different offsets, so they differ from each other.
    """
    data = np.frombuffer(text, np.uint8)
    grams = gram_hashes(data, table)
    least = sliding_least(grams, length - GRAM + 1)
    leaves = grams[: len(least) - 1] == least[:-1]  # the next window's name comes from another place
    first = np.concatenate(([0], np.flatnonzero((least[1:] != least[:-1]) | leaves) + 1))
    last = np.append(first[1:] - 1, len(least) - 1)
    return least[first].view(np.int64), first, last


RUN_SCHEMA = "key long, name long, digest long, first int, last int"


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gram_table()
        for batch in batches:
            keys, parts = batch.column(0).to_pylist(), []
            for key, text in zip(keys, batch.column(1)):
                text = text.as_py()
                if len(text) < length:
                    continue
                name, first, last = text_runs(text, length, table)
                ends = (last + length).tolist()
                digest = [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(first.tolist(), ends)]
                parts.append((np.full(len(name), key, np.int64), name, np.array(digest, np.uint64).view(np.int64), first.astype(np.int32), last.astype(np.int32)))
                if sum(len(p[0]) for p in parts[-64:]) > 50_000 or len(parts) >= 4096:
                    yield _batch(parts)
                    parts = []
            if parts:
                yield _batch(parts)

    def _batch(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["key", "name", "digest", "first", "last"])

    return run


def suffix_order(data: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffix array of ``data``, right in the first ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly. Every other suffix follows from
    the order of its successor: buckets are scanned in ascending order of the first byte, and
    the predecessor of each suffix scanned is put at the head of its own bucket. wanted: the suffixes
    to order (all); those that the order of these follows from come with them.
    """
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    change = np.flatnonzero(data[1:] != data[:-1])
    run_end = np.append(change, n - 1)
    rises = np.append(data[change + 1] > data[change], False)
    smaller = np.repeat(rises, np.diff(np.append(-1, run_end)))
    needed = np.ones(n, bool) if wanted is None else _with_sources(smaller, wanted)
    counts = np.bincount(data[needed], minlength=256)
    end = np.cumsum(counts)
    start = end - counts
    direct = np.flatnonzero(smaller & needed)
    raw = data.tobytes()
    heads = [raw[i : i + depth] for i in direct.tolist()]
    direct = direct[np.array(sorted(range(len(heads)), key=heads.__getitem__), np.int64)]
    del heads
    n_direct = np.bincount(data[direct], minlength=256)
    order = np.empty(int(counts.sum()), np.int64)
    taken = 0
    for c in np.flatnonzero(n_direct):
        order[end[c] - n_direct[c] : end[c]] = direct[taken : taken + n_direct[c]]
        taken += n_direct[c]
    head = start.copy()
    if needed[n - 1]:  # the last suffix has no successor
        order[head[data[n - 1]]] = n - 1
        head[data[n - 1]] += 1
    induced = needed & ~smaller

    def induce(seen: np.ndarray) -> None:
        before = seen[seen > 0] - 1
        before = before[induced[before]]
        if len(before) == 0:
            return
        chars = data[before]
        before = before[np.argsort(chars, kind="stable")]
        many = np.bincount(chars, minlength=256)
        done = 0
        for c in np.flatnonzero(many):
            order[head[c] : head[c] + many[c]] = before[done : done + many[c]]
            head[c] += many[c]
            done += many[c]

    for c in np.flatnonzero(counts):
        at = start[c]
        while at < head[c]:
            at, seen = head[c], order[at : head[c]]
            induce(seen)
        induce(order[end[c] - n_direct[c] : end[c]])
    return order


def _with_sources(smaller: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes, and those after each that is larger than its successor, up to the next smaller one."""
    n = len(smaller)
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))  # of each stretch
    direct = np.append(np.flatnonzero(smaller), n - 1)
    until = direct[np.searchsorted(direct[:-1], last)]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, last + 1, 1)
    np.add.at(step, until + 1, -1)
    return wanted | (np.cumsum(step[:-1]) > 0)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each two neighbours of ``order``, the length of their common prefix, ``most`` at most."""
    padded = np.concatenate((data, np.zeros(most + 8, np.uint8))).astype(np.uint64)
    words = padded[:-1] | padded[1:] << np.uint64(8)
    words = words[:-2] | words[2:] << np.uint64(16)
    words = words[:-4] | words[4:] << np.uint64(32)
    lengths = np.zeros(max(0, len(order) - 1), np.int64)
    alive = np.arange(len(lengths))
    for at in range(0, most, 8):
        if len(alive) == 0:
            break
        differ = words[order[alive] + at] ^ words[order[alive + 1] + at]
        lowest = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, 1).astype(np.float64)).astype(np.int64) // 8)
        lengths[alive] = np.minimum(at + same, most)
        alive = alive[differ == 0]
    return lengths


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region, the starts of its windows that occur elsewhere in the regions."""
    sizes = np.array([len(r) for r in regions])
    data = np.frombuffer(b"".join(regions), np.uint8)
    offset = np.cumsum(sizes) - sizes
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, offset, 1)
    np.add.at(step, offset + sizes - length + 1, -1)
    inside = np.cumsum(step[:-1]) > 0  # starts whose window stays in its region
    order = suffix_order(data, length, inside)
    order = order[inside[order]]
    equal = common_prefixes(data, order, length) >= length
    hit = np.zeros(len(order), bool)
    hit[:-1] |= equal
    hit[1:] |= equal
    found = np.sort(order[hit])
    cut = np.searchsorted(found, offset)
    return [found[a:b] - o for a, b, o in zip(cut, np.append(cut[1:], len(found)), offset)]


SPAN_SCHEMA = "key long, start int, stop int"


def _spans(keys, firsts, found, length):
    out = ([], [], [])
    for key, first, at in zip(keys, firsts, found):
        if len(at):
            gap = np.flatnonzero(np.diff(at) > length) + 1
            for a, b in zip(at[np.append(0, gap)].tolist(), at[np.append(gap - 1, len(at) - 1)].tolist()):
                out[0].append(key)
                out[1].append(first + a)
                out[2].append(first + b + length)
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["key", "start", "stop"])


def _sorted_blocks(length: int):
    """Rows come in order of name; whole names are gathered to a block and sorted together."""

    def spans(rows) -> pa.RecordBatch:
        return _spans([r[1] for r in rows], [r[2] for r in rows], repeated_windows([r[3] for r in rows], length), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, name, places = [], 0, None, set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != name:
                    places.clear()
                    if size >= BLOCK_BYTES:
                        yield spans(rows)
                        rows, size = [], 0
                name = row[0]
                if row[1:3] not in places:  # repeated rows of a table bring the same place
                    places.add(row[1:3])
                    rows.append(row)
                    size += len(row[3])
        if rows:
            yield spans(rows)

    return run


PART_SCHEMA = "name long, digest long, key long, first int, least int, most int, place int, region binary"


def _fetch(length: int):
    """Regions of the runs asked for, from texts that come with all places asked of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                key, text, asked = (batch.column(c)[i].as_py() for c in range(3))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a["name"] for a in asked], pa.int64()),
                        pa.array([key] * len(asked), pa.int64()),
                        pa.array([a["first"] for a in asked], pa.int32()),
                        pa.array([a["n_kinds"] for a in asked], pa.int64()),
                        pa.array([text[a["first"] : a["last"] + length] for a in asked], pa.binary()),
                    ],
                    names=["name", "key", "first", "n_kinds", "region"],
                )

    return run


def _halves(length: int):
    """Of each run, the windows with the named bytes in either half of the places ``least`` to ``most``, as runs of their own.

    ``place`` is where the bytes named first start in the region; it is looked for if negative.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gram_table()
        for batch in batches:
            out = []
            for name, key, first, least, most, place, region in zip(*(c.to_pylist() for c in batch.columns)):
                if place < 0:
                    last = len(region) - length
                    grams = gram_hashes(np.frombuffer(region, np.uint8), table).view(np.int64)
                    place = last + int(np.argmax(grams[last:] == name))
                middle = (least + most) // 2
                for low, high in ((least, middle), (middle + 1, most)):
                    a, b = max(0, place - high), min(len(region) - length, place - low)  # starts of such windows
                    if a <= b:
                        shared = region[place - low : place - high + length]
                        part = region[a : b + length]
                        out.append((_signed(xxhash.xxh3_64_intdigest(shared, low)), _signed(xxhash.xxh3_64_intdigest(part)), key, first + a, low, high, place - a, part))
            columns = zip(*out) if out else [[]] * 8
            kinds = [pa.int64()] * 3 + [pa.int32()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PART_SCHEMA.split(", ")])

    return run


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _sort(regions: DataFrame, length: int) -> DataFrame:
    dealt = regions.select("name", "key", "first", "region").repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(_sorted_blocks(length), SPAN_SCHEMA)


def _divided(large: DataFrame, length: int, block_runs: int) -> list[DataFrame]:
    """Tables of the spans repeated in names of too many runs, which are divided until all fit; rounds grow with the logarithm of ``length``."""
    large = settled(large.select("name", "key", "first", F.lit(0).alias("least"), F.lit(length - GRAM).alias("most"), F.lit(-1).alias("place"), "region"))
    out = []
    while not large.isEmpty():
        parts = settled(large.mapInArrow(_halves(length), PART_SCHEMA))
        one = F.struct("key", "first", "least", "most", "place", "region")
        kinds = settled(parts.groupBy("name", "digest").agg(F.count("*").alias("n_same"), F.min(one).alias("one")))
        names = kinds.groupBy("name").agg(F.count("*").alias("n_kinds")).filter("n_kinds > 1")
        n_parts, n_kinds = parts.count(), kinds.count()
        same = hot_join(parts.select("name", "digest", "key", "first", F.octet_length("region").alias("size")), kinds.filter("n_same > 1").select("name", "digest", "n_same"), ["name", "digest"], "n_same", n_parts)
        out.append(settled(same.select("key", F.col("first").alias("start"), (F.col("first") + F.col("size")).alias("stop"))))
        met = settled(hot_join(kinds.select("name", "one"), names, ["name"], "n_kinds", n_kinds).select("name", "one.*", "n_kinds"))
        discard(parts, kinds, large)
        out.append(settled(_sort(met.filter(F.col("n_kinds") <= block_runs), length)))
        large = settled(met.filter(F.col("n_kinds") > block_runs).drop("n_kinds"))
        discard(met)
    discard(large)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, block_runs: int = BLOCK_RUNS) -> DataFrame:
    """(key, start, stop) byte spans, overlapping ones included, of repeated windows, settled; docs: key, bytes."""
    runs = settled(docs.mapInArrow(_runs(length), RUN_SCHEMA))
    names = settled(runs.groupBy("name").agg(F.count("*").alias("n"), (F.min("digest") != F.max("digest")).alias("several")).filter("n > 1"))
    met = settled(hot_join(runs, names, ["name"], "n", runs.count()).drop("n"))
    discard(runs, names)
    several = met.filter("several")
    kinds = settled(several.groupBy("name", "digest").agg(F.count("*").alias("n_same"), F.min(F.struct("key", "first", "last")).alias("one")))
    per_name = settled(kinds.groupBy("name").agg(F.count("*").alias("n_kinds")))
    copies = hot_join(several.drop("several"), kinds.filter("n_same > 1").select("name", "digest", "n_same"), ["name", "digest"], "n_same", met.count())
    found = [settled(x.select("key", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))) for x in (met.filter("NOT several"), copies)]
    asked = hot_join(kinds.select("name", "one"), per_name, ["name"], "n_kinds", kinds.count()).groupBy("one.key").agg(F.collect_list(F.struct("name", "one.first", "one.last", "n_kinds")).alias("asked"))
    regions = settled(docs.join(asked, "key").mapInArrow(_fetch(length), "name long, key long, first int, n_kinds long, region binary"))
    discard(met, kinds, per_name)
    found.append(settled(_sort(regions.filter(F.col("n_kinds") <= block_runs), length)))
    found += _divided(regions.filter(F.col("n_kinds") > block_runs), length, block_runs)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    spans = settled(whole.distinct())
    discard(regions, *found)
    return spans


def _merged(spans, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = batch.column(0)
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": []}
        for text, starts, stops in zip(batch.column(1), batch.column(2), batch.column(3)):
            text = text.as_py()
            spans = _merged(zip(starts.as_py() or (), stops.as_py() or ()), len(text))
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(spans))
            out["kept"].append(kept.decode("utf-8", "ignore"))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([row, *(pa.array(v) for v in out.values())], names=["row", *out])


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_runs: int = BLOCK_RUNS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``keep`` columns and n_bytes, n_removed, n_spans, kept (text), kept_sha256.

    ``kept`` drops what is left of a code point that a span cuts; ``kept_sha256`` is of the bytes.
    """
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.xxhash64(F.col("doc_id"), F.col("text")).alias("key"), bytes_.alias("bytes"), F.struct(*keep).alias("row"))
    spans = repeated_spans(rows.select("key", "bytes"), length, block_runs)
    by_key = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    met = rows.join(by_key, "key", "left").select("row", "bytes", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    kind = rows.select("row").schema["row"].dataType.simpleString()
    cut = met.mapInArrow(_cut, f"row {kind}, n_bytes long, n_removed long, n_spans long, kept string, kept_sha256 string")
    return cut.select("row.*", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")
