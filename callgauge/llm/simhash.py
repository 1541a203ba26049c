"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint is cut into so few segments that, within the distance looked for, one of them
differs in at most one bit: four bits and three segments of 64 bits leave one such. Each
fingerprint is indexed under every variant of every segment with one bit wiped out, so such a pair
meets under some variant. Variants are met by equality, in sorted partitions, and every meeting is
verified on the whole fingerprint.

``drop_near_duplicates`` looks for a likeness (Jaccard) of 0.8 in five-word shingles, which leaves about a seventh of the bits
different, more than such a guarantee can cover. There fingerprints of 256 bits over the distinct shingles only propose pairs:
those that are equal in the bits picked by one of many tables and differ in at most ``Alike.most`` bits. With the number of
fingerprints, more bits are picked, so that meetings by chance stay few, and more tables are taken, so that a pair alike by 0.8 is missed by all
in one of ``MISSED`` cases at every size. Every
proposed pair is then held against the shingle sets of its two documents, and only what is alike by 0.8 is linked.
Equal fingerprints count as alike: at a likeness under 0.8 all 256 bits agree in less than one of 10^18 pairs.
A group that would propose more pairs than it has members reports a forest of nearest links instead, so proposals grow with the members of
a template and not with their pairs; members that a forest connects and verified links leave apart are compared on their sets, in tiles.

Equal fingerprints are folded first, so copies never meet each other. Small groups compare all
members; larger ones are searched breadth first and report a spanning forest instead of all
pairs, which keeps every link's two ends connected.

Behaviour: null and empty texts have no words and the fingerprint zero, linked like any other;
repeated rows share a fingerprint; a null doc_id counts as larger than all others for the choice
of component_id; an empty table gives an empty result; other columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hot_join, settled, with_ends
from .components import connected_components

SMALL_GROUP = 24
#: Pairs a member that a small group of the near-dedup proposes; one of more is searched as a large one is.
MOST_PAIRS = 1
#: Members of one tree of nearest links.
TREE = 2048


@dataclass(frozen=True)
class Scheme:
    """Seeds of the 64-bit words, the segments' sizes in bits (none spans two words) and the bits that linked fingerprints may differ in."""

    seeds: tuple[int, ...]
    sizes: tuple[int, ...]
    most: int

    def segments(self) -> list[tuple[int, int, int]]:
        """(word, lowest bit, bits) of each segment."""
        out, at = [], 0
        for n in self.sizes:
            out.append((at // 64, at % 64, n))
            at += n
        return out


FOUR_BITS = Scheme((42,), (21, 21, 22), 4)
FP = "struct<a:bigint,b:bigint>"

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _majority(hashes: np.ndarray) -> int:
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, shingle: int, seeds: tuple[int, ...] = (42,)) -> tuple[int, ...]:
    """Bit i of a word is one if it is set in over half of the shingles' XXH64 values."""
    words = text.lower().split()
    if not words:
        return (0,) * len(seeds)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return tuple(digest(joined, seed) for seed in seeds)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pieces = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())]
    return tuple(_majority(np.array([digest(p, seed) for p in pieces], np.uint64)) for seed in seeds)


def _struct(fp: np.ndarray) -> pa.StructArray:
    """(n, 2) words as a column."""
    a, b = (pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(2))
    return pa.StructArray.from_arrays([a, b], names=["a", "b"])


def _words(column: pa.StructArray) -> np.ndarray:
    return np.stack([column.field(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2)], 1)


def _fingerprints(shingle: int, seeds: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.zeros((batch.num_rows, 2), np.uint64)
            for i, t in enumerate(batch.column(1)):
                values[i, : len(seeds)] = fingerprint(t.as_py(), shingle, seeds)
            yield pa.RecordBatch.from_arrays([batch.column(0), _struct(values)], names=["row", "fp"])

    return run


def _variants(scheme: Scheme):
    """Each fingerprint under its signatures: number of the wiped bit, and the rest of its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = _words(batch.column(0))
            for i in range(0, len(fp), 4096):
                part, keys = fp[i : i + 4096], []
                for word, low, bits in scheme.segments():
                    value = (part[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
                    for bit in range(bits):
                        keys.append(value & np.uint64(~(1 << bit) & (1 << bits) - 1) | np.uint64((64 * word + low + bit) << 22))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), _struct(np.tile(part, (len(keys), 1)))], names=["signature", "fp"])

    return run


def _distance(differ: np.ndarray) -> np.ndarray:
    return np.bitwise_count(differ).astype(np.int64).sum(-1)


def _first_signature(differ: np.ndarray, scheme: Scheme) -> np.ndarray:
    """Of the wiped bits under which a pair meets, the first; a pair counts only there."""
    at = np.full(len(differ), -1)
    for word, low, bits in scheme.segments():
        part = (differ[:, word] >> np.uint64(low)) & np.uint64((1 << bits) - 1)
        one = np.bitwise_count(part) <= 1
        bit = np.where(part == 0, 0, np.log2(np.maximum(part, 1).astype(np.float64)).astype(np.int64))
        at = np.where((at < 0) & one, 64 * word + low + bit, at)
    return at


def _forest(fp: np.ndarray, most: int) -> np.ndarray:
    """Links that connect all members of a group whose members are linked: (link, end, word)."""
    left, edges = fp, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _distance(left ^ x) <= most
            if near.any():
                edges.append(np.stack((np.tile(x, (near.sum(), 1)), left[near]), 1))
                queue += list(left[near])
                left = left[~near]
    return np.concatenate(edges) if edges else np.empty((0, 2, 2), np.uint64)


def _whole_groups(batches: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of batches in order of the first one, cut so that no group of equal keys is."""
    held: list[tuple[np.ndarray, ...]] = []
    for columns in batches:
        key = columns[0]
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))  # the last group may go on in the next batch
        if whole or held and held[-1][0][-1] != key[-1]:
            yield tuple(map(np.concatenate, zip(*held, tuple(c[:whole] for c in columns))))
            held = []
        held.append(tuple(c[whole:] for c in columns))
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def _meet(scheme: Scheme):
    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        found = [np.empty((0, 2, 2), np.uint64)]
        small = ~np.repeat(size > SMALL_GROUP, size)
        at = np.flatnonzero(small)
        for shift in range(1, SMALL_GROUP):
            at = at[at < len(key) - shift]
            at = at[key[at + shift] == key[at]]
            if len(at) == 0:
                break
            differ = fp[at] ^ fp[at + shift]
            good = _distance(differ) <= scheme.most
            good[good] = _first_signature(differ[good], scheme) == key[at[good]] >> 22
            found.append(np.stack((fp[at[good]], fp[at[good] + shift]), 1))
        found += [_forest(fp[begin[i] : begin[i] + size[i]], scheme.most) for i in np.flatnonzero(size > SMALL_GROUP)]
        pairs = np.concatenate(found)
        return pa.RecordBatch.from_arrays([_struct(pairs[:, 0]), _struct(pairs[:, 1])], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _whole_groups((b.column(0).to_numpy(zero_copy_only=False), _words(b.column(1))) for b in batches):
            yield links(key, fp)

    return run


def link_fingerprints(fps: DataFrame, scheme: Scheme = FOUR_BITS) -> DataFrame:
    """(src, dst) links between distinct fingerprints ``fp`` that connect those that meet and differ in few enough bits."""
    signatures = fps.mapInArrow(_variants(scheme), f"signature long, fp {FP}")
    dealt = signatures.repartition("signature").sortWithinPartitions("signature")
    return dealt.mapInArrow(_meet(scheme), f"src {FP}, dst {FP}")


def near_duplicates(docs: DataFrame, shingle: int = 4, scheme: Scheme = FOUR_BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's ``keep`` columns (doc_id among them), ``fingerprint`` (hex digits) and ``component_id``.

    component_id is the smallest doc_id that links can reach from the row.
    """
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    prints = settled(rows.mapInArrow(_fingerprints(shingle, scheme.seeds), f"row {rows.schema['row'].dataType.simpleString()}, fp {FP}"))
    fps = settled(prints.groupBy("fp").agg(F.min("row.doc_id").alias("least"), F.count("*").alias("n")))
    links = settled(link_fingerprints(fps.select("fp"), scheme))
    roots = settled(connected_components(links).withColumnRenamed("node", "fp"))
    discard(links)
    least = fps.join(roots, "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    named = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_prints"))
    placed = settled(hot_join(least, named, ["root"], "n_prints", fps.count()).select("fp", "n", "component_id"))
    discard(roots, fps)
    digits = [F.lower(F.lpad(F.hex(f"fp.{w}"), 16, "0")) for w in "ab"[: len(scheme.seeds)]]
    met = hot_join(prints, placed, ["fp"], "n", prints.count(), by=["row"])
    return met.select("row.*", F.concat(*digits).alias("fingerprint"), "component_id")


# Near copies by likeness


BITS = 256
#: The share of bits in which a pair alike by 0.8 differs: the angle between the two sets over 180 degrees.
DIFFERENT = math.acos(0.8 / 0.9) / math.pi
#: One in so many pairs alike by 0.8 agrees in no table.
MISSED = 2000
#: The least share of such pairs that pass a key's further bits; tables make up for the others.
CHECKED = 0.95


def _at_most(k: int, n: int, p: float) -> float:
    """The probability that at most ``k`` of ``n`` bits differ, each with probability ``p``."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@dataclass(frozen=True)
class Alike:
    """Tables of a few picked bits that propose pairs, and the bits of 256 that a proposed pair may differ in.

    A row of the index is two numbers: a key and the number of the fingerprint. The key holds the table, the picked bits and, in what is left of 63 bits,
    ``checks`` more bits of the fingerprint, of which a pair may differ in ``most_checks``; so nearly all that meet by chance part without their fingerprints.
    """

    bits: int
    tables: int
    checks: int
    most_checks: int
    most: int = 60

    @classmethod
    def of(cls, n: int) -> Alike:
        """Bits and tables for ``n`` fingerprints: rows of the index grow with about the fourth root of ``n``."""
        bits = 16 + max(0, math.ceil((math.log2(max(1, n)) - 18) * 0.75))
        tables = lambda agree: math.ceil(math.log(MISSED) / -math.log1p(-((1 - DIFFERENT) ** bits) * agree))
        checks = 63 - bits - (tables(CHECKED) - 1).bit_length()
        most = next(k for k in range(checks + 1) if _at_most(k, checks, DIFFERENT) >= CHECKED)
        return cls(bits, tables(_at_most(most, checks, DIFFERENT)), checks, most)

    def picks(self) -> np.ndarray:
        """(tables, bits and checks) places of bits, the picked ones first."""
        rng = np.random.default_rng(7)
        return np.stack([rng.permutation(BITS)[: self.bits + self.checks] for _ in range(self.tables)])

    def masks(self) -> tuple[np.ndarray, np.ndarray]:
        """(tables, words) with the picked bits set, and with the further bits set."""
        found = []
        for places in np.split(self.picks(), [self.bits], axis=1):
            rows = np.zeros((self.tables, BITS), np.uint8)
            np.put_along_axis(rows, places, 1, 1)
            found.append(np.packbits(rows, axis=1, bitorder="little").view(np.uint64))
        return found[0], found[1]


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct XXH64 values of the runs of ``shingle`` words, ascending; a shorter text is one run, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    runs = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), np.uint64, len(runs)))


def _sketch(hashes: np.ndarray) -> list[int]:
    """Words of the fingerprint of a shingle set; those after the first come from mixed values."""
    out = [_majority(hashes)]
    for word in range(1, BITS // 64):
        x = hashes + np.uint64(word * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(x ^ (x >> np.uint64(31))))
    return out


def _binary(fp: np.ndarray) -> pa.Array:
    """(n, words) as a column of 32 bytes a row."""
    n, width = len(fp), BITS // 8
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(fp))])


def _unbinary(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, BITS // 64), np.uint64)
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], np.uint8, len(column) * BITS // 8, begin).view(np.uint64).reshape(len(column), -1)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_sketch(shingle_set(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _binary(np.array(words, np.uint64).reshape(-1, BITS // 64))], names=["row", "fp"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingle_set(t.as_py(), shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["fp", "runs"])

    return run


def _tables(scheme: Alike):
    """Each fingerprint's number under its key of every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks = scheme.picks()
        power, lower = ((1 << np.arange(n)).astype(np.float64) for n in (scheme.bits, scheme.checks))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                fp = np.ascontiguousarray(_unbinary(part.column(0))).view(np.uint8)
                bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float64)
                keys = []
                for t, p in enumerate(picks):
                    high, low = ((bits[:, q] @ w).astype(np.int64) for q, w in ((p[: scheme.bits], power), (p[scheme.bits :], lower)))
                    keys.append((high | t << scheme.bits) << scheme.checks | low)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.tile(part.column(1).to_numpy(), len(keys)))], names=["key", "node"])

    return run


def _groups(scheme: Alike, most_pairs: float):
    """From the index in order of keys, with the signature (table and picked bits): pairs (src, dst) of small groups that differ in few enough of the further bits, and members (src) of large groups.

    A small group of more than ``most_pairs`` such pairs a member counts as a large one of those that have some. A number by itself meets nobody.
    """
    checks = (1 << scheme.checks) - 1

    def meetings(key: np.ndarray, low: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        group = np.repeat(np.arange(len(size)), size)
        large = size > SMALL_GROUP
        met = large[group]
        at, found = np.flatnonzero(~met), [np.empty((0, 2), np.int64)]
        for shift in range(1, SMALL_GROUP):
            at = at[at < len(key) - shift]
            at = at[key[at + shift] == key[at]]
            if len(at) == 0:
                break
            near = at[np.bitwise_count(low[at] ^ low[at + shift]) <= scheme.most_checks]
            found.append(np.stack((near, near + shift), 1))
        pairs = np.concatenate(found)
        of = group[pairs[:, 0]]
        large |= np.bincount(of, minlength=len(size)) > most_pairs * size
        met[pairs] = True
        members, pairs = met & large[group], pairs[~large[of]]
        ends = np.sort(node[pairs], 1)
        columns = ((key[pairs[:, 0]], key[members]), (ends[:, 0], node[members]), (ends[:, 1], pa.nulls(int(members.sum()), pa.int64())))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(x, pa.int64()) for x in c]) for c in columns], names=["signature", "src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = ((k >> scheme.checks, k & checks, b.column(1).to_numpy()) for b in batches for k in (b.column(0).to_numpy(),))
        for group in _whole_groups(split):
            yield meetings(*group)

    return run


def _first_table(differ: np.ndarray, scheme: Alike) -> np.ndarray:
    """The first table in which each pair is equal and differs in few enough of the further bits."""
    picked, further = scheme.masks()
    found = []
    for i in range(0, len(differ), 256):
        part = differ[i : i + 256, None, :]
        found.append((((part & picked) == 0).all(-1) & (_distance(part & further) <= scheme.most_checks)).argmax(1))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _near(scheme: Alike):
    """Pairs with fingerprints a and b that differ in few enough bits, if ``at``, the first table that proposed them, is the first in which they meet: where they met in a large group before, its forest stands for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            differ = _unbinary(batch.column("a")) ^ _unbinary(batch.column("b"))
            good = _distance(differ) <= scheme.most
            good[good] = _first_table(differ[good], scheme) == batch.column("at").to_numpy()[good]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in "ab"], names=["src", "dst"])

    return run


def _nearest_forest(fp: np.ndarray, most: int) -> np.ndarray:
    """Links that connect each member of a group to the nearest of those before it, grown from the first: (link, end, word).

    Nearest links are the likeliest to hold when their shingle sets are compared. Members beyond ``TREE`` start trees of their own,
    from the same first member.
    """
    edges = [np.empty((0, 2, fp.shape[1]), np.uint64)]
    for at in range(1, len(fp), TREE):
        left, from_ = fp[at : at + TREE], fp[:1]
        from_ = np.repeat(from_, len(left), 0)
        far = _distance(left ^ from_)
        found = []
        while len(left):
            k = int(far.argmin())
            x = left[k].copy()
            if far[k] <= most:
                found.append((from_[k].copy(), x))
            left[k], from_[k], far[k] = left[-1], from_[-1], far[-1]  # the last one takes its place
            left, from_, far = left[:-1], from_[:-1], far[:-1]
            own = _distance(left ^ x)
            nearer = own < far
            far[nearer], from_[nearer] = own[nearer], x
        if found:
            edges.append(np.array(found, np.uint64))
    return np.concatenate(edges)


def _forests(most: int):
    """Links within large groups: forests of nearest links, which connect all that are near enough; where one falls into several trees, one across them too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in _whole_groups((b.column(0).to_numpy(), _unbinary(b.column(1))) for b in batches):
            begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            for a, b in zip(begin, np.append(begin[1:], len(key))):
                found = [_nearest_forest(fp[a:b].copy(), most)]
                if b - a > TREE + 1:  # several trees, which the first member alone may not connect
                    found.append(_forest(fp[a:b], most).reshape(-1, 2, BITS // 64))
                pairs = np.concatenate(found)
                yield pa.RecordBatch.from_arrays([_binary(pairs[:, 0]), _binary(pairs[:, 1])], names=["src", "dst"])

    return run


def _proposed(fps: DataFrame, scheme: Alike, most_pairs: float = SMALL_GROUP) -> DataFrame:
    """(src, dst, large) of the distinct pairs among ``fps`` (fp, node), settled; by default small groups propose all of theirs. Fingerprints are fetched for members of large groups and for pairs that pass the keys' further bits."""
    index = fps.select("fp", "node").mapInArrow(_tables(scheme), "key long, node long")
    dealt = index.repartition(F.shiftright("key", scheme.checks)).sortWithinPartitions("key")
    met = settled(dealt.mapInArrow(_groups(scheme, most_pairs), "signature long, src long, dst long"))
    pairs = settled(met.filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.min(F.shiftright("signature", scheme.bits)).alias("at")))
    near = with_ends(pairs, fps, "fp").select("at", "a", "b").mapInArrow(_near(scheme), "src binary, dst binary")
    members = met.filter("dst IS NULL").select("signature", F.col("src").alias("node")).join(fps, "node").select("signature", "fp")
    ordered = members.repartition("signature").sortWithinPartitions("signature", "fp")  # so groups of different tables start from the same members
    trees = ordered.mapInArrow(_forests(scheme.most), "src binary, dst binary")
    both = near.withColumn("large", F.lit(False)).unionByName(trees.withColumn("large", F.lit(True)))
    found = settled(both.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("large").alias("large")))
    discard(met, pairs)
    return found


def _shingle_sets(nodes: DataFrame, texts: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """(fp, runs) of the fingerprints ``nodes``, settled."""
    chosen = prints.groupBy("fp").agg(F.min("row.key").alias("key")).join(nodes, "fp", "left_semi")
    return settled(texts.join(chosen, "key").select("fp", "bytes").mapInArrow(_sets(shingle), "fp binary, runs array<bigint>"))


def _verified(pairs: DataFrame, texts: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose shingle sets are alike by 0.8 or more, settled."""
    nodes = pairs.select(F.col("src").alias("fp")).unionByName(pairs.select(F.col("dst").alias("fp"))).distinct()
    sets = _shingle_sets(nodes, texts, prints, shingle)
    met = with_ends(pairs.select("src", "dst"), sets.withColumnRenamed("fp", "node"), "runs")
    both = F.size(F.array_intersect("a", "b"))
    found = settled(met.filter(both * 9 >= (F.size("a") + F.size("b")) * 4).select("src", "dst"))  # both / union >= 0.8 in whole numbers
    discard(sets)
    return found


#: Members of a cluster that meet in one block, and columns of the sets held at a time; a tile compares two blocks.
BLOCK, COLUMNS = 256, 1 << 14


def _alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each two sets, whether they are alike by 0.8 or more."""
    size = np.array([len(x) for x in sets], np.float64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    return both * 9 >= (size[:, None] + size) * 4


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of tile; links alike by 0.8 or more that join different roots, as few as connect them."""
    read = lambda b: (*(b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)), _unbinary(b.column(2)), *(b.column(c).to_numpy(zero_copy_only=False) for c in (3, 4)))
    for columns in _whole_groups(map(read, batches)):
        begin = np.flatnonzero(np.concatenate(([True], columns[0][1:] != columns[0][:-1])))
        for a, b in zip(begin, np.append(begin[1:], len(columns[0]))):
            _, block, fp, root, runs = (c[a:b] for c in columns)
            _, group = np.unique(root.astype(object), return_inverse=True)
            apart = group[:, None] != group
            if block.min() != block.max():  # pairs within a block belong to its own tile
                apart &= block[:, None] != block
            if not apart.any():
                continue
            found = []
            for i, j in np.argwhere(np.triu(_alike(list(runs)) & apart)):
                if group[i] != group[j]:
                    found.append((fp[i], fp[j]))
                    group[group == group[j]] = group[i]
            if found:
                pairs = np.array(found, np.uint64)
                yield pa.RecordBatch.from_arrays([_binary(pairs[:, 0]), _binary(pairs[:, 1])], names=["src", "dst"])


def _left_apart(large: DataFrame, roots: DataFrame, texts: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """Links between members of one cluster of ``large`` pairs that ``roots`` leave apart, settled.

    All members of a cluster are compared, in tiles of two blocks each, so no task holds a whole cluster and only links that join are reported.
    """
    known = roots.withColumnRenamed("node", "fp")
    nodes = settled(large.select(F.col("src").alias("fp")).unionByName(large.select(F.col("dst").alias("fp"))).distinct().join(known, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    of = lambda end: nodes.select(F.col("fp").alias(end), F.col("root").alias(f"of_{end}"))
    contracted = large.join(of("src"), "src").join(of("dst"), "dst").filter("of_src <> of_dst").select(F.least("of_src", "of_dst").alias("src"), F.greatest("of_src", "of_dst").alias("dst")).distinct()
    clusters = settled(connected_components(contracted).toDF("root", "cluster"))  # of roots, so members linked already don't come again
    members = settled(nodes.join(clusters, "root").select("fp", "cluster", "root"))
    several = settled(members.groupBy("cluster").agg(F.count("*").alias("n"), (F.min("root") != F.max("root")).alias("several")).filter("several").select("cluster", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "n"))
    chosen = settled(hot_join(members, several, ["cluster"], "n", members.count()).drop("n"))
    sets = _shingle_sets(chosen.select("fp"), texts, prints, shingle)
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = chosen.join(sets, "fp").select("fp", "cluster", "root", "runs", block.alias("block"), other.alias("other"))
    tiles = placed.select(F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "block", "fp", "root", "runs")
    found = settled(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links, "src binary, dst binary"))
    discard(nodes, clusters, members, several, chosen, sets)
    return found


def alike_roots(texts: DataFrame, prints: DataFrame, shingle: int, scheme: Alike | None = None) -> DataFrame:
    """(node, root) of the fingerprints linked by likeness, settled; scheme: that for their number, if none is given.

    The forests of large groups may hang on pairs that turn out unlike. So the members that these forests connect are compared
    once more, on their shingle sets, where the links so far leave them apart.
    """
    fps = settled(prints.select("fp").distinct().withColumn("node", F.monotonically_increasing_id()))
    scheme = scheme or Alike.of(fps.count())
    pairs = _proposed(fps, scheme, MOST_PAIRS)
    links = _verified(pairs, texts, prints, shingle)
    roots = settled(connected_components(links))
    large = pairs.filter("large").select("src", "dst")
    if not large.isEmpty():
        more = _left_apart(large, roots, texts, prints, shingle)
        if not more.isEmpty():
            stars = roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))  # fewer rounds than from the links
            roots = settled(connected_components(stars.unionByName(more)))
        discard(more)
    discard(fps, pairs, links)
    return roots


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, scheme: Alike | None = None) -> DataFrame:
    """``docs`` with one row of each group of texts linked by a likeness of 0.8: that of the least doc_id (a null one last), of equal ids that of the least digest.

    Texts are dealt out by key only, to verify proposed pairs and to pick the rows that stay.
    """
    bytes_ = F.coalesce("text", F.lit("")).cast("binary")
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(bytes_))
    keyed = docs.select(F.struct("*").alias("doc"), key.alias("key"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", key.alias("key")).alias("row"), bytes_.alias("bytes"))
    rows = keyed.select("row", "bytes")
    prints = settled(rows.mapInArrow(_sketches(shingle), f"row {rows.schema['row'].dataType.simpleString()}, fp binary"))
    texts = keyed.select("key", "bytes").dropDuplicates(["key"])
    roots = alike_roots(texts, prints, shingle, scheme).withColumnRenamed("node", "fp")
    least = prints.groupBy("fp").agg(F.min("row").alias("row")).join(roots, "fp", "left")
    first = settled(least.groupBy(F.coalesce("root", "fp")).agg(F.min("row").alias("row")).select("row.key"))
    discard(prints, roots)
    return keyed.select("key", "doc").join(first, "key", "left_semi").dropDuplicates(["key"]).select("doc.*")
