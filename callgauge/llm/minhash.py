"""Near-duplicates by MinHash, found through a multi-index Hamming join.

A document's signature is the minima of its shingle set under 64 hash functions, each reduced to 16 bits (b-bit MinHash).
At a likeness (Jaccard) of 0.85 the mean number of minima that differ is 9.6; signatures that differ in at most ``MOST`` = 22 of them are looked for, so
a pair at exactly 0.85 is missed in about 3 of 100,000 cases, one at 0.9 in about one of 40 million. The search itself misses nothing: by pigeonhole, of 12 chunks of five or six
minima one has at most one error, and each chunk is indexed under every variant with one of its minima left out, so two such signatures
meet under some key. Proposed pairs are held against that distance and then against the full shingle sets.

Equal sets are folded before, so copies never meet. Keys that one document has are left where they are counted. A key of up to ``SMALL`` documents
proposes all of its pairs, one of more only those with the member that meets most others under all keys. Members of such large keys that verified links leave
apart meet again by the exact way of prefix filtering: sets alike by 0.85 share one of the rarest 15 % (and one) of either's shingles, rare among these members.
Of those that share a shingle only pairs go on whose places of it in the order of rarity leave enough others to share.
Large groups of equal rare shingles are compared in tiles, so nothing is capped and no task holds a whole key.

Behaviour: null and wordless texts have an empty set and stay by themselves; fewer than five words are one shingle; repeated rows and equal texts share a class; a null doc_id counts as
larger than all others; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, discard, hot_join, settled, with_ends
from .components import connected_components
from .words import Words, byte_classes, mixed, parts_of

MINIMA, CHUNKS, MOST = 64, 12, 22
#: Documents of a key that propose all of their pairs.
SMALL = 16
#: Fewer shingles than these are each more than this part of all rows; their order needs no counts.
COMMON = 4096
#: Likeness in hundredths.
ALIKE = 85
#: Bytes of text, and shingles of one text, that are hashed at a time; signatures of a tile's side.
TEXT_BYTES, AT_ONCE, TILE = 4 << 20, 8192, 512

_FACTORS = mixed(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_POWERS = mixed(np.arange(101, 109, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(words: Words, rows: int, length: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's runs of ``length`` words, ascending."""
    own = np.fromiter(map(xxhash.xxh64_intdigest, words.values.to_pylist()), np.uint64, len(words.values))[words.index]
    begin = np.searchsorted(words.row, np.arange(rows + 1))
    runs = np.zeros(max(0, len(own) - length + 1), np.uint64)
    for i in range(length):
        runs += own[i : len(own) - length + 1 + i] * _POWERS[i]
    runs = mixed(runs)
    for a, b in zip(begin, begin[1:]):
        if b - a >= length:
            yield np.unique(runs[a : b - length + 1])
        elif b > a:
            yield mixed((own[a:b] * _POWERS[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield np.empty(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minima, 16 bits each."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), AT_ONCE):
        np.minimum(least, (hashes[i : i + AT_ONCE, None] * _FACTORS).min(0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def _prints(length: int):
    """Set digest, size and signature of each text."""
    classes = byte_classes(SPACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 2, TEXT_BYTES):
                n, digest, signs = [], [], []
                for hashes in shingle_hashes(Words(part.column(2), classes), part.num_rows, length):
                    n.append(len(hashes))
                    digest.append(xxhash.xxh128_digest(hashes.tobytes()) if len(hashes) else None)
                    signs.append(signature(hashes).tobytes() if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "key", "n", "digest", "signature"])

    return run


def _sets(length: int):
    """Each node's shingle hashes."""
    classes = byte_classes(SPACES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, TEXT_BYTES):
                found = [h.view(np.int64) for h in shingle_hashes(Words(part.column(1), classes), part.num_rows, length)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a column as rows of 64 numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, MINIMA)


def variants() -> list[np.ndarray]:
    """The minima that each key consists of: of every chunk all but one."""
    bounds = [i * MINIMA // CHUNKS for i in range(CHUNKS + 1)]
    return [np.array(kept) for a, b in zip(bounds, bounds[1:]) for kept in combinations(range(a, b), b - a - 1)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node under its keys."""
    chosen = variants()
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            signs, keys = _matrix(part.column(1)).astype(np.uint64), []
            for i, kept in enumerate(chosen):
                key = np.full(len(signs), i + 1, np.uint64)
                for j in kept:
                    key = mixed((key << np.uint64(16) | signs[:, j]) + key)
                keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(part.column(0).to_numpy(), len(keys)))], names=["key", "node"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose signatures differ in few enough minima."""
    for batch in batches:
        differ = (_matrix(batch.column(2)) != _matrix(batch.column(3))).sum(1)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(differ <= MOST)) for c in batch.columns[:2]], names=["src", "dst"])


def _meetings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs: src, dst; large keys' members: key, node), both settled. Nothing but ids and keys is shuffled."""
    index = nodes.select("node", "signature").mapInArrow(_index, "key long, node long")
    counted = settled(index.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most")).filter("n > 1"))
    several = counted.filter("n > 2").select("key", "n", "least")
    total = several.agg(F.sum("n")).first()[0] or 0
    members = settled(hot_join(index, several, ["key"], "n", total, by=["node"], listed=True))
    two = counted.filter("n = 2").select(F.col("least").alias("src"), F.col("most").alias("dst"))
    big = members.filter(f"n > {SMALL}").select("key", "node", "n")
    meets = big.groupBy("node").agg(F.sum("n").alias("meets"))
    centre = big.join(meets, "node").groupBy("key", "n").agg(F.max_by("node", F.struct("meets", "node")).alias("centre"))
    star = hot_join(big.drop("n"), centre, ["key"], "n", total, by=["node"]).filter("node <> centre").select(F.least("node", "centre").alias("src"), F.greatest("node", "centre").alias("dst"))
    few = members.filter(f"n <= {SMALL}").groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("g"))
    ends = F.explode(F.flatten(F.transform("g", lambda x, i: F.transform(F.slice("g", i + 2, SMALL), lambda y: F.struct(x.alias("src"), y.alias("dst"))))))
    pairs = settled(two.unionByName(star).unionByName(few.select(ends.alias("p")).select("p.*")).distinct())
    large = settled(members.filter(f"n > {SMALL}").select("key", "node"))
    discard(counted, members)
    return pairs, large


def _shingles(wanted: DataFrame, nodes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(node, shingles) of the nodes ``wanted``, settled."""
    chosen = nodes.join(wanted.distinct(), "node", "left_semi").select("node", "key")
    one = texts.join(chosen, "key").groupBy("key").agg(F.first("node").alias("node"), F.first("bytes").alias("bytes"))  # repeated rows have one key
    return settled(one.select("node", "bytes").mapInArrow(_sets(length), "node long, shingles array<bigint>"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The pairs alike by 0.85 or more, settled."""
    near = settled(with_ends(pairs, nodes, "signature").select("src", "dst", "a", "b").mapInArrow(_near, "src long, dst long"))
    sets = _shingles(near.select(F.explode(F.array("src", "dst")).alias("node")), nodes, texts, length)
    both = F.size(F.array_intersect("a", "b"))
    found = settled(with_ends(near, sets, "shingles").filter(100 * both >= ALIKE * (F.size("a") + F.size("b") - both)).select("src", "dst"))
    discard(near, sets)
    return found


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots near by signature, of rows in order of tile; rows of a tile are at most two blocks."""
    held = None
    for batch in chain(batches, (None,)):
        rows = pa.Table.from_batches([batch]) if batch is not None else None
        held = pa.concat_tables([held, rows]).combine_chunks() if held is not None and rows is not None else rows if rows is not None else held
        if held is None or not held.num_rows:
            continue
        tile = held.column("tile").to_numpy()
        cut = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        ends = cut[1:] if batch is not None else np.append(cut[1:], len(tile))
        for a, b in zip(cut, ends):
            group = held.slice(a, b - a).combine_chunks()
            block, node, root, size, after = (group.column(c).to_numpy() for c in ("block", "node", "root", "size", "after"))
            signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(-1, MINIMA)
            for i in range(len(node)):
                # were it the first shingle that both share, they could share no more than it and the fewer of those after it
                ok = (root[i + 1 :] != root[i]) & ((100 + ALIKE) * (1 + np.minimum(after[i + 1 :], after[i])) >= ALIKE * (size[i + 1 :] + size[i]))
                ok &= (signs[i + 1 :] != signs[i]).sum(1) <= MOST
                if block.min() != block.max():  # pairs within a block belong to its own tile
                    ok &= block[i + 1 :] != block[i]
                if ok.any():
                    other = node[i + 1 :][ok]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, node[i])), pa.array(np.maximum(other, node[i]))], names=["src", "dst"])
        held = held.slice(ends[-1]) if len(ends) else held


def _parted(common: np.ndarray):
    """A row for each shingle of a node that isn't ``common``; common ones come last in the order of rarity, and of them only those near enough to its beginning are given out, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, shingles in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.asarray(shingles.values)
                known = np.isin(own, common, assume_unique=True)
                others, size = own[~known], len(own)
                last = size - -(-size * ALIKE // 100) + 1
                near = np.sort(own[known])[: max(0, last - len(others))]
                place = pa.array(np.concatenate((np.zeros(len(others), np.int64), len(others) + 1 + np.arange(len(near)))), mask=np.arange(len(others) + len(near)) < len(others))
                n = len(others) + len(near)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((others, near))), *(pa.array(np.full(n, v, np.int64)) for v in (node, size, len(others))), place], names=["shingle", "node", "size", "others", "place"])

    return run


def _left_apart(large: DataFrame, roots: DataFrame, nodes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Pairs of members of large keys that ``roots`` leave apart and that share one of the rarest shingles of either, settled."""
    members = large.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    split = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    total = large.count()
    apart = settled(hot_join(members, split.select("key", "n"), ["key"], "n", total, by=["node"]).select("node", "root").distinct())
    sets = _shingles(apart.select("node"), nodes, texts, length)
    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    often = settled(counts.filter("n > 1"))
    n_rows = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    common = [r.shingle for r in often.filter(F.col("n") * COMMON > n_rows).select("shingle").collect()]  # fewer than COMMON
    rows = sets.mapInArrow(_parted(np.array(sorted(common), np.int64)), "shingle long, node long, size long, others long, place long")
    shared = rows.filter("place IS NULL").drop("place").join(often, "shingle")  # no hot keys: each is less than one of COMMON rows
    of_node = Window.partitionBy("node")
    # shingles of one member come first in the order and meet nobody, so the places of the others begin after them
    place = F.row_number().over(of_node.orderBy("n", "shingle")) + F.col("others") - F.count("*").over(of_node)
    placed = shared.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * ALIKE / 100) + 1).unionByName(rows.filter("place IS NOT NULL").withColumn("n", F.lit(None).cast("bigint")))
    rare = settled(placed.join(apart, "node").select("shingle", "node", "root", "size", (F.col("size") - F.col("place")).alias("after")))
    groups = settled(rare.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("shingle", "n", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")))
    dealt = hot_join(rare, groups, ["shingle"], "n", max(1, rare.count()), by=["node"]).join(nodes.select("node", "signature"), "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = dealt.select("shingle", "node", "root", "size", "after", "signature", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = placed.select(F.xxhash64("shingle", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), "block", "node", "root", "size", "after", "signature")
    pairs = settled(tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tiles, "src long, dst long").distinct())
    discard(apart, sets, often, rare, groups)
    return pairs


def _roots(nodes: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(node, root) of all nodes with a link, settled."""
    pairs, large = _meetings(nodes)
    links = _verified(pairs, nodes, texts, length)
    discard(pairs)
    roots = settled(connected_components(links))
    if not large.isEmpty():
        more = _left_apart(large, roots, nodes, texts, length)
        if not more.isEmpty():
            found = _verified(more, nodes, texts, length)
            stars = roots.select(F.col("node").alias("src"), F.col("root").alias("dst"))
            roots = settled(connected_components(stars.unionByName(found)))
            discard(found)
        discard(more)
    discard(links, large)
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id of those that links can reach) and kept (whether it is the row's own)."""
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary")))
    keyed = docs.select("doc_id", key.alias("key"), text.cast("binary").alias("bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    prints = settled(keyed.mapInArrow(_prints(shingle), f"doc_id {kind}, key string, n bigint, digest binary, signature binary"))
    folded = prints.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("key").alias("key"), F.first("signature").alias("signature"), F.count("*").alias("copies"))
    nodes = settled(folded.withColumn("node", F.monotonically_increasing_id()))
    texts = keyed.select("key", "bytes")
    roots = _roots(nodes, texts, shingle)
    rooted = nodes.select("node", "digest", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes"))
    n_nodes = nodes.count()
    classes = settled(hot_join(rooted, named, ["root"], "n_nodes", n_nodes, by=["node"]).select("digest", "copies", "component_id"))
    met = hot_join(prints.filter("digest IS NOT NULL").select("doc_id", "n", "digest"), classes, ["digest"], "copies", prints.count(), by=["doc_id"])
    alone = prints.filter("digest IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    found = met.select("doc_id", "n", "component_id").unionByName(alone)
    discard(roots)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
