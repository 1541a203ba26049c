"""Phrases of two to four words that occur often and stand together, by pivot partitioning as in MG-FSM.

Words that occur ``least`` times in a language, from the most frequent on, get numbers. Each n-gram belongs to its rarest word, the pivot (to
its leftmost occurrence). A text is rewritten into fragments: round each word, the up to three words on either side that are at least as frequent, cut at pieces' ends
and at infrequent words. Fragments are routed by pivot, packed into a row for each task and bucket, and mined there level by level: an n-gram is counted only where the shorter
ones of the same pivot inside it are frequent, and only n-grams of the pivot are given out, so every frequent one comes once, with its whole count.

Pivots of more than ``HOT`` occurrences are routed by the word beside them too, and their equal fragments are added up before the shuffle. The ``BROADCAST`` most frequent words at most
are broadcast; the numbers of rarer ones meet their texts by a join. Candidates get the counts of their parts by joins on word numbers.

Behaviour: null and empty texts have no words; a null language is ``und``, together with texts that say so; repeated rows count as often as they come; equal scores and
counts go by the phrase's bytes; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hot_join, settled
from .words import Words, byte_classes, parts_of

#: Words of a phrase at most, and words on either side of a pivot.
LONGEST, REACH = 4, 3
#: Fixed: what separates words, and what ends a piece.
SPACES, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Words broadcast at most; occurrences from which a pivot's neighbours help to route it.
BROADCAST, HOT = 2_000_000, 4_000_000
#: Bytes of text that are counted or rewritten at a time; occurrences whose fragments share a bucket.
TEXT_BYTES, BUCKET = 16 << 20, 1_500_000
UNKNOWN = np.iinfo(np.int64).max


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """The rows of each language of a batch whose first column is the language."""
    for lang in batch.column(0).unique().to_pylist():
        yield lang, batch.filter(pc.equal(batch.column(0), lang))


def gathered(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about ``TEXT_BYTES`` of text."""
    held, size = [], 0
    for batch in batches:
        for part in parts_of(batch, column, TEXT_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= TEXT_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


# Words and their numbers


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = byte_classes(SPACES, ENDS)
    for part in gathered(batches, 1):
        for lang, rows in by_language(part):
            words = Words(rows.column(1), classes)
            n = np.bincount(words.index, minlength=len(words.values))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), words.values.cast(pa.string()), pa.array(n)], names=["lang", "word", "f"])


def word_counts(rows: DataFrame) -> DataFrame:
    """(lang, word, f) of all words of ``rows`` (lang, text), settled."""
    partial = rows.mapInArrow(_counts, "lang string, word string, f bigint")
    return settled(partial.groupBy("lang", "word").agg(F.sum("f").alias("f")))


@dataclass(frozen=True)
class Numbers:
    """Numbers of the most frequent words, by language: words, their occurrences, and where each language's numbers start."""

    words: dict[str, pa.Array]
    counts: dict[str, np.ndarray]

    def of(self, lang: str, words: pa.Array) -> np.ndarray:
        """Numbers of ``words``, which grow with rarity; UNKNOWN for others."""
        if lang not in self.words:
            return np.full(len(words), UNKNOWN)
        found = pc.index_in(words, self.words[lang])
        return pc.fill_null(found.cast(pa.int64()), UNKNOWN).to_numpy(zero_copy_only=False)


def number_words(counts: DataFrame, least: int, most: int) -> tuple[Numbers, DataFrame, DataFrame | None]:
    """(numbers of at most about ``most`` words, the table lang, word, f, id of all frequent words, the part of it that isn't broadcast or None), tables settled.

    Ids grow as words get rarer within a language; those of the broadcast words are their places in it.
    """
    frequent = counts.filter(F.col("f") >= least)
    n = frequent.count()
    top = frequent
    if n > most:  # from some count on, all of the words or none, so languages agree and ties stay together
        bound = frequent.agg(F.percentile_approx("f", 1 - most / n, 100_000)).first()[0]
        top = frequent.filter(F.col("f") > bound)
    found = top.toArrow()  # bounded by ``most``
    found = found.sort_by([("f", "descending"), ("word", "ascending")])
    words, sums = {}, {}
    for lang in found.column("lang").unique().to_pylist():
        own = found.filter(pc.equal(found.column("lang"), lang))
        words[lang] = own.column("word").combine_chunks().cast(pa.binary())
        sums[lang] = own.column("f").to_numpy()
    numbers = Numbers(words, sums)
    spark = counts.sparkSession
    ids = pa.table({"lang": pa.array([k for k, v in sums.items() for _ in v], pa.string()), "word": pa.array([w for v in words.values() for w in v.cast(pa.string()).to_pylist()], pa.string()), "f": pa.array(np.concatenate([*sums.values(), np.empty(0, np.int64)]).astype(np.int64)), "id": pa.array(np.concatenate([*(np.arange(len(v)) for v in sums.values()), np.empty(0, np.int64)]).astype(np.int64))})
    table = spark.createDataFrame(ids)
    rest = None
    if n > most:
        order = frequent.filter(F.col("f") <= bound).orderBy(F.desc("f"), "word")
        rest = settled(order.withColumn("id", F.monotonically_increasing_id() + found.num_rows))
        table = table.unionByName(rest)
    return numbers, settled(table), rest


def _unnumbered(shared):
    """The distinct words of each text that have no broadcast number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes(SPACES, ENDS)
        for batch in batches:
            for part in parts_of(batch, 1, TEXT_BYTES):
                for lang, rows in by_language(part):
                    words = Words(rows.column(1), classes)
                    unknown = shared.value.of(lang, words.values) == UNKNOWN
                    at = np.flatnonzero(unknown[words.index])
                    pairs = np.unique(np.stack((words.row[at], words.index[at])), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * pairs.shape[1], pa.string()), words.values.take(pa.array(pairs[1])).cast(pa.string()), rows.column(2).take(pa.array(pairs[0]))], names=["lang", "word", "row"])

    return run


# Fragments


def contexts(ids: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, how many words before it are more frequent without a gap, and how many after it at least as frequent (up to REACH)."""
    left, right = np.zeros(len(ids), np.int8), np.zeros(len(ids), np.int8)
    known = ids != UNKNOWN
    goes_on = known.copy()
    for d in range(1, REACH + 1):
        if d >= len(ids):
            break
        goes_on[:d] = False
        goes_on[d:] &= (piece[d:] == piece[:-d]) & (ids[:-d] < ids[d:])
        left[goes_on] = d
    goes_on = known
    for d in range(1, REACH + 1):
        if d >= len(ids):
            break
        goes_on[-d:] = False
        goes_on[:-d] &= (piece[d:] == piece[:-d]) & (ids[d:] <= ids[:-d])
        right[goes_on] = d
    return left, right


def _bucket(*keys: np.ndarray) -> np.ndarray:
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = (h + k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _packed(ids: np.ndarray) -> list[bytes]:
    """Four planes of 16 bits each; those of zeros only are empty."""
    planes = np.ascontiguousarray(ids.view(np.uint16).reshape(-1, 4).T)
    return [p.tobytes() if p.any() else b"" for p in planes]


def _unpacked(planes: list[bytes], n: int) -> np.ndarray:
    found = np.zeros((n, 4), np.uint16)
    for i, plane in enumerate(planes):
        if plane:
            found[:, i] = np.frombuffer(plane, np.uint16)
    return found.view(np.int64).ravel()


@dataclass
class Fragments:
    """Fragments: words before and after the pivot, kind (1: only n-grams that go on after it), times, and ids of REACH places before to REACH after."""

    left: np.ndarray
    right: np.ndarray
    kind: np.ndarray
    times: np.ndarray
    ids: np.ndarray

    def take(self, at: np.ndarray) -> Fragments:
        return Fragments(*(getattr(self, f)[at] for f in ("left", "right", "kind", "times", "ids")))

    def __len__(self) -> int:
        return len(self.left)


def _rounds(ids: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, kind: int) -> Fragments:
    """The fragments round the places ``at``; places beyond them are -1."""
    place = at[:, None] + np.arange(-REACH, REACH + 1)
    inside = (np.arange(-REACH, REACH + 1) >= -left[:, None]) & (np.arange(-REACH, REACH + 1) <= right[:, None])
    return Fragments(left, right, np.full(len(at), kind, np.int8), np.ones(len(at), np.int64), np.where(inside, ids[np.clip(place, 0, len(ids) - 1)], -1))


def _added_up(f: Fragments) -> Fragments:
    """Equal fragments together."""
    if not len(f):
        return f
    h = _bucket(*f.ids.T, f.kind.astype(np.int64))
    order = np.argsort(h, kind="stable")
    f = f.take(order)
    fresh = np.ones(len(f), bool)
    fresh[1:] = (f.ids[1:] != f.ids[:-1]).any(1) | (f.kind[1:] != f.kind[:-1])
    begin = np.flatnonzero(fresh)
    times = np.add.reduceat(f.times, begin)
    f = f.take(begin)
    f.times = times
    return f


_ROUTED = "bucket int, lang string, n int, sides binary, times binary, plane0 binary, plane1 binary, plane2 binary, plane3 binary"


def _routed(lang: str, f: Fragments, key: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket."""
    bucket = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    f, bucket = f.take(order), bucket[order]
    cut = np.append(np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), len(bucket)) if len(bucket) else np.zeros(1, int)
    inside = f.ids >= 0
    flat, ends = f.ids[inside], np.append(0, np.cumsum(inside.sum(1)))
    sides = (f.left | f.right << 2 | f.kind << 4).astype(np.uint8)
    rows = []
    for a, b in zip(cut, cut[1:]):
        once = (f.times[a:b] == 1).all()
        rows.append((int(bucket[a]), lang, int(b - a), sides[a:b].tobytes(), b"" if once else f.times[a:b].tobytes(), *_packed(np.ascontiguousarray(flat[ends[a] : ends[b]]))))
    columns = list(zip(*rows)) or [[]] * 9
    kinds = [pa.int32(), pa.string(), pa.int32()] + [pa.binary()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _ROUTED.split(", ")])


def _read(row: tuple) -> Fragments:
    n, sides, times, *planes = row
    sides = np.frombuffer(sides, np.uint8)
    left, right, kind = (sides & 3).astype(np.int8), (sides >> 2 & 3).astype(np.int8), (sides >> 4).astype(np.int8)
    places = np.arange(-REACH, REACH + 1)
    inside = (places >= -left[:, None]) & (places <= right[:, None])
    ids = np.full((n, len(places)), -1, np.int64)
    ids[inside] = _unpacked(planes, int(inside.sum()))
    return Fragments(left, right, kind, np.frombuffer(times, np.int64) if times else np.ones(n, np.int64), ids)


def _fragments(shared, buckets: int, hot: int):
    """Texts to routed fragments; columns: lang, text and, where not all numbers are broadcast, the words of the text and their ids and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = byte_classes(SPACES, ENDS)
        for part in gathered(batches, 1):
            for lang, rows in by_language(part):
                words = Words(rows.column(1), classes)
                numbers = shared.value.of(lang, words.values)
                counts = np.append(shared.value.counts.get(lang, np.empty(0, np.int64)), 0)
                if rows.num_columns > 2:  # a rarer word has the same number in all texts that have it
                    more = pa.table({"w": rows.column(2).flatten().cast(pa.binary()), "id": rows.column(3).flatten()}).group_by("w").aggregate([("id", "min")])
                    found = pc.index_in(words.values, more.column("w").combine_chunks())
                    own = pc.is_valid(found).to_numpy(zero_copy_only=False)
                    numbers = numbers.copy()
                    numbers[own] = more.column("id_min").to_numpy()[found.drop_null().to_numpy()]
                ids = numbers[words.index]
                left, right = contexts(ids, words.piece)
                at = np.flatnonzero((left > 0) | (right > 0))
                # rarer words than those broadcast are never hot
                of_pivot = counts[np.minimum(ids[at], len(counts) - 1)]
                is_hot = of_pivot > hot
                plain = at[~is_hot]
                f = _rounds(ids, plain, left[plain], right[plain], 0)
                yield from _routed(lang, f, _bucket(ids[plain]), buckets)
                at = at[is_hot]
                if len(at):
                    on, back = at[right[at] > 0], at[left[at] > 0]
                    f = _added_up(_rounds(ids, on, np.minimum(left[on], REACH - 1), right[on], 1))
                    yield from _routed(lang, f, _bucket(f.ids[:, REACH].copy(), f.ids[:, REACH + 1].copy()), buckets)
                    f = _added_up(_rounds(ids, back, left[back], np.zeros(len(back), np.int8), 0))
                    yield from _routed(lang, f, _bucket(f.ids[:, REACH].copy(), -1 - f.ids[:, REACH - 1]), buckets)

    return run


# Mining


def _sums(ids: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct rows, their sums, which row each one is)."""
    if len(ids) and ids.shape[1] == 2 and ids.max() < 2**31:
        _, first, inverse = np.unique(ids[:, 0] << 32 | ids[:, 1], return_index=True, return_inverse=True)
    else:
        order = np.lexsort(ids.T)
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[order][1:] != ids[order][:-1]).any(1)
        inverse = np.empty(len(ids), np.int64)
        inverse[order] = np.cumsum(fresh) - 1
        first = order[fresh]
    total = np.zeros(len(first), np.int64)
    np.add.at(total, inverse, times)
    return ids[first], total, inverse


def mine(f: Fragments, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, times) of the pivots' n-grams that occur ``least`` times, by length and place of the pivot."""
    good: dict[tuple[int, int], np.ndarray] = {}
    for n in range(1, LONGEST):
        for a in range(n + 1):
            b = n - a
            may = (f.left >= a) & (f.right >= b) & ((f.kind == 0) | (b > 0))
            for inner in ((a - 1, b), (a, b - 1)):
                if inner in good:
                    may &= good[inner] | ((f.kind == 1) & (inner[1] == 0))
            at = np.flatnonzero(may)
            found, times, which = _sums(f.ids[at, REACH - a : REACH + b + 1], f.times[at])
            enough = times >= least
            good[a, b] = np.zeros(len(f), bool)
            good[a, b][at[enough[which]]] = True
            yield found[enough], times[enough]
        alive = np.zeros(len(f), bool)
        for (a, b), ok in good.items():
            if a + b == n:
                alive |= ok
        if not alive.all():  # most fragments hold nothing frequent
            f = f.take(np.flatnonzero(alive))
            good = {k: v[alive] for k, v in good.items()}


def _mined(least: int):
    """Rows in order of bucket and language; each group is mined by itself."""

    def out(lang: str, rows: list[Fragments]) -> Iterator[pa.RecordBatch]:
        f = Fragments(*(np.concatenate([getattr(r, c) for r in rows]) for c in ("left", "right", "kind", "times", "ids")))
        for ids, times in mine(f, least):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.FixedSizeListArray.from_arrays(pa.array(ids.ravel()), ids.shape[1]).cast(pa.list_(pa.int64())), pa.array(times)], names=["lang", "ids", "f"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []
        for batch in batches:
            for bucket, lang, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if group != (bucket, lang) and rows:
                    yield from out(group[1], rows)
                    rows = []
                group = bucket, lang
                rows.append(_read(row))
        if rows:
            yield from out(group[1], rows)

    return run


def frequent_phrases(rows: DataFrame, counts: DataFrame, least: int = 30, most: int = BROADCAST, hot: int = HOT, per_bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lang, ids, f of every phrase of two to four words that occurs ``least`` times; lang, word, f, id of the frequent words), both settled."""
    numbers, table, rest = number_words(counts, least, most)
    shared = rows.sparkSession.sparkContext.broadcast(numbers)
    total = table.agg(F.sum("f")).first()[0] or 0
    buckets = max(1, -(-total // per_bucket))
    given = rows
    if rest is not None:
        keyed = settled(rows.withColumn("row", F.monotonically_increasing_id()))
        own = hot_join(keyed.mapInArrow(_unnumbered(shared), "lang string, word string, row bigint"), rest.select("lang", "word", "id", "f"), ["lang", "word"], "f", max(1, total), by=["row"])
        lists = own.groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("w"))
        given = keyed.join(lists, "row", "left").select("lang", "text", F.coalesce(F.col("w.word"), F.array().cast("array<string>")).alias("words"), F.coalesce(F.col("w.id"), F.array().cast("array<bigint>")).alias("ids"))
    routed = given.mapInArrow(_fragments(shared, buckets, hot), _ROUTED)
    dealt = routed.repartition("bucket").sortWithinPartitions("bucket", "lang")
    return settled(dealt.mapInArrow(_mined(least), "lang string, ids array<bigint>, f bigint")), table


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, most: int = BROADCAST, hot: int = HOT, per_bucket: int = BUCKET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's ``top`` phrases.

    a, l and r: occurrences of the phrase and of the two parts of its lowest-scoring cut; n: words of the language. A phrase within a longer one that
    occurs at least 80 % as often is left out.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counts = word_counts(rows)
    phrases, words = frequent_phrases(rows, counts, least, most, hot, per_bucket)
    grams = settled(phrases.unionByName(words.select("lang", F.array("id").alias("ids"), "f")))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("ids") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("ids") - m + 1), lambda i: F.slice("ids", i, m))))
    within = phrases.filter("size(ids) > 2").select("lang", F.explode(inner).alias("ids"), "f").groupBy("lang", "ids").agg(F.max("f").alias("longer"))
    kept = phrases.join(within, ["lang", "ids"], "left").filter("longer IS NULL OR 5 * longer < 4 * f").select("lang", "ids", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.size("ids") - 1))
    cuts = settled(kept.withColumn("k", cut).select("lang", "ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("one"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("two")))
    n_cuts = cuts.count()
    for part, name in (("one", "l"), ("two", "r")):
        asked = cuts.groupBy("lang", F.col(part).alias("ids")).agg(F.count("*").alias("asked"))
        stats = settled(asked.join(grams, ["lang", "ids"]).select("lang", F.col("ids").alias(part), F.col("f").alias(name), "asked"))
        cuts = hot_join(cuts, stats, ["lang", part], "asked", max(1, n_cuts), by=["ids", "k"]).drop("asked")
    score = F.expr("(2000000BD * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "ids", "a", "s.score", "s.l", "s.r")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = settled(scored.withColumn("place", F.rank().over(best)).filter(F.col("place") <= top).drop("place"))
    discard(cuts)
    spelt = first.select("lang", "ids", "a", "l", "r", "score", F.posexplode("ids").alias("at", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
    named = spelt.groupBy("lang", "ids", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s.word), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("bigint")
    totals = counts.groupBy("lang").agg(F.sum("f").alias("n"))
    return named.withColumn("rank", rank).filter(F.col("rank") <= top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
