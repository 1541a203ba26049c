"""Byte-pair encoding with a lexicon of frequent words in a minimal acyclic transducer.

Words (the pieces that the vocabulary's pattern cuts a text into) are counted over the whole
corpus. The most frequent ones are merged exactly once and compiled into an automaton whose
states share suffixes as well as prefixes; outputs on its arcs add up to a word's number, which points to the word's ids. The
automaton is one file in the shared folder; executors fetch it once and map it into memory. Words
outside the lexicon are merged exactly, lowest rank first and leftmost among equals.

The result doesn't depend on which words are in the lexicon. One shuffle, of pre-aggregated
word counts, sizes the lexicon; texts are never shuffled.

Behaviour: a null text counts as empty and has no ids; ids outside the vocabulary raise an
error when decoded; bytes that are no UTF-8 decode to U+FFFD; repeated rows encode alike; an empty table gives an
empty result and an empty lexicon; other columns pass through, one named like an added column is replaced.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROWS, appended, shared_folder

LEXICON_WORDS = 50_000
LONGEST_WORD = 64
NAIVE_SYMBOLS = 48
#: Distinct words whose counts a task holds before it sums them up and passes them on.
HELD_WORDS = 1_000_000
#: Letters of Latin alphabets and marks after words, for the short way of cutting pieces.
LETTERS = "A-Za-zÀ-ÖØ-öø-ž"
MARKS = ",.;:!?"

#: Fixed: the pattern of byte-level BPE, with white space by its Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special strings of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        of = byte_characters()
        ids = stated["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes | None] = [None] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [ids[c] for c, _ in sorted(of.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], int] = {}  # rank, then id of the merged token
        for rank, pair in enumerate(stated["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a], ids[b]] = rank << 32 | ids[a + b]
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pairs = keys[order], np.array(list(self.merges.values()), np.int64)[order]

    def merge_all(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of words of one length (a row of bytes each), as blocks of row numbers and their ids.

        Each round merges one pair of every row that still has one, so the rows stay of one length.
        """
        keys, packed = self.pairs
        none = np.int64(1 << 62)

        def rank(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            key = left.astype(np.int64) << 32 | right
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, packed[at], none)

        rows, ids = np.arange(len(words)), np.array(self.of_byte, np.int32)[words]
        ranks = rank(ids[:, :-1], ids[:, 1:])
        while len(rows) and (width := ids.shape[1]) > 1:
            each, at = np.arange(len(rows)), ranks.argmin(1)
            best = ranks[each, at]
            done = best == none
            if done.any():
                yield rows[done], ids[done]
                rows, ids, ranks, at, best = (x[~done] for x in (rows, ids, ranks, at, best))
                each = each[: len(rows)]
            ids[each, at] = best & 0xFFFFFFFF
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, columns[:-1] + (columns[:-1] >= at[:, None]), 1)
            for left in (at - 1, at):
                some = np.flatnonzero((left >= 0) & (left < width - 2))
                ranks[some, left[some]] = rank(ids[some, left[some]], ids[some, left[some] + 1])
        if len(rows):
            yield rows, ids

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        of, find, none = self.of_byte, self.merges.get, 1 << 62
        ids = [of[b] for b in word]
        if len(ids) > NAIVE_SYMBOLS:
            return self._merge_long(ids)
        found = [find(pair, none) for pair in zip(ids, ids[1:])]
        while found and (best := min(found)) < none:
            i = found.index(best)
            ids[i : i + 2] = [best & 0xFFFFFFFF]
            del found[i]
            if i < len(found):
                found[i] = find((ids[i], ids[i + 1]), none)
            if i:
                found[i - 1] = find((ids[i - 1], ids[i]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same in time n log n, by a heap of the pairs of a linked list."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (found >> 32, i, ids[i], ids[j], found & 0xFFFFFFFF))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x >= 0]


@dataclass
class WordTable:
    """Texts as numbers of pieces (``n`` pieces a text), pieces as numbers of words (``sizes`` words a piece), and the distinct words."""

    words: pa.Array
    of_pieces: np.ndarray
    sizes: np.ndarray
    pieces: np.ndarray
    n: np.ndarray

    def counts(self) -> np.ndarray:
        """How often each word occurs."""
        times = np.repeat(np.bincount(self.pieces, minlength=len(self.sizes)), self.sizes)
        return np.bincount(self.of_pieces, times, len(self.words)).astype(np.int64)


def spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[c]:starts[c] + sizes[c]]`` of all ``codes`` one after the other, and their sizes."""
    size = sizes[codes]
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + size, size)], size


class Splitter:
    """Cuts a text into pieces that are encoded on their own, and pieces into words.

    A single blank between two other characters that aren't white space always begins a word, so
    most texts fall into pieces by a plain split, in Arrow; the rest is cut into words at once. Special strings are pieces.
    """

    def __init__(self, special: dict[str, int]) -> None:
        self.special = special
        self.words = regex.compile(PATTERN).findall
        self.blanks_beside_spaces = re.compile(r" \s|\s ").search
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")").split if special else None

    def plain(self, text: str) -> bool:
        """Whether a split at blanks gives the pieces."""
        return not (self.blanks_beside_spaces(text) or any(s in text for s in self.special))

    def __call__(self, text: str) -> list[str]:
        """The words and special strings of one text."""
        if self.cut is None:
            return self.words(text)
        return [w for i, part in enumerate(self.cut(text)) for w in ([part] if i % 2 else self.words(part))]

    def table(self, text: pa.Array) -> WordTable:
        """The words of a column of texts."""
        text = pc.fill_null(text, "")
        strings = text.to_pylist()
        plain = np.array([self.plain(t) for t in strings], bool)
        lists = pc.split_pattern(text.filter(pa.array(plain)), " ")
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = np.zeros(len(strings), np.int64)
        n[plain] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)

        # kinds of pieces: one word of letters, such a word and a mark, anything else
        pieces = coded.dictionary.cast(pa.string())
        one = pc.match_substring_regex(pieces, f"^[{LETTERS}]+$")
        two = pc.match_substring_regex(pieces, f"^[{LETTERS}]+[{MARKS}]$")
        single, marked = pieces.filter(one), pieces.filter(two)
        rest = pieces.filter(pc.invert(pc.or_(one, two))).to_pylist()
        kind = np.where(one.to_numpy(zero_copy_only=False), 0, np.where(two.to_numpy(zero_copy_only=False), 1, 2))
        number = np.empty(len(pieces), np.int64)  # of a piece, by kinds
        number[np.argsort(kind, kind="stable")] = np.arange(len(pieces))
        codes = number[codes]

        cut = [self.words(" " + piece) for piece in rest]
        known: dict[str, int] = {}  # pieces without a blank before them: the rows' first ones, and words of other rows
        first = np.cumsum(n[plain]) - n[plain]
        codes[first] = [known.setdefault(t.split(" ", 1)[0], len(pieces) + len(known)) for t, p in zip(strings, plain) if p]
        cut += map(self.words, known)
        if not plain.all():
            whole: dict[str, int] = {}
            other = [[whole.setdefault(w, len(pieces) + len(known) + len(whole)) for w in self(t)] for t, p in zip(strings, plain) if not p]
            cut += [[w] for w in whole]
            parts, slow = iter(np.split(codes, np.cumsum(n[plain])[:-1])), iter(other)
            codes = np.concatenate([next(parts) if p else np.array(next(slow), np.int64) for p in plain])
            n[~plain] = [len(o) for o in other]

        blank = pa.scalar(" ")
        words = pa.concat_arrays([
            pc.binary_join_element_wise(blank, single, ""),
            pc.binary_join_element_wise(blank, pc.utf8_slice_codeunits(marked, 0, -1), ""),
            pc.utf8_slice_codeunits(marked, -1),
            pa.array([w for c in cut for w in c], pa.string()),
        ]).dictionary_encode()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = len(single), len(single) + len(marked)
        of_pieces = np.concatenate((at[:a], np.column_stack((at[a:b], at[b : b + len(marked)])).ravel(), at[b + len(marked) :]))
        sizes = np.concatenate((np.full(a, 1), np.full(len(marked), 2), [len(c) for c in cut])).astype(np.int64)
        return WordTable(words.dictionary.cast(pa.string()), of_pieces, sizes, codes, n)


def minimal_automaton(words: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States of the smallest acyclic automaton of sorted distinct ``words``: (final, (byte, state) arcs); the last is the start."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    register: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}
    path: list[list] = [[False, []]]  # unfinished states along the last word

    def finish(down_to: int, word: bytes) -> None:
        while len(path) > down_to + 1:
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            at = register.get(state)
            if at is None:
                at = register[state] = len(states)
                states.append(state)
            path[-1][1].append((word[len(path) - 1], at))

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        finish(common, last)
        path.extend([False, []] for _ in word[common:])
        path[-1][0] = True
        last = word
    finish(0, last)
    states.append((path[0][0], tuple(path[0][1])))
    return states


_HEADER = "<5i"
_MIX = 0x9E3779B1


def compile_lexicon(entries: list[tuple[bytes, list[int]]]) -> bytes:
    """The file image: start state, hashed arcs (state and byte -> state, output), final states, and ids by word number."""
    entries = sorted(entries)
    states = minimal_automaton([w for w, _ in entries])
    reach = [0] * len(states)
    arcs = []
    for i, (final, out) in enumerate(states):  # arcs lead to earlier states
        total = int(final)
        for byte, to in out:
            arcs.append((i << 8 | byte, to, total))
            total += reach[to]
        reach[i] = total
    size = 1 << max(4, (3 * len(arcs) // 2).bit_length())
    keys, targets, outputs = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    for key, to, output in arcs:
        at = (key * _MIX >> 7) & (size - 1)
        while keys[at] >= 0:
            at = (at + 1) & (size - 1)
        keys[at], targets[at], outputs[at] = key, to, output
    final = np.array([f for f, _ in states], np.int32)
    offsets = np.concatenate(([0], np.cumsum([len(ids) for _, ids in entries]))).astype(np.int32)
    pool = np.array([i for _, ids in entries for i in ids], np.int32)
    header = struct.pack(_HEADER, len(states) - 1, size, len(final), len(offsets), len(pool))
    return header + b"".join(a.tobytes() for a in (keys, targets, outputs, final, offsets, pool))


class Lexicon:
    """A compiled lexicon, read in place."""

    def __init__(self, image) -> None:
        self.start, size, n_states, n_offsets, n_pool = struct.unpack_from(_HEADER, image)
        view, at = memoryview(image), struct.calcsize(_HEADER)
        parts = []
        for n in (size, size, size, n_states, n_offsets, n_pool):
            parts.append(np.frombuffer(view[at : at + 4 * n], np.int32))
            at += 4 * n
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.pool = parts
        self.mask = size - 1

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find_all(self, words: np.ndarray) -> np.ndarray:
        """The numbers of words of one length (a row of bytes each); -1 for words that aren't in the lexicon."""
        state, number = np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        found = np.arange(len(words))  # rows that are still on a path
        for column in words.T:
            key = state[found] << 8 | column[found]
            at = (key * _MIX >> 7) & self.mask
            while (moved := np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))).size:
                at[moved] = (at[moved] + 1) & self.mask
            hit = self.keys[at] == key
            found, at = found[hit], at[hit]
            number[found] += self.outputs[at]
            state[found] = self.targets[at]
        out = np.full(len(words), -1, np.int64)
        found = found[self.final[state[found]] != 0]
        out[found] = number[found]
        return out

    def ids(self, word: bytes) -> bytes | None:
        """The ids of one word as int32 bytes; None if it isn't in the lexicon."""
        number = int(self.find_all(np.frombuffer(word, np.uint8)[None])[0])
        return None if number < 0 else self.pool[self.offsets[number] : self.offsets[number + 1]].tobytes()


def ids_of_words(words: pa.Array, vocabulary: Vocabulary, lexicon: Lexicon | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and where each word's begin and how many they are: from the lexicon, or else by exact merges."""
    _, places, data = words.buffers()
    places = np.frombuffer(places, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    data = np.frombuffer(data or b"", np.uint8)
    lengths = np.diff(places)
    starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    pools = [lexicon.pool if lexicon else np.zeros(0, np.int32)]
    end = len(pools[0])

    def add(rows: np.ndarray, ids: np.ndarray) -> None:
        nonlocal end
        starts[rows], sizes[rows] = end + np.arange(len(rows)) * ids.shape[1], ids.shape[1]
        pools.append(ids.ravel())
        end += ids.size

    special = pc.is_in(words, pa.array(list(vocabulary.special), pa.string())).to_numpy(zero_copy_only=False)
    alone = special | (lengths > LONGEST_WORD)
    for row in np.flatnonzero(alone).tolist():
        word = words[row].as_py()
        ids = [vocabulary.special[word]] if special[row] else vocabulary.merge(word.encode())
        add(np.array([row]), np.array([ids], np.int32))
    for length in np.unique(lengths[~alone]).tolist():
        rows = np.flatnonzero((lengths == length) & ~alone)
        if not length:
            continue
        matrix = data[places[rows][:, None] + np.arange(length)]
        if lexicon:
            number = lexicon.find_all(matrix)
            found = number >= 0
            at, number = rows[found], number[found]
            starts[at], sizes[at] = lexicon.offsets[number], lexicon.offsets[number + 1] - lexicon.offsets[number]
            rows, matrix = rows[~found], matrix[~found]
        for some, ids in vocabulary.merge_all(matrix):
            add(rows[some], ids)
    return np.concatenate(pools), starts, sizes


def _word_counts(special: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held = Splitter(special), []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

        for batch in batches:
            for row in range(0, batch.num_rows, ROWS):
                table = split.table(batch.column(0).slice(row, ROWS))
                n = table.counts()
                held.append(pa.table({"word": table.words, "n": n}).filter(pa.array(n > 0)))  # a piece without its blank may not occur
                if sum(map(len, held)) > HELD_WORDS:
                    held[:] = [summed()]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    return run


class Codec:
    """A vocabulary and the lexicon compiled for a corpus; encodes and decodes columns."""

    def __init__(self, spark: SparkSession, vocabulary: str) -> None:
        self.spark = spark
        self.shared = spark.sparkContext.broadcast(Vocabulary(vocabulary))  # of the size of the vocabulary file
        self.file: str | None = None

    def frequent_words(self, docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
        """(word, n) of the ``most`` most frequent words over all of ``docs``."""
        counts = docs.select("text").mapInArrow(_word_counts(self.shared.value.special), "word string, n long")
        short = counts.filter(F.octet_length("word") <= LONGEST_WORD)
        return short.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(most)

    def compile(self, docs: DataFrame, most: int = LEXICON_WORDS) -> Codec:
        """The lexicon of ``docs`` is built, put into the shared folder and handed out to the executors."""
        shared = self.shared

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary: Vocabulary = shared.value
            for batch in batches:
                words = batch.column(0).filter(pc.invert(pc.is_in(batch.column(0), pa.array(list(vocabulary.special), pa.string()))))
                ids, size = spread(*ids_of_words(words, vocabulary, None), np.arange(len(words)))
                ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([words, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["word", "ids"])

        found = self.frequent_words(docs, most).mapInArrow(merged, "word string, ids array<int>").collect()  # bounded by most
        image = compile_lexicon([(r.word.encode(), list(r.ids)) for r in found])
        jvm, name = self.spark.sparkContext._jvm, f"lexicon-{uuid.uuid4().hex}.bin"
        path = jvm.org.apache.hadoop.fs.Path(shared_folder(self.spark), name)
        out = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(image))
        out.close()
        self.spark.sparkContext.addFile(path.toString())
        self.file = name
        return self

    def encode(self, docs: DataFrame) -> DataFrame:
        """``docs`` and the column ``ids`` (array<int>) of its ``text``."""
        shared, file = self.shared, self.file

        def start():
            vocabulary: Vocabulary = shared.value
            lexicon = Lexicon.mapped(SparkFiles.get(file)) if file else None
            split = Splitter(vocabulary.special)

            def make(text: pa.Array) -> list[pa.Array]:
                table = split.table(text)
                of_pieces, size = spread(*ids_of_words(table.words, vocabulary, lexicon), table.of_pieces)
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(table.sizes)))]
                ids, size = spread(of_pieces, ends[:-1], np.diff(ends), table.pieces)
                ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(table.n)))]
                return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]

            return make

        return appended(docs, ["text"], "ids array<int>", start)

    def decode(self, encoded: DataFrame) -> DataFrame:
        """``encoded`` and the column ``decoded`` of its ``ids``."""
        shared = self.shared

        def start():
            tokens = pa.array(shared.value.bytes, pa.large_binary())  # null where an id isn't used

            def make(ids: pa.Array) -> list[pa.Array]:
                found = tokens.take(ids.flatten())
                if found.null_count:
                    raise ValueError("ids outside the vocabulary")
                _, places, data = found.buffers()
                places = np.frombuffer(places, np.int64)[found.offset : found.offset + len(found) + 1]
                n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
                ends = places[np.concatenate(([0], np.cumsum(n)))].tolist() if len(found) else [0] * (len(n) + 1)
                data = memoryview(data or b"")
                return [pa.array([str(data[a:b], "utf-8", "replace") for a, b in zip(ends, ends[1:])], pa.string())]

            return make

        return appended(encoded, ["ids"], "decoded string", start)
