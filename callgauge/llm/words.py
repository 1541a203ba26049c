"""Words of many texts at once: byte classes, packed words and their numbers in Arrow and numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Classes of bytes: part of a word, between words, and (for pieces) an end of a piece.
WORD, SPACE, END = 0, 1, 2
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def byte_classes(spaces: bytes, ends: bytes = b"") -> np.ndarray:
    found = np.zeros(256, np.uint8)
    found[list(spaces)] = SPACE
    found[list(ends)] = END
    return found


def parts_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts have about ``most`` bytes in all, one row at least."""
    ends = np.cumsum(np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(column).offset))) if batch.num_rows else np.empty(0, np.int64)
    at = 0
    while at < batch.num_rows:
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The lower-cased words of a column of texts (strings or bytes, none null), in order.

    ``row``: the text of each word; ``piece``: numbers that grow with each text and each end of a piece; ``values``: the distinct words, ``index``: which of them each word is.
    """

    def __init__(self, texts: pa.Array, classes: np.ndarray) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        kind = classes[data]
        inside = kind == WORD
        first = inside.copy()  # a word starts where the byte before is none of a word or of another text
        first[1:] &= ~inside[:-1]
        starts_text = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[starts_text] = inside[starts_text]
        start = np.flatnonzero(first)
        self.row = np.searchsorted(offsets, start, "right") - 1
        packed = LOWER[data[inside]]
        place = np.cumsum(inside)[start] - 1 if len(start) else np.empty(0, np.int64)
        ends = np.append(place, len(packed)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        found = words.dictionary_encode()
        self.values, self.index = found.dictionary, found.indices.to_numpy()
        breaks = np.cumsum(kind == END)
        self.piece = self.row + (breaks[start] if len(start) else 0)

    def __len__(self) -> int:
        return len(self.index)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, each bit depending on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
