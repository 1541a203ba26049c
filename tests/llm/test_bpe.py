import hashlib
import random

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callgauge.llm import lexicon_bpe as B
from callgauge.llm.registry import VOCABULARY, op8_bpe
from tests.oracle import SF

LIBRARY = Tokenizer.from_file(path("byte_bpe_50k.json"))


def texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "a", "'s", "É", "日本", "1", "--", "<|endoftext|>", "\t", " ", "the", " and", "!!", "\x85", "\x1c", "́", "ababab"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(1500)]
    every = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    out += [sep.join(every[i : i + 300]) for i in range(0, len(every), 300) for sep in (" ", "a", "1  ", "")]
    return [*out, "", " ", "a" * 3000, "ab" * 500 + " x", " lead", "trail ", "it's  we'LL 12３½"]


def test_encoding_is_the_librarys(spark):
    stated = texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(stated)] + [(-1, None, "x"), (-1, None, "x")], "doc_id long, text string, ids string")
    codec = B.Codec(spark, VOCABULARY).compile(docs, most=300)
    found = {r.doc_id: r for r in codec.decode(codec.encode(docs)).collect()}
    for i, t in enumerate(stated):
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        assert list(found[i].ids) == ids, t[:80]
        assert found[i].decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert list(found[-1].ids) == [] and found[-1].decoded == ""
    assert codec.encode(docs.limit(0)).count() == 0


def test_query_over_a_whole_table(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op8_bpe(spark, SF).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = LIBRARY.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_automaton_is_minimal_and_exact():
    words = sorted({w.encode() for w in ("tops", "top", "stop", "stops", "a", "taps", "tap", "")} - {b""})
    states = B.minimal_automaton(words)
    lexicon = B.Lexicon(B.compile_lexicon([(w, [i, i + 1]) for i, w in enumerate(words)]))
    assert [list(memoryview(lexicon.ids(w)).cast("i")) for w in words] == [[i, i + 1] for i in range(len(words))]
    assert lexicon.ids(b"to") is None and lexicon.ids(b"topsy") is None
    below = {}
    for i, (final, arcs) in enumerate(states):  # no two states accept the same endings
        ends = frozenset([b""] if final else []) | frozenset(bytes([b]) + e for b, to in arcs for e in below[to])
        assert ends not in below.values()
        below[i] = ends


def test_frequent_words_count_all_rows(spark):
    docs = spark.createDataFrame([("a b a",), ("a b",), (None,)], "text string")
    assert {r.word: r.n for r in B.Codec(spark, VOCABULARY).frequent_words(docs).collect()} == {"a": 2, " b": 2, " a": 1}


@pytest.mark.parametrize("n", [5, 200])
def test_long_and_short_merges_agree(n):
    vocabulary = B.Vocabulary(VOCABULARY)
    rng = random.Random(n)
    for _ in range(40):
        word = "".join(rng.choice("thaern") for _ in range(n)).encode()
        assert vocabulary._merge_long([vocabulary.of_byte[b] for b in word]) == LIBRARY.encode(word.decode(), add_special_tokens=False).ids
