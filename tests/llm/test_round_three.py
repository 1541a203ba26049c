import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgauge.llm import common, minhash, phrases, registry, vector_codes
from callgauge.llm.oracles import ORACLE_SQL
from tests.oracle import assert_same

DOCS = "doc_id bigint, text string, lang string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_minhash", "op12_codes", "op13_phrases"])
def test_matches_sql(spark, name):
    assert_same(spark, registry.queries()[name], ORACLE_SQL[name])


# MinHash


def alike_by_hand(rows):
    """(n_shingles, component_id) of each row, all pairs compared."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    first = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((rows[i][0], len(sets[i]), first[find(i)]) for i in range(len(rows))), key=str)


def found_rows(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", "y", True) for i, t in rows], "doc_id bigint, text string, key string, node string, kept boolean").repartition(4)
    found = minhash.near_duplicates(frame).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


def changed(rng, words, share):
    return [f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def test_minhash_against_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for family in range(6):
        base = [f"f{family}v{rng.randrange(400)}" for _ in range(rng.choice([30, 120, 300]))]
        rows += [" ".join(changed(rng, base, rng.choice([0.004, 0.012, 0.018, 0.03]))) for _ in range(30)]
    rows += ["", None, " \t\n", "One two", "one TWO", "one two three", "Ä b c d e", "ä b c d e", "a b c d e f", "a b c d e f g"] + rows[:3]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    given = list(zip(ids, rows)) + [(None, rows[5]), (None, ""), (7, rows[9]), (7, rows[9])]
    assert found_rows(spark, given) == alike_by_hand(given)


def test_minhash_joins_large_keys_by_rare_shingles(spark):
    """One template with much of its text exchanged: hundreds of members of a key that mostly don't link, and chains that only other members join."""
    rng = random.Random(4)
    template = [f"t{i}" for i in range(200)]
    rows = []
    for _ in range(60):
        own = template[: rng.randrange(150, 190)] + [f"o{rng.randrange(10**6)}" for _ in range(30)]
        rows += [" ".join(own), " ".join([*own, *(f"p{rng.randrange(10**6)}" for _ in range(rng.choice([5, 20, 40])))])]
    chain = template[:]
    for i in range(40):  # each one differs from the last by a few words only
        chain = chain[6:] + [f"c{i}x{j}" for j in range(6)]
        rows.append(" ".join(chain))
    given = list(enumerate(rows))
    assert found_rows(spark, given) == alike_by_hand(given)


def test_hot_keys_listed_in_the_plan(spark):
    keys = [1] * 3000 + [2] * 900 + [None] * 5 + list(range(3, 1200))
    rows = common.settled(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long"))
    stats = common.settled(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k < 1000"))
    joined = [common.hot_join(rows, stats, ["k"], "n", len(keys), by=["i"], listed=x) for x in (False, True)]
    plain = rows.join(stats, "k").select("k", "i", "n")
    assert all(sorted(x.select("k", "i", "n").collect()) == sorted(plain.collect()) for x in joined)
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in joined]
    assert "LeftOuter" in plans[0] and plans[1].count("Join ") == 1


def test_minhash_deals_its_index_and_shingles_without_a_join(spark, monkeypatch):
    """Rows of the index and of shingles pass one join each, that with the counts of their keys; there was a second to a list of hot keys."""
    plans = []

    def watched(rows, *more, **named):
        plans.append((rows.columns, (out := common.hot_join(rows, *more, **named))._jdf.queryExecution().optimizedPlan().toString()))
        return out

    monkeypatch.setattr(minhash, "hot_join", watched)
    template = [f"t{i}" for i in range(200)]
    rows = [(i, " ".join([*template, *(f"o{i}x{j}" for j in range(20 + i % 3))])) for i in range(40)]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == 40
    index = [plan for _, plan in plans if "_index(" in plan]
    assert len(index) == 1 and "LeftOuter" not in index[0]
    assert not any("others" in columns for columns, _ in plans)


def test_minhash_misses_almost_nothing_at_the_least_likeness():
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(3000):
        pool = rng.integers(0, 2**63, 400).astype(np.uint64)
        shared = pool[:340]  # 340 of 400 in all
        cut = rng.integers(0, 61)
        a, b = (np.concatenate((shared, own)) for own in (pool[340 : 340 + cut], pool[340 + cut :]))
        missed += (minhash.signature(a) != minhash.signature(b)).sum() > minhash.MOST
    assert missed <= 1


def test_minhash_keys_meet_all_near_signatures():
    rng = np.random.default_rng(6)
    chosen = minhash.variants()
    assert len(chosen) == minhash.MINIMA
    for _ in range(2000):
        differ = np.zeros(minhash.MINIMA, bool)
        differ[rng.choice(minhash.MINIMA, minhash.MOST, False)] = True
        assert any(not differ[kept].any() for kept in chosen)


def test_minhash_long_and_empty(spark):
    rng = random.Random(7)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(200_000))
    given = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    assert [r[2] for r in found_rows(spark, given)] == [1, 1, 3]
    assert found_rows(spark, []) == []


# Vector codes


def codes_by_hand(rows, parts=4, entries=256, rounds=4):
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[int(np.floor(np.float64(v) * 1024)) for v in r[1]] for r in kept]
    d = len(x[0])
    cuts = [(i * d // parts, (i + 1) * d // parts) for i in range(parts)]
    books = [[v[a:b] for v in x[:entries]] for a, b in cuts]

    def nearest(k, v):
        far = [sum((p - q) ** 2 for p, q in zip(v, c)) for c in books[k]]
        return min(far), far.index(min(far))

    for _ in range(rounds):
        for k, (a, b) in enumerate(cuts):
            own = defaultdict(list)
            for v in x:
                own[nearest(k, v[a:b])[1]].append(v[a:b])
            for e, vs in own.items():
                books[k][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, of_label = [], Counter()
    for r, v in zip(kept, x):
        found = [nearest(k, v[a:b]) for k, (a, b) in enumerate(cuts)]
        out.append((r[0], r[2], "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found)))
        of_label[r[2]] += out[-1][3]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, c, e, of_label[label], digest) for i, label, c, e in out), key=str)


VECTORS = "vec_id bigint, embedding array<double>, label int, code string, error string"


def compressed(spark, rows, **how):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(frame, **how).collect()), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_codes_against_plain_numbers(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(v) for v in rng.normal(size=10) * scale], int(i) % 3 if i % 7 else None) for i in rng.permutation(400)]
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[3][1], None), (900, None, 1), (901, [1.0] * 9 + [None], 1), (902, [float("nan")] * 10, 1), (903, [float("inf")] * 10, 1)]
    assert compressed(spark, rows, entries=40, rounds=3) == codes_by_hand(rows, entries=40, rounds=3)


def test_codes_of_odd_tables(spark):
    assert compressed(spark, []) == []
    assert compressed(spark, [(1, None, 1)]) == []
    few = compressed(spark, [(1, [1.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 3, 1)])
    assert [r[1:3] for r in few] == [("00000000", 0), ("01010101", 0), (None, None)]
    assert [r[2] for r in compressed(spark, [(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1)], entries=1)] == [2**63 - 1] * 2


# Phrases


def phrases_by_hand(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        cands = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + k] for g, a in cands.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * a >= 80 * own[g[i : i + k]]}
        scored = []
        for g, a in cands.items():
            if g not in gone:
                s, k = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-s, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        out += [(lang, rank, g.decode(), -a, left, right, n[lang], -s) for rank, (s, a, g, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"hot": 60}, {"hot": 0, "per_bucket": 50}, {"most": 7}, {"most": 7, "hot": 100, "per_bucket": 300}])
def test_phrases_by_hand(spark, how):
    rng = random.Random(9)
    letters = ["a", "b", "B", "c", "ü", "Ü", "d", "rare1", "rare2", "x" * 40]
    weights = [30, 20, 5, 10, 6, 2, 4, 2, 1, 1]
    rows = []
    for i in range(300):
        words = rng.choices(letters, weights, k=rng.randrange(0, 30))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(None, None, "en"), (1, "", None), (2, "...", "fr"), (3, "one two three", "it")] + [(9, "said once more and again", "en")] * 40
    frame = spark.createDataFrame([(*r, 1, "w") for r in rows], DOCS + ", ids int, word string").repartition(3)
    found = phrases.collocations(frame, least=8, top=25, **how)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == phrases_by_hand(rows, 8, 25)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None), (2, "one two", "en")], DOCS)).count() == 0


def test_only_pivot_owned_phrases_are_mined_and_text_is_long(spark):
    """A text of a megabyte in one row; repeated words belong to their leftmost place."""
    text = "to be or not to be " * 60_000
    found = phrases.collocations(spark.createDataFrame([(1, text, "en")], DOCS), hot=1000)
    by_hand = phrases_by_hand([(1, text, "en")], 30, 2000)
    assert sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == by_hand
    ids, piece = np.array([2, 2, 0, 2]), np.zeros(4, int)
    left, right = phrases.contexts(ids, piece)
    assert left.tolist() == [0, 0, 0, 1] and right.tolist() == [3, 2, 0, 0]
