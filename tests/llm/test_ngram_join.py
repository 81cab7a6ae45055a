import random
import re
from collections import Counter

import numpy as np

from tidemark.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    held = {}
    for i in sorted(sets):
        for x in sets[i]:
            held.setdefault(x, []).append(i)
    for i in sorted(sets):
        for j, n in Counter(j for x in sets[i] for j in held[x] if j < i).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(rnd, groups=90):
    words, rows = [f"w{i}" for i in range(300)], []
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 5, 6, 8, 9, 12, 15, 18, 22, 26, 30, 40, 80]))]
        for _ in range(rnd.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2])):
                p = rnd.randrange(len(w) + 1)
                kind = rnd.randrange(3)
                if kind == 0:
                    w.insert(p, rnd.choice(words))
                elif kind == 1 and len(w) > 1:
                    w.pop(min(p, len(w) - 1))
                else:
                    w[min(p, len(w) - 1)] = rnd.choice(words)
            rows.append((len(rows) * 3 + 1, " ".join(w).upper() if rnd.random() < 0.2 else "\t".join(w)))
    return rows + [(100_000, None), (100_001, ""), (100_002, " \n ")]


def joined(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}


def test_against_brute_force(spark):
    rows = corpus(random.Random(3))
    assert joined(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class int")) == brute(rows)


def test_salted_lists_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALT_ROWS", 3)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "LIGHT_MOST", 6)
    rows = corpus(random.Random(9), 40)
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rnd = random.Random(4)
    base = [f"v{rnd.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert ngram_join.join(df.limit(0)).count() == 0


def test_boundary_follows_cost():
    assert ngram_join.boundary({}) == 0
    assert 0 < ngram_join.boundary({4: 1000, 5: 1000, 8: 1000}) <= ngram_join.LIGHT_MOST
    assert ngram_join.boundary({24: 1000}) < 24


def test_rows_that_share_an_id_are_one_document(spark):
    a, b, c = "a b c d e f g", "p q r s t u v w", "k l m n o"
    rows = [(3, a), (5, a), (5, b), (5, b), (9, b), (9, c), (7, c), (1, "alone in here"), (None, a), (2, None), (2, "alone in here"), (8, ""), (8, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(3, 3, 3), (5, 3, 3), (5, 4, 3), (5, 4, 3), (9, 4, 3), (9, 1, 3), (7, 1, 3), (1, 1, 1), (None, 3, None), (2, 0, 1), (2, 1, 1), (8, 0, 8), (8, 0, 8)]
    assert got == sorted(want, key=str)


def test_ids_of_letters_and_a_very_long_text(spark):
    rnd = random.Random(7)
    long = [f"w{rnd.randrange(50_000)}" for _ in range(300_000)]
    rows = [("b", " ".join(long)), ("a", " ".join([*long[:-1], "end"])), ("c", "some other words than those")]
    assert joined(spark.createDataFrame(rows, "doc_id string, text string")) == brute(rows)


def test_sets_are_packed_without_loss():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 30, 850, 20_000):
        x = np.unique(rnd.integers(0, 2**64, n, dtype=np.uint64))
        assert (ngram_join.unpacked_set(ngram_join.packed_set(x)) == x).all()
    x = np.array([0, 2**64 - 1], dtype=np.uint64)
    assert (ngram_join.unpacked_set(ngram_join.packed_set(x)) == x).all()
