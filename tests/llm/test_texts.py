"""Tokens, fingerprints, licences, toxicity."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import regex
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import licenses, sentencepiece_bpe, spotsigs, toxicity

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
MODEL = sentencepiece_bpe.load(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdeinrst  ▁\n1,.é=()-"), st.characters(blacklist_categories=["Cs"])), max_size=80))
def test_encoding_equals_the_library(text):
    ids = sentencepiece_bpe.Encoder(MODEL).encode([text])[0]
    assert ids.tolist() == LIB.encode(text)
    assert MODEL.decode(np.concatenate(([1], ids, [2])).astype(int)) == LIB.decode([1, *ids.tolist(), 2])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31999), max_size=20))
def test_decoding_equals_the_library(ids):
    assert MODEL.decode(np.array(ids, dtype=int)) == LIB.decode(ids)


def test_digests(spark):
    texts = ["hello  world", "", None, " x", "a" * 5000, "日本😀"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in sentencepiece_bpe.digests(df, PATH).collect():
        ids = LIB.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.tokenise(df.limit(0), PATH).count() == 0


def spots(rows):
    words = lambda t: [w for w in regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", t.lower()).split(" ") if w]
    df = Counter(w for _, t in rows for w in set(words(t)))
    common = {w for w, _ in sorted(df.items(), key=lambda x: (-x[1], x[0].encode()))[: spotsigs.ANCHORS]}

    def fp(t):
        w = words(t)
        content = [x for x in w if x not in common]
        starts = [sum(x not in common for x in w[:k]) for k, x in enumerate(w) if x in common] or range(len(content))
        return {xxhash.xxh64_intdigest(" ".join(c).encode(), seed=42) for k in starts if (c := content[k : k + spotsigs.CHAIN])}

    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    rows = sorted(rows, reverse=True)
    out = {}
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        e = t[: len(t) - cut] + nxt[:cut]
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fp(t), like(fp(t), fp(e)), like(fp(t), fp(nxt)))
    return out


def test_spotsigs_against_brute_force(spark):
    rnd = random.Random(2)
    words = ["the", "of", "and", "is", *(f"word{i}" for i in range(60)), "é😀", "!", ""]
    rows = [(i * 700, " ".join(rnd.choice(words[:4] if rnd.random() < 0.4 else words) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    rows[5] = (rows[5][0], rows[4][1])
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    want = spots(rows)
    got = {r.doc_id: r for r in spotsigs.edited(df).collect()}
    for i, (n, sha, fp, a, b) in want.items():
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (n, sha)
        assert {int(x, 16) for x in g.fingerprint.split(",") if x} == fp
        assert abs(g.near_edited - a) < 1e-12 and abs(g.near_next - b) < 1e-12
    assert got[rows[4][0]].fingerprint == got[rows[5][0]].fingerprint


def test_spotsigs_of_sparse_null_and_repeated_ids(spark):
    rnd = random.Random(3)
    words = ["the", "of", "and", *(f"word{i}" for i in range(40)), "é😀"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))
    rows = [(rnd.randrange(-(2**62), 2**62), text()) for _ in range(80)] + [(None, text()) for _ in range(50)] + [(11, text()) for _ in range(20)] + [(12, "the same copy")] * 40 + [(None, None)] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = spotsigs.edited(df, bucket=16)
    assert "SinglePartition" not in out._jdf.queryExecution().toString()
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out.collect())
    hashed = lambda t: (lambda h: h - 2**64 if h >= 2**63 else h)(xxhash.xxh64_intdigest(t.encode(), seed=42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1])), reverse=True)
    want = Counter()
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        want[i, len(t), hashlib.sha256((t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]).encode()).hexdigest()] += 1
    assert got == want


def test_spotsigs_pairs_and_edges(spark):
    rnd = random.Random(8)
    base = [rnd.choice(["the", "of", f"q{rnd.randrange(400)}", f"q{rnd.randrange(400)}"]) for _ in range(300)]
    near = [*base[:295], "zz", *base[296:]]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, "something the else of entirely"), (5, None), (None, "the x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in spotsigs.near_classes(df).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, None)}
    assert spotsigs.near_classes(df.limit(0)).count() == 0
    assert spotsigs.edited(df).count() == len(rows) and spotsigs.edited(df.limit(0)).count() == 0
    one = spotsigs.edited(df.where("doc_id = 4")).first()
    assert one.near_next == 1.0


LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_licenses(spark):
    rnd = random.Random(6)
    parts = ["cc", "BY", "general", "public", "License", "all rights", "reserved", "x", "é", "-", "\n", "CC-BY"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))) for i in range(300)] + [(900, None), (901, "Released under the MIT License."), (902, "foo Licensed under the Apache License, Version 2.0. bar"), (903, "mit license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        places = [(k, label) for k in range(len(w)) for p, label in phrases if w[k : k + len(p)] == p]
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in places})) and set(g.base_labels.split(",")) <= set(g.labels.split(",")) | {""}
        assert 0 <= g.score <= 1
    assert "mit" in got[901].labels and "apache-2.0" in got[902].labels
    assert licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_licenses_bundled_in_one_text(spark):
    gaps = " xyzzy" * 40 + " "
    rows = [(0, gaps.join(t for _, t, _ in licenses.TEMPLATES)), (1, " ".join(w.decode() for w in licenses.VOCABULARY) + gaps + licenses.TEMPLATES[0][1])] + [(10 + i, licenses.TEMPLATES[0][1]) for i in range(20)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {label for label, _, _ in licenses.TEMPLATES} <= set(got[0].labels.split(","))
    assert "mit" in got[1].labels.split(",") and got[1].score == 1


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    scorer = toxicity.fit(labelled, labels)
    got = toxicity.score(labelled, scorer).select("doc_id", "score", "predicted").toPandas()
    truth = labels.toPandas().set_index("doc_id")["toxic"]
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    y = truth[held.doc_id].to_numpy()
    hits = (held.predicted.to_numpy() == 1) & (y == 1)
    assert hits.sum() / y.sum() > 0.9 and hits.sum() / (held.predicted == 1).sum() > 0.9
    assert held.score.between(0, 1).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (None, ""), (3, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}
    assert out[1] == 1.0 and out[2] == out[None] == out[3] == 0.0
    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 1, 0, 1]))
    assert y.tolist() == [0, 0.5, 1] and x.tolist() == [0, 1.5, 3]


def test_isotonic_pools_equal_margins():
    x, y = toxicity.isotonic(np.array([0.0, 0, 0, 1]), np.array([0.0, 1, 1, 1]))
    assert np.interp(0, x, y) == 2 / 3 and np.interp(1, x, y) == 1


def test_toxicity_with_repeated_ids_long_texts_and_clashing_columns(spark):
    docs = [(i, f"you idiot number {i}" if i % 3 == 0 else f"a fine day number {i}") for i in range(300)] + [(0, f"other text {k}") for k in range(500)] + [(0, "other text 1")] * 300
    docs += [(9000, "you idiot " * 300_000), (9001, None), (9002, "")]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(0, 1, 0), (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    names = ["score", "predicted", "id", "y", "half", "label", "toxic", "m"]
    df = spark.createDataFrame([(*r, *(["v"] * len(names))) for r in docs], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = toxicity.score(df, toxicity.fit(df, labels, sample_rows=400))
    out = got.collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.id == r.m == "v" for r in out)
    assert toxicity.score(df.limit(0), toxicity.fit(df.limit(0), labels)).count() == 0
    assert next(r.score for r in out if r.doc_id == 9001) == next(r.score for r in out if r.doc_id == 9002)


def test_encoding_edges(spark):
    long = "lorem ipsum 42 " * 40_000
    names = ["ids", "n_tokens", "t"]
    rows = [(0, long, "v", "v", "v"), (None, "x", "v", "v", "v"), (0, long, "v", "v", "v"), (1, "ab" * 30_000, "v", "v", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for r in sentencepiece_bpe.digests(df, PATH).collect():
        ids = LIB.encode(next(t for i, t, *_ in rows if i == r.doc_id), add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()


def test_licenses_edges(spark, monkeypatch):
    gaps = " xyzzy license" * 300 + " "
    text = gaps.join(t for _, t, _ in licenses.TEMPLATES)
    names = ["id", "word", "n", "n_words", "labels"]
    rows = [(1, text), (1, text), (None, "general public license"), (2, "general public license " * 100_000)]
    df = spark.createDataFrame([(*r, *(["v"] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = licenses.scan(df).collect()
    assert [r.labels for r in got if r.doc_id == 1] == [",".join(sorted({x for x, _, _ in licenses.TEMPLATES}))] * 2
    assert [(r.n_base, r.first_word, r.last_word) for r in got if r.doc_id == 2] == [(100_000, 0, 299_997)]
    code = licenses.codes(licenses.words(text))
    index = licenses.Index(10, np.ones(len(licenses.VOCABULARY) + 1))
    best = lambda found: {(x, s): max(c for y, t, c in found if (y, t) == (x, s)) for x, s, _ in found}
    whole = best(index.matches(code))
    monkeypatch.setattr(licenses, "WINDOW", 97)
    parts = best(index.matches(code))
    assert len(whole) >= 18 and whole.items() <= parts.items()


def test_license_labels_and_scores_against_the_definition(spark):
    """A template counts where its key phrases stand and enough of its words are in place, whatever the candidates."""
    rnd = random.Random(4)
    rows = []
    for i in range(120):
        _, t, _ = rnd.choice(licenses.TEMPLATES)
        w = [rnd.choice(["lorem", "x1"]) if rnd.random() < 0.15 else x for x in t.split()]
        rows.append((i, " ".join([*["pad"] * rnd.randint(0, 9), *w, *["pad"] * rnd.randint(0, 9)])))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w, found = t.split(), {}
        for label, template, keys in licenses.TEMPLATES:
            x = template.split()
            for shift in range(-len(x), len(w)):
                lo, hi = max(shift - licenses.SLACK, 0), min(shift + len(x) + licenses.SLACK, len(w))
                if hi > lo and all(f" {k} " in f" {' '.join(w[lo:hi])} " for k in keys):
                    share = sum(any(0 <= shift + p + d < len(w) and w[shift + p + d] == c for d in range(-licenses.SLACK, licenses.SLACK + 1)) for p, c in enumerate(x)) / len(x)
                    if share >= licenses.COVERAGE:
                        found[label] = max(found.get(label, 0), share)
        base = {label for p, label in licenses.PHRASES if f" {p} " in f" {t} "}
        labels = set(got[i].labels.split(",")) - {""}
        # The index may miss a template whose rare words are gone; it never adds one.
        assert base <= labels <= set(found) | base
        assert got[i].score <= max([1.0] * bool(base) + list(found.values()), default=0) + 1e-9


def test_spotsigs_classes_against_brute_force(spark):
    rnd = random.Random(6)
    words, rows = ["the", "of", "and", *(f"w{i}" for i in range(150))], []
    for g in range(40):
        base = [rnd.choice(words[:3] if rnd.random() < 0.4 else words) for _ in range(rnd.choice([3, 8, 20, 40, 90]))]
        for _ in range(rnd.choice([1, 2, 6, 15])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((len(rows) * 7, " ".join(w)))
    rows += [(rows[3][0], rows[40][1])]  # a repeated id: its rows keep their own classes
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common = spotsigs.anchors(df)
    sets = [frozenset(r.fp) for r in df.select(spotsigs.fingerprint(F.col("text"), common).alias("fp")).collect()]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                links += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    want = Counter((d, least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))
    assert links > 200 and Counter((r.doc_id, r.class_id) for r in spotsigs.near_classes(df).collect()) == want


def test_spotsigs_of_a_very_long_text_and_clashing_columns(spark):
    rnd = random.Random(5)
    words = ["the", "of", *(f"w{i}" for i in range(3000))]
    long = " ".join(rnd.choice(words) for _ in range(200_000))
    names = ["id", "h", "m", "bucket", "guest", "fp", "g", "next_text", "after"]
    rows = [(1, long), (2, "the short one of all"), (3, long[:-5])]
    df = spark.createDataFrame([(*r, *(["v"] * len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r for r in spotsigs.edited(df).collect()}
    assert got[1].n_chars == len(long) and got[3].near_edited > 0.5 and got[2].near_next < 0.1
    assert len(got[1].fingerprint.split(",")) > 1000


def test_anchors_and_rare_words_of_equal_frequency(spark):
    df = spark.createDataFrame([(i, " ".join(f"{a}{b}" for a in "zyxw" for b in "abcdefgh")) for i in range(3)], "doc_id long, text string")
    assert spotsigs.anchors(df) == sorted(f"{a}{b}" for a in "zyxw" for b in "abcdefgh")[: spotsigs.ANCHORS]
    same = licenses.Index(10, np.full(len(licenses.VOCABULARY) + 1, 5))
    assert same.rarity.tolist() == list(range(len(same.rarity)))
