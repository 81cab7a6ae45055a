"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features: densities of a fixed and of a learned lexicon, hits near a second-person word, capitals, punctuation and
obfuscation rates, length. The learned lexicon holds words and word beginnings whose odds differ most between the
labelled classes; its counts come from a bounded sample of labelled rows, half by half, so that the trees are trained
on lexicon features that their own rows did not shape. Only rows outside the held-out fold (crc32 of the id's text
modulo 4 is 2) lend labels. Labels, language, source and id are never features.

Defined results: null and empty texts have all features zero and get the score of such a row; a null id is never held
out; several label rows of one id count as toxic if one is; of several texts of one id the least lends its label; null
labels are ignored; with no labelled rows of both classes the score is min(1, 20 x density of the fixed lexicon). Equal
texts have equal scores, equal margins one calibrated value. Texts of any length are scored whole, in batches of some two
million characters. An empty table gives an empty table. Extra columns are kept and not read, but for ``score`` and
``predicted``, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise

#: Labelled rows that are learned from, at most (in expectation). More change the model little.
SAMPLE_ROWS = 12_000
#: Terms of the learned lexicon at most, each in so many toxic texts at least, at such log odds at least.
LEXICON_TERMS, LEAST_TEXTS, LEAST_ODDS = 3_000, 4, 2.0
TREES, DEPTH, RATE, BINS, LEAF = 60, 3, 0.15, 48, 8
THRESHOLD = 0.3
NEAR = 5
CACHE_WORDS = 400_000

# Common insults of four languages, and second-person words.
INSULTS = frozenset(
    "idiot idiots moron morons stupid scum trash garbage pathetic worthless loser losers clown disgusting dumb fool jerk creep filth vermin imbecile retard ugly "
    "idiota estúpido imbécil basura asqueroso payaso inútil escoria idiote stupide imbécile ordure dégoûtant pathétique connard salaud "
    "dumm dummkopf abschaum müll widerlich versager arschloch trottel".split()
)
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos usted ustedes tú tus du dich dir dein deine sie ihr euch".split())

WORD = re.compile(r"[^\W\d_]+")
MIXED = re.compile(r"[A-Za-z][@$!*#0134]+[A-Za-z]")
NAMES = ("words", "fixed_density", "fixed_hits", "learned_density", "learned_hits", "learned_most", "learned_mean", "near_second", "second_density", "capitals", "punctuation", "exclaims", "digits", "obfuscated", "word_length")

_kind = np.zeros((5, 257))
for _c in range(256):
    _s = chr(_c)
    _kind[:, _c] = (_s.isalpha(), _s.isupper(), 33 <= _c < 128 and not _s.isalnum(), _s in "!?", _s.isdigit())
_kind[0, 256] = 1  # what lies beyond Latin-1 counts as a letter


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def beginnings(word: str) -> list[str]:
    """The terms that a word stands for: itself, and its first 4 to 7 letters."""
    return [f"={word}", *(f"{word[:n]}*" for n in range(4, 8) if len(word) > n)]


class Weights(dict):
    """Word -> number of its row in ``rows``: (weight, in the fixed lexicon, second person)."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.rows = lexicon, []

    def __missing__(self, word: str) -> int:
        weight = max((self.lexicon.get(t, 0.0) for t in beginnings(word)), default=0.0) if self.lexicon else 0.0
        self.rows.append((weight, word in INSULTS, word in SECOND))
        n = self[word] = len(self.rows) - 1
        return n


def features(texts: list[str], weights: Weights) -> np.ndarray:
    if len(weights) > CACHE_WORDS:
        weights.clear()
        weights.rows.clear()
    words = [WORD.findall(t.lower()) for t in texts]
    n = np.array([len(w) for w in words], dtype=np.int64)
    flat = [x for w in words for x in w]
    index = np.fromiter(map(weights.__getitem__, flat), np.int64, len(flat))
    table = np.array(weights.rows, dtype=float).reshape(-1, 3)
    weight, fixed, second = table[index].T if len(flat) else np.zeros((3, 0))
    doc = np.repeat(np.arange(len(texts)), n)
    total = lambda x: np.bincount(doc, x, minlength=len(texts))
    hit = (weight > 0) | (fixed > 0)
    # Second-person words within NEAR words, in the same text: a difference of running sums cut at the text's ends.
    run, start = np.concatenate(([0], np.cumsum(second))), np.cumsum(n) - n
    pos = np.arange(len(flat))
    around = run[np.minimum(pos + NEAR + 1, (start + n)[doc])] - run[np.maximum(pos - NEAR, start[doc])] if len(flat) else np.zeros(0)
    most = np.zeros(len(texts))
    np.maximum.at(most, doc, weight)
    per = np.maximum(n, 1)
    shape = np.zeros((len(texts), 5))
    size = np.array([max(1, len(t)) for t in texts])
    for i, t in enumerate(texts):
        if t:
            code = np.minimum(np.frombuffer(t.encode("utf-16-le", "surrogatepass"), dtype=np.uint16), 256)
            shape[i] = _kind @ np.bincount(code, minlength=257)
    letters = np.maximum(shape[:, 0], 1)
    odd = np.array([len(MIXED.findall(t)) for t in texts], dtype=float)
    return np.column_stack((
        np.log1p(n), total(fixed) / per, np.log1p(total(fixed)), total(weight > 0) / per, np.log1p(total(weight > 0)), most, total(weight) / per, np.log1p(total(hit & (around > 0))), total(second) / per,
        shape[:, 1] / letters, shape[:, 2] / size, shape[:, 3] / size, shape[:, 4] / size, odd / per, shape[:, 0] / per,
    ))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Boosted:
    """Depth-wise trees on binned features, logistic loss, second-order leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = self.bin(x)
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base, self.trees = float(np.log(rate / (1 - rate))), []
        margin = np.full(len(y), self.base)
        for _ in range(TREES):
            p = sigmoid(margin)
            tree = self.grow(b, p - y, p * (1 - p) + 1e-9)
            self.trees.append(tree)
            margin += self.walk(tree, b)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros(x.shape, np.int64)

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full binary tree: per inner node a feature and a bin (rows above it go right), per node a value."""
        inner = 2**DEPTH - 1
        feature, cut, value = np.zeros(inner, np.int64), np.full(inner, BINS + 1), np.zeros(2 * inner + 1)
        node = np.zeros(len(g), dtype=np.int64)
        for level in range(DEPTH + 1):
            first, width = 2**level - 1, 2**level
            local = node - first
            gs, hs = np.bincount(local, g, width), np.bincount(local, h, width)
            value[first : first + width] = -RATE * gs / (hs + 1.0)
            if level == DEPTH:
                break
            best = np.full(width, 1e-6)
            for j in range(b.shape[1]):
                at = local * (BINS + 1) + b[:, j]
                left = [np.cumsum(np.bincount(at, w, width * (BINS + 1)).reshape(width, -1), axis=1)[:, :-1] for w in (g, h, np.ones(len(g)))]
                count = np.bincount(local, minlength=width)[:, None]
                gain = left[0] ** 2 / (left[1] + 1) + (gs[:, None] - left[0]) ** 2 / (hs[:, None] - left[1] + 1) - (gs**2 / (hs + 1))[:, None]
                gain = np.where((left[2] >= LEAF) & (count - left[2] >= LEAF), gain, -1)
                top = gain.argmax(axis=1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
                cut[first : first + width] = np.where(better, top, cut[first : first + width])
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > cut[node])
        return feature, cut, value

    def walk(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(b), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (b[np.arange(len(b)), feature[node]] > cut[node])
        return value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bin(x)
        return self.base + sum((self.walk(t, b) for t in self.trees), np.zeros(len(x)))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x, mean y of each pool), to be joined by straight lines. Equal x are one."""
    pools: list[list[float]] = []
    at, where, n = np.unique(x, return_inverse=True, return_counts=True)
    for a, b, m in zip((at * n).tolist(), np.bincount(where, y, len(at)).tolist(), n.tolist(), strict=True):
        pools.append([a, b, float(m)])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Scorer:
    """A learned lexicon, trees and knots; small, sent to the workers with the function."""

    def __init__(self, lexicon: dict[str, float], trees: Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots

    def score(self, texts: list[str], weights: Weights) -> np.ndarray:
        x = features(texts, weights)
        if self.trees is None:
            return np.minimum(1, 20 * x[:, 1])
        m = self.trees.margin(x)
        # The calibrated value, and a little of the raw one so that equal steps keep their order.
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 * sigmoid(m), 0, 1)


def odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    return np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))


def lexicon(terms: pd.DataFrame, halves: tuple[int, ...], rows: np.ndarray) -> dict[str, float]:
    """From counts (term, t0, c0, t1, c1) over ``halves``; rows[half] = (toxic, clean) texts."""
    t, c = sum(terms[f"t{h}"].to_numpy() for h in halves), sum(terms[f"c{h}"].to_numpy() for h in halves)
    n = rows[list(halves)].sum(axis=0)
    w = odds(t, c, n[0], n[1])
    good = np.flatnonzero((t >= LEAST_TEXTS / (2 / len(halves))) & (w >= LEAST_ODDS))
    good = good[np.lexsort((terms["term"].to_numpy()[good], -w[good] * t[good]))][:LEXICON_TERMS]
    return dict(zip(terms["term"].to_numpy()[good], w[good].tolist(), strict=True))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text", id_col: str = "doc_id") -> Scorer:
    """Learn from at most about ``sample_rows`` labelled rows of the folds that aren't held out."""
    truth = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    n = truth.count()
    if n > sample_rows:
        truth = truth.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1e6 * sample_rows / n))
    truth = truth.groupBy("id").agg(F.max("y").alias("y"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # ``truth`` has sample_rows rows, a parameter: its broadcast is bounded.
    labelled = src.join(F.broadcast(truth), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    sample = materialise(labelled.withColumn("half", F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(2)).cast("int")), "labelled")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in chunks([t or "" for t in pdf["text"]], 1_000_000):
                out = [(t, h, y) for x, h, y in zip(pdf["text"].iloc[a:b], pdf["half"].iloc[a:b], pdf["y"].iloc[a:b], strict=True) for t in {t for w in set(WORD.findall((x or "").lower())) for t in beginnings(w)}]
                yield pd.DataFrame(out, columns=["term", "half", "y"]).groupby(["term", "half", "y"]).size().reset_index(name="n")

    when = lambda h, y: F.sum(F.when((F.col("half") == h) & (F.col("y") == y), F.col("n")).otherwise(0))
    counted = sample.mapInPandas(terms, "term string, half int, y int, n long").groupBy("term").agg(when(0, 1).alias("t0"), when(0, 0).alias("c0"), when(1, 1).alias("t1"), when(1, 0).alias("c1"))
    rows = np.zeros((2, 2), dtype=np.int64)
    for r in sample.groupBy("half", "y").count().collect():
        rows[r["half"], 0 if r["y"] else 1] += r["count"]
    if rows[:, 0].sum() == 0 or rows[:, 1].sum() == 0:
        return Scorer({}, None, None)
    both = F.col("t0") + F.col("t1")
    value = F.log((both + 0.5) / (int(rows[:, 0].sum()) + 1)) - F.log((F.col("c0") + F.col("c1") + 0.5) / (int(rows[:, 1].sum()) + 1))
    found = counted.where((both >= LEAST_TEXTS) & (value >= LEAST_ODDS)).orderBy(F.desc(value * both), "term").limit(2 * LEXICON_TERMS).toPandas()
    lexicons = [lexicon(found, (1,), rows), lexicon(found, (0,), rows)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = [Weights(x) for x in lexicons]
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts):
                h = pdf["half"].to_numpy()[a:b, None] == 0
                x = np.where(h, features(texts[a:b], weights[0]), features(texts[a:b], weights[1]))
                yield pd.DataFrame(x, columns=NAMES).assign(y=pdf["y"].to_numpy()[a:b], id=pdf["id"].to_numpy()[a:b])

    got = sample.mapInPandas(measure, ", ".join(f"{x} double" for x in NAMES) + f", y int, id {sample.schema['id'].dataType.simpleString()}").toPandas().sort_values("id", kind="stable")
    x, y = got[list(NAMES)].to_numpy(), (got["y"].to_numpy() > 0).astype(float)
    # Out-of-fold margins of all rows calibrate the trees that all rows train.
    fold = np.arange(len(y)) % 4
    margin = np.zeros(len(y))
    for k in range(4):
        margin[fold == k] = Boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Scorer(lexicon(found, (0, 1), rows), Boosted(x, y), isotonic(margin, y))


def score(docs: DataFrame, scorer: Scorer, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; all columns stay (those two are replaced)."""
    out = docs.drop("score", "predicted")
    return out.withColumn("score", _scores(scorer)(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _scores(scorer: Scorer):
    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = Weights(scorer.lexicon)
        for s in batches:
            texts = [t or "" for t in s]
            yield pd.Series(np.concatenate([scorer.score(texts[a:b], weights) for a, b in chunks(texts)] or [np.zeros(0)]))

    return run
