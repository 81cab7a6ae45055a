"""Full-text, vector and hybrid search: postings, BM25 plans, exact and clustered vectors, fusion, evaluation.

Scores are rounded to nine digits before ranking, so that a sum's order does not decide ties; ties go to the lower id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ranges import RangeError
from .index import Index, counted

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, doc, tf, len) of a table without an index."""
    return counted(docs, id_col, tx.words(F.col(text_col)))


def scored(post: DataFrame, n: int, mean: float) -> DataFrame:
    """(doc, score, terms) over postings of the query's terms. The frequencies are as many rows as terms."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    return post.join(F.broadcast(df), "term").withColumn("part", part).groupBy("doc").agg(F.round(F.sum("part"), 9).alias("score"), F.count(F.lit(1)).alias("terms"))


def top(scores: DataFrame, k: int, offset: int = 0) -> DataFrame:
    return scores.orderBy(F.desc("score"), "doc").offset(offset).limit(k)


def pruned(post: DataFrame, n: int, cut: float) -> DataFrame:
    """Postings without terms that more than ``cut`` of all documents hold; the rarest term stays in any case."""
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = df.agg(F.min(F.struct("df", "term")).alias("m")).select("m.term")
    keep = df.where(F.col("df") <= cut * n).select("term").union(rarest).distinct()
    return post.join(F.broadcast(keep), "term", "left_semi")


def adaptive(scores: DataFrame, words: int, k: int) -> DataFrame:
    """Documents with more of the words first: tiers of all words, all but one, and so on."""
    return scores.orderBy(F.desc("terms"), F.desc("score"), "doc").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _blocks(queries: DataFrame, most: int = 2048):
    """A stated query set in blocks for the driver: (names, unit vectors) of ``most`` queries at most each."""
    at, n = queries.withColumn("_b", F.pmod(F.xxhash64("query"), F.lit(max(1, -(-queries.count() // (most // 2)))))), None
    n = at.agg(F.max("_b").alias("m")).first()["m"]
    for i in range(0 if n is None else n + 1):
        rows = at.where(F.col("_b") == i).select("query", "q").collect()
        if rows:
            yield np.array([r["query"] for r in rows]), _units(np.array([r["q"] for r in rows], dtype=np.float64))


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def _scores(vectors: DataFrame, queries: DataFrame, keep) -> DataFrame:
    """(query, doc, score) that ``keep(scores)`` marks, blocks of queries against all vectors; a vector isn't its own."""
    spark, out = vectors.sparkSession, []
    kind = vectors.schema["vec_id"].dataType.simpleString()
    for names, q in _blocks(queries):
        block = spark.sparkContext.broadcast((names, q))  # 2048 vectors at most

        def run(batches: Iterator[pd.DataFrame], block=block) -> Iterator[pd.DataFrame]:
            names, q = block.value
            for pdf in batches:
                for a in range(0, len(pdf), 1024):
                    part = pdf.iloc[a : a + 1024]
                    docs = part["vec_id"].to_numpy()
                    s = np.round(q @ _units(np.array(part["embedding"].tolist(), dtype=np.float64)).T, 9)
                    s[names[:, None] == docs[None, :]] = np.nan
                    i, j = np.nonzero(keep(s, docs))
                    yield pd.DataFrame({"query": names[i], "doc": docs[j], "score": s[i, j]})

        out.append(vectors.select("vec_id", "embedding").mapInPandas(run, f"query {kind}, doc {kind}, score double"))
    return reduce(DataFrame.union, out) if out else vectors.sparkSession.createDataFrame([], f"query {kind}, doc {kind}, score double")


def vector_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, doc, score, rank): the nearest ``k`` of each stated query. Each batch gives its own ``k`` at most."""

    def best(s: np.ndarray, docs: np.ndarray) -> np.ndarray:
        order = np.lexsort((np.broadcast_to(docs, s.shape), np.nan_to_num(-s, nan=np.inf)), axis=1)[:, :k]
        out = np.zeros(s.shape, dtype=bool)
        np.put_along_axis(out, order, True, axis=1)
        return out & ~np.isnan(s)

    w = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return _scores(vectors, queries, best).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def vector_near(vectors: DataFrame, queries: DataFrame, least: float) -> DataFrame:
    """(query, doc, score) of all pairs above a cosine: a filter, nothing is ranked."""
    return _scores(vectors, queries, lambda s, _: s > least)


def quantised(v: Column) -> Column:
    """Bytes of a vector: components over the largest one's 127th part."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    return F.transform(v, lambda x: F.bround(x.cast("double") / scale).cast("int"))


def sign_bits(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.when(x >= 0, "1").otherwise("0")), "")


def clustered(vectors: DataFrame, queries: DataFrame, k: int, clusters: int | None = None, recall: float = 0.95, tried: int = 64, seed: int = 7) -> DataFrame:
    """Inverted lists by k-means on unit vectors; each query reads the lists of its nearest centres, rescored exactly.

    As many lists are read as hold a share of ``recall`` of the true neighbours of ``tried`` queries, found exactly.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    clusters = clusters or max(2, round(n**0.5 / 2))
    rows = vectors.select("vec_id", "embedding", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.sqrt(dot(F.col("embedding"), F.col("embedding"))))).alias("features"))
    fitted = KMeans(k=clusters, seed=seed, maxIter=10).fit(rows.sample(min(1.0, 256 * clusters / max(1, n)), seed=seed))
    placed = fitted.transform(rows).select("vec_id", "embedding", F.col("prediction").alias("cell"))
    centres = _units(np.array(fitted.clusterCenters()) + 1e-12)
    some = queries.orderBy(F.xxhash64("query")).limit(tried)
    own = {r["query"]: r["q"] for r in some.collect()}
    true = vector_top(vectors, some, k).join(placed.select(F.col("vec_id").alias("doc"), "cell"), "doc").select("query", "cell").collect()
    places = sorted(int((centres @ np.array(own[r["query"]]) > centres[r["cell"]] @ np.array(own[r["query"]])).sum()) for r in true)
    probes = places[min(len(places) - 1, int(recall * len(places)))] + 1 if places else 1
    asked = []
    for names, q in _blocks(queries):
        order = np.argsort(-(q @ centres.T), axis=1)[:, :probes]
        asked += [(int(name), int(c)) for name, own in zip(names, order, strict=True) for c in own]
    # A row per stated query and list that it reads.
    cells = vectors.sparkSession.createDataFrame(asked, "query long, cell int").join(queries, "query")
    cells = F.broadcast(cells) if len(asked) <= 200_000 else cells
    near = placed.join(cells, "cell").where("vec_id <> query").select("query", F.col("vec_id").alias("doc"), F.round(cosine(F.col("embedding"), F.col("q")), 9).alias("score"))
    r = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return near.withColumn("rank", F.row_number().over(r).cast("long")).where(F.col("rank") <= k)


def scaled(scores: DataFrame) -> DataFrame:
    """Min-max scaling of one score list; a list of equal scores is all ones."""
    e = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return scores.join(F.broadcast(e)).select("doc", F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("score"))


def convex(words: DataFrame, vectors: DataFrame, w: float = 0.5) -> DataFrame:
    """A document that one list lacks counts zero there."""
    a, b = scaled(words).withColumnRenamed("score", "x"), scaled(vectors).withColumnRenamed("score", "y")
    return a.join(b, "doc", "full").select("doc", F.round((1 - w) * F.coalesce("x", F.lit(0.0)) + w * F.coalesce("y", F.lit(0.0)), 9).alias("score"))


def reciprocal(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion. The lists are top lists, a hundred rows or so."""
    out = None
    for x in lists:
        r = x.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc"))).select("doc", (1.0 / (k + F.col("rank"))).alias("part"))
        out = r if out is None else out.union(r)
    return out.groupBy("doc").agg(F.round(F.sum("part"), 9).alias("score"))


def similar(rows: DataFrame, key: str, grams: str, least: float) -> DataFrame:
    """(a, b, j, a_row, b_row): pairs of rows whose sets of grams reach a Jaccard likeness.

    Sets are ordered rare grams first; two that are alike enough share one of their first n - ceil(least n) + 1.
    """
    each = rows.select(F.col(key).alias("id"), F.explode(grams).alias("g"))
    rank = each.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    first = each.join(rank, "g").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    lead = first.select("id", F.explode(F.slice("o", 1, (F.size("o") - F.ceil(F.size("o") * least - 1e-9) + 1).cast("int"))).alias("x")).select("id", "x.g")
    met = lead.select(F.col("id").alias("a"), "g").join(lead.select(F.col("id").alias("b"), "g"), "g").where("a < b").select("a", "b").distinct()
    x, y = (rows.select(F.col(key).alias(n), F.struct(*rows.columns).alias(f"{n}_row")) for n in "ab")
    scored = met.join(x, "a").join(y, "b").withColumn("j", F.round(tx.jaccard(F.col(f"a_row.{grams}"), F.col(f"b_row.{grams}")), 9))
    return scored.where(F.col("j") >= least)


def passes(fields: Column, path: str, values: list | None = None, between: tuple[float | None, float | None] | None = None, missing: bool = False) -> Column:
    """Whether a JSON document's field passes: any of its values (a list counts as all of its items) is one of ``values``,
    exact in type and case (``"50"`` is not 50, 42.0 is 42), or lies in ``[low, high)``; ``missing``: it has no value."""
    if (values is not None) + (between is not None) + missing != 1:
        raise RangeError("a filter has values, a range or is missing, one of the three")
    raw = F.get_json_object(fields, f"$.{path}")
    own = F.variant_get(F.try_parse_json(fields), f"$.{path}", "variant")
    kind = F.schema_of_variant(own)
    items = F.when(F.startswith(kind, F.lit("ARRAY")), F.from_json(raw, "array<string>")).when(raw.isNotNull() & (kind != "VOID"), F.array(raw)).otherwise(F.array().cast("array<string>"))
    kinds = F.when(F.startswith(kind, F.lit("ARRAY")), F.transform(F.try_variant_get(own, "$", "array<variant>"), lambda v: F.schema_of_variant(v))).otherwise(F.array(kind))
    pairs = F.filter(F.zip_with(items, kinds, lambda v, k: F.struct(v.alias("v"), k.alias("k"))), lambda p: p["v"].isNotNull() & (p["k"] != "VOID"))
    number = lambda p: F.when((p["k"] != "STRING") & (p["k"] != "BOOLEAN"), p["v"].try_cast("double"))
    if missing:
        return F.coalesce(F.size(pairs) == 0, F.lit(True))
    if between is not None:
        low, high = between
        return F.coalesce(F.exists(pairs, lambda p: F.coalesce((number(p) >= low if low is not None else number(p).isNotNull()) & (number(p) < high if high is not None else F.lit(True)), F.lit(False))), F.lit(False))
    if any(v is None for v in values):
        raise RangeError("null is no value: ask for what is missing")

    def equal(p: Column, v) -> Column:
        if isinstance(v, bool):
            return (p["k"] == "BOOLEAN") & (p["v"] == str(v).lower())
        if isinstance(v, str):
            return (p["k"] == "STRING") & (p["v"] == v)
        exact = p["v"].try_cast("decimal(38,0)") == F.lit(str(v)).cast("decimal(38,0)") if isinstance(v, int) else F.lit(False)
        whole = p["v"].rlike(r"^-?\d+$") & F.lit(isinstance(v, int))
        return F.when(whole, exact).otherwise(F.coalesce(number(p) == float(v), F.lit(False))) & (p["k"] != "STRING") & (p["k"] != "BOOLEAN")

    return F.coalesce(F.exists(pairs, lambda p: reduce(lambda a, b: a | b, (F.coalesce(equal(p, v), F.lit(False)) for v in values), F.lit(False))), F.lit(False))


def paired(a: DataFrame, b: DataFrame, metric: str, rounds: int = 2000, seed: int = 7) -> dict[str, float]:
    """Two evaluations of one stated query set: wins, losses and ties of ``a``, its mean lead, and the middle 95 % of that
    mean over bootstrapped queries. A number per query comes to the driver."""
    rows = a.select("query", F.col(metric).alias("x")).join(b.select("query", F.col(metric).alias("y")), "query").orderBy("query").collect()
    lead = np.array([r["x"] - r["y"] for r in rows])
    if not len(lead):
        raise RangeError("no query is in both")
    rnd = np.random.default_rng(seed)
    means = np.sort([lead[rnd.integers(0, len(lead), len(lead))].mean() for _ in range(rounds)])
    return {"wins": int((lead > 0).sum()), "losses": int((lead < 0).sum()), "ties": int((lead == 0).sum()), "mean": float(lead.mean()), "low": float(means[rounds // 40]), "high": float(means[-1 - rounds // 40])}


def forms(own: Index, word: str, language: str = "en", most: int = 64) -> list[str]:
    """The index's terms that share a word's stem, the most frequent ones, and the word itself."""
    stem = own.spark.range(1).select(tx.stem(F.lit(word), language).alias("stem"))
    same = own.dictionary().withColumn("stem", tx.stem(F.col("term"), language)).join(F.broadcast(stem), "stem")
    return sorted({word, *(r["term"] for r in same.orderBy(F.desc("df"), "term").limit(most).collect())})


def any_form(post: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Postings of forms as postings of their words: a document's counts add up. ``words``: word -> its forms."""
    by = {f: w for w, fs in words.items() for f in fs}
    name = F.element_at(F.create_map(*(F.lit(x) for kv in by.items() for x in kv)), F.col("term"))
    return post.withColumn("term", name).groupBy("doc", "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def corrected(own: Index, words: list[str]) -> dict[str, str]:
    """What to search instead of words that no document holds: the nearest, then most frequent term; others stay."""
    held = {r["term"] for r in own.dictionary(lambda d: d.where(F.col("term").isin(words))).collect()}
    out = {}
    for w in words:
        best = None if w in held else typo_candidates(own.dictionary(), w, 1).first()
        out[w] = best["term"] if best else w
    return out


def facets(docs: DataFrame, found: DataFrame, id_col: str, by: list[str], most: int = 10) -> DataFrame:
    """(facet, value, n): how many of the documents found have each value, the most frequent ones of each facet."""
    held = docs.select(F.col(id_col).alias("doc"), *by).join(found.select("doc"), "doc", "left_semi")
    each = held.select(F.explode(F.array(*(F.struct(F.lit(b).alias("facet"), F.col(b).cast("string").alias("value")) for b in by))).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))
    return each.withColumn("rn", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("rn") <= most).drop("rn")


def evaluation(ranked: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """(query, recall, mrr, ndcg) at k, binary relevance. ranked(query, doc, rank), judged(query, doc)."""
    hit = ranked.where(F.col("rank") <= k).join(judged.withColumn("rel", F.lit(1)), ["query", "doc"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    got = hit.groupBy("query").agg(F.sum("rel").alias("found"), F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))).alias("rr"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"))
    want = judged.groupBy("query").agg(F.count(F.lit(1)).alias("all"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("all", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return want.join(got, "query", "left").select("query", F.round(F.coalesce(F.col("found"), F.lit(0)) / F.col("all"), 9).alias("recall"), F.round(F.coalesce("rr", F.lit(0.0)), 9).alias("mrr"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 9).alias("ndcg"))


def prefix(terms: DataFrame, begin: str, most: int = 32) -> DataFrame:
    """The most frequent terms that begin so. terms(term, df)."""
    return terms.where(F.startswith("term", F.lit(begin))).orderBy(F.desc("df"), "term").limit(most)


def typo_candidates(terms: DataFrame, word: str, most: int = 8) -> DataFrame:
    """Terms within the edits that a word's length allows, nearest and most frequent first. terms(term, df)."""
    n = tx.edits_allowed(word)
    # Two edits of the plain distance may be one swap: those further away than that are left out first.
    near = terms.where(F.length("term").between(len(word) - n, len(word) + n) & (F.col("term") != word) & (F.levenshtein("term", F.lit(word), 2 * n) >= 0))
    return near.withColumn("distance", tx.distance(F.col("term"), word)).where(F.col("distance") <= n).orderBy("distance", F.desc("df"), "term").limit(most)
