"""Search over ``documents`` and ``embeddings``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import index as ix
from ..operators import search as se
from ..session import shared_dir, table
from .registry import query

TERMS = ["the", "tion", "thanedble", "idiot"]
W = "regexp_extract_all(strip_accents(lower(replace(replace(text, '''', ''), '’', ''))), '[\\p{L}\\p{M}\\p{N}]+')"
TOK = f"(select doc_id doc, {W} w from documents)"
ST = f"(select count(*) n, sum(len(w)) / cast(count(*) as double) mean from {TOK})"


def posts(terms) -> str:
    return " union all ".join(f"select doc, '{t}' term, len(list_filter(w, lambda x: x = '{t}')) tf, len(w) len from {TOK} where list_contains(w, '{t}')" for t in terms)


def score(terms) -> str:
    p = f"({posts(terms)})"
    part = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))"
    return f"(select doc, round(sum({part}), 9) score, count(*) terms from {p} p join (select term, count(*) df from {p} group by all) using (term), {ST} group by all)"


def indexed(spark, d):
    return ix.kept(table(spark, d, "documents"), "doc_id", "text")


def bm25(spark, d, terms):
    """The index's numbers, and its postings of the terms: only the files that hold them are read."""
    own = indexed(spark, d)
    return table(spark, d, "documents"), *own.statistics, own.postings(terms)


@query(f"select doc, len(w) tokens, len(list_distinct(w)) terms from {TOK}")
def q_tokens(spark, d):
    w = tx.words(F.col("text"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.size(w).cast("long").alias("tokens"), F.size(F.array_distinct(w)).cast("long").alias("terms"))


@query(f"select term, count(*) df, sum(tf) cf from (select doc, term, count(*) tf from (select doc, unnest(w) term from {TOK}) group by all) group by all", longs="cf")
def q_postings_build(spark, d):
    return se.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"select doc, score from {score(['thanedble'])} order by score desc, doc limit 10")
def q_bm25_single(spark, d):
    _, n, mean, p = bm25(spark, d, ["thanedble"])
    return se.top(se.scored(p, n, mean), 10).select("doc", "score")


@query(f"select doc, score from {score(TERMS)} order by score desc, doc limit 10")
def q_bm25(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS)
    return se.top(se.scored(p, n, mean), 10).select("doc", "score")


@query(f"select doc, score, terms from {score(TERMS)}")
def q_search_or(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS)
    return se.scored(p, n, mean)


@query(f"select doc, score from {score(TERMS[:3])} where terms = 3")
def q_search_and(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS[:3])
    return se.scored(p, n, mean).where("terms = 3").select("doc", "score")


@query(f"with p as ({posts(TERMS)}), f as (select term, count(*) df from p group by all), k as (select term, df from f, {ST} where df <= 0.2 * n union select term, df from f where (df, term) = (select min((df, term)) from f)) select doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) score from p join k using (term), {ST} group by doc")
def q_search_pruned(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS)
    return se.scored(se.pruned(p, n, 0.2), n, mean).select("doc", "score")


@query(f"select doc, terms, score from {score(TERMS)} order by terms desc, score desc, doc limit 20")
def q_search_adaptive(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS)
    return se.adaptive(se.scored(p, n, mean), len(TERMS), 20).select("doc", "terms", "score")


@query(f"select doc, score from {score(TERMS)} order by score desc, doc limit 10 offset 10")
def q_search_topk(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS)
    return se.top(se.scored(p, n, mean), 10, 10).select("doc", "score")


@query(f"select doc, score from {score(TERMS)} join documents on doc = doc_id where lang = 'en' and source in ('src1', 'src2') order by score desc, doc limit 10")
def q_search_filtered(spark, d):
    docs, n, mean, p = bm25(spark, d, TERMS)
    kept = docs.where("lang = 'en' and source in ('src1', 'src2')").select(F.col("doc_id").alias("doc"))
    return se.top(se.scored(p, n, mean).join(kept, "doc", "left_semi"), 10).select("doc", "score")


@query(f"with p as ({posts(['thanedble', 'tion'])}), u as (select 2.0::double w, * from p union all select 1.0, * from p where len > 100) select doc, round(sum(w * tf), 6) score from u group by doc")
def q_bm25_fields(spark, d):
    _, _, _, p = bm25(spark, d, ["thanedble", "tion"])
    fields = p.withColumn("w", F.lit(2.0)).union(p.where("len > 100").withColumn("w", F.lit(1.0)))
    return fields.groupBy("doc").agg(F.round(F.sum(F.col("w") * F.col("tf")), 6).alias("score"))


@query(f"select term, count(*) df from (select distinct doc, unnest(w) term from {TOK}) where starts_with(term, 'than') group by all order by df desc, term limit 32")
def q_prefix_expand(spark, d):
    return se.prefix(indexed(spark, d).dictionary(), "than")


@query(f"select term, distance from (select term, damerau_levenshtein(term, 'wrothless') distance, count(*) df from (select distinct doc, unnest(w) term from {TOK}) where len(term) between 7 and 11 group by all) where distance between 1 and 2 order by distance, df desc, term limit 8")
def q_typo_candidates(spark, d):
    return se.typo_candidates(indexed(spark, d).dictionary(), "wrothless").select("term", F.col("distance").cast("long").alias("distance"))


@query(f"with h as (select doc, lang, source from {score(TERMS[:3])} join documents on doc = doc_id where terms = 3), f as (select 'lang' facet, lang as value, count(*) n from h group by all union all select 'source', source, count(*) from h group by all) select facet, value, n from f qualify row_number() over (partition by facet order by n desc, value) <= 10")
def q_search_facets(spark, d):
    docs, n, mean, p = bm25(spark, d, TERMS[:3])
    return se.facets(docs, se.scored(p, n, mean).where("terms = 3"), "doc_id", ["lang", "source"])


def cos(a: str, b: str) -> str:
    return f"list_inner_product({a}::double[], {b}::double[]) / sqrt(list_inner_product({a}::double[], {a}::double[]) * list_inner_product({b}::double[], {b}::double[]))"


NEAR = f"(select q.vec_id query, v.vec_id doc, round({cos('q.embedding', 'v.embedding')}, 9) score from embeddings q, embeddings v where q.vec_id % 50 = 0 and q.vec_id <> v.vec_id)"


def asked(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


@query(f"select query, doc, score, rank from (select *, row_number() over (partition by query order by score desc, doc) rank from {NEAR}) where rank <= 10")
def q_vector_topk(spark, d):
    return se.vector_top(table(spark, d, "embeddings"), asked(spark, d), 10)


@query(f"select query, doc, round(score, 6) score from {NEAR} where score > 0.2")
def q_vector_cosine(spark, d):
    return se.vector_near(table(spark, d, "embeddings"), asked(spark, d), 0.2).select("query", "doc", F.round("score", 6).alias("score"))


@query("select vec_id, list_max(list_transform(embedding, lambda x: abs(x::double))) / 127 step, array_to_string(list_transform(embedding, lambda x: case when x >= 0 then '1' else '0' end), '') bits from embeddings")
def q_vector_quantized(spark, d):
    step = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))) / 127
    return table(spark, d, "embeddings").select("vec_id", step.alias("step"), se.sign_bits(F.col("embedding")).alias("bits"))


@query()
def q_vector_ivf(spark, d):
    return se.clustered(table(spark, d, "embeddings"), asked(spark, d), 10)


LIST = f"select doc, score from {score(TERMS)} order by score desc, doc limit 100"
VEC = "select doc, score from " + NEAR + " where query = 0 order by score desc, doc limit 100"


def both_lists(spark, d):
    _, n, mean, p = bm25(spark, d, TERMS)
    words = se.top(se.scored(p, n, mean), 100).select("doc", "score")
    return words, se.vector_top(table(spark, d, "embeddings"), asked(spark, d).where("query = 0"), 100).select("doc", "score")


@query(f"with a as ({LIST}), b as ({VEC}), x as (select doc, (score - (select min(score) from a)) / ((select max(score) from a) - (select min(score) from a)) s from a), y as (select doc, (score - (select min(score) from b)) / ((select max(score) from b) - (select min(score) from b)) s from b) select coalesce(x.doc, y.doc) doc, round(0.5 * coalesce(x.s, 0) + 0.5 * coalesce(y.s, 0), 9) score from x full join y on x.doc = y.doc")
def q_hybrid_convex(spark, d):
    return se.convex(*both_lists(spark, d))


@query(f"with a as ({LIST}), b as ({VEC}), r as (select doc, 1.0::double / (60 + row_number() over (order by score desc, doc)) p from a union all select doc, 1.0::double / (60 + row_number() over (order by score desc, doc)) from b) select doc, round(sum(p), 9) score from r group by doc")
def q_hybrid_rrf(spark, d):
    return se.reciprocal(list(both_lists(spark, d)))


@query(f"with a as ({LIST}), b as (select doc, score from {NEAR} where query = 0) select a.doc, coalesce(b.score, -1) score from a left join b on a.doc = b.doc")
def q_hybrid_rerank(spark, d):
    words, _ = both_lists(spark, d)
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("q"), F.lit(0).cast("long").alias("one"))  # a row
    near = e.join(words.select("doc"), F.col("vec_id") == F.col("doc"), "left_semi").where("vec_id <> 0").withColumn("one", F.lit(0).cast("long")).join(F.broadcast(one), "one")
    near = near.select(F.col("vec_id").alias("doc"), F.round(se.cosine(F.col("embedding"), F.col("q")), 9).alias("s"))
    return words.select("doc").join(near, "doc", "left").select("doc", F.coalesce("s", F.lit(-1.0)).alias("score"))


@query(f"with r as (select query, doc, rank from (select *, row_number() over (partition by query order by score desc, doc) rank from {NEAR}) where rank <= 10), j as (select q.vec_id query, v.vec_id doc from embeddings q, embeddings v where q.vec_id % 50 = 0 and v.vec_id <> q.vec_id and q.label = v.label), i as (select query, count(*) n from j group by all), h as (select query, rank, doc in (select doc from j where j.query = r.query) rel from r) select query, round(coalesce(sum(case when rel then 1 else 0 end), 0) / cast(n as double), 9) recall, round(coalesce(max(case when rel then 1.0::double / rank end), 0), 9) mrr, round(coalesce(sum(case when rel then 1 / log2(rank + 1) else 0 end), 0) / (select sum(1 / log2(g + 1)) from range(1, 11) t(g) where g <= n), 9) ndcg from h join i using (query) group by query, n")
def q_ir_metrics(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("label").alias("ql"))
    judged = e.join(F.broadcast(q), (F.col("label") == F.col("ql")) & (F.col("vec_id") != F.col("query"))).select("query", F.col("vec_id").alias("doc"))
    return se.evaluation(se.vector_top(e, asked(spark, d), 10), judged)


@query("with g as (select p_name, count(*) parts, list_distinct(list_transform(range(1, len(p_name) + 2), lambda i: substr('  ' || lower(p_name) || ' ', i, 3))) t from part group by p_name), p as (select a.p_name a, b.p_name b, a.parts * b.parts pairs, round(len(list_intersect(a.t, b.t)) / cast(len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) as double), 9) j from g a, g b where a.p_name < b.p_name) select * from p where j >= 0.4", longs="pairs")
def q_trigram_jaccard(spark, d):
    names = table(spark, d, "part").groupBy("p_name").agg(F.count(F.lit(1)).alias("parts"))
    return se.similar(names.select("p_name", "parts", tx.trigrams(F.col("p_name")).alias("t")), "p_name", "t", 0.4).select("a", "b", (F.col("a_row.parts") * F.col("b_row.parts")).alias("pairs"), "j")


STEM1 = "regexp_replace(term, '(sses|ies)$', 'ss')"
STEM2 = "case when len(w) > 3 and regexp_matches(w, '[^s]s$') then left(w, len(w) - 1) else w end"
STEM3 = "case when len(x) > 6 and ends_with(x, 'ing') then left(x, len(x) - 3) when len(x) > 5 and ends_with(x, 'ed') then left(x, len(x) - 2) else x end"


@query(f"select stem, count(distinct term) forms, count(*) uses from (select term, {STEM3} stem from (select term, {STEM2} x from (select term, {STEM1} w from (select doc, unnest(w) term from {TOK})))) where starts_with(stem, 'than') group by all")
def q_search_stem(spark, d):
    w = table(spark, d, "documents").select(F.explode(tx.words(F.col("text"))).alias("term"))
    s = w.withColumn("stem", tx.stem(F.col("term"))).where(F.startswith("stem", F.lit("than")))
    return s.groupBy("stem").agg(F.count_distinct("term").alias("forms"), F.count(F.lit(1)).alias("uses"))


@query(f"with t as (select doc, len(w) len, unnest(w) term from {TOK}), p as (select doc, len, count(*) tf from (select doc, len, {STEM3} stem from (select doc, len, {STEM2} x from (select doc, len, {STEM1} w from t))) where stem = 'idiot' group by all), d as (select count(*) df from p) select doc, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)), 9) score from p, d, {ST}")
def q_search_forms(spark, d):
    own = indexed(spark, d)
    words = {"idiot": se.forms(own, "idiots")}
    return se.scored(se.any_form(own.postings(words["idiot"]), words), *own.statistics).select("doc", "score")


@query(f"select word, coalesce(max(term), word) as searched from (select unnest(['wrothless', 'tion', 'zzzzzzzzzz']) word) left join (select 'wrothless' word, term from (select term, damerau_levenshtein(term, 'wrothless') distance, count(*) df from (select distinct doc, unnest(w) term from {TOK}) where len(term) between 7 and 11 group by all) where distance between 1 and 2 order by distance, df desc, term limit 1) using (word) group by word")
def q_search_corrected(spark, d):
    found = se.corrected(indexed(spark, d), ["wrothless", "tion", "zzzzzzzzzz"])
    return spark.createDataFrame(sorted(found.items()), "word string, searched string")


@query(f"with kept as (select doc, w from {TOK} where doc % 10 <> 3 union all select doc, ['replaced'] from {TOK} where doc % 10 = 3) select term, count(distinct doc) df from (select doc, unnest(w) term from kept) where term in ('the', 'replaced', 'tion') group by all")
def q_index_upsert(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = docs.where("doc_id % 10 = 3").select("doc_id", F.lit("replaced").alias("text"))
    own = ix.Index(spark, f"{shared_dir(spark)}/tidemark-index-{uuid.uuid4().hex}").build(docs, "doc_id", "text").upsert(changed, "doc_id", "text")
    return own.postings(["the", "replaced", "tion"]).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
