"""SQL (DuckDB) for the queries that SQL can express: the same rows by plain means."""

from __future__ import annotations

from .secrets import RULES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def op1() -> str:
    parts = []
    for no, (kind, e, _) in enumerate(RULES):
        keep = " and length(regexp_extract(m[i], {0}, 2)) >= 6".format(_literal(e)) if kind == "assign" else ""
        before = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        parts.append(
            f"select doc_id, {before} s, {no} no_, {_literal(kind)} kind, {before} + length(m[i]) e from (select doc_id, p, m, unnest(range(1, len(m) + 1)) i from (select doc_id, string_split_regex(coalesce(text, ''), {_literal(e)}) p, regexp_extract_all(coalesce(text, ''), {_literal(e)}, 0) m from documents)) where i > 0{keep}"
        )
    joined = "coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' order by s, no_)"
    base = [k for k, _, own in RULES if own]
    counts = ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in base)
    return f"with spans as ({' union all '.join(parts)}) select d.doc_id, {counts}, sha256({joined} filter (no_ < {len(base)}), '')) base_sha256, {joined}, '') spans from documents d left join spans using (doc_id) group by d.doc_id"


def _components(links: str) -> str:
    """``reach(x, y)`` over ``links(x, y)``, both ways and from each node to itself."""
    return f"reach(x, y) as (select x, x from {links} union select reach.x, l.y from reach join {links} l on l.x = reach.y), least(x, c) as (select x, min(y) from reach group by x)"


OP4 = f"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end g from w),
u as (select doc_id, len(g) n, unnest(g) g from s),
pairs as (select a.doc_id x, b.doc_id y from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
links as (select x, y from pairs union all select y, x from pairs),
{_components("links")}
select doc_id, len(g) n_shingles, coalesce(c, doc_id) component_id from s left join least on x = doc_id"""

BASE32 = "array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || rpad(substr(h, 1 + (5 * i) // 4, 3), 3, '0'))::bigint >> (7 - (5 * i) % 4)) & 31)]), '')"
OP5 = f"""select page_id, strlen(coalesce(html, '')) payload_bytes, {BASE32} payload_digest, case when page_id = last then 'response' else 'revisit' end record_type, case when page_id <> last then last end refers_to
from (select *, sha1(coalesce(html, '')) h, max(page_id) over (partition by coalesce(html, '')) last from pages)"""

OP7 = f"""with recursive v as (select vec_id, label, embedding::double[] e, sqrt(list_inner_product(embedding::double[], embedding::double[])) n from embeddings),
links as (select a.vec_id x, b.vec_id y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
{_components("links")},
k as (select x, count(*) m from links group by x)
select vec_id, coalesce(m, 0) n_links, coalesce(c, vec_id) component_id, coalesce(c, vec_id) = vec_id kept from v left join k on k.x = vec_id left join least on least.x = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": op1(), "op4_ngram_join": OP4, "op5_warc": OP5, "op7_embedding_dedup": OP7}
