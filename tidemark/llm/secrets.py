"""Secret scans through a trigram inverted index, with DataFrame functions only.

Each rule's expression is compiled to a Boolean query of trigrams that any match must hold. The index has a posting
list per (trigram, block of ids) for the trigrams that the rules ask for; lists of a block meet in one row, the queries
are evaluated there by intersecting and uniting lists, and only documents that they name are searched by the rule. A
rule without a mandatory trigram is searched in every document. The index folds case, so it names too many documents
at worst, never too few.

Defined results: a null text is the empty text; a null id is in no index and is searched by every rule; rows that share
an id are searched by the rules that either calls for and keep their own spans. An empty table gives an empty table.
Spans count code points. Texts may be of any length and hold any number of matches: time is in proportion. Extra columns
are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import materialise

#: (kind, expression, what its matches must fulfil, in base). Expressions read alike in Java and Python.
RULES = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", True),
    # A run is matched whole or, if too short, not at all: the same as dropping short matches afterwards.
    ("access", r"AKIA[A-Z0-9]{16,}", True),
    ("hex", r"[0-9a-f]{24,}", True),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", False),
    ("google", r"AIza[0-9A-Za-z_-]{35}", False),
    ("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
    ("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", False),
    ("url_password", r"://[^\s:/@]+:[^\s:/@]+@", False),
]
#: Ids per block of the index: a posting list is so long at most (but for repeated ids, which it holds once).
BLOCK = 1024
MOST_STRINGS = 32
#: Named documents that are broadcast, some 20 MB; more of them are joined by a shuffle of the texts.
BROADCAST_IDS = 500_000
#: Trigrams that a conjunction keeps: its rarest by English letters. Fewer name more documents, never fewer.
MOST_GRAMS = 5
COMMON_LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


# Queries: True, a trigram, or ("and" | "or", frozenset of queries).
def both(*qs):
    parts = set()
    for q in qs:
        if q is True:
            continue
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", frozenset(parts))


def terms(q) -> frozenset:
    return q[1] if isinstance(q, tuple) and q[0] == "and" else frozenset({q})


def either(qs):
    parts = set(qs)
    # What holds whenever a weaker alternative holds adds nothing.
    parts = parts if True in parts else {q for q in parts if not any(terms(o) < terms(q) for o in parts)}
    return True if not parts or True in parts else next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def holds(text: str):
    return both(*(text[i : i + 3] for i in range(len(text) - 2)))


def one_of(strings):
    return either(holds(s) for s in strings)


@dataclass(frozen=True)
class Known:
    """What is known of an expression's matches: all of them (or None), their beginnings and ends, and a query."""

    exact: frozenset | None
    first: frozenset
    last: frozenset
    query: object

    @classmethod
    def strings(cls, found) -> Known:
        found = frozenset(found)
        return cls(found, found, found, True) if len(found) <= MOST_STRINGS else ANY

    def then(self, other: Known) -> Known:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST_STRINGS:
            return Known.strings(a + b for a in self.exact for b in other.exact)
        cross = lambda x, y: frozenset(a + b for a in x for b in y) if len(x) * len(y) <= MOST_STRINGS else None
        seam = cross(self.last, other.first)
        first = (cross(self.exact, other.first) or self.first) if self.exact is not None else self.first
        last = (cross(self.last, other.exact) or other.last) if other.exact is not None else other.last
        return Known(None, first, last, both(self.sure(), other.sure(), True if seam is None else one_of(seam)))

    def sure(self):
        """The query by itself, with what the strings say."""
        return both(self.query, True if self.exact is None else one_of(self.exact), one_of(self.first), one_of(self.last))


ANY = Known(None, frozenset({""}), frozenset({""}), True)
EMPTY = Known(frozenset({""}), frozenset({""}), frozenset({""}), True)


def known(node) -> Known:
    if isinstance(node, parser.SubPattern):
        return reduce(Known.then, (known(x) for x in node), EMPTY)
    op, arg = node
    if op is sre.LITERAL:
        return Known.strings({chr(arg).lower()})
    if op is sre.IN:
        chars = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return ANY
        return Known.strings(chars) if len(chars) <= 6 else ANY
    if op is sre.SUBPATTERN:
        return known(arg[-1])
    if op is sre.BRANCH:
        parts = [known(x) for x in arg[1]]
        if all(p.exact is not None for p in parts):
            return Known.strings(s for p in parts for s in p.exact)
        return Known(None, frozenset().union(*(p.first for p in parts)), frozenset().union(*(p.last for p in parts)), either(p.sure() for p in parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = arg
        inner = known(body)
        if low == 0:
            return Known.strings(inner.exact | {""}) if high == 1 and inner.exact is not None else ANY
        if low == high == 1:
            return inner
        return Known(None, inner.first, inner.last, inner.sure())
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return EMPTY
    return ANY


def rarity(gram: str) -> tuple:
    return -sum(COMMON_LETTERS.find(c) if c in COMMON_LETTERS else len(COMMON_LETTERS) for c in gram), gram


def trimmed(q):
    if not isinstance(q, tuple):
        return q
    if q[0] == "or":
        return either(trimmed(x) for x in q[1])
    own = sorted((x for x in q[1] if isinstance(x, str)), key=rarity)[:MOST_GRAMS]
    return both(*own, *(trimmed(x) for x in q[1] if not isinstance(x, str)))


def query(expression: str):
    """The Boolean trigram query of an expression, over text in lower case; True: every text must be searched."""
    return trimmed(known(parser.parse(expression)).sure())


def grams(q) -> set[str]:
    return set() if q is True else {q} if isinstance(q, str) else set().union(*(grams(x) for x in q[1]))


def evaluated(q, lists: Column) -> Column:
    """The ids that a query names, from a map of posting lists."""
    if isinstance(q, str):
        return F.coalesce(F.element_at(lists, q), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if q[0] == "and" else F.array_union, (evaluated(x, lists) for x in sorted(q[1], key=str)))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, rules array<int>): the rules with mandatory trigrams whose queries name the document."""
    queries = {i: q for i, (_, e, _) in enumerate(rules) if (q := query(e)) is not True}
    wanted = sorted(set().union(*(grams(q) for q in queries.values())))
    low = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("low"))
    found = low.select("doc_id", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda g: F.contains(F.col("low"), g))).alias("gram"))
    postings = found.groupBy(F.floor(F.col("doc_id") / BLOCK).alias("block"), "gram").agg(F.collect_set("doc_id").alias("ids"))
    blocks = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "ids"))).alias("lists"))

    def tagged(i: int, ids: Column) -> Column:
        return F.transform(ids, lambda x: F.struct(x.alias("doc_id"), F.lit(i).alias("rule")))

    named = F.flatten(F.array(*(tagged(i, evaluated(q, F.col("lists"))) for i, q in queries.items())))
    return blocks.select(F.explode(named).alias("c")).groupBy("c.doc_id").agg(F.collect_set("c.rule").alias("rules"))


def long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, RULES[0][1], 2)) >= 6


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """(id, text, spans array<struct<start,no,kind,end>>) of every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    open_rules = [i for i, (_, e, _) in enumerate(rules) if query(e) is True]
    cand = materialise(candidates(src, rules).withColumnRenamed("doc_id", "cand_id"), "named")
    few = cand.count() <= BROADCAST_IDS
    out = src.join(F.broadcast(cand) if few else cand, src["doc_id"].cast("long") == F.col("cand_id"), "left").drop("cand_id")
    for i, (_, e, _) in enumerate(rules):
        found = spans.matches(F.col("text"), e)
        if i not in open_rules:
            found = F.when(F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", i), F.lit(False)), found).otherwise(F.array().cast("array<string>"))
        out = out.withColumn(f"m{i}", found)
    parts = []
    for i, (kind, e, _) in enumerate(rules):
        keep = None
        if kind == "assign":  # a shorter value still uses up its match
            keep = long_value
        parts.append(spans.placed(F.col("text"), e, F.col(f"m{i}"), kind, i, keep))
    return out.select(F.col("doc_id").alias(id_col), "text", F.concat(*parts).alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id", rules=RULES) -> DataFrame:
    base = [kind for kind, _, own in rules if own]
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return scanned.select(id_col, *(spans.of_kind(F.col("spans"), k).alias(f"n_{k}") for k in base), F.sha2(spans.joined(own), 256).alias("base_sha256"), spans.joined(F.col("spans")).alias("spans"))
