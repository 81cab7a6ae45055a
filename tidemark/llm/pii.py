"""Personal data: fixed forms, and terms that reveal them by corpus co-occurrence; DataFrame functions only.

E-mail addresses, IP addresses, card and phone numbers are the protected entities. A term outside them tells
PMI(term; entity) bits of the entity's IC(entity) = log2(N / df(entity)) bits, both estimated over all rows: df counts
rows that hold a term or an entity, co-occurrence counts different texts that hold both or, if these are more, different
surroundings of the entity that hold the term, so that copies of one text are no evidence. An entity that stands in one
context only has no co-occurrence to estimate. A term that tells a share of ``DISCLOSES`` or more is generalised, one
that tells ``REMOVES`` or more is removed, wherever it stands in a text that holds that entity.

Defined results: null and empty texts have no spans and stay as they are; repeated rows have equal spans; an empty
table gives an empty table. A null id is an ordinary row. Spans count code points, end exclusive; of spans that overlap
every code point is replaced once. Texts may be of any length and hold any number of matches: time is in proportion.
``sanitise`` keeps all columns, whatever their names, and all rows; texts without spans are unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import materialise

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Expressions whose matches, after the tests below, are those of the plain forms, in time linear in the text: a run is
#: tried at its beginning only, and never given back.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"\p{L}{4,}"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters around an entity that are a context of its own within a text.
NEAR = 80
#: Contexts that a term and an entity must share, and shares of the entity's information.
CONTEXTS, DISCLOSES, REMOVES = 2, 0.6, 0.9


def valid_ip(m: Column) -> Column:
    return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")


def luhn(m: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(m, "[^0-9]", "")), "")
    number = lambda d: F.coalesce(F.try_to_number(d, F.lit("9")).cast("int"), F.lit(0))
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, twice(number(d))).otherwise(number(d)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid_phone(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15)


def base_spans(text: Column, matches: dict[str, Column]) -> Column:
    keep = {"email": None, "ip": valid_ip, "card": luhn, "phone": valid_phone}
    form = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    return F.array_sort(F.concat(*(spans.placed(text, form[k], matches[k], k, i, keep[k]) for i, k in enumerate(KINDS[:4]))))


def found_in(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ``base``: spans of the fixed forms."""
    text = F.col("text")
    nothing = F.array().cast("array<string>")
    gate = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    form = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    out = docs.withColumns({f"_{k}": F.when(gate[k], spans.matches(text, form[k])).otherwise(nothing) for k in form})
    return out.withColumn("base", base_spans(text, {k: F.col(f"_{k}") for k in form})).drop(*(f"_{k}" for k in form))


def contexts(text: Column, base: Column) -> Column:
    """Per entity: its value, and the text before and after it, cut at white space."""

    def all_of(blocks: Column, size: Column) -> Column:
        def one(s: Column) -> Column:
            begin, end = F.greatest(s["start"] - NEAR, F.lit(0)), F.least(s["end"] + NEAR, size)
            before, after = spans.piece(blocks, begin, s["start"]), spans.piece(blocks, s["end"], end)
            # A word that the window cuts is left out.
            whole = F.when(begin > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before)
            kept = F.when(s["end"] + NEAR <= size, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
            entity = F.concat_ws(":", s["kind"], F.lower(spans.piece(blocks, s["start"], s["end"])))
            return F.struct(entity.alias("entity"), whole.alias("before"), kept.alias("after"))

        return F.transform(base, one)

    return spans.let(spans.blocks_of(text), lambda blocks: spans.let(F.length(text), lambda size: all_of(blocks, size)))


def outside(text: Column, base: Column) -> Column:
    """``text`` with blanks in the places of the entities, so that places stay the same."""
    return spans.replaced(text, base, lambda s, word: F.repeat(F.lit(" "), F.length(word)))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): rows of ``docs`` that hold each term; sums meet before the shuffle."""
    return docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def disclosures(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(mark, told): per text whose terms disclose an entity in it, a map of these terms to their shares.

    ``base``: (mark, near, rest) of the rows that hold entities: the entities' contexts, and the text outside them.
    """
    n = float(max(docs.count(), 1))
    entity_df = base.select(F.explode(F.array_distinct(F.transform("near", lambda e: e["entity"]))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("entity_df"))
    entity_df = materialise(entity_df, "entity-df")
    most = entity_df.agg(F.max("entity_df").alias("m")).first()["m"] or 1
    term_df = materialise(frequencies(docs), "term-df")
    # As min(co, df, df(entity)) is no more than df(entity), a term with a higher df can't tell enough.
    limit = lambda e: F.pow(F.lit(n), F.lit(1 - DISCLOSES)) * F.pow(e, F.lit(DISCLOSES)) * (1 + 1e-9)
    texts = materialise(base.select("mark", F.array_distinct(F.transform("near", lambda e: e["entity"])).alias("entities"), terms_of(F.col("rest")).alias("held")).dropDuplicates(["mark"]), "held")
    whose = texts.select("mark", F.explode("entities").alias("entity")).join(entity_df, "entity")
    what = texts.select("mark", F.explode("held").alias("term")).join(term_df.where(F.col("df") <= limit(F.lit(float(most)))), "term")
    pairs = whose.join(what, "mark").where(F.col("df") <= limit(F.col("entity_df")))
    far = pairs.where((F.col("df") >= CONTEXTS) & (F.col("entity_df") >= CONTEXTS)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("co"))
    # A hot entity or term is many rows of one key: distinct triples and counts meet before each shuffle.
    sides = base.select(F.explode("near").alias("e")).select("e.entity", F.xxhash64("e.before", "e.after").alias("context"), F.explode(F.array_union(terms_of(F.col("e.before")), terms_of(F.col("e.after")))).alias("term"))
    close = sides.distinct().groupBy("entity", "term").agg(F.count(F.lit(1)).alias("co"))
    together = far.where(F.col("co") >= CONTEXTS).unionByName(close.where(F.col("co") >= CONTEXTS)).groupBy("entity", "term").agg(F.max("co").alias("co"))
    ic = F.log2(F.lit(n) / F.col("entity_df"))
    pmi = F.log2(F.lit(n) * F.least("co", "df", "entity_df") / (F.col("df") * F.col("entity_df")))
    told = together.join(entity_df, "entity").join(term_df, "term").where(ic > 0).withColumn("share", F.least(pmi / ic, F.lit(1.0))).where(F.col("share") >= DISCLOSES).select("entity", "term", "share")
    hit = pairs.select("mark", "entity", "term").join(materialise(told, "told"), ["entity", "term"]).groupBy("mark", "term").agg(F.max("share").alias("share"))
    return hit.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))


def term_spans(rest: Column, told: Column) -> Column:
    """Spans with shares of the terms in the map ``told``: their spellings in the text, as whole runs of letters."""
    spelt = F.array_distinct(F.filter(F.regexp_extract_all(rest, F.lit(TERM), F.lit(0)), lambda w: F.map_contains_key(told, F.lower(w))))
    form = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(spelt, "|"), F.lit(r")(?!\p{L})"))
    at = spans.placed(rest, form, spans.matches(rest, form), "term", 4)

    def shared(blocks: Column) -> Column:
        return F.transform(at, lambda s: F.struct(s["start"], s["no"], s["kind"], s["end"], told[F.lower(spans.piece(blocks, s["start"], s["end"]))].alias("share")))

    return F.when(F.size(spelt) > 0, spans.let(spans.blocks_of(rest), shared))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, mark, base, terms) of every row; ``mark`` is a hash of the text, to find the row's text again."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = F.size("base") > 0
    base = found_in(src).select("doc_id", F.xxhash64("text").alias("mark"), "base", F.when(some, contexts(F.col("text"), F.col("base"))).alias("near"), F.when(some, outside(F.col("text"), F.col("base"))).alias("rest"))
    base = materialise(base, "entities")
    told = disclosures(src, base.where(some).select("mark", "near", "rest")).withColumnRenamed("mark", "told_mark")
    held = base.where(some).join(told, F.col("mark") == F.col("told_mark"), "left").select("doc_id", "mark", "base", F.when(F.col("told").isNotNull(), term_spans(F.col("rest"), F.col("told"))).alias("terms"))
    return held.unionByName(base.where(~some).select("doc_id", "mark", "base", F.lit(None).cast(held.schema["terms"].dataType).alias("terms")))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    terms = F.coalesce(F.transform("terms", lambda s: F.struct(s["start"], s["no"], s["kind"], s["end"])), spans.none())
    every = F.concat(F.col("base"), terms)
    return scanned.select(F.col("doc_id").alias(id_col), *(spans.of_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]), F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"), spans.joined(every).alias("spans"))


def sanitise(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each span replaced: entities by their kind, disclosing terms by a general form or nothing."""
    mark = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    # The row travels as one value, so that none of its columns meets one of these.
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own_id"), mark.alias("own_mark"))
    found = scan(docs, text_col, id_col).where("size(base) > 0").dropDuplicates(["doc_id", "mark"])
    as_term = F.coalesce(F.col("terms"), F.array().cast("array<struct<start:int,no:int,kind:string,end:int,share:double>>"))
    as_base = F.transform("base", lambda s: F.struct(s["start"], s["no"], s["kind"], s["end"], F.lit(1.0).alias("share")))
    found = found.select("doc_id", "mark", F.array_sort(F.concat(as_base, as_term)).alias("found"))

    def instead(s: Column, word: Column) -> Column:
        return F.when(s["kind"] != "term", F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).when(s["share"] >= REMOVES, F.lit("<REDACTED>")).otherwise(F.concat(F.substring(word, 1, 2), F.lit("*")))

    joined = marked.join(found, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_mark") == F.col("mark")), "left")
    text = F.col("row")[text_col]
    new = F.when(F.col("found").isNotNull(), spans.replaced(text.cast("string"), F.col("found"), instead)).otherwise(text)
    return joined.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
