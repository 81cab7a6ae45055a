"""SpotSigs fingerprints, with DataFrame functions only.

Anchors are the words that most rows of the table hold. At each anchor the chain of the next ``CHAIN`` words that are no
anchors is a spot signature; the set of a text's signature hashes is its fingerprint. Fingerprints are compared by
Jaccard likeness, partitioned by set length, so that pairs whose lengths alone exclude the threshold never meet.

Defined results: a text without anchors takes the chains at all its words; a text without words has the empty
fingerprint. The likeness of two empty fingerprints is 1, of an empty and another 0. Equal texts have equal
fingerprints. A null text is the empty text. Anchors of equal frequency are taken by the word. Texts may be of any
length. A single row is its own successor; an empty table gives an empty table. Columns besides id and text are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import components, materialise, release, write_lines

ANCHORS, CHAIN = 24, 3
#: Rows that are put in order together, to find each row's successor; the most such buckets (beyond, they grow).
BUCKET, MOST_BUCKETS = 2_048, 65_536
#: Counts by which hashes are ordered, rare ones first.
ORDERS = 1 << 14
MARK = "\u0001"


def words(text: Column) -> Column:
    """Lower-case letters and digits, other characters as single spaces."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}]+", " ")


def anchors(docs: DataFrame, n: int = ANCHORS) -> list[str]:
    """The words that most rows hold: counts over all rows, ``n`` of them to the driver."""
    held = docs.select(F.explode(F.array_distinct(F.split(words(F.col("text")), " "))).alias("word")).where("word <> ''")
    return [r["word"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()]


def fingerprint(text: Column, common: list[str]) -> Column:
    """Ascending distinct hashes of the spot signatures."""
    spaced = F.concat(F.lit(" "), F.trim(words(text)), F.lit(" "))
    marked = F.regexp_replace(spaced, " (?:" + "|".join(sorted(common)) + ")(?= )", MARK) if common else spaced
    # An anchor is now a mark at the end of the word before it.
    tokens = F.split(F.rtrim(marked), " ")

    def signatures(tokens: Column) -> Column:
        """``tokens`` is a lambda's variable, so that splitting the text is done once and not for each word."""
        plain = ~F.exists(tokens, lambda t: F.endswith(t, F.lit(MARK)))

        def at(flag: Column) -> Column:
            def chain(word: Column, i: Column) -> Column:
                return F.when(flag | F.endswith(word, F.lit(MARK)), F.translate(F.array_join(F.slice(tokens, i + 2, CHAIN), " "), MARK, ""))

            found = F.filter(F.transform(tokens, chain), lambda s: s.isNotNull() & (s != ""))
            return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.xxhash64(s))))

        return F.element_at(F.transform(F.array(plain), at), 1)

    return F.element_at(F.transform(F.array(F.split(F.rtrim(marked), " ")), signatures), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union).cast("double")


def shown(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ",")


def near_classes(docs: DataFrame, least: float = 0.75, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, class_id) of every row: the least id that links of likeness ``least`` reach, its own included.

    Rows of equal fingerprints are one. A fingerprint of n hashes, rare ones first, meets others through its first
    n - ceil(least n) + 1 hashes, in lists of its own partition of lengths and of the next shorter one. In each list
    every member is compared with the list's leader; in lists that then hold several classes, members outside the
    largest one are compared with those of others. Null ids and empty fingerprints have no links; a null id has no class.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hashed = src.select("id", fingerprint(F.col("text"), anchors(src)).alias("fp")).withColumns({"k": F.xxhash64("fp"), "l": F.xxhash64(F.lit(1), "fp")})
    rows = materialise(hashed, "fingerprints")
    able = F.col("id").isNotNull() & (F.size("fp") > 0)
    reps = materialise(rows.where(able).groupBy("k", "l").agg(F.first("fp").alias("fp")).withColumn("node", F.monotonically_increasing_id()), "representatives")
    # How many fingerprints hold each hash, by a table of fixed size: it only orders them.
    counted = reps.select(F.explode("fp").alias("sig")).groupBy(F.pmod("sig", F.lit(ORDERS)).cast("int").alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()
    load = [0] * ORDERS
    for r in counted:
        load[r["at"]] = r["n"]
    loads = F.from_json(F.lit(json.dumps(load)), "array<bigint>")
    ordered = F.array_sort(F.transform("fp", lambda s: F.struct(F.get(loads, F.pmod(s, F.lit(ORDERS)).cast("int")).alias("load"), s.alias("sig"))))
    n = F.size("fp")
    part = F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / least)) + 1e-9)
    first = reps.select("node", n.alias("n"), part.alias("part"), F.explode(F.slice(ordered, 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("x"))
    entries = materialise(first.select("x.sig", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "node", "n"), "entries")

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that are alike enough; written."""
        x, y = (reps.select(F.col("node").alias(c), F.col("fp").alias(f"{c}_fp")) for c in "ab")
        both = F.size(F.array_intersect("a_fp", "b_fp"))
        near = both >= least * (F.size("a_fp") + F.size("b_fp") - both) - 1e-9
        return materialise(pairs.distinct().join(x, "a").join(y, "b").where(near).select("a", "b"), "links")

    fits = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    # A hot list is a row per task until its leader is known.
    led = entries.groupBy("sig", "part").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").select("sig", "part", F.col("lead.node").alias("a"), F.col("lead.n").alias("m"))
    stars = linked(entries.join(led, ["sig", "part"]).where((F.col("node") != F.col("a")) & fits).select("a", F.col("node").alias("b")))
    comp = materialise(components(stars), "comp")
    held = entries.join(led.select("sig", "part"), ["sig", "part"], "left_semi").join(comp, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    held = materialise(held, "held")
    share = held.groupBy("sig", "part", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("sig", "part").agg(F.max(F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("parts"))
    mixed = materialise(held.join(share.where("parts > 1").select("sig", "part", F.col("main.comp").alias("main")), ["sig", "part"]), "mixed")
    out = mixed.where("comp <> main").select("sig", "part", F.col("node").alias("a"), F.col("n").alias("m"), F.col("comp").alias("ac"), F.col("main").alias("am"))
    rest = out.join(mixed.select("sig", "part", "node", "n", "comp"), ["sig", "part"]).where(F.expr("ac <> comp and (comp = am or a < node)") & fits).select("a", F.col("node").alias("b"))
    whole = components(stars.union(linked(rest)))
    named = rows.where(able).join(reps.select("k", "l", "node"), ["k", "l"]).join(whole, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    named = materialise(named, "named")
    smallest = named.groupBy("component").agg(F.min("id").alias("class_id"))
    found = named.join(smallest, "component").select("id", "class_id").union(rows.where(~able).select("id", F.col("id")))
    for t in (entries, comp, held, mixed):
        release(t)
    return found.select(F.col("id").alias(id_col), "class_id")


def ranges(keys: DataFrame, bucket: int = BUCKET) -> tuple[list[Row], list[Row], int]:
    """The least and the greatest key of ranges of ``keys(id, h, m)``, in order, nulls first; the greatest ``m``.

    The ranges are dealt from a sample of the keys, so sparse, dense and repeated ids make no difference; none is empty.
    Two keys of each of ``MOST_BUCKETS`` ranges at most come to the driver.
    """
    parts = max(1, min(MOST_BUCKETS, -(-keys.count() // bucket)))
    dealt = keys.repartitionByRange(parts, F.asc_nulls_first("id"), "h").groupBy(F.spark_partition_id().alias("part"))
    key = F.struct("id", "h")
    found = dealt.agg(F.min(key).alias("low"), F.max(key).alias("top"), F.max("m").alias("m")).orderBy("part").collect()
    return [r["low"] for r in found], [r["top"] for r in found], max((r["m"] for r in found), default=1)


def range_of(key: Column, low: list[Row], kind: str) -> Column:
    """The last range whose least key is not above ``key``: a search by halves, no join."""
    bounds = F.from_json(F.lit(json.dumps([{"id": r["id"], "h": r["h"]} for r in low], default=str)), f"array<struct<id:{kind},h:bigint>>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(low).bit_length())))

    def half(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"] + 1) / 2).cast("int")
        up = key >= F.get(bounds, mid)
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.struct(F.when(up, mid).otherwise(at["lo"]).alias("lo"), F.when(up, at["hi"]).otherwise(mid - 1).alias("hi")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(low) - 1).alias("hi")), half, lambda at: at["lo"])


def edited(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row, in descending order of ids.

    The edited text ends with the beginning of the next row's text instead of its own last third. Rows are put in order
    within ranges of ids; each range gets a copy of the next range's first row, so that one shuffle of the texts is
    enough. Null ids come last; equal ids are ordered by a hash of their texts. Equal rows are one in that order: all
    but the last of them are followed by an equal row.
    """
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark, kind = docs.sparkSession, src.schema["id"].dataType.simpleString()
    common = anchors(src)
    src = src.withColumn("h", F.xxhash64("text"))
    keys = src.groupBy("id", "h").agg(F.count(F.lit(1)).alias("m"))
    low, top, most = ranges(keys, bucket)
    rows = src.withColumn("bucket", range_of(F.struct("id", "h"), low, kind))
    if most > 1:
        again = keys.where("m > 1").select(F.col("id").alias("kid"), F.col("h").alias("kh"), "m")
        rows = rows.dropDuplicates(["id", "h"]).join(again, F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh")), "left").drop("kid", "kh")
    # The greatest key of each range names the successor of the next range's last row.
    lines = (json.dumps({"kid": r["id"], "kh": r["h"], "after": (i + 1) % len(top)}, default=str) for i, r in enumerate(top))
    heads = F.broadcast(spark.read.schema(f"kid {kind}, kh long, after int").json(write_lines(spark, lines, "heads")))
    guests = src.join(heads, F.col("id").eqNullSafe(F.col("kid")) & (F.col("h") == F.col("kh"))).groupBy("after").agg(F.min(F.struct("id", "h", "text")).alias("g")).select("g.*", F.col("after").alias("bucket"))
    every = rows.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)), allowMissingColumns=True)
    every = every.repartition("bucket").withColumn("fp", fingerprint(F.col("text"), common))
    w = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), F.desc("h"))
    ahead = every.withColumns({"next_text": F.lead("text").over(w), "next_fp": F.lead("fp").over(w)}).where("not guest")
    if most > 1:
        # The first of a row and its copies is followed by the next row, the others by an equal one.
        follow = F.transform(F.sequence(F.lit(1), F.coalesce("m", F.lit(1))), lambda k: F.when(k == 1, F.struct("next_text", "next_fp")).otherwise(F.struct(F.col("text").alias("next_text"), F.col("fp").alias("next_fp"))))
        ahead = ahead.select("id", "text", "fp", F.explode(follow).alias("f")).select("id", "text", "fp", "f.*")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    out = ahead.withColumn("n_chars", n.cast("long")).withColumn("edited", changed).drop("text", "next_text").withColumn("edited_fp", fingerprint(F.col("edited"), common))
    return out.select(
        F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
