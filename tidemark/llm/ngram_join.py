"""N-gram Jaccard join: links documents whose word-shingle sets overlap enough, by a size-aware heavy-light join.

Documents with equal sets form a class; only one document of a class is joined. Classes are split by set size at a
boundary that a cost estimate picks:

* light sets: for each pair of sizes (s, t) the least overlap o that makes a link is fixed, so every subset of o
  shingles is enumerated as a key, and sets of sizes s and t that meet at a key are linked for certain;
* heavy sets: shingles are ordered rare first by a fixed-size count sketch, and each set enters the inverted lists of
  its first shingles only (prefix filter). The lists are scanned twice. First every member is compared with its list's
  leader, which joins large groups of near copies by a star instead of all pairs. Then, in lists that still hold
  several components, members outside the list's largest component are compared with the members of others, under the
  size, prefix and position filters. Every comparison is exact on the whole sets of 64-bit shingle hashes.

No link between components is lost: a pair that is not compared lies within one component already. The sketch only
orders shingles, whatever it counts the result is the same.

Defined results: null and empty texts have size 0 and link with nothing; fewer than ``width`` words make one shingle of
all words; rows that share an id are one document with the links of all of them, each row with the size of its own set; a
null id links with nothing and has a null component. Texts may be of any length: a task holds the sets of some two
million characters, and of the longest text. Equal sizes and frequencies are ordered by hash and id. An empty table gives
an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, components, materialise, release

WIDTH = 5
#: Light sets have so many shingles at most, whatever the cost: subsets of larger ones grow too fast.
LIGHT_MOST = 24
#: What reading one entry of an inverted list costs, in enumerated subsets.
LIST_COST = 4.0
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 14
#: Lists that are longer than this, by the sketch, are dealt over several tasks.
SALT_ROWS = 50_000
#: Ids that are broadcast to pick documents; more of them are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Members that are compared with one copy of a leader's set.
GROUP = 256
CACHE_WORDS = 500_000

_fold = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_mult = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def least_overlap(s: int, t: int) -> int:
    """100 i >= 75 (s + t - i)."""
    return -(-3 * (s + t) // 7)


def probe(n: int) -> int:
    """Shingles of a set of n by which it can meet any partner: the first of the common order."""
    return n - -(-3 * n // 4) + 1


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, words: Hashes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending, unsigned."""
    ws = text.encode("utf-8", "surrogatepass").translate(_fold).split()
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    if len(words) > CACHE_WORDS:
        words.clear()
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    k = min(width, len(ws))
    with np.errstate(over="ignore"):
        x = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            x = x * _mult[0] + h[i : len(h) - k + 1 + i] * _mult[i % 8]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return np.unique(x)


def sketch(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Counts of documents per bucket of shingle hashes: a vector per task, summed in two steps of bounded fan-in."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, total = Hashes(), np.zeros(size, dtype=np.int64)
        for pdf in batches:
            for a, b in chunks([t or "" for t in pdf["text"]]):
                x = [shingles(t or "", words, width) for t in pdf["text"].iloc[a:b]]
                total += np.bincount((np.concatenate(x) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        task = TaskContext.get().partitionId()
        for k in range(0, size, SKETCH_BLOCK):
            yield pd.DataFrame({"part": [task // 512], "block": [k // SKETCH_BLOCK], "counts": [total[k : k + SKETCH_BLOCK].astype("<u4").tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype="<u4").astype(np.int64) for x in pdf["counts"])
        return pdf.iloc[:1].assign(part=0, counts=[np.minimum(total, 2**32 - 1).astype("<u4").tobytes()])

    kind = "part int, block int, counts binary"
    merged = docs.select("text").mapInPandas(count, kind).groupBy("part", "block").applyInPandas(add, kind).groupBy("block").applyInPandas(add, kind)
    out = np.zeros(size, dtype=np.uint32)
    for r in merged.collect():  # 4 MB, whatever the table
        out[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] = np.frombuffer(r["counts"], dtype="<u4")
    return out


def signatures(docs: DataFrame, counts, width: int = WIDTH) -> DataFrame:
    """(doc_id, n, class, tokens, loads): the first shingles of each set in the common order, and their sketch counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, load = Hashes(), counts.value
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts):
                n, key, tokens, hot = [], [], [], []
                for t in texts[a:b]:
                    x = shingles(t, words, width)
                    c = load[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    first = np.lexsort((x, c))[: len(x) if len(x) <= LIGHT_MOST else probe(len(x))]
                    n.append(len(x))
                    key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    tokens.append(x[first].view(np.int64))
                    hot.append((c[first] // SALT_ROWS + 1).astype(np.int32) if len(x) and c[first].max() >= SALT_ROWS else None)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[a:b].array, "n": np.array(n, dtype=np.int32), "class": key, "tokens": tokens, "salts": hot})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, class binary, tokens array<long>, salts array<int>")


def boundary(sizes: dict[int, int]) -> int:
    """The largest size of light sets, of least estimated cost. ``sizes``: classes by set size."""

    def light(n: int, top: int) -> float:
        return sum(comb(n, least_overlap(n, t)) for t in range(-(-3 * n // 4), min(top, 4 * n // 3) + 1))

    def cost(top: int) -> float:
        return sum(c * (light(n, top) if n <= top else 0) + c * (LIST_COST * probe(n) if n >= 0.75 * (top + 1) else 0) for n, c in sizes.items() if n)

    return min(range(LIGHT_MOST + 1), key=lambda top: (cost(top), top))


def light_edges(reps: DataFrame, top: int) -> DataFrame:
    """(a, b) between sets of at most ``top`` shingles: stars within each key of an enumerated subset."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rep, n, tokens in zip(pdf["rep"], pdf["n"], pdf["tokens"], strict=True):
                x = np.sort(np.asarray(tokens, dtype=np.int64))
                for t in range(-(-3 * n // 4), min(top, 4 * n // 3) + 1):
                    pair = bytes((min(n, t), max(n, t)))
                    out += [(hashlib.blake2b(pair + np.array(c).tobytes(), digest_size=16).digest(), rep, n, n != t) for c in combinations(x.tolist(), least_overlap(n, t))]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["key", "rep", "n", "cross"])
                    out = []
            yield pd.DataFrame(out, columns=["key", "rep", "n", "cross"])

    kind = reps.schema["rep"].dataType.simpleString()
    keys = reps.where((F.col("n") <= top) & (F.col("n") > 0)).select("rep", "n", "tokens").mapInPandas(run, f"key binary, rep {kind}, n int, cross boolean")
    met = keys.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("cross").alias("cross")).where("a < z and (not cross or lo < hi)")
    return keys.join(met.select("key", "a"), "key").where("a < rep").select("a", F.col("rep").alias("b")).distinct()


def packed_set(x: np.ndarray) -> bytes:
    """Ascending hashes as their distances, of seven bytes each; the eighth bytes of those that need one stand before."""
    gaps = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    wide = np.flatnonzero(gaps[:, 7])
    return np.uint32(len(wide)).tobytes() + wide.astype("<u4").tobytes() + gaps[wide, 7].tobytes() + gaps[:, :7].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    body = np.frombuffer(data, np.uint8, offset=4 + 5 * n).reshape(-1, 7)
    gaps = np.zeros((len(body), 8), dtype=np.uint8)
    gaps[:, :7] = body
    gaps[np.frombuffer(data, "<u4", n, 4), 7] = np.frombuffer(data, np.uint8, n, 4 + 4 * n)
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def verify(docs: DataFrame, pairs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Those of ``pairs(a, b)`` that are links, by their whole sets; written.

    Pairs of one ``a`` form groups of ``GROUP`` members at most, each with its own copy of a's set: one shuffle of sets,
    read in order, one group after the other, with a's set in hand.
    """
    pairs = materialise(pairs, "pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("salts"))
    members = pairs.join(salts, "a").select(F.col("b").alias("rep"), F.col("a").alias("group"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.lit(False).alias("hub"))
    hubs = salts.select(F.col("a").alias("rep"), F.col("a").alias("group"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("hub"))
    need = materialise(members.union(hubs), "need")
    n = need.count()
    chosen = docs.join(F.broadcast(need) if n <= BROADCAST_IDS else need, docs["doc_id"] == need["rep"]).select("group", "salt", "hub", "rep", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Hashes()
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            for a, b in chunks(texts):
                yield pdf.iloc[a:b].drop(columns="text").assign(set=[packed_set(shingles(t, words, width)) for t in texts[a:b]])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for pdf in batches:
            found = []
            for group, salt, hub, rep, data in zip(pdf["group"], pdf["salt"], pdf["hub"], pdf["rep"], pdf["set"], strict=True):
                if (group, salt) != at:
                    at, own = (group, salt), None
                x = unpacked_set(data)
                if hub:
                    own = x
                    continue
                i = len(np.intersect1d(x, own, assume_unique=True))
                if 100 * i >= 75 * (len(x) + len(own) - i):
                    found.append((group, rep))
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64" if kind == "bigint" else object)

    sets = chosen.mapInPandas(pack, f"group {kind}, salt int, hub boolean, rep {kind}, set binary")
    out = materialise(sets.repartition("group", "salt").sortWithinPartitions("group", "salt", F.desc("hub")).mapInPandas(compare, f"a {kind}, b {kind}"), "links")
    release(pairs)
    release(need)
    return out


def possible(top: int) -> str:
    """Whether an entry pair (a_n, a_pos), (b_n, b_pos) may be a link's first common shingle, of sets not both light.

    The sizes must fit, what is left from that place on must reach the least overlap, and the smaller set meets the
    larger within its shorter prefix.
    """
    return (
        f"least(a_n, b_n) * 4 >= greatest(a_n, b_n) * 3 and greatest(a_n, b_n) > {top} and 7 * least(a_n - a_pos, b_n - b_pos) >= 3 * (a_n + b_n)"
        " and if(a_n <= b_n, a_pos, b_pos) <= least(a_n, b_n) - (6 * least(a_n, b_n) + 6) div 7"
    )


def heavy_edges(docs: DataFrame, reps: DataFrame, top: int, known: DataFrame, width: int = WIDTH) -> DataFrame:
    """(a, b) between sets of which one at least has more than ``top`` shingles. ``known``: edges found before."""
    # One entry per class and leading shingle. ``np`` packs the set's size and the shingle's place in it.
    lead = F.slice("tokens", 1, F.col("n") - F.floor((3 * F.col("n") + 3) / 4).cast("int") + 1)
    large = reps.where(F.col("n") >= -(-3 * (top + 1) // 4))
    packed = (F.col("n").cast("long") * 2**32 + F.col("pos")).alias("np")
    plain = large.where("salts is null").select("rep", "n", F.posexplode(lead).alias("pos", "key")).select("key", F.lit(0).alias("salt"), "rep", packed)
    hot = large.where("salts is not null").select("rep", "n", "salts", F.posexplode(lead).alias("pos", "key")).withColumn("parts", F.element_at("salts", F.col("pos") + 1))
    # A list's load decides whether it is salted, the same for all its entries; it has one leader per salt.
    salted = hot.select("key", F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("rep"), "parts")).otherwise(0).cast("int").alias("salt"), "rep", packed)
    w = Window.partitionBy("key", "salt")
    lists = plain.union(salted).withColumns({"m": F.count(F.lit(1)).over(w), "l_rep": F.min("rep").over(w)})
    lists = lists.withColumn("l_np", F.min(F.when(F.col("rep") == F.col("l_rep"), F.col("np"))).over(w)).where("m > 1 or salt > 0").withColumn("more", F.expr("m > 2 or salt > 0")).drop("m")
    lists = materialise(lists, "lists")
    unpack = {"n": F.shiftright("np", 32), "pos": F.col("np").bitwiseAND(2**32 - 1), "l_n": F.shiftright("l_np", 32), "l_pos": F.col("l_np").bitwiseAND(2**32 - 1)}
    members = lists.withColumns(unpack)
    stars = members.select(F.col("l_rep").alias("a"), F.col("l_n").alias("a_n"), F.col("l_pos").alias("a_pos"), F.col("rep").alias("b"), F.col("n").alias("b_n"), F.col("pos").alias("b_pos")).where("a <> b")
    heads = members.where("salt > 0").select("key", "l_rep", "l_n", "l_pos").distinct()
    chief = heads.groupBy("key").agg(F.min(F.struct("l_rep", "l_n", "l_pos")).alias("c"))
    over = heads.join(chief, "key").select(F.col("c.l_rep").alias("a"), F.col("c.l_n").alias("a_n"), F.col("c.l_pos").alias("a_pos"), F.col("l_rep").alias("b"), F.col("l_n").alias("b_n"), F.col("l_pos").alias("b_pos")).where("a <> b")
    stars = stars.union(over).where(possible(top))
    first = verify(docs, stars.select("a", "b").distinct(), width)
    comp = materialise(components(first.union(known)), "comp")
    # Lists that hold several components: members outside the list's largest one against all of other components. In a
    # list of two nothing is left to compare, nor with a list's leader.
    held = members.where("more").select("key", "rep", "n", "pos", F.when(F.col("salt") == 0, F.col("l_rep")).alias("l_rep")).join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    held = materialise(held, "held")
    share = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    mixed = share.groupBy("key").agg(F.max(F.struct("m", "comp")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key", F.col("main.comp").alias("main"))
    mixed = materialise(held.join(mixed, "key"), "mixed")
    a = mixed.where("comp <> main").select("key", *(F.col(c).alias(f"a_{c}") for c in ("rep", "n", "pos", "comp", "main", "l_rep")))
    b = mixed.select("key", *(F.col(c).alias(f"b_{c}") for c in ("rep", "n", "pos", "comp")))
    # Both outside the main component: once, by their ids. The smaller set meets the larger within its shorter prefix.
    pairs = a.join(b, "key").where("a_comp <> b_comp and (b_comp = a_main or a_rep < b_rep) and not a_rep <=> a_l_rep and not b_rep <=> a_l_rep").where(possible(top))
    second = verify(docs, pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct(), width)
    for t in (lists, comp, held, mixed):
        release(t)
    return first.union(second)


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``docs``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    repeated = src.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").limit(1).count() > 0
    out = of_repeated_ids(src, width) if repeated else of_ids(src, width)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id")


def of_repeated_ids(src: DataFrame, width: int) -> DataFrame:
    """``of_ids`` of the different (id, text), numbered; then the classes that share an id are one."""
    rows = src.where("doc_id is not null").groupBy("doc_id", F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("m"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    own = of_ids(rows.select(F.col("row").alias("doc_id"), "text"), width).select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("part"))
    own = materialise(rows.select("row", "doc_id", "m").join(own, "row"), "parts")
    first = own.groupBy("doc_id").agg(F.min("part").alias("first"))
    joins = own.select("doc_id", "part").distinct().join(first, "doc_id").select(F.col("first").alias("a"), F.col("part").alias("b"))
    named = own.join(components(joins.where("a <> b")), F.col("part") == F.col("node"), "left").withColumn("whole", F.coalesce("component", "part"))
    named = materialise(named.select("doc_id", "n_shingles", "m", "whole"), "whole")
    least = materialise(named.groupBy("whole").agg(F.min("doc_id").alias("component_id")), "least")
    out = named.join(least, "whole").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m")))).select("doc_id", "n_shingles", "component_id")
    nameless = of_ids(src.where("doc_id is null"), width)
    return out.union(nameless.select("doc_id", "n_shingles", "component_id"))


def of_ids(src: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) of rows whose ids are different or null."""
    spark = src.sparkSession
    load = sketch(src, width)
    counts = spark.sparkContext.broadcast(load)  # 4 MB
    signed = materialise(signatures(src, counts, width), "signatures")
    # Equal sets: minima meet before the shuffle, so that a large group of copies is a few rows. The first shingles stay
    # where they are: copies are taken out by their ids.
    in_class = F.col("class").isNotNull() & F.col("doc_id").isNotNull()
    members = signed.select("doc_id", "n", "class")
    smallest = materialise(members.where(in_class).groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("m")), "smallest")
    copies = materialise(members.where(in_class).join(smallest.where("m > 1").select("class", "rep"), "class").where("doc_id <> rep").select("class", F.col("doc_id").alias("copy")), "copies")
    many = copies.count() > BROADCAST_IDS
    classes = signed.where(in_class).join(copies if many else F.broadcast(copies), (signed["class"] == copies["class"]) & (F.col("doc_id") == F.col("copy")), "left_anti")
    classes = classes.select(F.col("doc_id").alias("rep"), "class", "n", "tokens", "salts")
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= 2 * LIGHT_MOST).groupBy("n").count().collect()}
    top = boundary(sizes)
    light = materialise(light_edges(classes, top), "light")
    heavy = heavy_edges(src, classes, top, light, width)
    comp = components(light.union(heavy))
    final = smallest.select("class", "rep").join(comp, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("component", "rep").alias("component_id"))
    out = members.where(in_class).join(final, "class", "left").select("doc_id", "n", "component_id").union(members.where(~in_class).select("doc_id", "n", F.col("doc_id")))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
