"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's rows are dealt into blocks of equal size. In the ideal mixture the sources that are not used up grow at
once, each in proportion to its exact weight; a block is released at the last whole slot before the ideal mixture begins
it and due at the first after it ends it. In each slot the released block that is due first is taken. Such a schedule
meets all dues, so no source is ever a whole block away from the ideal mixture, however long it is. When a source runs
out, the others go on with their weights among themselves. Every row gets one place; none is dropped or repeated.

Slots depend on each other from first to last, so they are found on the driver, from the sources' sizes and weights: it
holds a number per block and a name per source, rows never, and writes the slots as a table in the shared folder. All
numbers are whole, of any length: nothing is rounded. Blocks hold ``BLOCK_ROWS`` rows, and more, all alike, where there
would be more than ``MOST_BLOCKS``: the driver's work is bounded, the promise of less than a block is the same.

Defined results: a null source is a source of its own; a source without a positive weight has the least of the stated
ones; rows are ordered within a source by a hash of the id, rows of null and repeated ids by a hash of all their columns
(but maps), so equal rows are interchangeable; equal dues go to the greater weight, then to the lesser name; empty and
very long texts and null ids are ordinary; an empty table gives an empty table. All columns of the input are kept,
whatever their names, but that the three added ones replace any of the same names.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import write_lines

#: Sources whose names are broadcast; more are joined by a shuffle, with the same result.
MOST_SOURCES = 200
BLOCK_ROWS, MOST_BLOCKS = 16, 1 << 21
#: Rows that are ranked together; a source's ranks add up from such buckets, and these from runs of buckets.
BUCKET_ROWS, RUN = 512, 4096


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int]]:
    """(source, its block) of each slot: earliest due first among released blocks.

    Source i's block k begins when every source has had k / w_i of its weight, or all it has: at slot
    sum(min(w_j k / w_i, n_j)), a concave function of straight pieces, which is the least of them.
    """
    exact = [Fraction(w) for w in weights]
    unit = lcm(*(w.denominator for w in exact))
    w = [int(x * unit) for x in exact]
    ends: dict[Fraction, list[int]] = {}
    for i, n in enumerate(blocks):
        if n:
            ends.setdefault(Fraction(n, w[i]), []).append(i)
    last = sorted(ends)
    pieces = [(sum(w[i] for i, n in enumerate(blocks) if n), 0)]
    for v in last:
        pieces.append((pieces[-1][0] - sum(w[i] for i in ends[v]), pieces[-1][1] + sum(blocks[i] for i in ends[v])))
    near = [float(v * unit) for v in last]

    def bounds(i: int, k: int) -> tuple[int, int]:
        p = bisect_right(near, k / weights[i])  # a float may be one piece off: the least of the neighbours is right
        at = min(a * k + c * w[i] for a, c in pieces[max(p - 1, 0) : p + 2])
        return at // w[i], -(-at // w[i])

    waiting = [(0, i, 0) for i, n in enumerate(blocks) if n]
    ready: list[tuple[int, float, int, int, int]] = []
    for slot in range(sum(blocks)):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            release, due = bounds(i, k + 1)
            heapq.heappush(ready, (due, -weights[i], i, k, release))
        _, _, i, k, release = heapq.heappop(ready)
        yield i, k
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, (release, i, k + 1))


def period_of(slots: dict[str, int]) -> list[str]:
    """Whose block stands in each slot of one period of whole weights."""
    names = sorted(slots)
    return [names[i] for i, _ in schedule([slots[s] for s in names], [slots[s] for s in names])]


def slots_of(spark: SparkSession, blocks: list[int], weights: list[float], per: int = 1024) -> DataFrame:
    """The schedule as (source, first, slots): the slots of a source's blocks from ``first`` on, ``per`` of them a row."""
    found: list[list[int]] = [[] for _ in blocks]

    def lines() -> Iterator[str]:
        for t, (i, k) in enumerate(schedule(blocks, weights)):
            found[i].append(t)
            if len(found[i]) == per:
                yield json.dumps({"source": i, "first": k + 1 - per, "slots": found[i]})
                found[i] = []
        for i, rest in enumerate(found):
            if rest:
                yield json.dumps({"source": i, "first": blocks[i] - len(rest), "slots": rest})

    return spark.read.schema("source int, first long, slots array<long>").json(write_lines(spark, lines(), "slots"))


def natural(sizes: dict[str, int]) -> dict[str, float]:
    """Default weights: square roots of the sizes, which lift small sources."""
    return {s: n**0.5 for s, n in sizes.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_slot`` and ``mix_position``, by which to order."""
    spark = docs.sparkSession
    added = ["mix_block", "mix_slot", "mix_position"]
    src = docs.drop(*added)
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    sized = src.select(named.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["s"]: r["n"] for r in sized.orderBy("s").collect()}
    if not sizes:
        return src.select("*", *(F.lit(None).cast("long").alias(x) for x in added))
    block_rows = max(block_rows, -(-sum(sizes.values()) // MOST_BLOCKS))
    want = natural(sizes) if weights is None else {("=" + s): w for s, w in weights.items() if w > 0}
    least = min(want.values(), default=1)
    plan = slots_of(spark, [-(-n // block_rows) for n in sizes.values()], [want.get(s, least) for s in sizes])
    plan = plan.select(F.col("source").alias("ps"), F.posexplode("slots").alias("pos", "slot"), "first").select("ps", (F.col("first") + F.col("pos")).alias("pb"), "slot")
    lines = (json.dumps({"name": s, "no": i, "buckets": -(-n // BUCKET_ROWS)}) for i, (s, n) in enumerate(sizes.items()))
    sources = spark.read.schema("name string, no int, buckets long").json(write_lines(spark, lines, "sources"))
    sources = F.broadcast(sources) if len(sizes) <= MOST_SOURCES else sources
    # The row travels as one value, so that none of its columns meets one of these.
    whole = [F.col(f"`{f.name}`") for f in src.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = {"s": named, "h": F.xxhash64(F.lit(11), F.col(id_col)), "g": F.xxhash64(F.lit(12), *whole)}
    rows = src.select(F.struct("*").alias("row"), *(v.alias(k) for k, v in keys.items())).join(sources, F.col("s") == F.col("name")).withColumn("b", F.pmod(F.xxhash64("h", "g"), "buckets")).select("no", "b", "h", "g", "row")
    # Ranks within a source: counts of its runs, then of a run's buckets add up, and rows are numbered within a bucket.
    counts = src.select(*(v.alias(k) for k, v in keys.items())).join(sources, F.col("s") == F.col("name")).groupBy("no", F.pmod(F.xxhash64("h", "g"), "buckets").alias("b")).agg(F.count(F.lit(1)).alias("c")).withColumn("run", F.floor(F.col("b") / RUN))
    ahead = lambda what, w: F.coalesce(F.sum(what).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("no", "run").agg(F.sum("c").alias("c")).select("no", "run", ahead("c", Window.partitionBy("no").orderBy("run")).alias("before_run"))
    before = counts.join(runs, ["no", "run"]).withColumn("before", F.col("before_run") + ahead("c", Window.partitionBy("no", "run").orderBy("b")))
    # A bucket's few blocks get their slots before they meet its rows.
    covered = before.select("no", "b", "before", F.explode(F.sequence(F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("c") - 1) / block_rows))).alias("tb"))
    covered = covered.join(plan, (F.col("no") == F.col("ps")) & (F.col("tb") == F.col("pb"))).groupBy(F.col("no").alias("on"), F.col("b").alias("ob")).agg(F.first("before").alias("before"), F.sort_array(F.collect_list("slot")).alias("slots"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("no", "b").orderBy("h", "g")))
    rank = F.col("before") + F.col("r") - 1
    ranked = numbered.join(covered, (F.col("no") == F.col("on")) & (F.col("b") == F.col("ob"))).select("row", F.floor(rank / block_rows).alias("mix_block"), F.pmod(rank, F.lit(block_rows)).alias("inside"), "before", "slots")
    placed = ranked.withColumn("mix_slot", F.get("slots", (F.col("mix_block") - F.floor(F.col("before") / block_rows)).cast("int")))
    return placed.select(*(F.col("row")[c].alias(c) for c in src.columns), "mix_block", "mix_slot", (F.col("mix_slot") * block_rows + F.col("inside")).alias("mix_position"))
