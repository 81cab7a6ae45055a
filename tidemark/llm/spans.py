"""Places of regular expressions in texts, with DataFrame functions only.

Running lengths are taken in blocks of ``STEP`` on three levels, so that a text of a great many matches takes time in
proportion to them, and pieces of a text are cut from blocks of ``PIECE`` code points, not by a walk from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,no:int,kind:string,end:int>>"
STEP, LEVELS, PIECE = 64, 3, 4096


def none() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is found once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, begin: Column, add: Callable[[Column, Column], Column], levels: int = LEVELS) -> Column:
    """What ``add`` makes of ``begin`` and all values before each place of an array of numbers; ``add`` is associative."""
    if levels == 1:
        start = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, start, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def of_blocks(blocks: Column) -> Column:
        whole = F.transform(blocks, lambda b: F.aggregate(b, F.lit(None).cast("int"), lambda acc, x: F.when(acc.isNull(), x).otherwise(add(acc, x))))
        return F.flatten(F.zip_with(blocks, running(whole, begin, add, levels - 1), lambda b, at: running(b, at, add, 1)))

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / STEP).cast("int")), lambda b: F.slice(v, b * STEP + 1, STEP))

    return let(values, lambda v: F.when(F.size(v) > 0, let(cut(v), of_blocks)).otherwise(F.array().cast("array<int>")))


def placed(text: Column, pattern: str, found: Column, kind: str, no: int, keep=None) -> Column:
    """Spans in code points of ``found``, the matches of ``pattern``; ``keep(match, i)`` drops those that fail.

    What stands between the matches comes from splitting at them: running lengths give the places. The arrays are as
    long as there are matches; texts without any are not split.
    """

    def of_pairs(pairs: Column) -> Column:
        ahead = running(F.transform(pairs, lambda p: p["gap"] + p["n"]), F.lit(0), lambda a, b: a + b)
        return F.zip_with(pairs, ahead, lambda p, at: F.struct((at + p["gap"]).alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), (at + p["gap"] + p["n"]).alias("end")))

    between = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("n")))
    spans = let(pairs, of_pairs)
    if keep is not None:
        kept = F.transform(found, keep)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), kept.alias("k")), lambda z: z["k"]), lambda z: z["s"])
    return F.when(F.size(found) > 0, spans).otherwise(none())


def blocks_of(text: Column) -> Column:
    """``text`` in pieces of ``PIECE`` code points (empty: one empty piece)."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def piece(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points from ``begin`` to ``end`` of a text in blocks."""
    first = F.floor(begin / PIECE).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
    return F.when(end > begin, F.substring(near, begin - first * PIECE + 1, end - begin)).otherwise("")


def replaced(text: Column, spans: Column, instead: Callable[[Column, Column], Column]) -> Column:
    """``text`` with ``instead(span, its text)`` for each span; of spans that overlap, each stands for what is left of it.

    ``spans`` are sorted by their starts. A span inside those before it is dropped.
    """

    def written(blocks: Column, own: Column) -> Column:
        done = running(F.transform(own, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        left = F.filter(F.zip_with(own, done, lambda s, at: F.struct(s.alias("s"), at.alias("at"))), lambda x: x["s"]["end"] > x["at"])

        def part(x: Column) -> Column:
            start = F.greatest(x["s"]["start"], x["at"])
            return F.concat(piece(blocks, x["at"], start), instead(x["s"], piece(blocks, start, x["s"]["end"])))

        rest = F.array_max(F.transform(own, lambda s: s["end"]))
        return F.concat(F.array_join(F.transform(left, part), ""), piece(blocks, rest, F.length(text)))

    return F.when(F.size(spans) > 0, let(blocks_of(text), lambda blocks: let(spans, lambda own: written(blocks, own)))).otherwise(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then by the kinds' order, with commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
