"""Sums of doubles that are exact and rounded once, whatever the partitioning, with DataFrame functions only.

A double is cut into four whole numbers of 24 bits and less, in places of 2^24, from the place of its leading bit down.
These are added as longs per leading place, on the map side first, so a hot group is a few rows per task. The few places
of a group are then carried into digits, and the leading ones make the double nearest to the sum. A sum past a double is
infinite; values that are not finite decide the sum as they would in any order; nulls are left out, no values give null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24
LOW, HIGH = -60, 52  # places that occur, with room for carries


#: 2^(12 k) for the half places from LOW on, from a table so that no rounding moves them.
POWERS = "array(" + ", ".join(f"{2.0 ** (12 * k)!r}D" for k in range(LOW, HIGH + 33)) + ")"


def cut(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with, for each column ``x``, ``x_place`` of the leading part and parts ``x_d0`` to ``x_d3``; null where it
    isn't finite. Each step is one projection for all columns; the units are powers of two.
    """
    # Very small values are lifted by 30 places, so that the units of their parts are ordinary doubles.
    small = lambda x: f"abs({x}) < {2.0**-600!r}D"
    out = df.withColumns({f"{x}_y": F.expr(f"if(abs({x}) < double('infinity'), if({small(x)}, {x} * {2.0**720!r}D, {x}), null)") for x in cols})
    # A logarithm that is a little off moves the leading part by one place at most, for which there is room.
    out = out.withColumns({f"{x}_p": F.expr(f"if({x}_y is null, null, coalesce(cast(floor(log2(abs({x}_y)) / {BITS}) as int), 0))") for x in cols})
    out = out.withColumns({k: v for x in cols for k, v in {f"{x}_place": F.expr(f"if({small(x)}, {x}_p - 30, {x}_p)"), f"{x}_u": F.expr(f"get({POWERS}, 2 * {x}_p - {LOW})")}.items()})
    for i in range(4):
        out = out.withColumns({f"{x}_d{i}": F.expr(f"cast({_rest(x, i)} / {x}_u * {2.0 ** (BITS * i)!r}D as bigint)") for x in cols})
    return out


def _rest(x: str, i: int) -> str:
    """What the first ``i`` parts leave of a value, exactly."""
    return f"{x}_y" if i == 0 else f"({_rest(x, i - 1)} - {x}_d{i - 1} * ({x}_u * {2.0 ** (-BITS * (i - 1))!r}D))"


def assembled(parts: str) -> Column:
    """The double nearest to the sum of ``parts``, a column of arrays of (place, d0, d1, d2, d3)."""
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    every = f"flatten(transform({parts}, p -> array({', '.join(f"named_struct('at', p.place - {i}, 'd', p.d{i})" for i in range(4))})))"
    # Sums of longs carry three places up.
    places = "sequence(array_min(transform(e, x -> x.at)), array_max(transform(e, x -> x.at)) + 4)"
    plain = f"transform({places}, b -> aggregate(filter(e, x -> x.at = b), 0L, (a, x) -> a + x.d))"

    def carried(digits: str) -> str:
        return f"aggregate({digits}, named_struct('over', 0L, 'out', cast(array() as array<bigint>)), (a, x) -> named_struct('over', shiftright(a.over + x, {BITS}), 'out', concat(a.out, array((a.over + x) & {(1 << BITS) - 1}L))))"

    # A sum below zero is carried as its opposite.
    signed = let(carried("g"), "c", f"if(c.over < 0, named_struct('sign', -1.0D, 'd', {carried('transform(g, y -> -y)')}.out), named_struct('sign', 1.0D, 'd', c.out))")
    top = "cast(size(s.d) - coalesce(nullif(array_position(reverse(transform(s.d, x -> x != 0)), true), 0) - 1, size(s.d)) as int)"  # digits up to the leading one
    at = lambda k: f"coalesce(get(s.d, t - {k}), 0L)"
    # Two exact doubles, the lower below half of the upper's last bit but for a trace of what follows: one rounding.
    head, tail = f"cast({at(1)} * {1 << BITS}L + {at(2)} as double)", f"cast({at(3)} * {1 << BITS}L + {at(4)} as double)"
    more = "exists(slice(s.d, 1, greatest(t - 4, 0)), x -> x != 0)"
    power = f"get({POWERS}, array_min(transform(e, x -> x.at)) + t - 4 - {LOW})"
    near = let(power, "u", f"s.sign * ({head} * {2.0 ** (2 * BITS)!r}D + ({tail} + if({more}, 0.5D, 0.0D))) * u * u")
    return F.expr(let(every, "e", let(plain, "g", let(signed, "s", let(top, "t", f"if(t <= 0, 0.0D, {near})")))))


PARTS = "array<struct<place:int,d0:bigint,d1:bigint,d2:bigint,d3:bigint>>"


def sums(df: DataFrame, keys: list[str], totals: dict[str, list[Column]], others: dict[str, tuple[Column, str]] | None = None, parts: bool = False) -> DataFrame:
    """(keys, totals, others): ``totals[name]`` is the exact sum of its columns over a group.

    ``others[name]`` is an aggregate and how its partial results meet: "sum", "max" or "min". With ``parts`` there is
    also ``name_parts`` of each total, by which ``again`` adds totals up exactly.
    """
    others = others or {}
    cols = {f"_t{k}_{i}": c.cast("double") for k, cs in enumerate(totals.values()) for i, c in enumerate(cs)}
    split = cut(df.withColumns(cols), list(cols))
    aggs = [F.sum(f"{c}_d{i}").alias(f"{c}_d{i}") for c in cols for i in range(4)]
    odd = [F.sum(F.when(F.col(c).isNotNull() & F.col(f"{c}_place").isNull(), F.col(c))).alias(f"{c}_odd") for c in cols]
    first = split.groupBy(*keys, *(f"{c}_place" for c in cols)).agg(*aggs, *odd, *(a.alias(n) for n, (a, _) in others.items()))
    out = []
    for k, cs in enumerate(totals.values()):
        own = [f"_t{k}_{i}" for i in range(len(cs))]
        held = F.flatten(F.array(*(F.collect_list(F.when(F.col(f"{c}_place").isNotNull(), F.struct(F.col(f"{c}_place").alias("place"), *(F.col(f"{c}_d{i}").alias(f"d{i}") for i in range(4))))) for c in own)))
        out += [held.alias(f"_t{k}"), reduce(lambda a, b: F.coalesce(a + b, a, b), [F.sum(f"{c}_odd") for c in own]).alias(f"_t{k}_odd")]
    met = first.groupBy(*keys).agg(*out, *(getattr(F, how)(n).alias(n) for n, (_, how) in others.items()))
    return finished(met, keys, totals, others, parts)


def finished(met: DataFrame, keys: list[str], totals, others, parts: bool) -> DataFrame:
    final = [F.when(F.col(f"_t{k}_odd").isNotNull(), F.col(f"_t{k}_odd")).when(F.size(f"_t{k}") > 0, assembled(f"_t{k}")).alias(n) for k, n in enumerate(totals)]
    # What is not finite goes along in place of its total.
    own = [F.struct(F.col(f"_t{k}").cast(PARTS).alias("parts"), F.col(f"_t{k}_odd").alias("odd")).alias(f"{n}_parts") for k, n in enumerate(totals)] if parts else []
    return met.select(*keys, *final, *own, *others)


def again(df: DataFrame, keys: list[str], total: str, others: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """Totals of totals that came with their parts: exact, whatever was added first."""
    others, p = others or {}, F.col(f"{total}_parts")
    rows = df.select(*keys, F.posexplode_outer(p["parts"]).alias("_no", "_p"))
    first = rows.groupBy(*keys, F.col("_p.place").alias("_place")).agg(*(F.sum(f"_p.d{i}").alias(f"d{i}") for i in range(4)))
    met = first.groupBy(*keys).agg(F.collect_list(F.when(F.col("_place").isNotNull(), F.struct(F.col("_place").alias("place"), *(f"d{i}" for i in range(4))))).alias("_t0"))
    plain = df.groupBy(*(F.col(k).alias(f"_k_{k}") for k in keys)).agg(F.sum(p["odd"]).alias("_t0_odd"), *(a.alias(n) for n, (a, _) in others.items()))
    joined = met.join(plain, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))) if keys else met.crossJoin(plain)
    return finished(joined, keys, [total], others, False)
