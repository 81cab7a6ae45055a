"""What a statement is expected to cost, by its plan, and whether a sample tells the same as the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_cost(df: DataFrame) -> int:
    """Bytes that the nodes of the optimised plan are expected to give, in all: it orders statements, it is no time."""

    def size(node) -> int:
        kids = node.children()
        return int(str(node.stats().sizeInBytes())) + sum(size(kids.apply(i)) for i in range(kids.size()))

    return size(df._jdf.queryExecution().optimizedPlan())


def by_cost(statements: dict[str, DataFrame]) -> list[tuple[str, int]]:
    return sorted(((name, plan_cost(df)) for name, df in statements.items()), key=lambda x: (x[1], x[0]))


def leaders(df: DataFrame, group: str, fraction: float, seed: int = 17, most: int = 5) -> dict[str, object]:
    """Whether a sample's most frequent group is the whole's, and how many of the first ``most`` they share."""

    def first(rows: DataFrame) -> list:
        return [r[group] for r in rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group).limit(most).collect()]

    whole, some = first(df), first(df.sample(fraction=fraction, seed=seed))
    return {"same_leader": whole[:1] == some[:1], "overlap": len(set(whole) & set(some)) / max(1, len(whole))}
