"""Foreign keys by a learned model of column pairs: names, types, counts and shared values, in two stages of trees.

Facts of columns come from one pass over each table: counts, and a sample of different values by hash, the same part of
the hashes for every column, so that two samples meet as the whole columns do. Pairs are as many as columns times keys:
they are a matter of the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import name_tokens, singular
from .see import key_stem

#: Different values kept of each column, about; all columns are cut at the same hash.
SAMPLE = 512
FEATURES = ["same_stem", "stem_in_table", "trigrams", "same_words", "family", "ratio", "found", "covered", "last", "unique", "order"]
CONTEXT = ["score", "place", "lead", "rivals"]


@dataclass(frozen=True)
class Fact:
    table: str
    column: str
    kind: str
    rows: int
    distinct: int
    place: int
    values: frozenset = field(default=frozenset(), repr=False)
    key: bool = False


def facts(tables: dict[str, DataFrame], keys: dict[str, str]) -> list[Fact]:
    """Counts of each whole-number and text column, and its values whose hash is among the table's least."""
    out = []
    for t, df in tables.items():
        cols = [f for f in df.schema.fields if f.dataType.simpleString() in ("int", "bigint", "string")]
        counted = df.agg(F.count(F.lit(1)).alias("n"), *(F.count_distinct(f.name).alias(f"d{i}") for i, f in enumerate(cols))).first()
        # One part of all hashes for all columns of all tables: a pair's samples hold the same values if both have them.
        values = reduce(DataFrame.union, (df.select(F.lit(i).alias("i"), F.xxhash64(F.col(f.name).cast("string")).alias("h")).where(F.col(f.name).isNotNull()) for i, f in enumerate(cols))).distinct()
        rate = min(1.0, SAMPLE / max(1, max(counted[f"d{i}"] for i in range(len(cols)))))
        part = 1 << max(0, round(-_log2(rate)))
        kept = values.where(F.pmod("h", F.lit(part)) == 0).collect()
        for i, f in enumerate(cols):
            out.append(Fact(t, f.name, f.dataType.simpleString(), counted["n"], counted[f"d{i}"], i, frozenset([part, *(("v", r["h"]) for r in kept if r["i"] == i)]), keys.get(t) == f.name))
    return out


def _log2(x: float) -> float:
    import math

    return math.log2(x)


def _grams(name: str) -> set[str]:
    text = f"  {' '.join(name_tokens(name))} "
    return {text[i : i + 3] for i in range(len(text) - 2)}


def shared(child: Fact, parent: Fact) -> tuple[float, float]:
    """Shares of the child's values that the parent holds, and of the parent's that the child holds, by the coarser sample."""
    part = max([1, *(x for x in (*child.values, *parent.values) if isinstance(x, int))])
    a, b = ({x[1] for x in f.values if isinstance(x, tuple) and x[1] % part == 0} for f in (child, parent))
    return len(a & b) / max(1, len(a)), len(a & b) / max(1, len(b))


def pairs(columns: list[Fact], true: set[tuple[str, str, str, str]] | None = None) -> pd.DataFrame:
    """A row per column and key of another table of the same family of types, with features and, if known, the label."""
    family = lambda k: "int" if k in ("int", "bigint") else k
    rows = []
    for c in columns:
        for p in columns:
            if not p.key or c.table == p.table or c.key or family(c.kind) != family(p.kind):
                continue
            stem, own = key_stem(c.column), _grams(c.column)
            target = _grams(p.column) | _grams(p.table)
            found, covered = shared(c, p)
            words, named = set(map(singular, name_tokens(c.column))), set(map(singular, [*name_tokens(p.table), *name_tokens(p.column)]))
            rows.append({
                "child": c.table, "column": c.column, "parent": p.table, "key": p.column,
                "same_stem": float(bool(stem) and stem == key_stem(p.column)), "stem_in_table": float(len(stem) >= 3 and (singular(p.table).startswith(stem) or stem.startswith(singular(p.table)))),
                "trigrams": len(own & target) / max(1, len(own | target)), "same_words": len(words & named) / max(1, len(words)), "family": float(c.kind == p.kind), "ratio": min(1.0, c.distinct / max(1, p.distinct)),
                "found": found, "covered": covered, "last": float(name_tokens(c.column)[-1:] in (["id"], ["key"], ["code"], ["no"]) or bool(stem)), "unique": c.distinct / max(1, c.rows), "order": float(c.place),
                "label": None if true is None else float((c.table, c.column, p.table, p.column) in true),
            })
    return pd.DataFrame(rows, columns=["child", "column", "parent", "key", *FEATURES, "label"])


@dataclass
class KeyModel:
    first: object
    second: object
    threshold: float = 0.5

    @classmethod
    def fit(cls, spark: SparkSession, known: pd.DataFrame, seed: int = 17) -> KeyModel:
        """Trees on the pairs' features, then on these with what the first stage says of a column's other targets; the
        threshold is that of the best F1 over the known pairs."""
        model = cls(_trees(spark, known, FEATURES, seed), None)
        staged = model._context(spark, known)
        model.second = _trees(spark, staged, [*FEATURES, *CONTEXT], seed)
        scored = _score(spark, model.second, staged, [*FEATURES, *CONTEXT])
        best = _best_targets(staged.assign(final=scored))
        cuts = sorted(set(best["final"].round(6)))
        f1 = lambda t: 2 * ((best["final"] >= t) & (best["label"] == 1)).sum() / max(1, (best["final"] >= t).sum() + (known["label"] == 1).sum())
        model.threshold = max(cuts, key=lambda t: (f1(t), t), default=0.5)
        return model

    def _context(self, spark: SparkSession, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows.assign(score=_score(spark, self.first, rows, FEATURES))
        own = out.groupby(["child", "column"])["score"]
        out["place"] = own.rank(ascending=False, method="min")
        out["lead"] = out["score"] - own.transform("max")
        out["rivals"] = out.groupby(["child", "parent"])["score"].transform(lambda s: float((s > 0.5).sum()))
        return out

    def predict(self, spark: SparkSession, rows: pd.DataFrame) -> pd.DataFrame:
        """(child, column, parent, key, final): one target a column at most, above the threshold."""
        if not len(rows):
            return rows.assign(final=[])[["child", "column", "parent", "key", "final"]]
        staged = self._context(spark, rows)
        best = _best_targets(staged.assign(final=_score(spark, self.second, staged, [*FEATURES, *CONTEXT])))
        return best[best["final"] >= self.threshold][["child", "column", "parent", "key", "final"]].reset_index(drop=True)


def _best_targets(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["final", "parent", "key"], ascending=[False, True, True], kind="stable").drop_duplicates(["child", "column"])


def _vectors(spark: SparkSession, rows: pd.DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame(rows[[*names, *(["label"] if rows["label"].notna().all() else [])]].assign(row=range(len(rows))))
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def _trees(spark: SparkSession, rows: pd.DataFrame, names: list[str], seed: int):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(maxIter=20, maxDepth=4, seed=seed).fit(_vectors(spark, rows, names))


def _score(spark: SparkSession, model, rows: pd.DataFrame, names: list[str]) -> list[float]:
    from pyspark.ml.functions import vector_to_array

    out = model.transform(_vectors(spark, rows, names)).select("row", vector_to_array("probability")[1].alias("p")).orderBy("row").collect()
    return [r["p"] for r in out]
