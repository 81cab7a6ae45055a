"""Running sums in the order of a number, without one task for the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, by: str, amount: str, out: str, parts: int = 256) -> DataFrame:
    """``df`` with the sum of ``amount`` over rows of lesser ``by`` (a number, different in each row).

    Rows are summed within ranges of ``by`` between quantiles, and the ranges' totals, ``parts`` at most, among themselves.
    """
    from pyspark.ml.feature import Bucketizer

    rows = df.withColumn("_by", F.col(by).cast("double"))
    cuts = sorted(set(rows.approxQuantile("_by", [i / parts for i in range(1, parts)], 0.25 / parts)))
    splits = [float("-inf"), *(c for c in cuts if abs(c) != float("inf")), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_by", outputCol="_part").transform(rows) if len(splits) > 2 else rows.withColumn("_part", F.lit(0.0))
    ahead = lambda w: F.coalesce(F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("_part").agg(F.sum(amount).alias(amount))
    before = totals.select(F.col("_part").alias("_of"), ahead(Window.orderBy("_part")).alias("_before"))
    inside = rows.withColumn("_inside", ahead(Window.partitionBy("_part").orderBy(by)))
    return inside.join(F.broadcast(before), F.col("_part") == F.col("_of")).withColumn(out, F.col("_before") + F.col("_inside")).drop("_by", "_part", "_of", "_before", "_inside")
