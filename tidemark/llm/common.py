"""What several of these operators share: written intermediate tables, connected components, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where all run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, lost executors don't matter."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def write_lines(spark: SparkSession, lines: Iterable[str], what: str) -> str:
    """Write text that the driver holds as a file of lines in the shared folder; its path."""
    path = new_path(spark, what)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop)
    try:
        lines = iter(lines)
        while some := "".join(f"{x}\n" for x in islice(lines, 20_000)):
            out.write(bytearray(some.encode()))
    finally:
        out.close()
    return path


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, component)``; the component is its smallest node.

    Alternating large-star and small-star steps, all as joins and partial minima, so that a node with a great many
    neighbours is pre-aggregated before the shuffle and split by the adaptive join. Nodes without edges don't appear;
    null ends and self loops are ignored. The driver sees two numbers per step.
    """

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def large(e: DataFrame) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        return e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()

    cur = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = state(cur)
    for _ in range(rounds):
        if not was[0]:
            break
        new = materialise(small(large(cur)), "edges")
        release(cur)
        cur, now = new, state(new)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def chunks(texts: list, size: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``size`` characters each, so that memory follows the longest text, not the batch."""
    begin = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield begin, i + 1
            begin, n = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def span_list(spans: Column) -> Column:
    """``array<struct<start,kind_no,kind,end>>``, sorted, as ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
