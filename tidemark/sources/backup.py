"""Copies of tables with a manifest that tells whether each file is still what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "file string, size long, sha256 string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of the files below ``path``, by their place in it; each is read by one task."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    place = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "file:/"), "^" + root.replace("file:///", "file:/").replace(".", r"\.") + "/", "")
    return found.select(place.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def backup(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table and then the manifest, without which there is no backup; returns the manifest."""
    for name, df in tables.items():
        df.write.option("compression", "zstd").parquet(f"{path}/data/{name}")
    files(spark, f"{path}/data").coalesce(1).write.json(f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def broken(spark: SparkSession, path: str) -> DataFrame:
    """(file, why): files that are missing, changed or not in the manifest."""
    told, held = spark.read.schema(MANIFEST).json(f"{path}/manifest"), files(spark, f"{path}/data")
    j = told.alias("t").join(held.alias("h"), "file", "full")
    why = F.when(F.col("h.sha256").isNull(), "missing").when(F.col("t.sha256").isNull(), "unknown").when((F.col("t.sha256") != F.col("h.sha256")) | (F.col("t.size") != F.col("h.size")), "changed")
    return j.select("file", why.alias("why")).where("why is not null")


def restore(spark: SparkSession, path: str, tables: list[str]) -> dict[str, DataFrame]:
    """The tables of a backup, only if every file is what was written."""
    if (bad := broken(spark, path).limit(5).collect()):
        raise ValueError(f"the backup is not whole: {', '.join(r['file'] + ' ' + r['why'] for r in bad)}")
    return {t: spark.read.parquet(f"{path}/data/{t}") for t in tables}
