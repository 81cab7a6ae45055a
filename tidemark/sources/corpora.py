"""Search corpora with questions and judgements, in the layouts in which they are published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = {"sep": "\t", "quote": "", "escape": ""}


def msmarco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """documents(doc, title, text) of ``collection.tsv``, questions(query, text) of ``queries.tsv``, qrels(query, doc, grade)."""
    docs = spark.read.options(**RAW).csv(f"{path}/collection.tsv", schema="doc string, text string").select("doc", F.lit(None).cast("string").alias("title"), "text")
    return docs, spark.read.options(**RAW).csv(f"{path}/queries.tsv", schema="query string, text string"), trec(spark, f"{path}/qrels.tsv")


def beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three of ``corpus.jsonl``, ``queries.jsonl`` and ``qrels/<split>.tsv`` with its line of names."""
    docs = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").select(F.col("_id").alias("doc"), "title", "text")
    questions = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").select(F.col("_id").alias("query"), "text")
    qrels = spark.read.options(header=True, **RAW).csv(f"{path}/qrels/{split}.tsv", schema="query string, doc string, grade int")
    return docs, questions, qrels


def miracl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same three of ``docs*.jsonl*``, ``topics.tsv`` and ``qrels.tsv``."""
    docs = spark.read.schema("docid string, title string, text string").json(f"{path}/docs*").select(F.col("docid").alias("doc"), "title", "text")
    return docs, spark.read.options(**RAW).csv(f"{path}/topics.tsv", schema="query string, text string"), trec(spark, f"{path}/qrels.tsv")


def trec(spark: SparkSession, path: str) -> DataFrame:
    """qrels(query, doc, grade) of lines ``query 0 doc grade``, by tabs or blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("query"), parts[2].alias("doc"), parts[3].cast("int").alias("grade"))


def relevant(qrels: DataFrame, least: int = 1) -> DataFrame:
    return qrels.where(F.col("grade") >= least).select("query", "doc").distinct()
