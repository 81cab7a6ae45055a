"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty table; rows with nulls in any column are ordinary rows,
a null text as an empty one; a null id is never linked and never dropped for its id; texts may be of any length; columns
beyond those of ``documents`` are kept, whatever their names. What a stage does with repeated rows and ties stands with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, pii, sentencepiece_bpe, toxicity
from tidemark.llm.common import materialise, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go; the scorer learns from the labels of the allowed folds.

    Rows of one text are kept or dropped together. Without labels of both classes a fixed lexicon scores.
    """
    scorer = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), scorer)
    return scored.where("predicted = 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest id stays; of rows that repeat an id, the least by hash.

    Texts of no words are linked with nothing: all of them stay.
    """
    gone = ngram_join.join(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    kept = materialise(docs.join(gone, docs["doc_id"] == F.col("gone"), "left_anti"), "kept")
    again = materialise(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(F.col("doc_id").alias("again")), "again")
    if again.isEmpty():
        return kept
    row = F.struct(*docs.columns)
    one = kept.join(again, kept["doc_id"] == F.col("again")).groupBy("again").agg(F.min_by(row, F.struct(F.md5(F.to_json(row)), F.xxhash64(F.to_json(row)))).alias("row"))
    return kept.join(again, kept["doc_id"] == F.col("again"), "left_anti").unionByName(one.select("row.*"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced in the texts; ``n_chars`` follows them.

    Equal texts become equal texts; of spans that overlap every character is replaced once; null texts stay null.
    """
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture. A null source is one of its own; equal rows are interchangeable."""
    return mixing.mix(docs).orderBy("mix_position").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with begin and end, a row per row; an empty text has these two."""
    import public_tokenizers

    return sentencepiece_bpe.tokenise(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("ngram_join", near_duplicates),
    ("pii", private),
    ("mixing", mixed),
    ("sentencepiece", tokens),
]

#: SQL can't express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written in the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
