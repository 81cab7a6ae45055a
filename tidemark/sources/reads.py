"""Reads of other services: scraped metric pages and probes, as rows that a collector fetched.

Fetching is the collector's: these take its answers (instance, us, status, took_us, body), one row an attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formats import exposition


def scraped(answers: DataFrame) -> DataFrame:
    """Samples (instance, name, kind, labels, us, value) of the pages of good answers; a sample without a time of its
    own has that of its scrape, and ``instance`` is a label of each that has none of that name."""
    good = answers.where("status = 200").withColumn("id", F.concat_ws("\n", "instance", F.col("us").cast("string")))
    rows = exposition(good, "id", "body").where("name is not null")
    at = F.split("id", "\n")
    labels = F.when(F.map_contains_key("labels", F.lit("instance")), F.col("labels")).otherwise(F.map_concat("labels", F.create_map(F.lit("instance"), at[0])))
    return rows.select(at[0].alias("instance"), "name", "kind", labels.alias("labels"), F.coalesce(F.col("ms") * 1000, at[1].cast("long")).alias("us"), "value")


def probes(answers: DataFrame, slow_us: int) -> DataFrame:
    """(instance, us, status, took_us, state): ``down`` without an answer or with an error, ``slow``, else ``up``."""
    state = F.when(F.col("status").isNull() | (F.col("status") >= 400), "down").when(F.col("took_us") > slow_us, "slow").otherwise("up")
    return answers.select("instance", "us", "status", "took_us", state.alias("state"))


def notices(transitions: DataFrame, url: str) -> DataFrame:
    """(url, key, body): what a webhook is to be told of each change of state, once by its key."""
    body = F.to_json(F.struct("instance", "was", "state", "us"))
    return transitions.select(F.lit(url).alias("url"), F.sha2(body, 256).alias("key"), body.alias("body")).dropDuplicates(["key"])
