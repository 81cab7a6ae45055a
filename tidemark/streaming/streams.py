"""Structured Streaming forms of the batch operators: buckets with late data, idempotent events, exactly-once batches,
fixed windows that begin with a key's first event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def buckets(stream: DataFrame, every: str, keys: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts and sums per bucket, final once the watermark has passed; later rows are dropped from the aggregate."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(F.col("window.start").alias("at"), *keys, "n", F.col("total").cast("double").alias("total"))


def runs(stream: DataFrame, key: str, idle: str = "1 hour", late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """An idle hour ends a run."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, idle), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def idempotent(stream: DataFrame, ids: list[str], late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """A repeat of an event's id is a no-op while the watermark still knows it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def exactly_once(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch in a folder named by its number: a batch that is tried again replaces itself."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_windows(stream: DataFrame, key: str, span_seconds: int, ts: str = "ts") -> DataFrame:
    """Fixed windows that begin at a key's first event after its last window ended: (key, begin, n) after each batch."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, n = state.get if state.exists else (None, 0)
        times = sorted(int(t.value // 1000) for pdf in batches for t in pdf[ts])
        for t in times:
            if begin is None or t >= begin + span_seconds * 1_000_000:
                begin, n = t, 0
            n += 1
        state.update((begin, n))
        yield pd.DataFrame({key: [k[0]], "begin_us": [begin], "n": [n]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {stream.schema[key].dataType.simpleString()}, begin_us long, n long", "begin_us long, n long", "update", GroupStateTimeout.NoTimeout)
