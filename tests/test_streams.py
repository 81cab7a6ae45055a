"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tidemark.streaming import streams


def source(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value")
    path = str(tmp_path / "in")
    df.repartition(3).write.parquet(path)
    return df, streams.events(spark, path, df.schema, files=10)


def finish(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_buckets(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    got = {(r.at, r.event_type): r.n for r in finish(streams.buckets(stream, "1 day", ["event_type"]), "buckets", "complete", tmp_path).collect()}
    want = {(r[0], r[1]): r[2] for r in df.groupBy(F.window("ts", "1 day").start, "event_type").count().collect()}
    assert got == want


def test_idempotent_and_exactly_once(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    assert finish(streams.idempotent(stream, ["event_id"]), "once", "append", tmp_path).count() == df.count()
    q = streams.exactly_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()


def test_first_windows(spark, tmp_path):
    df, stream = source(spark, tmp_path)
    got = {r.user_id: r.n for r in finish(streams.first_windows(stream, "user_id", 86_400 * 365), "windows", "update", tmp_path).groupBy("user_id").agg(F.max("n").alias("n")).collect()}
    assert got == {r.user_id: r["count"] for r in df.groupBy("user_id").count().collect()}
