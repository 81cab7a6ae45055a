"""Flows: what a trigger starts runs in units, each kept once it is whole, so that a run that died goes on at the next.

A unit's answer is a small table under the run's folder; Spark's marker of a whole write says that it is kept. A unit
that died runs again as a whole, and what it does bears repeating: collected events have ids of their own, new states
and the notifications they cause are one write, and an action's operation has the same id on every attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def event_ids(rows: DataFrame, instance: str, at: str) -> DataFrame:
    """``rows`` with ``event``: a hash of instance, time, fields and the place among identical rows of one read, so that
    the same window read again names the same events and two identical rows stay two."""
    fields = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    keyed = rows.withColumn("_f", F.sha2(fields, 256))
    place = F.row_number().over(Window.partitionBy(F.col(instance), F.col(at), F.col("_f")).orderBy("_f"))
    return keyed.withColumn("event", F.sha2(F.concat_ws("|", F.col(instance).cast("string"), F.col(at).cast("string"), "_f", place.cast("string")), 256)).drop("_f")


class Run:
    def __init__(self, spark: SparkSession, path: str, flow: str, run: str):
        self.spark, self.name, self.path = spark, f"{flow}/{run}", f"{path}/{flow}/{run}"

    def _kept(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def unit(self, name: str, work: Callable[[], DataFrame]) -> DataFrame:
        """The kept answer of a unit; ``work`` is done only if there is none."""
        at = f"{self.path}/{name}"
        if not self._kept(at):
            work().write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def collect(self, name: str, read: Callable[[], DataFrame], dataset: str, instance: str, at: str) -> DataFrame:
        """Events of a read that the dataset has not go into it; kept: (instance, rows, window_end)."""

        def work() -> DataFrame:
            rows = event_ids(read(), instance, at)
            new = f"{self.path}/{name}-rows"
            rows.write.mode("overwrite").parquet(new)
            rows = self.spark.read.parquet(new)
            held = self._kept(dataset)
            fresh = rows.join(self.spark.read.parquet(dataset).select("event"), "event", "left_anti") if held else rows
            fresh.write.mode("append").parquet(dataset)
            return rows.groupBy(F.col(instance).alias("instance")).agg(F.count(F.lit(1)).alias("rows"), F.max(at).alias("window_end"))

        return self.unit(name, work)

    def evaluate(self, name: str, found: Callable[[], DataFrame], states: DataFrame) -> DataFrame:
        """Transitions (subject, was, state) of subjects whose condition ``found(subject, breach)`` moves them; a null
        ``breach`` moves none. ``states(subject, state)`` are those before the run."""

        def work() -> DataFrame:
            was = F.coalesce("state", F.lit("ok"))
            now = F.when(F.col("breach"), "firing").otherwise("ok")
            return found().where("breach is not null").join(states, "subject", "left").select("subject", was.alias("was"), now.alias("state")).where("was <> state")

        return self.unit(name, work)

    def commit(self, name: str, transitions: DataFrame, states: DataFrame) -> DataFrame:
        """New states and one notification a transition, in one write: (kind, subject, state, operation)."""

        def work() -> DataFrame:
            moved = transitions.select("subject", F.col("state").alias("new"))
            after = states.join(moved, "subject", "full").select(F.lit("state").alias("kind"), "subject", F.coalesce("new", "state").alias("state"), F.lit(None).cast("string").alias("operation"))
            return after.union(transitions.select(F.lit("notify"), "subject", "state", self.operation(name)))

        return self.unit(name, work)

    def operation(self, step: str):
        """The id of an action: flow/run/step/subject, the same on every attempt."""
        return F.concat_ws("/", F.lit(self.name), F.lit(step), "subject")

    def act(self, name: str, subjects: DataFrame, action: Callable[[str, str], str], when: bool = True) -> DataFrame:
        """An action per subject, (subject, operation, result); what it is told twice by one operation it does once.

        The subjects are those of a report or of transitions, a stated few: they come to the driver.
        """

        def work() -> DataFrame:
            rows = subjects.select("subject", self.operation(name).alias("operation")).orderBy("subject").collect() if when else []
            return self.spark.createDataFrame([(r["subject"], r["operation"], action(r["subject"], r["operation"])) for r in rows], "subject string, operation string, result string")

        return self.unit(name, work)
