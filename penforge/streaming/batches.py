"""Long reviews in resumable batches: a batch commits whole segments only, as many as its budgets allow.

Answers to segments are recorded rows. How far a session has come is a log with one folder for each batch, written
over when a batch is done again, so a run that broke off and one that didn't leave the same rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


class Budget(NamedTuple):
    """What a batch and a session may take."""

    segments: int = 2
    seconds: float = 120.0
    calls: int = 12
    session_calls: int = 128
    least_seconds: float = 1.0  # a segment isn't begun with less


PROGRESS = "session long, completed int, calls int"


def attempts(progress: DataFrame, answers: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """The segments that one batch begins: session, segment, n_calls (what it really takes of the budget), committed.

    progress: session, completed (segments so far), calls. answers: session, segment (from 1), calls, seconds, ok. A
    segment is begun while there is budget left, and committed if it is ok and fits whole; the first one that isn't
    ends the batch, and its calls are spent.
    """
    rows = answers.join(progress.select("session", "completed", F.col("calls").alias("spent")), "session")
    rows = rows.where((F.col("segment") > F.col("completed")) & (F.col("segment") <= F.col("completed") + budget.segments))
    upto = Window.partitionBy("session").orderBy("segment")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    used = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    rows = rows.withColumns({"calls_before": used("calls"), "seconds_before": used("seconds"), "place": F.row_number().over(upto)})
    room = F.least(F.lit(budget.calls) - F.col("calls_before"), F.lit(budget.session_calls) - F.col("spent") - F.col("calls_before"))
    begun = (room > 0) & (F.lit(budget.seconds) - F.col("seconds_before") >= budget.least_seconds) & (F.col("segment") == F.col("completed") + F.col("place"))
    fits = begun & F.col("ok") & (F.col("calls") <= room) & (F.col("seconds_before") + F.col("seconds") <= budget.seconds)
    rows = rows.withColumns({"room": room, "begun": begun, "fits": F.coalesce(fits, F.lit(False))})
    rows = rows.withColumn("earlier", F.coalesce(F.min("fits").over(before), F.lit(True))).where("begun AND earlier")
    return rows.select("session", "segment", F.least("calls", F.greatest("room", F.lit(0))).cast("int").alias("n_calls"), F.col("fits").alias("committed"))


def advanced(progress: DataFrame, tried: DataFrame) -> DataFrame:
    """progress after a batch; sessions that began nothing stay as they are."""
    sums = tried.groupBy("session").agg(F.count_if("committed").cast("int").alias("more"), F.sum("n_calls").cast("int").alias("n_calls"))
    zero = F.lit(0)
    return progress.join(sums, "session", "left").select("session", (F.col("completed") + F.coalesce("more", zero)).alias("completed"), (F.col("calls") + F.coalesce("n_calls", zero)).alias("calls"))


class ReviewLog:
    """Progress and committed segments under a folder that all executors share; step() is a foreachBatch function."""

    def __init__(self, spark: SparkSession, path: str, answers: DataFrame, budget: Budget = Budget()):
        self.spark, self.path, self.answers, self.budget = spark, path.rstrip("/"), answers, budget

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "false").option("ignoreMissingFiles", "true").parquet(f"{self.path}/{name}")

    def _exists(self, name: str) -> bool:
        # asked of the file system that holds the path, whatever it is
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def progress(self, before: int | None = None) -> DataFrame:
        """session, completed, calls after all batches, or those before one."""
        if not self._exists("progress"):
            return self.spark.createDataFrame([], PROGRESS)
        rows = self._read("progress", PROGRESS)
        rows = rows if before is None else rows.where(F.col("batch") < before)
        return rows.groupBy("session").agg(F.max_by(F.struct("completed", "calls"), "batch").alias("p")).select("session", "p.*")

    def committed(self) -> DataFrame:
        """session, segment, n_calls of what is committed."""
        return self._read("segments", "session long, segment int, n_calls int").where("batch IS NOT NULL").select("session", "segment", "n_calls")

    def step(self, requests: DataFrame, batch: int) -> None:
        """One more batch of each session (session) that is asked for, however often it is. The progress row is written last."""
        asked = requests.select("session").where("session IS NOT NULL").distinct()
        zero = F.lit(0)
        now = asked.join(self.progress(batch), "session", "left").select("session", F.coalesce("completed", zero).alias("completed"), F.coalesce("calls", zero).alias("calls"))
        tried = attempts(now, self.answers, self.budget)
        tried.where("committed").select("session", F.col("segment").cast("int").alias("segment"), "n_calls").write.mode("overwrite").parquet(f"{self.path}/segments/batch={batch}")
        advanced(now, tried).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch}")
