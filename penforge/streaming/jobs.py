"""Job events as a stream: an append-only log, and requests that a running count per user tells apart."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

PARTS = "user_id long, request long, first_event long, last_event long, n_events long"


def shared_folder(spark: SparkSession, tag: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="penforge-stream-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/penforge/{tag}-{uuid.uuid4().hex[:12]}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table that is one file or a folder of them; a stream takes a file by a pattern only."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


def _numbered(key, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Of one user and batch, a row for each request; the state is the number of the request that is open."""
    rows = pd.concat(list(chunks)).sort_values("event_id")
    open_ = state.get[0] if state.exists else 0
    rows["request"] = open_ + (rows["event_type"] == "click").cumsum()
    state.update((int(rows["request"].iloc[-1]),))
    found = rows.groupby("request").event_id.agg(first_event="min", last_event="max", n_events="count").reset_index()
    found.insert(0, "user_id", key[0])
    yield found[["user_id", "request", "first_event", "last_event", "n_events"]]


def request_parts(events: DataFrame) -> DataFrame:
    """PARTS of a stream of events whose batches come in event order; a request that goes on has several."""
    return events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(_numbered, PARTS, "request long", "append", "NoTimeout")


def run_to_end(stream: DataFrame, tag: str) -> DataFrame:
    """What is there now, written once through a checkpoint that survives lost executors, and read back."""
    spark, out = stream.sparkSession, shared_folder(stream.sparkSession, tag)
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def requests(events: DataFrame) -> DataFrame:
    """user_id, request, first_event, last_event, n_events of a stream of events."""
    parts = run_to_end(request_parts(events), "requests")
    return parts.groupBy("user_id", "request").agg(F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"), F.sum("n_events").alias("n_events"))
