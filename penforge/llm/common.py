"""What the operators of this folder share: tables in the shared folder, components, packing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import importlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Deleted or split at wherever a contract speaks of white space.
WHITE = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a temporary folder serves a local master; on a cluster
    executors would each write to their own disk, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="penforge-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/penforge/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str, fmt: str = "parquet") -> DataFrame:
    """df written to the shared folder and read back: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.format(fmt).save(path)
    return spark.read.schema(df.schema).format(fmt).load(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


class Pieces:
    """What pieces of text are made of: ranges of one array of ids. Piece 0 is empty, and texts are put together by
    taking pieces by number. What is remembered is forgotten between batches once it is much; it changes no result."""

    def __init__(self, most_pieces: int = 300_000, most_ids: int = 4_000_000):
        self.most_pieces, self.most_ids = most_pieces, most_ids
        self._clear()

    def _clear(self) -> None:
        self.known: dict[Hashable, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def forget(self) -> None:
        if len(self.known) > self.most_pieces or len(self.ids) > self.most_ids:
            self._clear()

    def remember(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """ids: of all keys, one after another."""
        self.known.update(zip(keys, range(len(self.size), len(self.size) + len(keys))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids.astype(np.int32)])

    def numbers(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def take(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of the numbered pieces, how many each has)."""
        sizes = self.size[pieces]
        upto = np.cumsum(sizes)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.repeat(self.start[pieces] - upto + sizes, sizes) + np.arange(total)], sizes


def give_back() -> None:
    """Memory that a Python worker holds but doesn't use goes back to the system; workers are used again."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not the C library that has it


_held: list[str] = []  # the module whose state this worker holds


def take_over(module: str) -> None:
    """Called in a worker: what another operator's module remembers there is forgotten first."""
    if _held != [module]:
        for other in _held:
            importlib.import_module(other).clear_state()
        _held[:] = [module]
        give_back()


def released(run: Callable, module: str = "") -> Callable:
    """run, a generator over Arrow batches, after which a worker gives unused memory back. module: the one with
    clear_state(), if it remembers anything between tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(module or __name__)
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def clear_state() -> None:
    """Nothing is remembered here."""


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge are absent.

    Alternating large-star and small-star rounds; every round is one stored table of at most as many rows as
    edges, so no component is gathered anywhere, and hubs are pre-aggregated by a partial minimum.
    """
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
