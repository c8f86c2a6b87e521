"""Embedding whitening: MLlib's RowMatrix over exactly centred rows.

Entries become integers, so that sums are exact and n*x - S, the centred row times n, is too. The Gramian of the
centred rows over n is the covariance; it is as large as the dimension says, whatever the rows, and its eigenvectors
are found on the driver. Rows are whitened where they are, from a broadcast of a few numbers for each dimension.

Defined cases: a null vector, or one with a null or non-finite entry, has no row. Vectors of each length are whitened
by themselves; empty ones have no components. Repeated rows and null ids count and have rows of their own. A component
without variance (one vector, equal vectors, fewer vectors than dimensions) has a null `whitened` and takes no part in
identity_error, which is 0 where no component has variance; without any variance `explained` is null. An entry so
large that n*x leaves a long is an error. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table, released, stored

SCALE, SHIFT = 64, 1_000_000
MOST_COMPONENTS = 32
#: An eigenvalue below this share of the largest is rounding, not variance.
NO_VARIANCE = 1e-12
SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, x (array of long) of the vectors whose entries are all finite."""
    v = F.col(column)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return vectors.where(v.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", x.alias("x"))


def sums(numbers: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vectors: how many there are and their exact sums. A task passes on one row for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            x = batch.column(0)
            lengths, flat = np.diff(x.offsets.to_numpy()), x.flatten().to_numpy()
            for d in np.unique(lengths).tolist():
                rows = flat[np.repeat(lengths == d, lengths)].reshape(-1, d) if d else np.zeros((int((lengths == 0).sum()), 0), np.int64)
                n, total = own.get(d, (0, np.zeros(d, object)))
                high, low = rows >> 32, rows & 0xFFFFFFFF  # sums of halves fit a long
                own[d] = n + len(rows), total + high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
        for d, (n, total) in own.items():
            yield pa.record_batch([pa.array([d] * (d + 1), pa.int32()), pa.array(range(d + 1), pa.int32()), pa.array([str(t) for t in [n, *total]])], ["d", "i", "total"])

    parts = numbers.select("x").mapInArrow(released(run), "d int, i int, total string")
    rows = parts.groupBy("d", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # one for each dimension
    out: dict[int, dict[int, int]] = {}
    for r in rows:
        out.setdefault(r.d, {})[r.i] = int(r.total)
    return {d: (got[0], [got[i] for i in range(1, d + 1)]) for d, got in sorted(out.items())}


def covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Of centred rows (arrays of double), divisor n."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n).computeGramianMatrix().toArray() / n


def _centred(n: int, total: list[int]) -> Column:
    """Of x: (n*x - S) / n; n*x - S is a whole number."""
    s = F.lit(total).cast("array<long>")
    return F.transform("x", lambda x, i: (x * F.lit(n).cast("long") - s[i]).cast("double") / F.lit(float(n)))


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) by falling eigenvalue; an eigenvector's largest entry is positive."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return e, u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def _whitened(numbers: DataFrame, n: int, total: list[int], e: np.ndarray, u: np.ndarray) -> DataFrame:
    """vec_id, deviation, w (array of double, of the components that have variance)."""
    d, sent = len(total), numbers.sparkSession.sparkContext.broadcast((np.array(total, object), u / np.sqrt(e)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, w = sent.value
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["x"].to_numpy()).astype(np.int64)
            if max(int(np.abs(x).max()), 1) * n < 2**61:
                off = x * n - s.astype(np.int64)
            else:
                off = x.astype(object) * n - s
            # squares are summed as whole numbers, in a long where they fit
            exact = off if d * int(np.abs(off).max()) ** 2 < 2**63 else off.astype(object)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation": [str(t) for t in (exact * exact).sum(axis=1)], "w": list(off.astype(np.float64) / n @ w)})

    # as text, since pandas would make longs beside a null floats
    rows = numbers.where(F.size("x") == d).select(F.col("vec_id").cast("string"), "x").mapInPandas(run, "vec_id string, deviation string, w array<double>")
    return rows.withColumns({"vec_id": F.col("vec_id").cast("long"), "deviation": F.col("deviation").cast("decimal(38,0)")})


def whiten(vectors: DataFrame, column: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each vector and component."""
    spark = vectors.sparkSession
    numbers = whole_numbers(vectors, column)
    out = None
    for d, (n, total) in sums(numbers).items():
        if d == 0:
            continue
        rows = numbers.where(F.size("x") == d).select(_centred(n, total).alias("c"))
        v = covariance(rows, "c", n)
        e, u = components(v, most)
        live = int((e > max(e[0], 0) * NO_VARIANCE).sum())  # the first ones, as e falls
        white = stored(_whitened(numbers, n, total, e[:live], u[:, :live]), "whitened")
        error = 0.0
        if live:
            mean = white.select(F.posexplode("w").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w")).orderBy("i").collect()
            mean = F.lit([r.w / n for r in mean])
            spread = covariance(white.select(F.transform("w", lambda w, i: w - mean[i]).alias("c")), "c", n)
            error = float(np.abs(spread - np.eye(live)).max())
        trace = float(np.trace(v))
        share = F.lit([float(x) / trace if trace > 0 else None for x in e]).cast("array<double>")
        exploded = white.select("vec_id", "deviation", "w", F.explode(F.lit(list(range(1, len(e) + 1)))).alias("component"))
        found = exploded.select(
            "vec_id", F.col("component").cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
            F.get("w", F.col("component") - 1).alias("whitened"), F.get(share, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"),
        )
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As whiten(); a deviation beyond a long is null."""
    return whiten(read_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
