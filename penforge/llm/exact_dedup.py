"""Exact deduplication with a persistent digest index.

The index is a Parquet table bucketed and sorted by digest in the shared folder. A batch is digested once into a
narrow table, grouped (partial aggregation first, so a group holding a third of all rows is a few rows by the time
it is shuffled), anti-joined to the index by sort-merge, and what is new is appended.

Defined cases: a null text counts as empty; empty texts are equal to each other; of repeated rows (same doc_id, same
text) one stays; a null doc_id sorts last and may stay; empty input gives no rows; further columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WHITE, fresh_path, read_table, stored, whole_text

#: A group with at least this share of all rows is joined by broadcast: there can be at most 1/share of them.
HOT_SHARE = 0.001


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id",
        F.sha2(F.translate(whole_text(), WHITE, ""), 256).alias("text_sha256"),
        F.char_length(whole_text()).cast("long").alias("n_code_points"),
        F.monotonically_increasing_id().alias("row_no"),
    )


class DigestIndex:
    """Digests of everything ingested so far: text_sha256, keep_id, keep_row, group_size."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 24):
        self.spark, self.buckets = spark, buckets
        self.path = path or fresh_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(
            f"CREATE TABLE {self.table} (text_sha256 STRING, keep_id BIGINT, keep_row BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Appends what is new and returns a row for each row of docs, dropped ones too.

        Texts that the index already holds are dropped in favour of the row it names; group_size counts the batch.
        """
        batch = stored(digests(docs), "digests")
        best = F.min(F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
        groups = stored(
            batch.groupBy("text_sha256").agg(best.alias("best"), F.count("*").alias("group_size"))
            .select("text_sha256", F.col("best.doc_id").alias("keep_id"), F.col("best.row_no").alias("keep_row"), "group_size")
            .repartition(self.buckets, "text_sha256"),
            "digest-groups",
        )
        known = self.rows().select("text_sha256", F.col("keep_id").alias("known_id"))
        held = groups.hint("merge").join(known.hint("merge"), "text_sha256")
        fresh = groups.join(known.hint("merge"), "text_sha256", "left_anti")
        settled = stored(
            fresh.unionByName(held.select("text_sha256", F.col("known_id").alias("keep_id"), F.lit(-1).cast("long").alias("keep_row"), "group_size")),
            "digest-settled",
        )
        (settled.where("keep_row >= 0").repartition(self.buckets, "text_sha256").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").option("path", self.path).saveAsTable(self.table))
        least = max(2, int(batch.count() * HOT_SHARE))
        hot = F.broadcast(settled.where(F.col("group_size") >= least))
        rows = batch.join(hot, "text_sha256").unionByName(
            batch.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(settled.where(F.col("group_size") < least), "text_sha256")
        )
        return rows.select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "text_sha256", "n_code_points")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called."""
    decided = stored(DigestIndex(docs.sparkSession).ingest(docs), "dedup-decided")
    # a row stays if its key belongs to a kept row; only keys that several rows share need dropDuplicates
    stay = decided.groupBy("doc_id", "text_sha256", "n_code_points").agg(F.max("kept").alias("kept"), F.count("*").alias("n_same")).where("kept")
    stay = stay.select(F.struct("doc_id", "text_sha256", "n_code_points").alias("key"), F.col("n_same").alias("n_same"))
    key = F.struct("doc_id", F.sha2(F.translate(whole_text(), WHITE, ""), 256).alias("text_sha256"), F.char_length(whole_text()).cast("long").alias("n_code_points"))
    # the columns of docs go as one, so no name can clash; a null doc_id equals itself within a struct
    out = docs.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")).join(stay, "key")
    once, more = out.where("n_same = 1"), out.where("n_same > 1").dropDuplicates(["key"])
    return once.unionByName(more).select("own.*")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DigestIndex(spark).ingest(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             row_number() OVER w = 1 AS kept
      FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""
