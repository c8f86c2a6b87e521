"""Rendezvous hashing of stable record keys over weighted shards.

Every record scores every shard with -ln(u) / weight, u a hash of key and shard in (0, 1); the least score wins. A
further shard only takes records for which it scores least, so no record moves between older shards. Slots are dealt
in two levels: a number within a block of the shard, plus the sizes of the shard's earlier blocks. Rows that agree in
id, size and checksum are counted before they are shuffled, dealt in chunks and spread out again at the end, so slots
depend on the rows alone, not on files or partitions, and a row that repeats without bound is still many blocks.

Defined cases: a null key hashes as the empty string; repeated rows share a shard and get different slots; a null
text has size 1 and checksum 0; empty input gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table, stored

#: Rows that one block of slots holds on average.
BLOCK_ROWS = 20_000
#: Repeats of a row that share a block.
CHUNK_ROWS = 4_096


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: int from 0. weights: a positive number for each shard."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scored = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        scored.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scored))["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    chunks = rows.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {chunk_rows})")))
    chunks = chunks.select(
        "doc_id", "size", "text_crc32", "chunk", F.least(F.lit(chunk_rows), F.col("copies") - F.col("chunk") * chunk_rows).alias("n"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        (rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    chunks = stored(chunks, "sharded")
    blocks = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // block_rows))
    chunks = chunks.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "chunk"), F.lit(blocks)).cast("int"))
    sizes = chunks.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    # one row for each shard and block: the running sum is over at most `blocks` rows of a shard
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    earlier = Window.partitionBy("shard", "block").orderBy("doc_id", "size", "text_crc32", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    dealt = chunks.withColumn("inside", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(starts, ["shard", "block"])
    first = F.col("start") + F.col("inside")
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard",
    )


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read_table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
