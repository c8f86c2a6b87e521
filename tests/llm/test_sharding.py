"""Sharding: slots of the rows alone, repeated rows over many blocks, unequal weights, growth."""

from collections import Counter

from pyspark.sql import functions as F

from penforge.llm import sharding

SCHEMA = "doc_id long, text string, shard string"


def rows_of(df, **kw):
    return [tuple(r) for r in sharding.shard(df, [1.0] * 5, [1.0] * 6, **kw).collect()]


def test_slots_do_not_depend_on_partitions(spark):
    rows = [(i % 170, f"text {i % 190}", "clash") for i in range(400)] + [(None, None, "clash")] * 3
    one = rows_of(spark.createDataFrame(rows, SCHEMA).coalesce(1), block_rows=20, chunk_rows=2)
    many = rows_of(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), block_rows=20, chunk_rows=2)
    assert sorted(one, key=str) == sorted(many, key=str) and len(one) == 403


def test_one_row_holds_most_of_the_table(spark):
    rows = [(7, "same", "")] * 900 + [(i, "other", "") for i in range(100)]
    got = rows_of(spark.createDataFrame(rows, SCHEMA), block_rows=50, chunk_rows=10)
    assert Counter(r[0] for r in got) == Counter(r[0] for r in rows)
    for s in {r[4] for r in got}:
        assert sorted(r[5] for r in got if r[4] == s) == list(range(sum(r[4] == s for r in got)))


def test_weights_and_growth(spark):
    keys = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("ü").alias("text"))
    weights = [1.0, 2.0, 5.0]
    got = sharding.shard(keys, weights, [*weights, 2.0]).collect()
    counts = Counter(r.shard for r in got)
    assert all(abs(counts[s] / 20_000 - w / 8) < 0.015 for s, w in enumerate(weights))
    moved = [r for r in got if r.grown_shard != r.shard]
    assert all(r.grown_shard == 3 for r in moved) and abs(len(moved) / 20_000 - 0.2) < 0.015
    assert {(r.size, r.law) for r in got} == {(3, "key")}


def test_a_very_long_text_and_no_rows(spark):
    assert [r[1] for r in rows_of(spark.createDataFrame([(1, "x" * 3_000_000, "")], SCHEMA))] == [3_000_001]
    assert rows_of(spark.createDataFrame([], SCHEMA)) == []
