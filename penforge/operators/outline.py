"""Sections of documents: where each ends, and a locator of titles that tells repeated ones apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def sections(headings: DataFrame) -> DataFrame:
    """doc_id, ln, level, title, end_ln, locator of each heading (doc_id, ln, level, title, parent).

    A section ends before the next heading of its level or a smaller one; end_ln is null if it runs to the end. The
    locator joins title[n] of the headings above it and its own, n counting equal titles under one parent. All
    windows are of one document, so the rows are shuffled once.
    """
    after = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(1, Window.unboundedFollowing)
    before = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("doc_id", "parent", "title").orderBy("ln")
    rows = headings.withColumn("step", F.concat("title", F.lit("["), F.row_number().over(same).cast("string"), F.lit("]")))
    nexts = {f"next{i}": F.min(F.when(F.col("level") == i, F.col("ln"))).over(after) for i in range(1, 7)}
    lasts = {f"last{i}": F.last(F.when(F.col("level") == i, F.struct("ln", "step")), True).over(before) for i in range(1, 7)}
    rows = rows.withColumns(nexts | lasts)
    end = F.least(*[F.when(F.col("level") >= i, F.col(f"next{i}")) for i in range(1, 7)])
    above, seen = [], F.lit(0)
    for i in range(1, 7):
        own = F.col(f"last{i}")
        above.append(F.when((F.col("level") > i) & (own["ln"] > seen), own["step"]))
        seen = F.greatest(seen, F.coalesce(own["ln"], F.lit(0)))
    locator = F.concat_ws("/", *above, "step")
    return rows.select("doc_id", "ln", "level", "title", (end - 1).alias("end_ln"), locator.alias("locator"))
