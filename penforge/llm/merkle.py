"""Merkle manifest of a dataset: a tree over the rows of each language, and one over the languages' roots.

Leaves are numbered within their group by one range sort and the counts of its partitions, so that a group of any
size is spread over all tasks. 2 ** BLOCK_LEVELS consecutive nodes make an aligned block, which is a subtree. Executors
run the levels of a block as DuckDB queries (ordered string_agg, then sha256) over Arrow rows and give back its root;
block roots are the nodes of the next tier, until each group has one. Proofs come down the same way: a tier's blocks
are co-grouped with the steps of their roots, and each node gets the steps within its block and those above.
A group of n rows needs log(n) / BLOCK_LEVELS tiers; nothing but one number per tier reaches the driver.

Defined cases: a null field counts as `-`; a null doc_id comes first and is never tampered with; rows of equal doc_id
go by their leaf; repeated rows are leaves of their own; a null language is a group, before all others; an empty table
has no rows; a null n_chars can't be tampered with; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table, stored

#: Levels of the tree in one block: 1,024 leaves.
BLOCK_LEVELS = 10
LEFT, RIGHT, ALONE = "L", "R", "-"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(n_chars: Column | str = "n_chars") -> Column:
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col(n_chars) if isinstance(n_chars, str) else n_chars, F.col("text")]
    return F.sha2(F.concat(*map(_field, fields)), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with pos (from 0, within their group by `order`) and n (the rows of their group), without a task that
    reads a whole group."""
    rows = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("row_no", F.monotonically_increasing_id())
    rows = stored(rows.withColumns({"part": F.shiftright("row_no", 33), "row_no": F.col("row_no").bitwiseAND((1 << 33) - 1)}), "merkle-sorted")
    parts = rows.groupBy(group, "part").agg(F.count("*").alias("here"), F.min("row_no").alias("first"))
    # one row for each group and partition
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"before": F.coalesce(F.sum("here").over(before), F.lit(0)), "n": F.sum("here").over(Window.partitionBy(group))})
    # a group's rows of one partition are joined on both keys, so a large group is spread as its partitions are
    parts = parts.select(group, "part", (F.col("before") - F.col("first")).alias("shift"), "n")
    return rows.join(parts, [group, "part"]).withColumn("pos", F.col("row_no") + F.col("shift")).drop("row_no", "part", "shift")


def _height(n: int) -> int:
    """Levels above n nodes until one is left."""
    return (n - 1).bit_length()


@lru_cache(maxsize=1)
def _db() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})


def clear_state() -> None:
    _db.cache_clear()


LEVEL_SQL = "SELECT pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {below} GROUP BY pos // 2"
STEP_SQL = """
SELECT t.* REPLACE (list_append(t.steps, CASE WHEN s.h IS NULL THEN '-' WHEN (t.pos >> {level}) % 2 = 1 THEN 'L' || s.h ELSE 'R' || s.h END) AS steps)
FROM {rows} AS t LEFT JOIN level{level} AS s ON s.pos = xor(t.pos >> {level}, 1)
"""
FOLD_SQL = "list_reduce(list_prepend({leaf}, steps), lambda h, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || h) WHEN s[1] = 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END)"


def _levels(rows: pa.Table, height: int) -> None:
    """Tables level0 to level<height> of a block's nodes (pos, h) in this task's connection; the last has its root."""
    db = _db()
    db.register("given", rows)
    db.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT pos, h FROM given")
    db.unregister("given")
    for i in range(height):
        db.execute(f"CREATE OR REPLACE TEMP TABLE level{i + 1} AS " + LEVEL_SQL.format(below=f"level{i}"))


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """key, pos, h, n: of each block of nodes its root, as a node of the next tier."""

    def run(block: pa.Table) -> pa.Table:
        n = block["n"][0].as_py()
        height = min(_height(n), levels)
        _levels(block.select(["pos", "h"]), height)
        h = _db().sql(f"SELECT h FROM level{height}").fetchall()[0][0]
        return pa.table({"key": block["key"][:1], "pos": block["block"][:1], "h": [h], "n": pa.array([-(-n // (1 << levels))], pa.int64())})

    blocks = nodes.select("key", "n", "h", "pos", F.shiftright("pos", levels).alias("block"))
    return stored(blocks.groupBy("key", "block").applyInArrow(run, "key string, pos long, h string, n long"), "merkle-roots")


def tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The tiers of a tree above each group: nodes themselves first; of the last one each group has one node."""
    out = [nodes.select("key", "pos", "h", "n")]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(_roots(out[-1], levels))
    return out


def _block_steps(mine: pa.Table, above: pa.Table, levels: int) -> tuple[str, list[str], str | None]:
    """(the table, in this task's connection, of a block's rows with the steps within the block; the steps above; the
    group's root)."""
    db = _db()
    height = min(_height(mine["n"][0].as_py()), levels)
    _levels(mine.select(["pos", "h"]), height)
    db.register("given", mine)
    db.execute("CREATE OR REPLACE TEMP TABLE rows0 AS SELECT *, []::VARCHAR[] AS steps FROM given")
    db.unregister("given")
    for i in range(height):
        db.execute(f"CREATE OR REPLACE TEMP TABLE rows{i + 1} AS " + STEP_SQL.format(level=i, rows=f"rows{i}"))
    return f"rows{height}", above["steps"][0].as_py(), above["subroot"][0].as_py()


def _met(nodes: DataFrame, above: DataFrame, levels: int, sql: str, schema: str) -> DataFrame:
    """sql, over a block's rows and their steps up to the root, for each block of nodes. above: key, pos, steps,
    subroot of the blocks' roots."""
    want = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}[c.split()[1]]) for c in schema.split(", ")])

    def run(mine: pa.Table, upper: pa.Table) -> pa.Table:
        if not len(mine) or not len(upper):
            return want.empty_table()
        rows, more, subroot = _block_steps(mine.drop_columns(["block"]), upper, levels)
        rows = f"(SELECT * REPLACE (list_concat(steps, $more::VARCHAR[]) AS steps), $subroot::VARCHAR AS subroot FROM {rows})"
        return _db().sql(sql.format(rows=rows), params={"more": more, "subroot": subroot}).to_arrow_table().cast(want)

    blocks = nodes.withColumn("block", F.shiftright("pos", levels))
    return blocks.groupBy("key", "block").cogroup(above.withColumnRenamed("pos", "block").groupBy("key", "block")).applyInArrow(run, schema)


def steps(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """key, pos, steps, subroot: the steps from each node to the root, given those of its block's root."""
    return stored(_met(nodes, above, levels, "SELECT key, pos, steps, subroot FROM {rows}", "key string, pos long, steps array<string>, subroot string"), "merkle-steps")


PROOF_SQL = (
    "SELECT doc_id, h AS leaf, subroot, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256, "
    f"{FOLD_SQL.format(leaf='coalesce(changed, h)')} AS folded_root FROM {{rows}}"
)


def manifest(docs: DataFrame, tampered: Column, levels: int = BLOCK_LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row. tampered: which rows are given
    one more in n_chars before they are proved against the untampered tree."""
    changed = F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    # a null language has the empty key, any other one begins with +
    key = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    # texts are read and hashed once: the range sort looks at its rows twice
    hashed = stored(docs.select(key.alias("key"), "doc_id", leaf().alias("h"), changed.alias("changed")), "merkle-hashed")
    leaves = stored(numbered(hashed, "key", "doc_id", "h"), "merkle-leaves")
    low = tiers(leaves, levels)
    # the languages' tree: one group, whose nodes are the subroots
    langs = stored(numbered(low[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "h"), "key", "of"), "merkle-langs")
    high = tiers(langs, levels)
    root = high[-1].select("h").first()
    # down again: above the root there is no step
    none = F.lit(None).cast("string").alias("subroot")
    above = high[-1].select("key", "pos", F.array().cast("array<string>").alias("steps"), none)
    for tier in high[-2::-1]:
        above = steps(tier, above, levels)
    above = langs.join(above.drop("subroot"), ["key", "pos"]).select(F.col("of").alias("key"), F.lit(0).cast("long").alias("pos"), "steps", F.col("h").alias("subroot"))
    for tier in low[-2:0:-1]:
        above = steps(tier, above, levels)
    proved = _met(leaves, above, levels, PROOF_SQL, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    root = F.lit(root.h if root else None).cast("string")
    return proved.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


OP13_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS key, n_chars,
    [CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END FOR x IN [doc_id::VARCHAR, source, lang]] AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: [ascii((doc_id::VARCHAR)[i]), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
      lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, key, sha256(array_to_string(head, '') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(array_to_string(head, '') || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR || tail) END AS changed
  FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaves),
low(key, level, pos, h, n) AS (
  SELECT key, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT key, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY key, level, pos // 2, n),
subroots AS (SELECT key, h, level AS height, row_number() OVER (ORDER BY key) - 1 AS seat, count(*) OVER () AS langs FROM low WHERE n = 1),
high(level, pos, h, n) AS (
  SELECT 0, seat, h, langs FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2, n),
places AS (
  SELECT p.doc_id, p.pos, p.key, p.leaf, p.changed, s.h AS subroot, unnest(range(0, s.height + (SELECT max(level) FROM high))) AS step, s.height, s.seat FROM placed AS p JOIN subroots AS s USING (key)),
steps AS (
  SELECT w.*, CASE WHEN step < height THEN pos >> step ELSE seat >> (step - height) END AS place FROM places AS w),
met AS (
  SELECT s.*, CASE WHEN step < height THEN l.h ELSE u.h END AS sibling
  FROM steps AS s LEFT JOIN low AS l ON l.key = s.key AND l.level = s.step AND l.pos = xor(s.place, 1) AND s.step < s.height
  LEFT JOIN high AS u ON u.level = s.step - s.height AND u.pos = xor(s.place, 1) AND s.step >= s.height),
proofs AS (
  SELECT key, pos, list(CASE WHEN sibling IS NULL THEN '-' WHEN place % 2 = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY step) AS steps FROM met GROUP BY key, pos),
done AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(p.changed, p.leaf) AS given, coalesce(q.steps, []) AS steps
  FROM placed AS p JOIN subroots AS s USING (key) LEFT JOIN proofs AS q ON q.key = p.key AND q.pos = p.pos)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
  list_reduce(list_prepend(given, steps), lambda h, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || h) WHEN s[1] = 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) AS folded_root,
  list_reduce(list_prepend(given, steps), lambda h, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || h) WHEN s[1] = 'R' THEN sha256(h || s[2:]) ELSE sha256(h) END) = root AS verified
FROM done
"""
