"""Queries of block XML: runs, sections, findings bound to nodes, patches checked and put in; with their SQL.

The documents are the Chinese corpus's lines as blocks; the SQL works on the lines, without XML.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import xmltree as X
from ..sources.corpus import ZH_SQL, zh_corpus

QUERIES, SQL = {}, {}
WORDS = ["说明", "非常", "可能", "左右", "简直", "系统"]


def query(name: str, sql: str):
    def keep(run):
        QUERIES[name], SQL[name] = run, sql
        return run

    return keep


_TAG = "CASE WHEN raw LIKE '#%' THEN concat('h', CAST(length(regexp_extract(raw, '^(#+)', 1)) AS VARCHAR(9))) WHEN raw LIKE '> %' THEN 'blockquote' WHEN raw LIKE '- %' THEN 'li' ELSE 'p' END"
_TEXT = "trim(regexp_replace(raw, '^(#+|>|-) ', ''))"


def xml_corpus(spark, sf_dir: str) -> DataFrame:
    """doc_id, xml: each line of a document of the corpus is a block."""
    block = F.concat(F.lit("<"), "tag", F.lit(' id="b'), "ln", F.lit('">'), "text", F.lit("</"), "tag", F.lit(">"))
    rows = zh_corpus(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "raw"))
    rows = rows.select("doc_id", (F.col("i") + 1).alias("ln"), F.expr(_TAG).alias("tag"), F.expr(_TEXT).alias("text"))
    return rows.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ln", block.alias("x"))))["x"], "").alias("xml"))


_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM ({ZH_SQL}))),
b AS (SELECT doc_id, ln, ln - 1 AS pos, concat('b', ln) AS block_id, {_TAG} AS tag, {_TEXT} AS text FROM lines),
s AS (SELECT *, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2) AS INTEGER) + 1 WHEN tag = 'p' THEN 0 ELSE 2 END AS prefix, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2) AS INTEGER) END AS level FROM b),
r AS (SELECT *, row_number() OVER w AS nth, coalesce(sum(prefix + len(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + prefix AS start FROM s WHERE text <> '' OR prefix > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT a.doc_id, a.pos, a.level, a.text AS title, (SELECT max(c.pos) FROM s c WHERE c.doc_id = a.doc_id AND c.pos < a.pos AND c.level < a.level) AS parent FROM s a WHERE a.level IS NOT NULL),
t AS (SELECT *, concat(title, '[', row_number() OVER (PARTITION BY doc_id, parent, title ORDER BY pos), ']') AS step FROM h),
u AS (SELECT t.doc_id, t.pos AS at, t.level, t.title, CASE WHEN q.step IS NULL THEN t.step ELSE concat(q.step, '/', t.step) END AS locator,
  coalesce((SELECT min(n.pos) FROM h n WHERE n.doc_id = t.doc_id AND n.pos > t.pos AND n.level <= t.level), 1000000) AS upto FROM t LEFT JOIN t q ON q.doc_id = t.doc_id AND q.pos = t.parent),
e AS (SELECT * FROM u UNION ALL SELECT doc_id, -1, 0, '{X.LEAD_IN}', '{X.LEAD_IN}', coalesce((SELECT min(pos) FROM h WHERE h.doc_id = d.doc_id), 1000000) FROM (SELECT DISTINCT doc_id FROM s) d),
v AS (SELECT e.doc_id, e.at, e.locator, e.title, e.level, min(s.pos) AS first, max(s.pos) AS last, concat('sha256:', sha256(string_agg(concat('<', s.tag, '>', s.text, '</', s.tag, '>'), '' ORDER BY s.pos))) AS fingerprint
  FROM e JOIN s ON s.doc_id = e.doc_id AND s.pos >= e.at AND s.pos < e.upto GROUP BY ALL),
words AS (SELECT unnest({WORDS!r}) AS found),
f AS (SELECT r.doc_id, r.block_id, r.pos, r.text, r.tag, CAST(2 * nth - 1 AS INTEGER) AS ln, found, CAST(strpos(r.text, found) - 1 AS INTEGER) AS source_start, CAST(strpos(r.text, found) - 1 + len(found) AS INTEGER) AS source_end,
  count_if(r.tag NOT LIKE 'h%') OVER (PARTITION BY r.doc_id, found) AS n, (SELECT max_by(v.locator, v.at) FROM v WHERE v.doc_id = r.doc_id AND v.first <= r.pos AND v.last >= r.pos) AS locator FROM r JOIN words ON contains(r.text, found)),
g AS (SELECT *, CASE WHEN tag LIKE 'h%' THEN 'unsupported_block' WHEN n > 1 THEN 'duplicate_source' ELSE 'exact' END AS status FROM f),
plan AS (SELECT doc_id, min_by(locator, concat(lpad(CAST(ln AS VARCHAR), 4, '0'), found)) AS plan_locator FROM g WHERE status = 'exact' GROUP BY doc_id),
k AS (SELECT g.*, plan_locator, CASE WHEN g.doc_id % 7 = 0 THEN 'section_changed' WHEN g.doc_id % 5 = 0 THEN 'noop_patch' WHEN locator <> plan_locator THEN 'block_outside_section' WHEN status = 'unsupported_block' THEN 'unsupported_block' WHEN status <> 'exact' THEN 'finding_mismatch' END AS failure
  FROM g JOIN plan USING (doc_id))
"""


def _bound(spark, sf_dir):
    docs = xml_corpus(spark, sf_dir)
    runs, rows = X.runs(docs), X.placed(X.blocks(docs))
    owned = X.owners(rows)
    text = runs.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", "text")))["text"], "").alias("text"))
    lines = text.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    found = lines.select("doc_id", (F.col("i") + 1).alias("ln"), "line", F.explode(F.array(*map(F.lit, WORDS))).alias("found")).where(F.contains("line", "found"))
    found = found.select("doc_id", F.concat(F.lpad(F.col("ln").cast("string"), 4, "0"), "found").alias("finding_id"), "ln", F.expr("instr(line, found)").alias("col"), "found")
    return docs, runs, rows, owned, found, X.bind(found, runs, owned)


@query("xml_runs", _SQL + "SELECT doc_id, block_id, '' AS path, CAST(start AS INTEGER) AS start, CAST(start + len(text) AS INTEGER) AS end_, text, tag NOT LIKE 'h%' AS writable FROM r WHERE text <> ''")
def xml_runs(spark, sf_dir):
    return X.runs(xml_corpus(spark, sf_dir)).where("path IS NOT NULL").select("doc_id", "block_id", "path", "start", "end_", "text", "writable")


@query("xml_sections", _SQL + "SELECT doc_id, locator, title, CAST(level AS INTEGER) AS level, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, fingerprint FROM v")
def xml_sections(spark, sf_dir):
    return X.sections(X.placed(X.blocks(xml_corpus(spark, sf_dir))))


@query("xml_bound_findings", _SQL + "SELECT doc_id, ln, found, status, status = 'exact' AS writable, block_id, source_start, source_end, locator FROM g")
def xml_bound_findings(spark, sf_dir):
    _, _, _, _, found, bound = _bound(spark, sf_dir)
    return bound.join(found, ["doc_id", "finding_id"]).select("doc_id", "ln", "found", "status", "writable", "block_id", "source_start", "source_end", "locator")


def _patches(spark, sf_dir):
    """One patch for each finding, the plan of a document being the section of its first exact finding."""
    docs, runs, rows, owned, found, bound = _bound(spark, sf_dir)
    parts = X.sections(rows)
    found = found.withColumn("rule", F.lit("E001"))
    plans = bound.where("status = 'exact'").groupBy("doc_id").agg(F.min_by("locator", "finding_id").alias("locator")).join(parts, ["doc_id", "locator"])
    plans = plans.select("doc_id", F.col("locator").alias("plan_locator"), F.when(F.col("doc_id") % 7 == 0, "sha256:0").otherwise(F.col("fingerprint")).alias("plan_fingerprint"))
    made = bound.select("doc_id", "finding_id", "block_id", "path", "source_start", "source_end").join(found, ["doc_id", "finding_id"]).join(plans, "doc_id")
    made = made.select(
        "doc_id", F.col("finding_id").alias("patch_id"), F.row_number().over(X.Window.partitionBy("doc_id").orderBy("finding_id")).alias("seq"), F.col("plan_locator").alias("locator"),
        F.col("plan_fingerprint").alias("fingerprint"), "block_id", "path", "source_start", "source_end", F.col("found").alias("before"), F.when(F.col("doc_id") % 5 == 0, F.col("found")).otherwise("很").alias("after"), "rule",
    )
    return docs, made, plans, parts, X.patch_failures(made, plans, runs, parts, owned, found, bound)


@query("xml_patch_failures", _SQL + "SELECT doc_id, concat(lpad(CAST(ln AS VARCHAR), 4, '0'), found) AS patch_id, failure FROM k")
def xml_patch_failures(spark, sf_dir):
    return _patches(spark, sf_dir)[-1]


_CHANGED = "s.text"
for _w in WORDS:
    _CHANGED = f"CASE WHEN list_contains(c.words, '{_w}') THEN regexp_replace({_CHANGED}, '{_w}', '很') ELSE {_CHANGED} END"


@query("xml_revised", _SQL + f"""
, c AS (SELECT doc_id, block_id, list(found) AS words, any_value(plan_locator) AS plan_locator FROM k WHERE failure IS NULL GROUP BY ALL),
o AS (SELECT doc_id, any_value(plan_locator) AS locator FROM c GROUP BY doc_id),
x AS (SELECT s.doc_id, s.pos, s.tag, s.block_id, {_CHANGED} AS new, v.first, v.last FROM o JOIN v USING (doc_id, locator) JOIN s USING (doc_id) LEFT JOIN c ON c.doc_id = s.doc_id AND c.block_id = s.block_id)
SELECT doc_id, string_agg(CASE WHEN new = '' THEN concat('<', tag, ' id="', block_id, '" />') ELSE concat('<', tag, ' id="', block_id, '">', new, '</', tag, '>') END, '' ORDER BY pos) AS revised,
  concat('sha256:', sha256(string_agg(concat('<', tag, '>', new, '</', tag, '>'), '' ORDER BY pos) FILTER (WHERE pos BETWEEN first AND last))) AS fingerprint FROM x GROUP BY doc_id
""")
def xml_revised(spark, sf_dir):
    docs, made, plans, parts, failures = _patches(spark, sf_dir)
    good = made.join(failures.where("failure IS NULL").select("doc_id", "patch_id"), ["doc_id", "patch_id"])
    return X.patched(docs, good, plans, parts).select("doc_id", "revised", F.element_at("fingerprints", -1).alias("fingerprint"))
