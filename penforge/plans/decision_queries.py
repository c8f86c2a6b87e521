"""Queries of the rewrite algebra and of feedback records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, review
from ..sources import files
from ..sources.corpus import ZH_SQL, zh_corpus

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(run):
        QUERIES[name], SQL[name] = run, sql
        return run

    return keep


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


@query("decision_coverage", """
WITH f AS (SELECT DISTINCT event_id % 900 AS finding_id, concat('R', event_id % 900 % 7) AS rule FROM events WHERE event_type = 'click'),
d AS (SELECT event_id % 1000 AS finding_id, count(*) AS n, min(concat('R', event_id % 1000 % 7 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END)) AS decided FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT finding_id, CASE WHEN n IS NULL THEN 'missing' WHEN rule IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN rule <> decided THEN 'rule' ELSE 'ok' END AS state FROM f FULL JOIN d USING (finding_id)
""")
def decision_coverage(spark, sf_dir):
    rows = _events(spark, sf_dir)
    found = rows.where("event_type = 'click'").selectExpr("event_id % 900 AS finding_id", "concat('R', event_id % 900 % 7) AS rule").distinct()
    made = rows.where("event_type = 'view'").selectExpr("event_id % 1000 AS finding_id", "concat('R', event_id % 1000 % 7 + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS rule")
    return decisions.coverage(found, made)


@query("decision_ids", """
SELECT event_id, CASE WHEN event_type = 'click' THEN concat('static-', event_id) ELSE concat('semantic-', user_id, '-', substr(sha256(concat('["', event_type, '", "', replace(props, '"', '\\"'), '", "', user_id, '"]')), 1, 16)) END AS id FROM events
""")
def decision_ids(spark, sf_dir):
    number = F.when(F.col("event_type") == "click", F.col("event_id"))
    made = decisions.decision_id(number, F.col("user_id"), F.col("event_type"), F.col("props"), F.col("user_id").cast("string"))
    return _events(spark, sf_dir).select("event_id", made.alias("id"))


@query("feedback_checked", """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'json' WHEN event_id % 12 = 0 THEN 'object' WHEN event_id % 11 = 0 THEN 'schema_version' WHEN event_type = 'error' THEN 'decision' WHEN event_id % 7 = 0 THEN 'rule' WHEN event_id % 5 = 0 THEN 'line' END AS error FROM events
""")
def feedback_checked(spark, sf_dir):
    name = "CASE event_type WHEN 'error' THEN 'NONE' WHEN 'view' THEN 'KEEP' ELSE 'ASK' END"
    text = f"""CASE WHEN event_id % 13 = 0 THEN '{{' WHEN event_id % 12 = 0 THEN '[]' ELSE concat('{{"schema_version": ', CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END, ', "decision": "', {name}, '", "rule": "', CASE WHEN event_id % 7 = 0 THEN ' ' ELSE 'C001' END,
      '", "file": "a.md", "line": ', CASE WHEN event_id % 5 = 0 THEN '0' ELSE '3' END, ', "column": 1, "text": "", "reason": "", "profile": "general", "recorded_at": ""}}') END"""
    return _events(spark, sf_dir).select("event_id", files.feedback_error(F.expr(text)).alias("error"))


@query("revised_documents", f"SELECT doc_id, replace(replace(text, '非常', ''), '十分', '很') AS revised FROM ({ZH_SQL}) WHERE len(text) - len(replace(text, '非常', '')) <= 2 AND len(text) - len(replace(text, '十分', '')) <= 2")
def revised_documents(spark, sf_dir):
    docs = zh_corpus(spark, sf_dir)
    once = lambda w: f"length(text) - length(replace(text, '{w}', '')) <= 2"
    docs = docs.where(once("非常") + " AND " + once("十分"))
    row = lambda n, w, new: F.struct(F.lit("static").alias("lane"), F.lit(n).alias("seq"), F.lit("REWRITE").alias("action"), F.lit(w).alias("before"), F.lit(new).alias("after"), F.lit("").alias("reason"), F.lit(None).cast("int").alias("source_start"))
    made = docs.select("doc_id", F.explode(F.array(row(1, "非常", ""), row(2, "十分", "很"))).alias("d")).select("doc_id", "d.*")
    return decisions.revised_texts(decisions.resolve_rewrites(made, docs, review.numbers_changed), docs)


@query("segment_progress", """
WITH s AS (SELECT user_id AS doc_id, event_id AS seg_no, CAST(event_id % 50 AS INTEGER) AS start, CAST(event_id % 50 + event_id % 9 AS INTEGER) AS end_, event_type FROM events)
SELECT doc_id, count(*) AS total, CAST(count_if(event_type = 'click') AS BIGINT) AS completed, CAST(sum(CASE WHEN event_type = 'click' THEN end_ - start ELSE 0 END) AS BIGINT) AS reviewed_chars FROM s GROUP BY doc_id
""")
def segment_progress(spark, sf_dir):
    rows = _events(spark, sf_dir).selectExpr("user_id AS doc_id", "event_id AS seg_no", "CAST(event_id % 50 AS INT) AS start", "CAST(event_id % 50 + event_id % 9 AS INT) AS end_", "event_type")
    return decisions.progress(rows, rows.where("event_type = 'click'"))
