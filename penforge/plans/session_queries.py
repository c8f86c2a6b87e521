"""Queries of review sessions and of recorded documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions, review, sessions
from ..sources import documents
from ..sources.corpus import ZH_SQL, zh_corpus
from ..streaming.jobs import shared_folder

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(run):
        QUERIES[name], SQL[name] = run, sql
        return run

    return keep


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("document_source", """
SELECT CASE WHEN error IS NULL THEN concat('doc', page_id) END AS document_id, CASE WHEN error IS NULL THEN page_id % 9 END AS revision,
       CASE WHEN error IS NULL THEN concat('https://docs.example.org/docx/doc', page_id) END AS url, CASE WHEN error IS NULL THEN md5(concat('<doc>', coalesce(html, ''), '</doc>')) END AS xml_md5, error
FROM (SELECT *, CASE WHEN page_id % 13 = 0 THEN 'json' WHEN page_id % 11 = 0 THEN 'conflict' WHEN page_id % 5 = 0 THEN 'ambiguous_content' WHEN page_id % 9 = 0 THEN 'invalid_response' END AS error FROM pages)
""")
def document_source(spark, sf_dir):
    """Pages as answers of a gateway, written as a recording and read through the source."""
    xml = F.concat(F.lit("<doc>"), F.coalesce("html", F.lit("")), F.lit("</doc>"))
    name = F.concat(F.lit("doc"), F.col("page_id"))
    old = F.when(F.col("page_id") % 5 == 0, "another").when(F.col("page_id") % 7 == 0, xml)
    new = F.when((F.col("page_id") % 5 == 0) | (F.col("page_id") % 7 != 0), xml)
    document = F.struct(name.alias("document_id"), (F.col("page_id") % 9).alias("revision_id"), new.alias("content"))
    answer = F.to_json(F.struct(F.lit(True).alias("ok"), F.struct(document.alias("document"), old.alias("content")).alias("data")))
    answer = F.when(F.col("page_id") % 11 == 0, '{"ok": false, "error": {"type": "conflict"}}').otherwise(answer)
    line = F.to_json(F.struct(F.concat(F.lit("https://docs.example.org/docx/"), name).alias("input_url"), answer.alias("answer")))
    path = shared_folder(spark, "recording")
    _table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 13 == 0, "{").otherwise(line).alias("value")).write.text(path)
    found = documents.documents(spark, path, ["docs.example.org"])
    return found.select("document_id", "revision", "url", F.md5("xml").alias("xml_md5"), "error")


@query("rewrite_conflicts", r"""
WITH RECURSIVE c AS (SELECT doc_id, text, k, CASE WHEN k % 2 = 1 THEN 'semantic' ELSE 'static' END AS lane, (doc_id * 7 * k + k * k * k) % (len(text) - 20) AS pos, 3 + (doc_id + k) % 9 AS n FROM documents, range(1, 9) r(k) WHERE len(text) > 40),
d AS (SELECT *, substr(text, pos + 1, n) AS before, CASE WHEN k % 3 = 0 THEN '' ELSE concat('<', substr(text, pos + 1, n), '>') END AS after, CASE WHEN k = 4 THEN 'VERIFY' ELSE 'REWRITE' END AS action FROM c),
e AS (SELECT doc_id, lane, k, pos, n, action, after, row_number() OVER (PARTITION BY doc_id ORDER BY lane DESC, k) AS i,
  regexp_extract_all(before, '[+\-−]?\p{Nd}+(?:[.,:/-]\p{Nd}+)*[%％]?') <> regexp_extract_all(after, '[+\-−]?\p{Nd}+(?:[.,:/-]\p{Nd}+)*[%％]?') AS changed FROM d),
s AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(a BIGINT, b BIGINT)[]) AS taken, CAST('' AS VARCHAR) AS state FROM documents WHERE len(text) > 40
  UNION ALL
  SELECT doc_id, i, CASE WHEN state = 'taken' THEN list_append(taken, {'a': pos, 'b': pos + n}) ELSE taken END, state FROM (
    SELECT e.doc_id, e.i, e.pos, e.n, s.taken, CASE WHEN e.action <> 'REWRITE' THEN 'kept' WHEN e.changed THEN 'numeric' WHEN len(list_filter(s.taken, lambda t: e.pos < t.b AND e.pos + e.n > t.a)) > 0 THEN 'overlap' ELSE 'taken' END AS state
    FROM s JOIN e ON e.doc_id = s.doc_id AND e.i = s.i + 1))
SELECT doc_id, lane, CAST(k AS INTEGER) AS seq, CAST(pos AS INTEGER) AS at, CASE WHEN state IN ('numeric', 'overlap') THEN 'ASK' ELSE action END AS action, CASE WHEN state IN ('numeric', 'overlap') THEN '' ELSE after END AS after,
  CASE WHEN state = 'numeric' THEN 1 WHEN state = 'overlap' THEN 2 ELSE 0 END AS why FROM s JOIN e USING (doc_id, i)
""")
def rewrite_conflicts(spark, sf_dir):
    """Eight rewrites of each document, some of them one upon another, settled lane by lane."""
    docs = _table(spark, sf_dir, "documents").where(F.length("text") > 40)
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("seq"))
    rows = rows.withColumns({"source_start": F.expr("CAST((doc_id * 7 * seq + seq * seq * seq) % (length(text) - 20) AS INT)"), "n": F.expr("CAST(3 + (doc_id + seq) % 9 AS INT)")})
    rows = rows.withColumn("before", F.expr("substring(text, source_start + 1, n)"))
    made = rows.select(
        "doc_id", F.expr("CASE WHEN seq % 2 = 1 THEN 'semantic' ELSE 'static' END AS lane"), "seq", F.expr("CASE WHEN seq = 4 THEN 'VERIFY' ELSE 'REWRITE' END AS action"), "before",
        F.expr("CASE WHEN seq % 3 = 0 THEN '' ELSE concat('<', before, '>') END AS after"), F.lit("").alias("reason"), "source_start",
    )
    settled = decisions.resolve_rewrites(made, docs, review.numbers_changed)
    why = F.when(F.col("reason") == decisions.NUMERIC, 1).when(F.col("reason") == decisions.OVERLAPS, 2).otherwise(0)
    return settled.select("doc_id", "lane", "seq", "at", "action", "after", why.alias("why"))


@query("session_fingerprints", """
SELECT doc_id, sha256(concat('["', sha256(coalesce(text, '')), '", "general", "', source, '", "m-', lang, '", "https://models.example.org/v1", ', CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE concat('"w', doc_id % 3, '"') END, ', ', CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END, ']')) AS fingerprint FROM documents
""")
def session_fingerprints(spark, sf_dir):
    model = F.concat(F.lit("  m-"), "lang", F.lit("\n"))
    workspace = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("w"), F.col("doc_id") % 3))
    made = sessions.fingerprint(F.col("text"), F.lit("general"), F.col("source"), model, F.lit(" https://models.example.org/v1// "), workspace, F.col("doc_id") % 3 != 0)
    return _table(spark, sf_dir, "documents").select("doc_id", made.alias("fingerprint"))


@query("retained_choices", """
SELECT user_id AS doc_id, event_id AS id, CASE event_id % 4 WHEN 0 THEN 'accepted' ELSE 'rejected' END AS choice FROM events
WHERE event_id % 4 < 2 AND event_type <> 'error' AND event_id % 3 <> 0 AND event_id % 7 <> 0 AND (event_id % 11 <> 0 OR event_id % 5 = 0)
""")
def retained_choices(spark, sf_dir):
    result = _table(spark, sf_dir, "events").selectExpr(
        "user_id AS doc_id", "event_id AS id", "CASE event_type WHEN 'error' THEN 'ASK' ELSE 'REWRITE' END AS action", "event_type AS before", "props AS after", "CASE WHEN event_id % 5 <> 0 THEN event_id % 17 END AS source_start"
    )
    changed = result.where("id % 3 <> 0").withColumns({"after": F.expr("CASE WHEN id % 7 = 0 THEN concat(after, '!') ELSE after END"), "source_start": F.expr("CASE WHEN id % 11 = 0 THEN source_start + 1 ELSE source_start END")})
    choices = result.selectExpr("doc_id", "id", "CASE id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'pending' END AS choice")
    return sessions.retained_choices(result, changed, choices)


@query("result_totals", """
WITH d AS (SELECT user_id AS session, count(*) AS n_decisions, CAST(count_if(event_type = 'view') AS BIGINT) AS n_semantic FROM events WHERE event_type <> 'purchase' GROUP BY 1), b AS (SELECT user_id AS session, CAST(sum(event_id % 12) AS BIGINT) AS model_calls FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT session, coalesce(n_decisions, 0) AS n_decisions, coalesce(n_semantic, 0) AS n_semantic, coalesce(model_calls, 0) AS model_calls FROM d FULL JOIN b USING (session)
""")
def result_totals(spark, sf_dir):
    events = _table(spark, sf_dir, "events").withColumnRenamed("user_id", "session")
    made = events.where("event_type <> 'purchase'").selectExpr("session", "CASE WHEN event_type <> 'view' THEN event_id END AS finding_id")
    return sessions.result_totals(made, events.where("event_type = 'purchase'").selectExpr("session", "event_id % 12 AS calls"))


@query("scan_latencies", "SELECT event_type AS name, count(value) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def scan_latencies(spark, sf_dir):
    rows = sessions.latencies(_table(spark, sf_dir, "events").selectExpr("event_type AS name", "value AS ms"))
    return rows.withColumn("median", F.round("median", 6))


_FEEDBACK = "SELECT event_id, concat('R', user_id % 9) AS rule_id, CASE event_type WHEN 'view' THEN 'KEEP' WHEN 'click' THEN 'REWRITE' WHEN 'error' THEN 'VERIFY' ELSE 'ASK' END AS decision FROM {events}"


@query("feedback_totals", f"""
SELECT rule_id, grouping(rule_id) = 1 AS is_total, count(*) AS total, {', '.join(f"CAST(count_if(decision = '{d}') AS BIGINT) AS n_{d.lower()}" for d in review.DECISIONS)}, CAST(count_if(decision = 'KEEP') AS DOUBLE) / count(*) AS keep_rate
FROM ({_FEEDBACK.format(events='events')}) GROUP BY ROLLUP (rule_id)
""")
def feedback_totals(spark, sf_dir):
    return sessions.feedback_totals(spark.sql(_FEEDBACK, events=_table(spark, sf_dir, "events")))


def _demo_sql() -> str:
    quoted = lambda *v: ", ".join(f"'{x}'" for x in v)
    times = "(len(text) - len(replace(text, '{0}', ''))) = len('{0}')"
    actions = [f"CASE WHEN {times.format(b)} THEN 'REWRITE:{b}' END" for b, _, _ in sessions.DEMO_REWRITES] + [f"CASE WHEN contains(text, '{b}') THEN {quoted(a + ':' + b)} END" for b, a, _ in sessions.DEMO_QUESTIONS]
    revised = "text"
    for before, after, _ in sessions.DEMO_REWRITES:
        revised = f"CASE WHEN {times.format(before)} THEN replace({revised}, '{before}', '{after}') ELSE {revised} END"
    return f"SELECT doc_id, concat_ws('|', {', '.join(actions)}) AS decisions, {revised} AS revised FROM ({ZH_SQL})"


@query("demo_walkthrough", _demo_sql())
def demo_walkthrough(spark, sf_dir):
    rows = sessions.demo_decisions(zh_corpus(spark, sf_dir))
    return rows.select("doc_id", F.array_join(F.transform("decisions", lambda d: F.concat(d["action"], F.lit(":"), d["before"])), "|").alias("decisions"), "revised")


@query("workspace_list_files", """
SELECT path, place, CASE WHEN 60 < total_matches THEN CAST(60 AS BIGINT) END AS next_cursor, total_matches FROM (SELECT path, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place, count(*) OVER () AS total_matches
FROM (SELECT concat(page_id, '/', url) AS path FROM pages) WHERE contains(lower(path), 'example')) WHERE place > 30 AND place <= 60
""")
def workspace_list_files(spark, sf_dir):
    return sessions.list_files(_table(spark, sf_dir, "pages").select(F.concat_ws("/", F.col("page_id").cast("string"), "url").alias("path")), "EXAMPLE", 30, 30)
