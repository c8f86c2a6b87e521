"""Every registered query of the review engine, and its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import rules
from ..operators import blockxml, decisions, lint, outline, report, review
from ..sources.corpus import ZH_SQL, zh_corpus
from ..streaming import jobs
from . import decision_queries, revision_queries, scan_queries, session_queries, xml_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = scan_queries.QUERIES | decision_queries.QUERIES | revision_queries.QUERIES | session_queries.QUERIES | xml_queries.QUERIES
SQL: dict[str, str] = scan_queries.SQL | decision_queries.SQL | revision_queries.SQL | session_queries.SQL | xml_queries.SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


# --- the lint, and SQL that finds the same without look-around -------------------------------------------------------

#: Rules whose SQL needs more than the literal: openers, what may not stand before, what must or may not follow.
_AROUND = {
    "C004": (["不仅", "不只是", "不单是", "不止是"], "", "[^。！？；\\n]{1,80}[，,][ \\t]*(更是|更|而是|还是|也)", ""),
    "R001": (["进行"], "", "(分析|讨论|研究|说明|处理|调查|测试|验证)", ""),
}
_M002 = [("先", "[优领祖神抢占争率首原]$", "", "[生进验导端烈贤天决知驱兆例后祖前]"), ("再", "不$", "", "[现生版造保就审]")]


def _literals(rule: str, patterns: list[str]) -> list[tuple[str, str, str, str]]:
    """(literal, not before, must follow, must not follow)."""
    if rule in _AROUND:
        words, before, follow, never = _AROUND[rule]
        return [(w, before, follow, never) for w in words]
    plain = [(p, "", "", "") for p in patterns if "(" not in p]
    return plain + (_M002 if rule == "M002" else [])


def findings_sql(profile: str, only: str | None = None) -> str:
    off, _, _ = rules.PROFILES[profile]
    values = []
    for rule, category, given, semantic, patterns, guard in rules.RULES:
        if rule == "D001" or rule in off or only not in (None, rule):
            continue
        never = guard.split(")", 1)[1] if guard and guard.startswith("(") else guard[len(patterns[0]) :] if guard else ""
        for n, (word, before, follow, after) in enumerate(_literals(rule, patterns)):
            values.append(f"('{rule}', '{category}', '{rules.severity(rule, given, semantic, profile)}', {n}, '{word}', '{before}', '{follow}', '{after or never}')")
    return f"""
WITH corpus AS ({ZH_SQL}),
rule_pattern(rule_id, category, severity, pat, word, before, follow, never) AS (VALUES {', '.join(values)}),
parts AS (SELECT doc_id, filename, string_split(text, chr(10)) AS p FROM corpus),
lines AS (SELECT doc_id, filename, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS raw FROM parts),
prose AS (SELECT * FROM lines WHERE trim(raw) <> '' AND NOT starts_with(raw, '#')),
cut AS (SELECT *, string_split(raw, word) AS q FROM prose, rule_pattern WHERE contains(raw, word)),
hit AS (SELECT *, unnest(list_transform(range(1, len(q)), lambda i: 1 + CAST(list_sum(list_transform(q[1:i], lambda x: len(x))) AS BIGINT) + (i - 1) * len(word))) AS col FROM cut),
ok AS (SELECT * FROM hit
  WHERE (before = '' OR NOT regexp_matches(substr(raw, 1, col - 1), before))
    AND (follow = '' OR regexp_matches(substr(raw, col + len(word)), '^(?:' || follow || ')'))
    AND (never = '' OR NOT regexp_matches(substr(raw, col + len(word)), '^(?:' || never || ')')))
SELECT doc_id, filename, CAST(ln AS INTEGER) AS ln, CAST(col AS INTEGER) AS col, rule_id, category, severity, arg_min(word, pat) AS found
FROM ok GROUP BY ALL
"""


def _lint(profile: str, only: str | None, spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint.lint(zh_corpus(spark, sf_dir), profile, only)


for _profile in rules.PROFILES:
    # D001 needs a back-reference, which the SQL of DuckDB lacks; it has a query of its own
    query(f"lint_findings_{_profile}", findings_sql(_profile))(
        lambda s, d, p=_profile: _lint(p, None, s, d).where("rule_id <> 'D001'")
    )
for _rule, *_ in rules.RULES:
    query(f"lint_rule_{_rule}", findings_sql("general", _rule) if _rule != "D001" else None)(partial(_lint, "general", _rule))


@query("findings_per_file", f"SELECT filename, count(*) AS n_findings FROM ({findings_sql('general')}) GROUP BY filename")
def findings_per_file(spark, sf_dir):
    return QUERIES["lint_findings_general"](spark, sf_dir).groupBy("filename").agg(F.count("*").alias("n_findings"))


_rank = "CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'suggestion' THEN 1 ELSE 0 END"


@query("severity_gate", f"SELECT doc_id, max({_rank}) AS worst, max({_rank}) >= 2 AS fails_warning FROM ({findings_sql('general')}) GROUP BY doc_id")
def severity_gate(spark, sf_dir):
    rank = F.expr(_rank)
    return QUERIES["lint_findings_general"](spark, sf_dir).groupBy("doc_id").agg(F.max(rank).alias("worst"), (F.max(rank) >= 2).alias("fails_warning"))


@query("finding_context", f"""
WITH f AS ({findings_sql('general')}), parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM ({ZH_SQL}))
SELECT f.doc_id, ln, col, rule_id, CASE WHEN ln > 1 THEN p[ln - 1] END AS before, CASE WHEN ln < len(p) THEN p[ln + 1] END AS after
FROM f JOIN parts USING (doc_id)
""")
def finding_context(spark, sf_dir):
    docs = zh_corpus(spark, sf_dir)
    near = lint.lines(docs, False).withColumns({"before": F.lag("raw").over(w := Window.partitionBy("doc_id").orderBy("ln")), "after": F.lead("raw").over(w)})
    return QUERIES["lint_findings_general"](spark, sf_dir).join(near.select("doc_id", "ln", "before", "after"), ["doc_id", "ln"]).select("doc_id", "ln", "col", "rule_id", "before", "after")


_LINES = f"SELECT doc_id, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM ({ZH_SQL}))"
_ROLE = "CASE WHEN trim(raw) = '' THEN 'blank' WHEN starts_with(raw, '#') THEN 'heading' WHEN starts_with(raw, '>') THEN 'blockquote' WHEN starts_with(raw, '- ') THEN 'list_item' ELSE 'paragraph' END"


@query("line_roles", f"SELECT doc_id, CAST(ln AS INTEGER) AS ln, {_ROLE} AS role FROM ({_LINES})")
def line_roles(spark, sf_dir):
    return lint.lines(zh_corpus(spark, sf_dir), False).select("doc_id", "ln", "role")


@query("masked_lines")
def masked_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("filename"), F.col("html").alias("text"))
    return lint.lines(docs.where("text IS NOT NULL")).select("doc_id", "ln", F.length("raw").alias("n_raw"), F.length("masked").alias("n_masked"))


_ISLANDS = f"""
SELECT doc_id, ln, raw, ln - row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS island FROM (SELECT *, {_ROLE} AS role FROM ({_LINES})) WHERE role = 'paragraph'
"""
_PARAGRAPHS = f"SELECT doc_id, CAST(min(ln) AS INTEGER) AS first_ln, count(*) AS n_lines, string_agg(raw, chr(10) ORDER BY ln) AS text FROM ({_ISLANDS}) GROUP BY doc_id, island"


@query("paragraph_islands", _PARAGRAPHS)
def paragraph_islands(spark, sf_dir):
    return lint.paragraphs(lint.lines(zh_corpus(spark, sf_dir), False))


@query("sentence_split", f"SELECT doc_id, first_ln, unnest(regexp_extract_all(text, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$')) AS sentence FROM ({_PARAGRAPHS})")
def sentence_split(spark, sf_dir):
    rows = paragraph_islands(spark, sf_dir).select("doc_id", "first_ln", F.explode(F.split("text", "(?<=[。！？!?；;])", -1)).alias("sentence"))
    return rows.where("sentence <> ''")


@query("long_sentences")
def long_sentences(spark, sf_dir):
    return lint.long_sentences(lint.lines(zh_corpus(spark, sf_dir), False), 15)


@query("heading_gaps", f"""
WITH h AS (SELECT doc_id, ln, regexp_extract(raw, '^(#+) ', 1) AS marks, regexp_extract(raw, '^#+ ([0-9]+)\\.', 1) AS number FROM ({_LINES}) WHERE regexp_matches(raw, '^#+ *[^# ]')),
s AS (SELECT *, lag(number) OVER (PARTITION BY doc_id, marks ORDER BY ln) AS prev FROM h)
SELECT doc_id, CAST(ln AS INTEGER) AS ln, prev, number FROM s WHERE number <> '' AND prev <> '' AND CAST(number AS INT) > CAST(prev AS INT) + 1
""")
def heading_gaps(spark, sf_dir):
    return lint.heading_gaps(lint.lines(zh_corpus(spark, sf_dir), False)).select("doc_id", "ln", "prev", "number")


@query("empty_headings", f"SELECT doc_id, CAST(ln AS INTEGER) AS ln FROM ({_LINES}) WHERE regexp_matches(raw, '^#+ *$')")
def empty_headings(spark, sf_dir):
    return lint.headings(lint.lines(zh_corpus(spark, sf_dir), False)).where("title = ''").select("doc_id", "ln")


@query("god_files", f"SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM ({ZH_SQL}) WHERE filename LIKE '%SKILL.md' AND len(string_split(text, chr(10))) > 5")
def god_files(spark, sf_dir):
    n = F.size(F.split("text", "\n", -1)).cast("long")
    return zh_corpus(spark, sf_dir).where(F.col("filename").endswith("SKILL.md") & (n > 5)).select("doc_id", n.alias("n_lines"))


# --- feedback, workspace, segments, decisions, events ----------------------------------------------------------------

_FEEDBACK = "SELECT concat('R', CAST(user_id % 17 AS VARCHAR(4))) AS rule_id, CASE event_type WHEN 'click' THEN 'KEEP' WHEN 'view' THEN 'KEEP' WHEN 'purchase' THEN 'REWRITE' WHEN 'signup' THEN 'VERIFY' ELSE 'ASK' END AS decision FROM events"


@query("feedback_keep_rate", f"""
SELECT rule_id, count(*) AS total, CAST(count_if(decision = 'KEEP') AS BIGINT) AS n_keep, CAST(count_if(decision = 'REWRITE') AS BIGINT) AS n_rewrite, CAST(count_if(decision = 'VERIFY') AS BIGINT) AS n_verify,
       CAST(count_if(decision = 'ASK') AS BIGINT) AS n_ask, CAST(CAST(count_if(decision = 'KEEP') AS BIGINT) AS DOUBLE) / count(*) AS keep_rate FROM ({_FEEDBACK}) GROUP BY rule_id
""")
def feedback_keep_rate(spark, sf_dir):
    return review.keep_rates(spark.sql(_FEEDBACK.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events")))


@query("workspace_search", """
WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
h AS (SELECT doc_id, ln, instr(lower(line), 'licensed') AS col FROM l WHERE contains(lower(line), 'licensed'))
SELECT doc_id, CAST(ln AS INTEGER) AS ln, CAST(col AS INTEGER) AS col FROM h ORDER BY doc_id, ln LIMIT 20
""")
def workspace_search(spark, sf_dir):
    return review.search(table(spark, sf_dir, "documents"), "licensed", 20)


@query("workspace_list_page", """
SELECT url, CAST(n AS INTEGER) AS place, total_matches FROM (SELECT url, row_number() OVER (ORDER BY url, page_id) AS n, count(*) OVER () AS total_matches FROM pages WHERE contains(lower(url), 'blog')) WHERE n > 10 AND n <= 40
""")
def workspace_list_page(spark, sf_dir):
    return review.list_page(table(spark, sf_dir, "pages"), "blog", 10, 30)


@query("workspace_read_page", """
WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
c AS (SELECT *, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) AS upto FROM l WHERE ln >= 2 AND ln < 202)
SELECT doc_id, CAST(ln AS INTEGER) AS ln, line FROM c WHERE upto <= 4000
""")
def workspace_read_page(spark, sf_dir):
    # the SQL asks for lines that fit with their line feed; workspace_read_part has the rest and the cursor
    rows = review.read_page(table(spark, sf_dir, "documents"), 2, 200, 4000)
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("ln"))
    return rows.withColumn("upto", upto).where("upto <= 4000").select("doc_id", "ln", "line")


@query("workspace_read_part", """
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
l AS (SELECT doc_id, len(p) AS total, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS line FROM p),
c AS (SELECT *, 4000 - coalesce(sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM l WHERE ln >= 2 AND ln < 202),
t AS (SELECT *, ln = max(ln) OVER (PARTITION BY doc_id) AS is_last FROM c WHERE room > 0),
n AS (SELECT doc_id, CASE WHEN len(line) > room THEN ln WHEN ln < total THEN ln + 1 END AS next_line, CASE WHEN len(line) > room THEN room WHEN ln < total THEN 0 END AS next_char FROM t WHERE is_last)
SELECT doc_id, CAST(ln AS INTEGER) AS ln, substr(line, 1, CAST(room AS BIGINT)) AS line, CAST(next_line AS INTEGER) AS next_line, CAST(next_char AS INTEGER) AS next_char FROM t JOIN n USING (doc_id)
""")
def workspace_read_part(spark, sf_dir):
    return review.read_page(table(spark, sf_dir, "documents"), 2, 200, 4000)


@query("numeric_guard", f"""
SELECT doc_id, regexp_extract_all(text, '[+−-]?[0-9]+(?:[.,:/-][0-9]+)*[%％]?') <> regexp_extract_all(replace(text, '20', '25'), '[+−-]?[0-9]+(?:[.,:/-][0-9]+)*[%％]?') AS changed FROM ({ZH_SQL})
""")
def numeric_guard(spark, sf_dir):
    return zh_corpus(spark, sf_dir).select("doc_id", review.numbers_changed(F.col("text"), F.expr("replace(text, '20', '25')")).alias("changed"))


@query("unique_rewrite", f"""
SELECT doc_id, strpos(text, '非常') AS col, replace(text, '非常', '') AS revised FROM ({ZH_SQL}) WHERE (len(text) - len(replace(text, '非常', ''))) / 2 = 1
""")
def unique_rewrite(spark, sf_dir):
    return review.unique_rewrite(zh_corpus(spark, sf_dir), "非常", "")


@query("doc_fingerprint", f"SELECT doc_id, concat('sha256:', sha256(text)) AS fingerprint FROM ({ZH_SQL})")
def doc_fingerprint(spark, sf_dir):
    return zh_corpus(spark, sf_dir).select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("fingerprint"))


@query("event_request_rows", """
WITH r AS (SELECT user_id, event_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS request FROM events)
SELECT user_id, request, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n_events FROM r GROUP BY user_id, request
""")
def event_request_rows(spark, sf_dir):
    return review.requests(table(spark, sf_dir, "events"))


@query("event_cursor", "SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 2000")
def event_cursor(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id > 500").orderBy("event_id").limit(2000).select("event_id", "event_type")


@query("doc_segments")
def doc_segments(spark, sf_dir):
    return review.segments(table(spark, sf_dir, "documents"))


# --- reports, files, sections, block XML, decision algebra, streams --------------------------------------------------


@query("report_lines", f"""
SELECT doc_id, ln, col, rule_id, concat(filename, ':', ln, ':', col, '  ', rule_id, repeat(' ', greatest(0, 5 - len(rule_id))), ' ', severity, repeat(' ', greatest(0, 10 - len(severity))), ' ', category, '  「', found, '」') AS line
FROM ({findings_sql('general')})
""")
def report_lines(spark, sf_dir):
    return report.finding_lines(QUERIES["lint_findings_general"](spark, sf_dir))


@query("report_totals", f"SELECT filename, count(*) AS n_findings FROM ({findings_sql('general')}) GROUP BY ROLLUP (filename)")
def report_totals(spark, sf_dir):
    return report.totals(QUERIES["lint_findings_general"](spark, sf_dir))


@query("report_exit_code", f"SELECT CAST(count_if(severity IN ('error', 'warning')) > 0 AS INTEGER) AS exit_code FROM ({findings_sql('general')})")
def report_exit_code(spark, sf_dir):
    return report.exit_code(QUERIES["lint_findings_general"](spark, sf_dir), "warning")


_FILES = """SELECT concat(CASE doc_id % 4 WHEN 0 THEN 'docs/' WHEN 1 THEN 'node_modules/' WHEN 2 THEN '.git/' ELSE 'notes/draft/' END, 'f', CAST(doc_id AS VARCHAR(20)),
  CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.py' ELSE '.markdown' END) AS path FROM documents"""


def _files(spark, sf_dir):
    return spark.sql(_FILES.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents").select("doc_id"))


@query("walked_files", f"SELECT DISTINCT path FROM ({_FILES}) WHERE regexp_matches(path, '[.](md|txt|rst|markdown)$') AND NOT starts_with(path, '.git/') AND NOT starts_with(path, 'node_modules/')")
def walked_files(spark, sf_dir):
    return report.walked(_files(spark, sf_dir), (".git", "node_modules"))


@query("ignored_files", f"SELECT path FROM ({_FILES}) WHERE NOT (starts_with(path, 'notes/') OR regexp_matches(path, '/f[^/]*7[.]md$'))")
def ignored_files(spark, sf_dir):
    return report.not_ignored(_files(spark, sf_dir), ["# drafts", "", "notes/", "f*7.md"])


@query("effective_profile", f"SELECT doc_id, CASE WHEN filename LIKE '%SKILL.md' THEN 'instruction' ELSE 'general' END AS profile FROM ({ZH_SQL})")
def effective_profile(spark, sf_dir):
    return zh_corpus(spark, sf_dir).select("doc_id", report.effective_profile(F.col("filename"), "general").alias("profile"))


_HEADS = f"SELECT doc_id, ln, len(regexp_extract(raw, '^(#+) ', 1)) AS level, trim(regexp_replace(raw, '^#+ ', '')) AS title FROM ({_LINES}) WHERE starts_with(raw, '#')"


@query("section_ranges", f"""
WITH h AS ({_HEADS}), p AS (SELECT a.*, coalesce((SELECT max(b.ln) FROM h b WHERE b.doc_id = a.doc_id AND b.ln < a.ln AND b.level < a.level), 0) AS parent FROM h a),
s AS (SELECT *, concat(title, '[', row_number() OVER (PARTITION BY doc_id, parent, title ORDER BY ln), ']') AS step FROM p),
e AS (SELECT a.doc_id, a.ln, min(b.ln) - 1 AS end_ln FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.ln > a.ln AND b.level <= a.level GROUP BY ALL)
SELECT s.doc_id, CAST(s.ln AS INTEGER) AS ln, CAST(s.level AS INTEGER) AS level, s.title, CAST(e.end_ln AS INTEGER) AS end_ln, CASE WHEN u.step IS NULL THEN s.step ELSE concat(u.step, '/', s.step) END AS locator
FROM s JOIN e USING (doc_id, ln) LEFT JOIN s u ON u.doc_id = s.doc_id AND u.ln = s.parent
""")
def section_ranges(spark, sf_dir):
    return outline.sections(lint.headings(lint.lines(zh_corpus(spark, sf_dir), False)))


_XML = f"""SELECT doc_id, ln, CASE WHEN raw LIKE '#%' THEN 'heading' WHEN raw LIKE '> %' THEN 'blockquote' WHEN raw LIKE '- %' THEN 'list_item' ELSE 'paragraph' END AS kind,
  CASE WHEN raw LIKE '#%' THEN 3 WHEN raw LIKE '> %' OR raw LIKE '- %' THEN 2 ELSE 0 END AS prefix, trim(regexp_replace(raw, '^(#+|>|-) ', '')) AS text FROM ({{lines}})"""


@query("xml_spans", f"""
WITH b AS (SELECT *, len(text) AS n FROM ({_XML.format(lines=_LINES)}) WHERE text <> ''),
o AS (SELECT *, coalesce(sum(prefix + n + 2) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + prefix AS start FROM b)
SELECT doc_id, concat('b', ln) AS block_id, kind, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS end_, text, kind <> 'heading' AS writable FROM o
""")
def xml_spans(spark, sf_dir):
    lines = lint.lines(zh_corpus(spark, sf_dir), False).select("doc_id", "ln", "raw")
    rows = spark.sql(_XML.format(lines="SELECT * FROM {zh_lines}"), zh_lines=lines)
    tag = F.when(F.col("kind") == "heading", "h2").when(F.col("kind") == "blockquote", "blockquote").when(F.col("kind") == "list_item", "li").otherwise("p")
    block = F.concat(F.lit("<"), tag, F.lit(' id="b'), F.col("ln"), F.lit('">'), "text", F.lit("</"), tag, F.lit(">"))
    docs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", block.alias("x")))).alias("all")).select("doc_id", F.array_join("all.x", "").alias("xml"))
    return blockxml.spans(docs).where("error IS NULL").select("doc_id", "block_id", "kind", "start", "end_", "text", "writable")


@query("patch_approval", """
WITH a AS (SELECT event_id % 700 AS patch_id, count(*) AS n_a FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT event_id % 900 AS patch_id, count(*) AS n_b FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT patch_id, CASE WHEN n_a > 1 OR n_b > 1 THEN 'duplicate' WHEN n_b IS NULL THEN 'missing' WHEN n_a IS NULL THEN 'extra' ELSE 'ok' END AS state FROM a FULL JOIN b USING (patch_id)
""")
def patch_approval(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return decisions.approval(
        events.where("event_type = 'purchase'").select((F.col("event_id") % 700).alias("patch_id")), events.where("event_type = 'signup'").select((F.col("event_id") % 900).alias("patch_id"))
    )


@query("event_request_stream", SQL["event_request_rows"])
def event_request_stream(spark, sf_dir):
    return jobs.requests(jobs.event_stream(spark, f"{sf_dir}/events.parquet"))
