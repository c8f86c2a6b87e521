"""Queries of revisions, answers, batches, manifests and a user's rules, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.answers import PREVIEW_CHARS, summary_preview
from ..operators import lint, manifests, review, revision
from ..sources.corpus import BLOCKS, MD_SQL, md_corpus
from ..streaming import answers, batches
from .scan_queries import scan_sql

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def keep(run):
        QUERIES[name], SQL[name] = run, sql
        return run

    return keep


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("minimal_patches", """
SELECT doc_id, CAST(strpos(text, 'e') - 1 AS INTEGER) AS start, 'e' AS before, concat('e', chr(769)) AS after, sha256(regexp_replace(text, 'e', concat('e', chr(769)))) AS patched_sha256
FROM documents WHERE contains(text, 'e')
""")
def minimal_patches(spark, sf_dir):
    # the first e of each text gets an accent of its own, which the patch may not part from it
    docs = _table(spark, sf_dir, "documents").where(F.contains("text", F.lit("e"))).select("doc_id", F.col("text").alias("before"))
    pairs = docs.withColumn("after", F.concat(F.substring_index("before", "e", 1), F.lit("e\u0301"), F.expr("substring(before, instr(before, 'e') + 1)")))
    patches = revision.minimal_patches(pairs.withColumn("text", F.col("before")), "doc_id", "text")
    return patches.select("doc_id", "start", "before", "after", F.sha2(revision.patched(F.col("text"), F.col("start"), F.col("before"), F.col("after")), 256).alias("patched_sha256"))


@query("change_context", """
WITH h AS (SELECT doc_id, text, strpos(text, ' the ') AS p FROM documents WHERE contains(text, ' the ')),
c AS (SELECT doc_id, substr(text, 1, p - 1) AS lead, substr(text, p + 5) AS trail FROM h)
SELECT doc_id, right_grapheme(lead, 70) AS before, ' the ' AS focus, left_grapheme(trail, 70) AS after, CAST(len(lead) - len(replace(lead, chr(10), '')) + 1 AS INTEGER) AS line,
  CAST(length_grapheme(regexp_extract(lead, '[^\\n]*$')) + 1 AS INTEGER) AS "column", length_grapheme(lead) > 70 AS clipped_before, length_grapheme(trail) > 70 AS clipped_after FROM c
""")
def change_context(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where(F.contains("text", F.lit(" the ")))
    changes = docs.select("doc_id", F.col("text").alias("source"), F.lit(" the ").alias("before"), F.lit(None).cast("int").alias("source_start"))
    return revision.change_context(changes, "doc_id").drop("error", "end_line")


@query("revision_diffs", """
WITH t AS (SELECT doc_id, text AS before, concat('-- first --', chr(10), CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END) AS after FROM documents WHERE text <> '' AND NOT contains(text, '-- first --')),
n AS (SELECT doc_id, before, after, len(regexp_replace(before, '\\n$', '')) - len(replace(regexp_replace(before, '\\n$', ''), chr(10), '')) + 1 AS n_before, contains(before, chr(10)) AS cut FROM t)
SELECT doc_id, CAST(n_before - CASE WHEN cut THEN 1 ELSE 0 END AS BIGINT) AS n_equal, CAST(CASE WHEN cut THEN 1 ELSE 0 END AS BIGINT) AS n_delete, CAST(1 AS BIGINT) AS n_insert,
  sha256(regexp_replace(before, '\\n$', '')) AS old_sha256, sha256(regexp_replace(after, '\\n$', '')) AS new_sha256 FROM n
""")
def revision_diffs(spark, sf_dir):
    # the first line goes, where there is more than one, and another one comes; both texts are put together from the rows
    docs = _table(spark, sf_dir, "documents").where((F.col("text") != "") & ~F.contains("text", F.lit("-- first --"))).select("doc_id", F.col("text").alias("before"))
    rest = F.when(F.contains("before", F.lit("\n")), F.expr("substring(before, instr(before, '\n') + 1)")).otherwise(F.col("before"))
    rows = revision.revision_diff(docs.withColumn("after", F.concat(F.lit("-- first --\n"), rest)), "doc_id")
    line = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    side = lambda n, other: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != other, F.struct(n, line.alias("x"))))), lambda x: x["x"]), "\n"), 256)
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("equal", "delete", "insert")]
    return rows.groupBy("doc_id").agg(*counts, side("old_line", "insert").alias("old_sha256"), side("new_line", "delete").alias("new_sha256"))


_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")]


def _json_text(column: str, q) -> str:
    return reduce(lambda x, e: f"replace({x}, {q(e[0])}, {q(e[1])})", _ESCAPES, column)


def _quote(x: str) -> str:
    """A text as an expression without quotes and backslashes."""
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in x) + ")"


@query("summary_previews", f"""
WITH a AS (SELECT doc_id, k, left(concat('{{"summary":"', {_json_text('text', _quote)}, '"}}'), CAST(40 * k * k AS BIGINT)) AS content FROM documents, (SELECT unnest([1, 2, 3, 4, 20]) AS k)),
v AS (SELECT doc_id, k, regexp_replace(left(content, 6000), '^.{{12}}', '') AS value FROM a),
q AS (SELECT doc_id, k, CASE WHEN regexp_matches(value, '^(?s:[^\\\\"]|\\\\.)*"') THEN regexp_extract(value, '^((?s:[^\\\\"]|\\\\.)*)"', 1) WHEN regexp_matches(value, '^(?s:[^\\\\"]|\\\\.)*\\\\$') THEN left(value, len(value) - 1) ELSE value END AS value FROM v)
SELECT doc_id, CAST(k AS INTEGER) AS k, left(replace(replace(replace(replace(replace(replace(value, '\\\\', chr(1)), '\\"', '"'), '\\n', chr(10)), '\\t', chr(9)), '\\r', chr(13)), chr(1), '\\'), {PREVIEW_CHARS}) AS preview FROM q
""")
def summary_previews(spark, sf_dir):
    # each text as the summary of an answer, broken off at five lengths
    text = F.col("text")
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    whole = F.concat(F.lit('{"summary":"'), text, F.lit('"}'))
    rows = _table(spark, sf_dir, "documents").select("doc_id", whole.alias("whole"), F.explode(F.lit([1, 2, 3, 4, 20])).alias("k"))
    return rows.select("doc_id", "k", summary_preview(F.substring(F.col("whole"), F.lit(1), 40 * F.col("k") * F.col("k"))).alias("preview"))


@query("answers_reassembled", """
SELECT conv_id AS request, 'done' AS status, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS content_sha256, CAST(count(CASE WHEN role = 'user' THEN 1 END) > 0 AS INTEGER) AS n_tools
FROM conversations GROUP BY conv_id
""")
def answers_reassembled(spark, sf_dir):
    # assistant turns as content, user turns as the arguments of one tool call, in fragments of 61 bytes
    turns = _table(spark, sf_dir, "conversations")
    said = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    tool = F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("arguments")).alias("function"))
    asked = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(tool).alias("tool_calls")).alias("delta"))).alias("choices")))
    event = F.concat(F.lit("data: "), F.when(F.col("role") == "assistant", said).when(F.col("role") == "user", asked).otherwise('{"choices":[]}'), F.lit("\n\n"))
    whole = turns.groupBy(F.col("conv_id").alias("request")).agg(F.array_sort(F.collect_list(F.struct("turn", event.alias("x")))).alias("all"))
    bytes_ = F.concat(F.array_join("all.x", ""), F.lit('data: {"choices":[{"finish_reason":"stop"}]}\n\ndata: [DONE]\n\n')).cast("binary")
    whole = whole.select("request", bytes_.alias("b")).select("request", "b", F.posexplode(F.expr("sequence(0, octet_length(b) - 1, 61)")).alias("seq", "at"))
    fragments = whole.select("request", "seq", F.substring(F.col("b"), F.col("at") + 1, F.lit(61)).alias("data"))
    return answers.reassembled(fragments).select("request", "status", F.sha2("content", 256).alias("content_sha256"), F.size("tool_calls").alias("n_tools"))


_RECORDED = "SELECT conv_id AS session, CAST(turn + 1 AS INTEGER) AS segment, CAST(1 + length(text) % 8 AS INTEGER) AS calls, CAST(length(text) AS DOUBLE) / 20 AS seconds, length(text) % 13 <> 0 AS ok FROM conversations"


def _step(n: int) -> str:
    return f"""
r{n} AS (SELECT a.*, completed, s.calls AS spent, coalesce(sum(a.calls) OVER b, 0) AS calls_before, coalesce(sum(a.seconds) OVER b, 0) AS seconds_before, row_number() OVER (PARTITION BY a.session ORDER BY segment) AS place
  FROM a JOIN s{n} AS s ON s.session = a.session WHERE segment > completed AND segment <= completed + 2 WINDOW b AS (PARTITION BY a.session ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m{n} AS (SELECT *, least(12 - calls_before, 128 - spent - calls_before) AS room FROM r{n}),
f{n} AS (SELECT *, room > 0 AND 120 - seconds_before >= 1 AND segment = completed + place AS begun, room > 0 AND 120 - seconds_before >= 1 AND segment = completed + place AND ok AND calls <= room AND seconds_before + seconds <= 120 AS fits FROM m{n}),
t{n} AS (SELECT session, count_if(fits) AS more, sum(least(calls, greatest(room, 0))) AS n_calls FROM (SELECT *, coalesce(bool_and(fits) OVER (PARTITION BY session ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS earlier FROM f{n}) WHERE begun AND earlier GROUP BY session),
s{n + 1} AS (SELECT session, CAST(completed + coalesce(more, 0) AS INTEGER) AS completed, CAST(calls + coalesce(n_calls, 0) AS INTEGER) AS calls FROM s{n} LEFT JOIN t{n} USING (session))"""


@query("review_batches", f"WITH a AS ({_RECORDED}), s0 AS (SELECT DISTINCT session, CAST(0 AS INTEGER) AS completed, CAST(0 AS INTEGER) AS calls FROM a), {_step(0)}, {_step(1)} SELECT * FROM s2")
def review_batches(spark, sf_dir):
    recorded = spark.sql(_RECORDED.replace("FROM conversations", "FROM {conversations}"), conversations=_table(spark, sf_dir, "conversations"))
    progress = recorded.select("session").distinct().select("session", F.lit(0).alias("completed"), F.lit(0).alias("calls"))
    for _ in range(2):
        progress = batches.advanced(progress, batches.attempts(progress, recorded))
    return progress


# --- manifests ---------------------------------------------------------------------------------------------------------

_PATCH = '{"patch_id":"p%d","section_locator":"s","section_fingerprint":"#","block_id":"b","node_path":[0,1],"source_start":1,"source_end":2,"before":"a","after":"b","rule_id":"R","rationale":"r"}'
_WHOLE = '{"document_id":"D","section_locator":"s","initial_fingerprint":"f","base_revision":3,"approved_patch_ids":["p1","p2"],"expected_fingerprints":["x"],"patches":[' + _PATCH % 1 + "," + _PATCH % 2 + "]}"
#: What is changed in a manifest, and what is then its error.
_FAULTS = [
    ("@", "@", None), ('"patches":[', '"patches":', "manifest_json"), ('{"document_id"', '[{"document_id"', "manifest_json"), ('"base_revision":3', '"base_revision":3,"extra":1', "unknown_fields"), ('"document_id":"D"', '"document_id":"E"', "document_mismatch"),
    ('"patches":[', '"patches":[5,', "manifest_schema"), ('"rationale":"r"', '"rationale":"r","more":0', "unknown_fields"), ('"patch_id":"p2"', '"patch_id":"p1"', "duplicate_patch_id"), ("[0,1]", '[0,"1"]', "manifest_schema"),
    (',"block_id":"b"', "", "manifest_schema"), ('["p1","p2"]', '["p1","p1"]', "duplicate_approved_id"), ('["p1","p2"]', '["p1"]', "unapproved_patch"), ('["p1","p2"]', '["p1","p2","p3"]', "missing_patch"),
    ('"base_revision":3', '"base_revision":-3', "manifest_schema"), ('"initial_fingerprint":"f"', '"initial_fingerprint":""', "manifest_schema"), ('["x"]', '["x",1]', "manifest_schema"), ('"base_revision":3', '"base_revision":true', "manifest_schema"),
]


def _manifests(spark, sf_dir):
    text = F.replace(F.lit(_WHOLE), F.lit("#"), F.sha2("text", 256))
    wrong = F.coalesce(*[F.when(F.col("doc_id") % len(_FAULTS) == n, F.replace(text, F.lit(a), F.lit(b))) for n, (a, b, _) in enumerate(_FAULTS)])
    return _table(spark, sf_dir, "documents").select("doc_id", F.lit("D").alias("document_id"), wrong.alias("text"))


_ERROR = "CASE doc_id %% %d %s END" % (len(_FAULTS), " ".join(f"WHEN {n} THEN " + (f"'{e}'" if e else "NULL") for n, (_, _, e) in enumerate(_FAULTS)))


@query("manifest_errors", f"SELECT doc_id, {_ERROR} AS error FROM documents")
def manifest_errors(spark, sf_dir):
    return _manifests(spark, sf_dir).select("doc_id", manifests.manifest_error(F.col("text"), F.col("document_id")).alias("error"))


@query("manifest_patches", f"SELECT doc_id, CAST(n - 1 AS INTEGER) AS place, concat('p', n) AS patch_id, sha256(text) AS section_fingerprint, CAST(2 AS BIGINT) AS source_end FROM documents, (SELECT unnest([1, 2]) AS n) WHERE doc_id % {len(_FAULTS)} = 0")
def manifest_patches(spark, sf_dir):
    return manifests.manifest_patches(_manifests(spark, sf_dir), "doc_id").select("doc_id", "place", "patch_id", "section_fingerprint", "source_end")


# --- searching within budgets ------------------------------------------------------------------------------------------

_PATHS = "concat('d', lpad(CAST(doc_id AS VARCHAR(20)), 12, '0'), '.md')"
_LOOKED = f"""
f AS (SELECT {_PATHS} AS path, text, strlen(text) AS size FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, row_number() OVER (ORDER BY path) > 200 OR sum(size) OVER (ORDER BY path) > 2097152 AS beyond FROM f),
l AS (SELECT path, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS x FROM (SELECT path, string_split(text, chr(10)) AS p FROM b WHERE NOT beyond)),
o AS (SELECT *, coalesce(sum(len(x) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM l),
m AS (SELECT path, line, begun, x, strpos(lower(x), 'licensed') - 1 AS s FROM o WHERE contains(lower(x), 'licensed') ORDER BY path, line LIMIT 20)"""


def _files(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("path"), F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"))


@query("workspace_search_matches", f"""
WITH {_LOOKED}, c AS (SELECT *, greatest(0, least(s - 150, len(x) - 500)) AS a FROM m)
SELECT path, CAST(line AS INTEGER) AS line, CAST(s + 1 AS INTEGER) AS col, CAST(begun + s AS INTEGER) AS "offset", substr(x, a + 1, least(len(x), a + 500) - a) AS text, CAST(a AS INTEGER) AS snippet_start_char, CAST(least(len(x), a + 500) AS INTEGER) AS snippet_end_char FROM c
""")
def workspace_search_matches(spark, sf_dir):
    return review.search_matches(_files(spark, sf_dir), "LICENSED").drop("start_char", "end_char")


@query("workspace_search_summary", f"""
WITH {_LOOKED}, n AS (SELECT count(*) AS n_matches, max(path) AS last FROM m)
SELECT n_matches, n_matches >= 20 OR (SELECT bool_or(beyond) FROM b) AS truncated, (SELECT count(*) FROM b, n WHERE NOT beyond AND (n_matches < 20 OR path <= last)) AS scanned_files,
  (SELECT CAST(sum(size) AS BIGINT) FROM b, n WHERE NOT beyond AND (n_matches < 20 OR path <= last)) AS scanned_bytes, CAST(0 AS BIGINT) AS skipped_files FROM n
""")
def workspace_search_summary(spark, sf_dir):
    return review.search_summary(_files(spark, sf_dir), "LICENSED")


# --- a user's rules and profile ----------------------------------------------------------------------------------------

_SIZES = ", ".join(f"({n}, {text.count(chr(10)) + 1})" for n, (text, _) in enumerate(BLOCKS))


@query("scan_user_rules", f"""
WITH corpus AS ({MD_SQL.format(documents='documents')}), sizes(block, n) AS (VALUES {_SIZES}),
placed AS (SELECT doc_id, filename, first_block AS block, 0 AS base FROM corpus UNION ALL SELECT doc_id, filename, second_block, n FROM corpus JOIN sizes ON sizes.block = first_block),
own(block, line, col, sentence) AS (VALUES (1, 4, 7, '围栏之后大概正常。'), (2, 3, 10, '| `也许` | 正常 |'))
SELECT doc_id, filename, ln, col, rule_id, category, CASE WHEN rule_id = 'H001' THEN 'error' ELSE severity END AS severity, found, message, sentence FROM ({scan_sql('instruction')}) WHERE rule_id <> 'E001'
UNION ALL SELECT doc_id, filename, CAST(base + line + 1 AS INTEGER), col, 'U001', '自定', 'warning', '正常', '「正常」说明什么', sentence FROM placed JOIN own USING (block)
""")
def scan_user_rules(spark, sf_dir):
    # severities and the longest sentence are the profile's
    own = spark.createDataFrame([("U001", None, "自定", "suggestion", False, ["正(?=常)常"], "正常人", "「{w}」说明什么", "")], rules.RULE_KIND)
    profile = spark.createDataFrame([("own", ["E001", "DOC002"], {"U001": "warning", "H001": "error"}, 50)], rules.PROFILE_KIND)
    found = lint.scan(md_corpus(spark, sf_dir), "own", rules.rule_frame(spark).unionByName(own), rules.profile_frame(spark).unionByName(profile))
    return found.drop("review_hint", "seq")
