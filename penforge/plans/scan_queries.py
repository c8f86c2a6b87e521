"""The complete scan and what is made of it, over the Markdown corpus; its SQL lays hand-made findings of the blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markdown, rules
from ..operators import lint, report
from ..sources.corpus import BLOCKS, MD_SQL, md_corpus

_MD = MD_SQL.format(documents="documents")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def scan_sql(profile: str) -> str:
    """doc_id, filename, ln, col, rule_id, category, severity, found, message, sentence."""
    off, _, most = rules.PROFILES[profile]
    rows = []
    for n, (text, findings) in enumerate(BLOCKS):
        for line, col, rule, found, sentence, w in findings:
            if rule in off or rule == "S001" and int(w) <= most:
                continue
            about = rules.by_id(rule)
            before, _, after = w.partition("|")
            message = rules.MESSAGES[rule].replace("{w}", w).replace("{len}", w).replace("{max}", str(most)).replace("{prev}", before).replace("{curr}", after)
            rows.append(f"({n}, {line}, {col}, {', '.join(map(_quoted, (rule, about['category'], rules.severity(rule, about['severity'], about['semantic'], profile), found, message, sentence)))})")
    sizes = ", ".join(f"({n}, {text.count(chr(10)) + 1})" for n, (text, _) in enumerate(BLOCKS))
    large = rules.by_id("A900")
    before, _, after = rules.MESSAGES["A900"].replace("{max}", str(rules.MOST_LINES)).partition("{len}")
    return f"""
WITH corpus AS ({_MD}), sizes(block, n) AS (VALUES {sizes}),
known(block, line, col, rule_id, category, severity, found, message, sentence) AS (VALUES {', '.join(rows)}),
placed AS (SELECT doc_id, filename, first_block AS block, 0 AS base FROM corpus
  UNION ALL SELECT doc_id, filename, second_block, n FROM corpus JOIN sizes ON sizes.block = first_block),
large AS (SELECT doc_id, filename, a.n + b.n AS n_lines, string_split(text, chr(10))[1] AS head FROM corpus JOIN sizes a ON a.block = first_block JOIN sizes b ON b.block = second_block)
SELECT doc_id, filename, CAST(base + line + 1 AS INTEGER) AS ln, col, rule_id, category, severity, found, message, sentence FROM placed JOIN known USING (block)
UNION ALL SELECT doc_id, filename, 1, 1, 'A900', '{large['category']}', '{large['severity']}', '', concat('{before}', n_lines, '{after}'), regexp_extract(head, '^[^。！？!?；;]*[。！？!?；;]?')
FROM large WHERE filename LIKE '%SKILL.md' AND n_lines > {rules.MOST_LINES}
"""


def scan_query(profile: str):
    return lambda spark, sf_dir: lint.scan(md_corpus(spark, sf_dir), profile).drop("review_hint", "seq")


QUERIES = {f"scan_{p}": scan_query(p) for p in rules.PROFILES}
SQL = {f"scan_{p}": scan_sql(p) for p in rules.PROFILES}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return keep


_ALL = scan_sql("product")
#: A report line: widths 5 and 10; what was found follows a message that names nothing.
_LINE = """concat(filename, ':', ln, ':', col, '  ', rule_id, repeat(' ', greatest(0, 5 - len(rule_id))), ' ', severity, repeat(' ', greatest(0, 10 - len(severity))), ' ', category, '  ', message,
  CASE WHEN found <> '' AND NOT contains(message, '「') THEN concat(' 「', found, '」') ELSE '' END)"""


@query("scan_report", f"SELECT doc_id, ln, col, rule_id, {_LINE} AS line FROM ({_ALL})")
def scan_report(spark, sf_dir):
    return report.message_lines(lint.scan(md_corpus(spark, sf_dir), "product"))


@query("scan_summary", f"SELECT concat('✖ ', (SELECT count(*) FROM ({_ALL})), ' 处（', (SELECT string_agg(concat(filename, ': ', n), '  ' ORDER BY filename) FROM (SELECT filename, count(*) AS n FROM ({_ALL}) GROUP BY filename)), '）') AS summary")
def scan_summary(spark, sf_dir):
    return report.summary(lint.scan(md_corpus(spark, sf_dir), "product"))


@query("scan_public", f"""
WITH f AS ({_ALL}), parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM ({_MD}))
SELECT rule_id AS "rule", CASE severity WHEN 'candidate' THEN 'candidate' ELSE 'lint' END AS type, severity, category, message, filename AS file, ln AS line, col AS "column", found AS "text", sentence,
  CASE WHEN ln > 1 THEN p[ln - 1] END AS "before", CASE WHEN ln < len(p) THEN p[ln + 1] END AS "after" FROM f JOIN parts USING (doc_id)
""")
def scan_public(spark, sf_dir):
    docs = md_corpus(spark, sf_dir)
    return report.public(lint.scan(docs, "product"), docs).drop("review_hint")


@query("scan_exit_code", f"SELECT CAST(count_if(severity IN ('error', 'warning')) > 0 AS INTEGER) AS exit_code FROM ({_ALL})")
def scan_exit_code(spark, sf_dir):
    return report.exit_code(lint.scan(md_corpus(spark, sf_dir), "product"), "warning")


@query("scan_worst", f"SELECT filename, count(*) AS n_findings, max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'suggestion' THEN 1 ELSE 0 END) AS worst FROM ({_ALL}) GROUP BY filename")
def scan_worst(spark, sf_dir):
    rank = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in rules.RANK.items()])
    return lint.scan(md_corpus(spark, sf_dir), "product").groupBy("filename").agg(F.count("*").alias("n_findings"), F.max(rank).alias("worst"))


@query("md_masked_lines", f"""
SELECT doc_id, CAST(ln AS INTEGER) AS ln, masked FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS masked FROM (
  SELECT doc_id, string_split(replace(replace(replace(replace(replace(replace(replace(replace(text,
    '可能大概非常' || chr(10) || '# 不是标题', '      ' || chr(10) || '      '), '`也许`', '    '), '<!-- 可能', '       '), '大概 -->', '      '), '`可能`', '    '),
    '[大约](http://a.b/好像)', ' 大约' || repeat(' ', 16)), '    大概是代码', '    大概是代码'), '```text', '```text'), chr(10)) AS p FROM ({_MD}))) WHERE ln > 0
""")
def md_masked_lines(spark, sf_dir):
    return lint.laid_out(md_corpus(spark, sf_dir)).select("doc_id", "ln", "masked")


_ROLES = """CASE WHEN trim(raw) = '' THEN 'blank' WHEN starts_with(raw, '```') THEN 'fence' WHEN starts_with(raw, '#') THEN 'heading' WHEN starts_with(raw, '>') THEN 'blockquote'
  WHEN starts_with(raw, '|') OR raw IN ('名称 | 备注', '--- | ---', '接口 | 十分稳定') THEN 'table' WHEN starts_with(raw, '- ') THEN 'list_item' WHEN starts_with(raw, '    ') THEN 'fence' ELSE 'paragraph' END"""


@query("md_roles", f"SELECT doc_id, CAST(ln AS INTEGER) AS ln, {_ROLES} AS role FROM (SELECT doc_id, unnest(range(1, len(p) + 1)) AS ln, unnest(p) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM ({_MD})))")
def md_roles(spark, sf_dir):
    return lint.laid_out(md_corpus(spark, sf_dir)).select("doc_id", "ln", "role")


@query("md_table_cells", f"""
WITH corpus AS ({_MD}), sizes(block, n) AS (VALUES {', '.join(f"({n}, {t.count(chr(10)) + 1})" for n, (t, _) in enumerate(BLOCKS))}),
placed AS (SELECT doc_id, first_block AS block, 0 AS base FROM corpus UNION ALL SELECT doc_id, second_block, n FROM corpus JOIN sizes ON sizes.block = first_block),
cells(block, line, col, cell) AS (VALUES (2, 1, 3, '项目'), (2, 1, 8, '说明'), (2, 3, 3, '登录'), (2, 3, 8, '可能失败，大概重试'), (2, 4, 3, '`也许`'), (2, 4, 10, '正常'), (3, 1, 1, '名称'), (3, 1, 6, '备注'), (3, 3, 1, '接口'), (3, 3, 6, '十分稳定'))
SELECT doc_id, CAST(base + line AS INTEGER) AS ln, col, cell FROM placed JOIN cells USING (block)
""")
def md_table_cells(spark, sf_dir):
    rows = lint.laid_out(md_corpus(spark, sf_dir)).select("doc_id", "ln", F.explode("cells").alias("c"))
    return rows.select("doc_id", "ln", "c.col", F.col("c.raw").alias("cell"))


@query("rule_table", f"WITH n AS (SELECT rule_id, count(*) AS n FROM ({_ALL}) GROUP BY rule_id) SELECT t.*, coalesce(n, 0) AS n_findings FROM (VALUES " + ", ".join(f"({_quoted(r)}, {_quoted(rules.by_id(r)['category'])}, {_quoted(rules.by_id(r)['severity'])}, {rules.by_id(r)['semantic']}, {len(rules.by_id(r)['patterns'])})" for r in rules.ORDER) + ") t(rule_id, category, severity, semantic, n_patterns) LEFT JOIN n USING (rule_id)")
def rule_table(spark, sf_dir):
    counts = lint.scan(md_corpus(spark, sf_dir), "product").groupBy("rule_id").agg(F.count("*").alias("n"))
    known = rules.rule_frame(spark).select("rule_id", "category", "severity", "semantic", F.size("patterns").alias("n_patterns"))
    return known.join(counts, "rule_id", "left").select(*known.columns, F.coalesce("n", F.lit(0)).alias("n_findings"))


@query("newline_reading", "SELECT doc_id, replace(replace(concat(replace(text, chr(10), chr(13) || chr(10)), chr(13), 'x'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents")
def newline_reading(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = F.concat(F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\rx"))
    return docs.select("doc_id", markdown.newlines(given).alias("text"))
