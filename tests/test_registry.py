import os

import duckdb
import pytest

from penforge.plans import registry
from penforge.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["lint_findings_general", "lint_findings_product", "heading_gaps", "paragraph_islands", "feedback_keep_rate", "event_request_rows", "report_lines", "report_totals", "report_exit_code", "walked_files", "ignored_files", "section_ranges", "xml_spans", "patch_approval", "event_request_stream"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(columns).collect())))
    assert rows and rows == sorted(map(repr, want.select(*columns).fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["workspace_read_page", "workspace_read_part"])
def test_reads_equal_sql(spark, name):
    test_equals_sql(spark, name)


def test_lint_queries_hide_code_and_comments(spark, monkeypatch):
    text = "`可能` 和 <!-- 大概 --> 与\n```\n非常\n```\n或许"
    docs = spark.createDataFrame([(1, "a.md", text)], "doc_id long, filename string, text string")
    monkeypatch.setattr(registry, "zh_corpus", lambda *_: docs)
    for name in ("lint_findings_general", "lint_rule_H002"):
        assert [(r.ln, r.found) for r in QUERIES[name](spark, DATA).collect()] == [(5, "或许")]
