"""The complete scan: context, cells, spans, headings, order, and its registered queries against their SQL."""

import os

import pytest

from penforge.functions import markdown
from penforge.functions.markdown import layout_of, roles, table_cells
from penforge.operators import lint, report
from penforge.plans.scan_queries import QUERIES
from tests.test_registry import test_equals_sql as equals_sql

DATA = "/root/testdata/sf0.001"


def docs(spark, *texts, name="a.md"):
    return spark.createDataFrame([(i, name, t) for i, t in enumerate(texts)], "doc_id long, filename string, text string")


def found(spark, text, profile="general", name="a.md"):
    return [(r.ln, r.col, r.rule_id, r.found) for r in lint.ordered_scan(docs(spark, text, name=name), profile).collect()]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    equals_sql(spark, name)


def test_profiles_differ(spark):
    rows = {p: {tuple(r) for r in QUERIES[f"scan_{p}"](spark, DATA).collect()} for p in ("general", "academic", "product", "formal", "instruction")}
    assert len({frozenset(x) for x in rows.values()}) == 5


def test_tables_in_context():
    assert roles(["a | b", "--- | ---", "c | d", "", "e | f"]) == ["table", "table", "table", "blank", "paragraph"]
    assert roles(["a | b", "--- | ---", "--- | ---", "c | d", "- x | y"]) == ["table"] * 4 + ["list_item"]
    assert roles(["a | b", "- | -"]) == ["paragraph", "list_item"]
    assert table_cells(r"| a \| b | `c | d` |  | e") == [(3, r"a \| b"), (12, "`c | d`"), (25, "e")]
    assert table_cells("|---|---|") == []


def test_cells_are_scanned_alone(spark):
    assert found(spark, "可能 a | 可能\n---|---\n| 不 | 再试 |") == [(1, 1, "H002", "可能"), (1, 8, "H002", "可能"), (3, 7, "M002", "再")]
    assert found(spark, "| 综上所述 | 的 |\n|---|---|") == [(1, 3, "C001", "综上所述")]  # the guard reads the whole line
    assert found(spark, "| a `可能` | <!-- 大概 --> |\n|---|---|") == []


def test_masks_cover_headings_and_code(spark):
    assert found(spark, "# t\n```\n# not a heading\n#\n```\n#") == [(6, 1, "DOC001", "")]
    assert found(spark, "x\n\n    ```\n\n可能") == [(5, 1, "H002", "可能")]
    assert found(spark, "---\ntitle: 可能\n---\n\n大概") == [(5, 1, "H001", "大概")]


def test_long_sentences(spark):
    long = "甲乙丙丁戊己庚辛壬" * 9
    assert found(spark, "短句。  " + long + "。") == [(1, 6, "S001", long + "。")]
    assert found(spark, "开头\n" + long[:40] + "\n" + long[40:]) == [(1, 1, "S001", "开头\n" + long[:40] + "\n" + long[40:])]
    assert found(spark, "- " + long) == [] and found(spark, "word " * 60) == []
    assert found(spark, f"| a | {long} |\n|---|---|") == [(1, 7, "S001", long)]
    assert found(spark, long[:60], "instruction") == [(1, 1, "S001", long[:60])] and found(spark, long[:60]) == []


def test_numbers_of_any_length(spark):
    big = "9" * 45
    assert found(spark, f"# {big} 甲\n# 1{big} 乙\n# 007 丙\n# 8 丁", "product") == [(2, 3, "DOC002", "")]
    assert found(spark, "## 1. 甲\n## 乙\n## 3. 丙", "product") == [] and found(spark, "## 1. 甲\n## \n## 3. 丙", "product")[-1] == (3, 4, "DOC002", "")


def test_sentences_messages_and_order(spark):
    rows = lint.ordered_scan(docs(spark, "前一句。可能大概！后一句。"), "general").collect()
    assert [(r.rule_id, r.sentence) for r in rows] == [("H002", "可能大概！"), ("H001", "可能大概！")]
    assert rows[1].message == "模糊词「大概」，表述要精确" and rows[1].review_hint
    assert found(spark, "x\n" * 300, "general", "b/SKILL.md") == [(1, 1, "A900", "")] and found(spark, "x\n" * 299, "general", "b/SKILL.md") == []


def test_edge_texts(spark):
    assert [found(spark, t) for t in ("", "\n", None, "😀可能", "　可能")] == [[], [], [], [(1, 2, "H002", "可能")], [(1, 2, "H002", "可能")]]
    assert report.summary(lint.scan(docs(spark, "x"))).collect()[0].summary == "✅ 未发现坏味"
    text = "`a` [b](c) <!-- d\n--> e\n| f `|` g | h |\n|---|---|\n"
    assert all(len(x["raw"]) == len(x["masked"]) for x in layout_of(text))


def test_lines_of_many_documents_leave_a_task_in_batches(spark, monkeypatch):
    monkeypatch.setattr(markdown, "ROWS", 7)
    docs = spark.createDataFrame([(n, f"{n}.md", None if n == 3 else "\n".join("行" * (n + 1))) for n in range(12)], "doc_id long, filename string, text string")
    taken = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kind, *more: taken.update(run=run, kind=kind) or self)
    markdown.layout(docs, "doc_id", "filename")
    batch = markdown.pa.record_batch([[n for n in range(12)], [f"{n}.md" for n in range(12)], [None if n == 3 else "\n".join("行" * (n + 1)) for n in range(12)]], ["doc_id", "filename", "text"])
    out = list(taken["run"](iter([batch])))
    sizes = [b.num_rows for b in out]
    assert max(sizes) == 7 and sum(sizes) == sum(n + 1 for n in range(12) if n != 3)
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["doc_id"], r["ln"]) for r in rows] == [(n, i) for n in range(12) if n != 3 for i in range(1, n + 2)]
