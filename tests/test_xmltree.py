import os

import duckdb
import pyarrow as pa
import pytest

from penforge.operators import xmltree as X
from penforge.plans import xml_queries

DATA = "/root/testdata/sf0.001"
DOC = (
    '<p id="lead">开头可能</p><h1 id="a">甲<b>乙</b></h1><p id="b">一<b>二<a href="u">三</a>四</b>五<br/>六<pre>七</pre>八</p><p>无号</p>'
    '<h2 id="c">丙</h2><ul id="d"><li>子</li><note>丑</note><li>寅</li></ul><h2 id="e">丙</h2><table id="t"><tbody><tr><td>卯<br/></td><td/></tr></tbody></table>'
    '<h1 id="f">甲乙</h1><other id="g">辰</other><pre id="h">巳</pre><callout id="i"><p>午</p><x>未</x>申</callout>'
)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", list(xml_queries.QUERIES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got, want = xml_queries.QUERIES[name](spark, DATA), con.sql(xml_queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(columns).collect())))
    assert rows and rows == sorted(map(repr, want.select(*columns).fetchall()))


def docs_of(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, xml string")


def test_runs_make_the_text_and_name_their_nodes(spark):
    rows = sorted(X.runs(docs_of(spark, (1, DOC))).collect(), key=lambda r: r.seq)
    text = "".join(r.text for r in rows)
    assert text.split("\n\n") == ["开头可能", "# 甲乙", "一二三四五\n六七八", "无号", "## 丙", "- 子丑\n- 寅", "## 丙", "| 卯\n |  |", "# 甲乙", "辰", "午未申"]
    assert all(text[r.start : r.end_] == r.text for r in rows)
    by = {r.text: r for r in rows if r.path is not None}
    assert [by[c].path for c in "一二三四五六七八"] == ["", "0", "0/0", "0/0/-1", "0/-1", "1/-1", "2", "2/-1"]
    assert [by[c].writable for c in "一七八子丑卯辰午未申"] == [True, False, True, True, False, False, False, True, False, True]
    assert not by["无号"].writable and by["卯"].reason == "table_cell" and by["丑"].path == "1"


def test_bad_documents_say_why(spark):
    deep = "<b>" * 400 + "</b>" * 400
    given = docs_of(spark, (1, "<!doctype a><p/>"), (2, "<p>"), (3, '<p id="x" block-id="y">z</p>'), (4, deep), (5, None), (6, ""), (7, '<p id="x" block-id="x">z</p>'))
    errors = {1: "unsafe_xml", 2: "malformed_xml", 3: "ambiguous_block_id", 4: "too_deep"}
    assert {r.doc_id: r.error for r in X.runs(given).collect() if r.error} == errors
    assert {r.doc_id: r.error for r in X.blocks(given).collect() if r.error} == errors
    assert {r.doc_id for r in X.runs(given).collect()} == {1, 2, 3, 4, 7}


def test_sections_reach_to_their_end_and_have_one_owner(spark):
    rows = X.placed(X.blocks(docs_of(spark, (1, DOC), (2, '<p id="x">y</p>'))))
    got = {(r.doc_id, r.locator): (r.first, r.last, r.level) for r in X.sections(rows).collect()}
    assert got == {
        (1, "文档开头"): (0, 0, 0), (1, "甲乙[1]"): (1, 7, 1), (1, "甲乙[1]/丙[1]"): (4, 5, 2), (1, "甲乙[1]/丙[2]"): (6, 7, 2), (1, "甲乙[2]"): (8, 11, 1), (2, "文档开头"): (0, 0, 0),
    }
    own = {r.block_id: r.locator for r in X.owners(rows).where("doc_id = 1").collect()}
    assert own["lead"] == "文档开头" and own["b"] == "甲乙[1]" and own["d"] == "甲乙[1]/丙[1]" and own["t"] == "甲乙[1]/丙[2]" and own["i"] == "甲乙[2]"


def test_fingerprints_know_structure_but_not_ids(spark):
    forms = ['<p id="a">x<b>y</b></p>', '<p block-id="z" revision-id="4">x<b>y</b></p>', "<p>xy</p>", "<p>x&lt;b&gt;y&lt;/b&gt;</p>", "<p k='1'>x<b>y</b></p>", "<p>x<b/>y</p>", "<p>x<b>y</b>z</p>"]
    got = {r.doc_id: r.fingerprint for r in X.sections(X.placed(X.blocks(docs_of(spark, *enumerate(forms))))).collect()}
    assert got[0] == got[1] and len(set(got.values())) == 6


def bound_of(spark, xml, *found):
    docs = docs_of(spark, (1, xml))
    rows = X.placed(X.blocks(docs))
    findings = spark.createDataFrame([(1, n, *f) for n, f in enumerate(found)], "doc_id long, finding_id int, ln int, col int, found string")
    return {r.finding_id: r for r in X.bind(findings, X.runs(docs), X.owners(rows)).collect()}


def test_findings_bind_by_the_first_reason_that_holds(spark):
    xml = '<h1 id="a">题</h1><p id="b">一<b>二</b>三幺</p><p id="c">三</p><p id="d">四</p><p id="d">五</p><table id="t"><tr><td>六</td></tr></table><p>七</p><p id="e">八<br/>九</p>'
    cases = [
        ((1, 3, "题"), "unsupported_block"), ((3, 1, "一"), "exact"), ((3, 1, "一二"), "cross_node"), ((3, 3, "三"), "duplicate_source"), ((7, 1, "四"), "source_mismatch"), ((11, 3, "六"), "exact"),
        ((13, 1, "七"), "synthetic_span"), ((15, 1, "八\n九"), "synthetic_span"), ((16, 1, "九"), "exact"), ((3, 1, "二"), "unmapped"), ((3, 1, ""), "empty_match"), ((99, 1, "一"), "unmapped"),
        ((0, 1, "一"), "unmapped"), ((3, 0, "一"), "unmapped"), ((16, 1, "九十"), "unmapped"), ((16, 9, ""), "unmapped"), ((None, 1, "一"), "unmapped"), ((1, 1, "# 题"), "synthetic_span"),
    ]
    got = bound_of(spark, xml, *[c for c, _ in cases])
    assert [got[n].status for n in range(len(cases))] == [s for _, s in cases]
    assert [n for n, r in got.items() if r.writable] == [n for n in got if n in (1, 8)]
    assert got[5].reason == "table_cell" and not got[5].writable and (got[8].path, got[8].source_start, got[8].source_end) == ("0/-1", 0, 1)
    assert got[2].block_id == "b" and got[2].path is None and got[1].locator == "题[1]" and got[9].locator is None


def test_long_texts_bind_across_cells(spark):
    long = "字" * 9000
    got = bound_of(spark, f'<p id="a">前{long}后</p><p id="b">尾</p>', (1, 2, long), (1, 9002, "后"), (3, 1, "尾"))
    assert [(got[n].status, got[n].source_start, got[n].source_end) for n in range(3)] == [("exact", 1, 9001), ("exact", 9001, 9002), ("exact", 0, 1)]


def test_patches_fail_by_kind_and_the_rest_is_put_in(spark):
    xml = '<h1 id="h">题</h1><p id="a">一二<b>三</b>四 &amp; 五</p><p id="b">六</p><h1 id="k">尾</h1><p id="c">七</p>'
    docs = docs_of(spark, (1, xml))
    rows, runs = X.placed(X.blocks(docs)), X.runs(docs)
    parts, own = X.sections(rows), X.owners(rows)
    place = {w: (ln, col) for w, ln, col in [("一二", 3, 1), ("二", 3, 2), ("三", 3, 3), ("四", 3, 4), ("六", 5, 1), ("七", 9, 1), ("题", 1, 3)]}
    findings = spark.createDataFrame([(1, n, ln, col, w, "E001") for n, (w, (ln, col)) in enumerate(place.items())], "doc_id long, finding_id int, ln int, col int, found string, rule string")
    bound = X.bind(findings, runs, own)
    good = parts.where("locator = '题[1]'").first().fingerprint
    plans = spark.createDataFrame([(1, "题[1]", good)], "doc_id long, plan_locator string, plan_fingerprint string")
    base = lambda n, block, path, a, b, before, after="新", rule="E001", locator="题[1]", mark=good: (1, n, n, locator, mark, block, path, a, b, before, after, rule)
    made = [
        base(1, "a", "", 0, 2, "一二"), base(2, "a", "", 1, 2, "二"), base(3, "a", "0", 0, 1, "三", "<&"), base(4, "a", "0/-1", 0, 1, "四", ""), base(5, "b", "", 0, 1, "六", "六"), base(6, "c", "", 0, 1, "七"),
        base(7, "h", "", 0, 1, "题"), base(8, "b", "", 0, 1, "九"), base(9, "b", "", 1, 1, "六"), base(10, "b", "", 0, 1, "六", rule="DOC001"), base(11, "b", "", 0, 1, "六", locator="尾[1]"),
        base(12, "b", "", 0, 1, "六", mark="x"), base(13, "b", "", 0, 1, "六", rule="C001"), base(14, "a", "5", 0, 1, "六"), base(15, "z", "", 0, 1, "六"), base(16, "b", "", 0, 1, None),
    ]
    kind = "doc_id long, patch_id int, seq int, locator string, fingerprint string, block_id string, path string, source_start int, source_end int, before string, after string, rule string"
    patches = spark.createDataFrame(made, kind)
    failed = lambda p: {r.patch_id: r.failure for r in X.patch_failures(patches, p, runs, parts, own, findings, bound).collect()}
    assert failed(plans) == {
        1: None, 2: "overlapping_patches", 3: None, 4: None, 5: "noop_patch", 6: "block_outside_section", 7: "unsupported_block", 8: "source_mismatch", 9: "invalid_offsets", 10: "unsupported_block",
        11: "section_mismatch", 12: "fingerprint_mismatch", 13: "finding_mismatch", 14: "source_mismatch", 15: "block_outside_section", 16: "noop_patch",
    }
    assert set(failed(plans.selectExpr("doc_id", "plan_locator", "'x' AS plan_fingerprint")).values()) == {"section_changed"}
    assert set(failed(plans.selectExpr("doc_id", "'无' AS plan_locator", "plan_fingerprint")).values()) == {"missing_section"}
    done = X.patched(docs, patches.where("patch_id IN (1, 3, 4)"), plans, parts)
    row = done.first()
    assert row.revised == '<h1 id="h">题</h1><p id="a">新<b>&lt;&amp;</b> &amp; 五</p><p id="b">六</p><h1 id="k">尾</h1><p id="c">七</p>'
    after = X.sections(X.placed(X.blocks(docs_of(spark, (1, row.revised))))).where("locator = '题[1]'").first().fingerprint
    assert row.fingerprints == [after] and after != good
    for expected, failure in [([after], None), ([after, after], "expected_fingerprints_mismatch"), ([""], "expected_fingerprints_mismatch"), ([good], "expected_fingerprint_mismatch"), (None, "expected_fingerprints_mismatch")]:
        told = spark.createDataFrame([(1, expected)], "doc_id long, expected array<string>")
        assert X.fingerprint_failures(done, told).first().failure == failure


def test_rows_of_many_documents_leave_a_task_together(spark, monkeypatch):
    taken = {}
    docs = spark.createDataFrame([(1, "<p>a</p>")], "doc_id long, xml string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, kind, *more: taken.update(run=run) or self)
    monkeypatch.setattr(X, "BATCH_ROWS", 50)
    X.blocks(docs)
    batch = pa.record_batch([list(range(100)), [None if n == 5 else "<p>a</p><p>b</p>" for n in range(100)]], ["doc_id", "xml"])
    out = list(taken["run"](iter([batch])))
    assert [b.num_rows for b in out] == [50, 50, 50, 48]
    assert [r["doc_id"] for b in out for r in b.to_pylist()] == [n for n in range(100) if n != 5 for _ in "ab"]
