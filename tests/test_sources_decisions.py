"""Files, feedback, addresses, and the algebra of rewrites."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from penforge.operators import decisions, review
from penforge.sources import files


def test_files(spark, tmp_path):
    for name, raw in {"a.md": "一\r\n二\r三".encode(), "b.py": b"x", "n/c.txt": b"\xef\xbb\xbfok", "node_modules/d.md": b"no", ".h/e.md": b"no", "f.MDX": b"m"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    root = str(tmp_path)
    assert [tuple(r) for r in files.read_texts(spark, root).collect()] == [("a.md", "一\n二\n三"), ("n/c.txt", "﻿ok")]
    assert [(r.path, r.name) for r in files.manifest(spark, root).collect()] == [("a.md", "a.md"), ("f.MDX", "f.MDX"), ("n/c.txt", "c.txt")]
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    got = {r.path: (r.text, r.error) for r in files.bounded(files.files(spark, root), 5).collect()}
    assert got["n/c.txt"] == ("ok", None) and got["bad.md"] == (None, "encoding") and got["a.md"] == (None, "size")
    with pytest.raises(Exception, match="UTF|utf"):
        files.read_texts(spark, root).collect()


GOOD = {"schema_version": 1, "decision": "KEEP", "rule": "C001", "file": "a.md", "line": 1, "column": 2, "text": "", "reason": "", "profile": "general", "recorded_at": "x"}


def test_feedback(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text("\n".join([json.dumps(GOOD), "", json.dumps(GOOD | {"decision": "ASK"})]) + "\n")
    rows = files.feedback(files.numbered_lines(spark, str(path)))
    assert sorted(map(tuple, rows.collect())) == [("C001", "ASK"), ("C001", "KEEP")]
    assert review.keep_rates(rows).first().keep_rate == 0.5
    bad = {"json": "{", "object": "[1]", "schema_version": GOOD | {"schema_version": 2}, "decision": GOOD | {"decision": "keep"}, "rule": GOOD | {"rule": " "}, "file": GOOD | {"file": 3}, "line": GOOD | {"line": True}, "column": GOOD | {"column": 0}, "profile": {k: v for k, v in GOOD.items() if k != "profile"}}
    given = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in bad.items()] + [(None, json.dumps(GOOD))], "want string, text string")
    assert all(r.want == r.got for r in given.select("want", files.feedback_error(F.col("text")).alias("got")).collect())
    path.write_text(json.dumps(GOOD) + "\n\n{\n")
    with pytest.raises(ValueError, match=":3: json"):
        files.feedback(files.numbered_lines(spark, str(path)))
    files.record(spark.createDataFrame([{k: v for k, v in (GOOD | {"decision": " ask "}).items() if k != "schema_version"}]), str(tmp_path / "out"))
    assert [r.decision for r in spark.read.json(str(tmp_path / "out")).collect()] == ["ASK"]


def test_addresses_and_requests(spark):
    urls = ["https://a.Example.com/docx/T1?x=1#share-9", "http://a.example.com/docx/T", "https://u:p@a.example.com/docx/T", "https://evil.com/docx/T", "https://a.example.com/sheet/T", "https://b.tail.org/wiki/T/#other", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string").select("i", files.document_ref(F.col("url"), ["a.example.com"], [".tail.org"]).alias("d")).orderBy("i").collect()
    assert [r.d.error for r in rows] == [None, "scheme", "credentials", "host", "path", None, "scheme"]
    assert rows[0].d.url == "https://a.example.com/docx/T1#share-9" and rows[5].d.url == "https://b.tail.org/wiki/T"
    asked = spark.createDataFrame([("x", "general"), (" 　", "general"), (None, "formal"), ("x" * 200_001, "formal"), ("x", "other")], "t string, p string")
    assert [r[0] for r in asked.select(files.request_error(F.col("t"), F.col("p"))).collect()] == [None, "blank", "blank", "long", "profile"]


TEXT = "甲乙丙丁 甲乙 三十 30 秒\n第二行 重复 重复"


def test_rewrites(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "无改动")], "doc_id long, text string")
    rows = [
        (1, "semantic", 1, "REWRITE", "乙丙", "乙", "s1", None), (1, "static", 2, "REWRITE", "丙丁", "丙", "t2", None), (1, "static", 1, "KEEP", "甲乙", "", "t1", None),
        (1, "static", 3, "REWRITE", "30 秒", "20 秒", "t3", None), (1, "semantic", 2, "REWRITE", "重复", "x", "s2", None), (1, "semantic", 3, "REWRITE", "重复", "唯一", "s3", 23),
    ]
    given = spark.createDataFrame(rows, "doc_id long, lane string, seq int, action string, before string, after string, reason string, source_start int")
    out = decisions.resolve_rewrites(given, docs, review.numbers_changed)
    got = {(r.lane, r.seq): (r.action, r.after, r.reason) for r in out.collect()}
    assert TEXT[23:25] == "重复"
    assert got[("static", 1)] == ("KEEP", "", "t1") and got[("static", 2)][0] == "REWRITE"
    assert got[("semantic", 1)] == ("ASK", "", decisions.OVERLAPS + "s1") and got[("static", 3)] == ("ASK", "", decisions.NUMERIC + "t3")
    assert got[("semantic", 2)][0] == "INVALID" and got[("semantic", 3)][0] == "REWRITE"
    assert {r.doc_id: r.revised for r in decisions.revised_texts(out, docs).collect()} == {1: "甲乙丙 甲乙 三十 30 秒\n第二行 重复 唯一", 2: "无改动"}


def test_links_coverage_offsets_and_ids(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 1, 2, "丙"), (1, 2, 10, "三十"), (1, 3, 0, "")], "doc_id long, finding_id int, offset int, found string")
    semantic = spark.createDataFrame([(1, 1, "乙丙丁", None, [1, 2, 3, 1]), (1, 2, "重复", None, [1])], "doc_id long, seq int, before string, source_start int, related array<int>")
    assert [tuple(r) for r in decisions.verified_links(semantic, found, docs).collect()] == [(1, 1, 1)]
    have = spark.createDataFrame([(i, "R") for i in (1, 2, 3, 4)], "finding_id int, rule string")
    made = spark.createDataFrame([(1, "R"), (2, "X"), (3, "R"), (3, "R"), (9, "R")], "finding_id int, rule string")
    assert {r.finding_id: r.state for r in decisions.coverage(have, made).collect()} == {1: "ok", 2: "rule", 3: "duplicate", 4: "missing", 9: "unknown"}
    segments = spark.createDataFrame([(1, 0, 0, 100, 0), (1, 1, 100, 200, 70)], "doc_id long, seg_no int, start int, end_ int, context_start int")
    given = spark.createDataFrame([(1, 1, None, "REWRITE", "abc", "x", "r", 29), (1, 1, None, "REWRITE", "abc", "x", "r", 128), (1, 1, 5, "REWRITE", "abc", "x", "r", 29), (1, 1, None, "ASK", "abc", "", "r", 30)], "doc_id long, seg_no int, finding_id int, action string, before string, after string, reason string, offset int")
    assert sorted((r.finding_id or 0, r.action, r.at) for r in decisions.global_offsets(given, segments).collect()) == [(0, "ASK", 100), (0, "ASK", 198), (5, "ASK", 99)]
    want = hashlib.sha256(json.dumps(["S", 'a"\n', "b\\"], ensure_ascii=False).encode()).hexdigest()[:16]
    row = spark.range(1).select(decisions.decision_id(F.lit(None).cast("int"), F.lit(7), F.lit("S"), F.lit('a"\n'), F.lit("b\\")).alias("a"), decisions.decision_id(F.lit(3), F.lit(7), F.lit("S"), F.lit(""), F.lit("")).alias("b")).first()
    assert (row.a, row.b) == (f"semantic-7-{want}", "static-3")
    around = docs.select(decisions.clarification(F.col("text"), F.lit("第二"), F.lit(None).cast("int")).alias("c"), decisions.clarification(F.col("text"), F.lit("重复"), F.lit(None).cast("int")).alias("n")).first()
    assert tuple(around.c) == (TEXT.index("第二"), "第二行 重复 重复")
    assert around.n is None
    assert [tuple(r) for r in decisions.progress(segments, segments.where("seg_no = 1")).collect()] == [(1, 2, 1, 100)]
