"""Recorded documents as a data source; fingerprints, choices, totals and the walkthrough of sessions."""

import hashlib
import io
import json
import random
from statistics import median

import duckdb
import pytest
from pyspark.sql import functions as F

from penforge.operators import decisions, sessions
from penforge.plans import session_queries
from penforge.plans.registry import QUERIES, SQL
from penforge.sources import documents

DATA = "/root/testdata/sf0.001"

HOSTS = ["docs.example.org"]


def answer(name="d1", revision=3, content="<p>x</p>", **more):
    return {"ok": True, "data": {"document": {"document_id": name, "revision_id": revision, "content": content}, **more}}


def line(value, url="https://docs.example.org/docx/d1"):
    return json.dumps({"input_url": url, "answer": value}, ensure_ascii=False)


def test_lines_belong_to_one_split():
    rng = random.Random(5)
    for _ in range(200):
        data = b"\n".join(bytes(rng.choices(b"ab\r", k=rng.randrange(9))) for _ in range(rng.randrange(1, 9)))
        size = rng.randrange(1, 12)
        cut = [x for at in range(0, len(data), size) for x in documents.lines_of(io.BytesIO(data), at, min(len(data), at + size))]
        whole = list(documents.lines_of(io.BytesIO(data), 0, len(data)))
        assert cut == whole and b"".join(x for _, x in whole) == data


def test_recording(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    good = [line(answer(revision=n, content="文" * 200 + str(n))) for n in (3, 9, 4)]
    bad = ["{", "[1]", json.dumps({"input_url": " ", "answer": {}}), json.dumps({"input_url": "u"}), line({"ok": False, "error": {"type": "conflict"}}), line(answer(content="")), line(answer(content="a") | {"ok": 1})]
    (tmp_path / "a.jsonl").write_text("\n".join(good) + "\n\n", encoding="utf-8")
    (tmp_path / "sub" / "b.jsonl").write_text("\n".join([*bad, line(answer("d2", 1), "https://docs.example.org/docx/d2"), line(json.dumps(answer("d2", 1, "other")), "https://docs.example.org/docx/d2")]), encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("no record")
    (tmp_path / "empty.jsonl").write_text("")
    rows = {}
    for size in (7, 300, 1 << 20):
        found = documents.documents(spark, str(tmp_path), HOSTS, split_bytes=size)
        rows[size] = sorted(map(tuple, found.collect()), key=str)
    assert rows[7] == rows[300] == rows[1 << 20] and len(rows[7]) == 12
    errors = sorted(str(r[5]) for r in rows[7] if r[6] == "b.jsonl")
    assert errors == sorted(["json", "object", "input_url", "answer", "conflict", "invalid_response", "protocol_error", "None", "None"])
    last = {r.document_id: (r.revision, r.xml) for r in documents.latest(found).collect()}
    assert last == {"d1": (9, "文" * 200 + "9"), "d2": (1, "other")}


def test_odd_recordings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    assert documents.documents(spark, str(tmp_path / "a"), HOSTS).count() == 0
    with pytest.raises(Exception, match="missing"):
        documents.answers(spark, str(tmp_path / "missing")).count()
    (tmp_path / "a" / "x").write_bytes(b'{"input_url": "\\ud800", "answer": "\\ud800"}\n\xff\n' + b"[" * 100_000 + b"\n" + line(answer(content="y" * 9_000_000)).encode())
    found = documents.documents(spark, "file:" + str(tmp_path / "a"), HOSTS).select("error", F.length("xml").alias("n")).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, [("protocol_error", None), ("json", None), ("json", None), (None, 9_000_000)]))


def test_json_strings_are_as_python_writes_them(spark):
    texts = ["", "a\"b", *[f"x{chr(c)}y" for c in range(32)], "\\u001F", "\\\x1f", "\\\\\x1f\\", "\\\\u001F\x0b", "\x1a\x1b\\u000B", "é\u2028\x7f😀", "]["]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decisions.json_string(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == [json.dumps(t, ensure_ascii=False) for t in texts]


def test_fingerprint(spark):
    row = ("text\x1f", "general", 'a"\x0b.md', "  m\n", " https://h/v1// ", None, True)
    value = [hashlib.sha256(row[0].encode()).hexdigest(), row[1], row[2], "m", "https://h/v1", None, True]
    df = spark.createDataFrame([row], "a string, b string, c string, d string, e string, f string, g boolean")
    got = df.select(sessions.fingerprint(*map(F.col, "abcdefg"))).first()[0]
    assert got == hashlib.sha256(json.dumps(value, ensure_ascii=False).encode()).hexdigest()


def test_retained_choices(spark):
    schema = "doc_id int, id string, action string, before string, after string, source_start int"
    old = [(1, "a", "REWRITE", "x", "y", None), (1, "b", "REWRITE", "x", "y", 3), (1, "c", "ASK", "x", "", 3), (1, "d", "REWRITE", "x", "y", 3), (2, "a", "REWRITE", "x", "y", 1)]
    new = [(1, "a", "REWRITE", "x", "y", None), (1, "b", "REWRITE", "x", "y", None), (1, "c", "ASK", "x", "", 3), (1, "d", "REWRITE", "x", "y", 3), (2, "a", "REWRITE", "x", "z", 1), (1, "e", "REWRITE", "x", "y", 1)]
    chosen = [(1, i, "accepted") for i in "abce"] + [(1, "d", "maybe"), (2, "a", "rejected")]
    got = sessions.retained_choices(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), spark.createDataFrame(chosen, "doc_id int, id string, choice string"))
    assert [tuple(r) for r in got.collect()] == [(1, "a", "accepted")]


def test_latencies(spark):
    rng = random.Random(2)
    samples = [round(rng.random() * 100, 3) for _ in range(30)]
    rows = spark.createDataFrame([("s", x) for x in samples] + [("one", 4.0), ("none", None)], "name string, ms double")
    got = {r.name: (r.n, r.median, r.p95) for r in sessions.latencies(rows).collect()}
    assert got["s"][2] == sorted(samples)[28] and got["s"][1] == pytest.approx(median(samples))
    assert got["one"] == (1, 4.0, 4.0) and got["none"] == (0, None, None)


def test_walkthrough(spark):
    texts = ["总而言之，需要进行分析。", "进行分析，再进行分析。", "请相关同事尽快处理这个问题。请相关同事尽快处理这个问题。", None, ""]
    rows = sessions.demo_decisions(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [r.revised for r in rows] == ["需要分析。", texts[1], texts[2], None, ""]
    assert [[d.action for d in r.decisions or []] for r in rows] == [["REWRITE", "REWRITE"], [], ["ASK"], [], []]


def test_list_files(spark):
    files = spark.createDataFrame([(f"{'A' if i % 2 else 'b'}/{i:02}.md",) for i in range(9)], "path string")
    page = lambda *a: [tuple(r) for r in sessions.list_files(files, *a).collect()]
    assert page("a/", 0, 3) == [("A/01.md", 1, 3, 4), ("A/03.md", 2, 3, 4), ("A/05.md", 3, 3, 4)]
    assert page("a/", 3, 3) == [("A/07.md", 4, None, 4)] and page("none") == []
    with pytest.raises(ValueError):
        page("", 2_001)


@pytest.mark.parametrize("name", sorted(session_queries.QUERIES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "events", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(columns).collect())))
    assert rows and rows == sorted(map(repr, want.select(*columns).fetchall()))
