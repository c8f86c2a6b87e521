import random

from penforge.operators import blockxml, decisions, outline, report, review


def test_related_decisions_fold_in_order(spark):
    kind = "action string, before string, after string, reason string"
    static = spark.createDataFrame([(1, "REWRITE", "甲", "乙", "r1"), (2, "KEEP", "丙", "", "r2"), (3, "ASK", "丁", "", "r3")], f"finding_id int, {kind}")
    related = spark.createDataFrame(
        [(1, 2, "S_B", "VERIFY", "甲", "", "b"), (1, 1, "S_A", "REWRITE", "甲", "乙", "a"), (2, 1, "S_A", "REWRITE", "丙", "己", "c")],
        f"finding_id int, seq int, rule string, {kind}",
    )
    got = {r.finding_id: r for r in decisions.merge_related(static, related).collect()}
    assert (got[1].action, got[1].after) == ("VERIFY", "")
    assert got[1].reason.index("S_A") < got[1].reason.index("S_B")
    assert got[1].reason.count(decisions.DISAGREE) == 1
    assert got[2].action == "ASK" and got[3].reason == "r3"


def test_findings_fall_into_one_core(spark):
    segments = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 5, 9), (2, 0, 0, 9)], "doc_id int, seg_no int, start int, end_ int")
    findings = spark.createDataFrame([(1, 4), (1, 5), (2, 5), (2, 9)], "doc_id int, offset int")
    assert sorted(map(tuple, decisions.segment_of(findings, segments).collect())) == [(1, 4, 0), (1, 5, 1), (2, 5, 0)]


def test_block_xml(spark):
    xml = '<h1 id="a">标题</h1><p id="b">一<b>二</b><br/>三</p><p id="c"> </p><ol><li id="d">x</li><li>y</li></ol><pre>code</pre><table id="t"><tr><td>1</td><td>2</td></tr></table>'
    docs = spark.createDataFrame([(1, xml), (2, "<!DOCTYPE a><p/>"), (3, "<p>"), (4, None), (5, "")], "doc_id long, xml string")
    rows = blockxml.spans(docs).collect()
    first = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.seq)
    assert [r.text for r in first] == ["标题", "一二\n三", "x", "y", "| 1 | 2 |"]
    assert [r.writable for r in first] == [False, True, True, False, False]
    assert [(r.start, r.end_) for r in first[:3]] == [(2, 4), (6, 10), (15, 16)]
    assert {(r.doc_id, r.error) for r in rows if r.error} == {(2, "declaration"), (3, "not well formed")}


def test_sections_tell_repeated_titles_apart(spark):
    heads = [(1, 1, 1, "A", 0), (1, 3, 2, "B", 1), (1, 5, 2, "B", 1), (1, 7, 1, "A", 0), (1, 8, 3, "B", 7)]
    got = outline.sections(spark.createDataFrame(heads, "doc_id int, ln int, level int, title string, parent int")).orderBy("ln").collect()
    assert [r.locator for r in got] == ["A[1]", "A[1]/B[1]", "A[1]/B[2]", "A[2]", "A[2]/B[1]"]
    assert [r.end_ln for r in got] == [6, 4, 6, None, None]


def test_report_of_nothing(spark):
    none = spark.createDataFrame([], "filename string, severity string")
    assert report.exit_code(none, "candidate").first().exit_code == 0
    paths = spark.createDataFrame([("a/b.md",), ("a/.x/b.md",), ("./c.txt",), ("a/c.MD",), ("a/b.md",)], "path string")
    assert sorted(r.path for r in report.walked(paths, ("v",)).collect()) == ["./c.txt", "a/b.md"]


def read(text, line, char, most_lines, most_chars):
    """The rows and the cursor of one read, line by line."""
    lines, out, used, cursor = text.split("\n"), [], 0, (None, None)
    for i in range(line - 1, min(line - 1 + most_lines, len(lines))):
        at = char if i == line - 1 else 0
        room = most_chars - used - bool(out)
        if room <= 0:
            return out, (i + 1, at)
        piece = lines[i][at : at + room]
        used += len(piece) + bool(out)
        out.append((i + 1, piece))
        if at + len(piece) < len(lines[i]):
            return out, (i + 1, at + len(piece))
        cursor = (i + 2, 0) if i + 1 < len(lines) else (None, None)
    return out, cursor


def test_read_page_cuts_the_crossing_line_and_tells_where_to_go_on(spark):
    rng = random.Random(5)
    texts = ["x\n" + "y" * 30, "aaaa\nbbbbb", "aaaa\nbbbb\n", "", "\n\n"] + ["\n".join("ü😀ab"[: rng.randrange(5)] * rng.randrange(5) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for line, char, most_lines, most_chars in ((1, 0, 3, 10), (2, 0, 200, 10), (2, 3, 2, 7), (1, 1, 9, 1)):
        got = {}
        for r in review.read_page(docs, line, most_lines, most_chars, char).orderBy("doc_id", "ln").collect():
            got.setdefault(r.doc_id, ([], (r.next_line, r.next_char)))[0].append((r.ln, r.line))
        fits = {i: t for i, t in enumerate(texts) if line <= t.count("\n") + 1 and char <= len(t.split("\n")[line - 1])}
        assert got == {i: read(t, line, char, most_lines, most_chars) for i, t in fits.items()}
