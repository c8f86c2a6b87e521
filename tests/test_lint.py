from hypothesis import given, strategies as st

from penforge.functions.markdown import mask_text
from penforge.operators import lint, review

TRIP = "- 集合地点大概在东门左右。\n- 雨天行程可能取消，装备十分简单\n\n# 2 路线\n山路非常陡，不再开放的小径绕行。队伍进行说明后出发\n# 5 费用\n费用费用由领队收取；是否能够退款，原先没有写。\n> 毋庸置疑，天气决定一切"


def docs(spark, *texts):
    return spark.createDataFrame([(i, "a.md", t) for i, t in enumerate(texts)], "doc_id long, filename string, text string")


def found(spark, text, profile="general"):
    return {(r.ln, r.col, r.rule_id, r.found) for r in lint.lint(docs(spark, text), profile).collect()}


def test_a_trip(spark):
    want = {
        (1, 7, "H001", "大概"), (1, 12, "H003", "左右"), (2, 7, "H002", "可能"), (2, 14, "E001", "十分"), (5, 3, "E001", "非常"), (5, 7, "M002", "不再"), (5, 19, "R001", "进行"),
        (7, 1, "D001", "费用费用"), (7, 11, "R002", "是否能够"), (7, 18, "M001", "原先"), (8, 3, "C001", "毋庸置疑"),
    }
    assert found(spark, TRIP, "product") == want
    assert {(r.ln, r.col, r.rule_id, r.found) for r in lint.scan(docs(spark, TRIP), "product").collect()} == want | {(6, 3, "DOC002", "")}
    gaps = lint.heading_gaps(lint.lines(docs(spark, TRIP))).collect()
    assert [(r.ln, r.prev, r.number) for r in gaps] == [(6, "2", "5")]


def test_guards_positions_and_masks(spark):
    assert found(spark, "综上所述的方案，由此可见一斑，左右两边。") == set()
    assert found(spark, "😀可能") == {(1, 2, "H002", "可能")}
    assert found(spark, "`可能` 和 <!-- 大概 --> 与\n```\n非常\n```") == set()
    assert found(spark, "不再来") == {(1, 1, "M002", "不再")}


@given(st.text(alphabet="a`~<>!-# \n[]()*|", max_size=120))
def test_masks_keep_lengths_and_lines(text):
    masked = mask_text(text)
    assert [len(x) for x in masked.split("\n")] == [len(x) for x in text.split("\n")]


def test_roles(spark):
    rows = lint.lines(docs(spark, "# a\n- b\n> c\n|d|\n\n~~~\n    x\ny")).orderBy("ln").collect()
    assert [r.role for r in rows] == ["heading", "list_item", "blockquote", "table", "blank", "fence", "fence", "paragraph"]


def test_segments_cover():
    text = ("x" * 50 + "\n\n") * 200
    parts = review.segment_bounds(text)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and all(b - a <= 4000 for a, b, *_ in parts)


def test_segments_hold_no_more_than_24_findings(spark):
    text, dense = "x" * 5000, [*range(30), 4500]
    assert [b[:2] for b in review.segment_bounds(text, findings=dense)] == [(0, 24), (24, 4024), (4024, 5000)]
    assert [b[:2] for b in review.segment_bounds(text, findings=[7] * 40)] == [(0, 7), (7, 4007), (4007, 5000)]
    docs = spark.createDataFrame([(1, text, dense), (2, text, []), (3, text, None)], "doc_id long, text string, offsets array<int>")
    got = {(r.doc_id, r.start, r.end_) for r in review.segments(docs).collect()}
    assert got == {(1, 0, 24), (1, 24, 4024), (1, 4024, 5000), *((d, a, z) for d in (2, 3) for a, z in ((0, 4000), (4000, 5000)))}
    assert len(review.segments(docs.select("doc_id", "text")).collect()) == 6
