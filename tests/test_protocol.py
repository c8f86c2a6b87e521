import json

from pyspark.sql import functions as F

from penforge.operators import decisions, xmltree as X
from penforge.sources import files


def test_payloads_say_what_is_wrong(spark):
    def made(ok=True, **more):
        document = {"document_id": "T1", "revision_id": 3, "content": "<p/>", "url": "https://a.example/docx/T1?x=1#y"} | more.pop("document", {})
        return json.dumps({"ok": ok, "data": {"document": {k: v for k, v in document.items() if v != "-"}, **more}})

    cases = [
        (made(), None), (made(document={"content": "-"}, content="<q/>"), None), (made(content="<p/>"), None), (made(document={"url": "-"}), None), (made(content="<q/>"), "ambiguous_content"),
        (made(document={"content": 7}), "invalid_response"), (made(document={"document_id": ""}), "unresolved_document"), (made(document={"revision_id": "-"}), "missing_revision"),
        (made(document={"revision_id": None}), "invalid_response"), (made(document={"revision_id": True}), "invalid_response"), (made(document={"revision_id": 0}), "invalid_response"),
        (made(document={"url": "https://a.example/wiki/T1"}), "unresolved_document"), (made(document={"url": "https://b.example/docx/T1"}), "unresolved_document"),
        (made(document={"document_id": "T2"}), "unresolved_document"), (json.dumps({"ok": False, "error": {"type": "auth"}}), "auth"), ("{}", "protocol_error"), ("{", "protocol_error"),
        (json.dumps({"ok": True, "data": []}), "invalid_response"), (None, "protocol_error"),
    ]
    rows = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(cases)], "n int, t string")
    got = {r.n: r.p for r in rows.select("n", files.payload(F.col("t"), F.lit("https://a.example/docx/T1"), ["a.example"]).alias("p")).collect()}
    assert [got[n].error for n in range(len(cases))] == [e for _, e in cases]
    assert tuple(got[0])[:4] == ("T1", 3, "https://a.example/docx/T1", "<p/>") and got[1].xml == "<q/>" and got[3].url == "https://a.example/docx/T1"


def test_lanes_parse_or_name_the_first_fault(spark):
    def answer(*items, summary="好 "):
        return json.dumps({"summary": summary, "decisions": list(items)})

    def item(**more):
        whole = {"rule": " SEMANTIC_A ", "finding_index": None, "action": "ASK", "reason": "r", "before": "b", "after": "", "related_finding_indexes": [1, 2]} | more
        return {k: v for k, v in whole.items() if v != "-"}

    cases = [
        (answer(item()), None, None), (f" ```json\n{answer(item())}\n ``` ", None, None), (answer(), None, None), (answer(item(before="-", after="-")), None, None), ("{", "json", None), (f"```json\n{answer()}", "json", None),
        ("[]", "object", None), (answer(summary=" "), "summary", None), ('{"summary": "s", "decisions": {}}', "decisions", None), (answer(item(), 5), "object", 2), (answer(item(rule=" ")), "rule", 1),
        (answer(item(finding_index=0)), "finding_index", 1), (answer(item(finding_index=True)), "finding_index", 1), (answer(item(action="NO")), "action", 1), (answer(item(reason=3)), "reason", 1),
        (answer(item(before=None)), "before/after", 1), (answer(item(related_finding_indexes=[3])), "related", 1), (answer(item(related_finding_indexes=["1"])), "related", 1),
        (answer(item(related_finding_indexes="-")), "related", 1), (answer(item(related_finding_indexes=[1, 1])), "related twice", 1), (answer(item(finding_index=1)), "indexed", 1),
        (answer(item(), item(rule="X")), "rule name", 2), (answer(item(action="KEEP")), "keep", 1), (answer(item(action="KEEP"), item(reason="")), "reason", 2), (None, "json", None),
    ]
    rows = spark.createDataFrame([(n, t) for n, (t, _, _) in enumerate(cases)], "n int, t string")
    got = {r.n: r.p for r in rows.select("n", decisions.parse_lane(F.col("t"), "semantic", F.lit(2)).alias("p")).collect()}
    assert [(got[n].error, got[n].item) for n in range(len(cases))] == [(e, i) for _, e, i in cases]
    assert got[0].summary == "好" and got[0].decisions == got[1].decisions and tuple(got[0].decisions[0]) == (None, "SEMANTIC_A", "ASK", "r", "b", "", [1, 2])
    assert got[3].decisions[0].before == "" and got[2].decisions == []
    static = rows.where("n = 0").unionByName(spark.createDataFrame([(99, answer(item(rule="C001", action="KEEP", finding_index=2)))], "n int, t string"))
    told = {r.n: r.p for r in static.select("n", decisions.parse_lane(F.col("t"), "static", F.lit(2)).alias("p")).collect()}
    assert told[0].error == "not indexed" and told[99].error is None and told[99].decisions[0].finding_index == 2


def test_stale_patches_find_their_block_by_place_alone(spark):
    xml = '<h1 id="h">题</h1><p id="n1">甲乙</p><p id="n2">丙<b>丁</b></p><p id="n3">丙戊</p><p>己</p><h2 id="k">小</h2><p id="n4">庚</p><h1>题</h1>'
    docs = spark.createDataFrame([(1, xml)], "doc_id long, xml string")
    rows, runs = X.placed(X.blocks(docs)), X.runs(docs)
    made = [
        (1, 1, "题[1]", "", 1, 2, "乙"), (1, 2, "题[1]", "0", 0, 1, "丁"), (1, 3, "题[1]", "", 0, 1, "丙"), (1, 4, "题[1]", "", 0, 1, "乙"), (1, 5, "题[1]", "", 0, 1, "己"), (1, 6, "题[1]", "", 0, 1, "庚"),
        (1, 7, "无[1]", "", 0, 1, "庚"), (1, 8, "题[1]/小[1]", "", 0, 1, "庚"), (1, 9, "题[1]", "", 0, 2, "丙戊"),
    ]
    patches = spark.createDataFrame(made, "doc_id long, patch_id int, locator string, path string, source_start int, source_end int, before string")
    got = {r.patch_id: (r.block_id, r.failure) for r in X.remapped(patches, runs, X.sections(rows), X.owners(rows)).collect()}
    assert got == {
        1: ("n1", None), 2: ("n2", None), 3: (None, "remap_failed"), 4: (None, "remap_failed"), 5: (None, "remap_failed"), 6: (None, "block_outside_section"), 7: (None, "missing_section"), 8: ("n4", None), 9: ("n3", None),
    }
