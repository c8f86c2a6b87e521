"""Manifests, searches within budgets, checked overwriting, rules and profiles as tables; new queries against their SQL."""

import hashlib
import json
import multiprocessing
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from penforge.functions import rules
from penforge.operators import lint, manifests, review
from penforge.plans.revision_queries import QUERIES, SQL
from penforge.sources import files

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA), con.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(columns).collect())))
    assert rows and rows == sorted(map(repr, want.select(*columns).fetchall()))


# --- manifests ---------------------------------------------------------------------------------------------------------


def patch(**changed):
    own = {"patch_id": "p1", "section_locator": "s", "section_fingerprint": "f", "block_id": "b", "node_path": [0], "source_start": 1, "source_end": 2, "before": "a", "after": "", "rule_id": "R", "rationale": "r"}
    return {k: v for k, v in (own | changed).items() if v != "gone"}


def whole(**changed):
    own = {"document_id": "D", "section_locator": "s", "initial_fingerprint": "f", "base_revision": 0, "approved_patch_ids": ["p1"], "expected_fingerprints": [], "patches": [patch()]}
    return json.dumps({k: v for k, v in (own | changed).items() if v != "gone"})


MANIFESTS = [
    (whole(), None), (whole(patches=[], approved_patch_ids=[]), None), (whole() + " " * manifests.MOST_BYTES, "manifest_limit"), ("{", "manifest_json"), ("[]", "manifest_schema"), ("null", "manifest_schema"),
    (whole(extra=1, document_id="E"), "unknown_fields"), (whole(document_id=5), "document_mismatch"), (whole(document_id="gone"), "document_mismatch"), (whole(patches={}), "manifest_schema"), (whole(patches="gone"), "manifest_schema"),
    (whole(patches=[5]), "manifest_schema"), (whole(patches=[patch(more=1)]), "unknown_fields"), (whole(patches=[patch(patch_id="")]), "manifest_schema"), (whole(patches=[patch(patch_id=0)]), "manifest_schema"),
    (whole(patches=[patch(patch_id=7)], approved_patch_ids=["7"]), None), (whole(patches=[patch(patch_id="gone")]), "manifest_schema"), (whole(patches=[patch(), patch()]), "duplicate_patch_id"),
    (whole(patches=[patch(), patch(more=1), patch()]), "unknown_fields"), (whole(patches=[patch(), patch(), patch(more=1)]), "duplicate_patch_id"), (whole(patches=[patch(node_path="0")]), "manifest_schema"), (whole(patches=[patch(node_path=[1.5])]), "manifest_schema"),
    (whole(patches=[patch(node_path=[])]), None), (whole(patches=[patch(rationale="gone")]), "manifest_schema"), (whole(patches=[patch(source_end="x")]), "manifest_schema"), (whole(patches=[patch(source_end="12")]), None),
    (whole(approved_patch_ids="p1"), "manifest_schema"), (whole(approved_patch_ids=["p1", 1]), "manifest_schema"), (whole(approved_patch_ids=["p1", "p1"]), "duplicate_approved_id"), (whole(expected_fingerprints=[1]), "manifest_schema"),
    (whole(expected_fingerprints="gone"), "manifest_schema"), (whole(approved_patch_ids=[]), "unapproved_patch"), (whole(approved_patch_ids=["p1", "p2"]), "missing_patch"), (whole(section_locator=""), "manifest_schema"),
    (whole(initial_fingerprint=1), "manifest_schema"), (whole(base_revision=-1), "manifest_schema"), (whole(base_revision=True), "manifest_schema"), (whole(base_revision="1"), "manifest_schema"), (whole(base_revision=1.5), "manifest_schema"), (whole(base_revision=12), None),
]


def test_the_first_error_of_each_manifest(spark):
    rows = [(i, t, "D") for i, (t, _) in enumerate(MANIFESTS)] + [(-1, whole(), None), (-2, None, "D")]
    table = spark.createDataFrame(rows, "id int, text string, document_id string")
    got = {r.id: r.e for r in table.select("id", manifests.manifest_error(F.col("text"), F.col("document_id")).alias("e")).collect()}
    assert got.pop(-1) == "unresolved_document" and got.pop(-2) == "manifest_json"
    assert got == {i: e for i, (_, e) in enumerate(MANIFESTS)}
    patches = manifests.manifest_patches(table, "id").orderBy("id").collect()
    assert len(patches) == sum(e is None for _, e in MANIFESTS) - 1 and patches[0].node_path == [0] and patches[0].after == ""


# --- search ------------------------------------------------------------------------------------------------------------


def folder(spark, *texts, size=None):
    return spark.createDataFrame([(f"f{i:03}.md", size or len((t or "").encode()), t) for i, t in enumerate(texts)], "path string, size long, content string")


def test_matches_and_snippets(spark):
    long = "x" * 400 + "NeedLe" + "y" * 400
    found = review.search_matches(folder(spark, "a\r\nneedle needle\x0bb", long, None, "none"), "NEEDLE").collect()
    assert [(r.path, r.line, r.col, r.start_char, r.end_char, r.offset) for r in found] == [("f000.md", 2, 1, 0, 6, 3), ("f001.md", 1, 401, 400, 406, 400)]
    assert found[1].text == long[250:750] and (found[1].snippet_start_char, found[1].snippet_end_char) == (250, 750)
    assert [r.col for r in review.search_matches(folder(spark, "😀a.b", "axb 中文"), "a.b").collect()] == [2]
    assert [r.path for r in review.search_matches(folder(spark, "x", "x"), "X", prefix="f001").collect()] == ["f001.md"]
    with pytest.raises(ValueError):
        review.search_matches(folder(spark, "x"), "x", prefix="a/../b")


def summary(*args):
    return tuple(review.search_summary(*args).first())


def test_budgets(spark):
    assert summary(folder(spark, "x", "y", None), "x") == (1, True, 2, 2, 1)
    assert summary(folder(spark, "x", "y"), "x") == (1, False, 2, 2, 0)
    assert summary(folder(spark, *["x"] * 40), "x", 20) == (20, True, 20, 20, 0)
    assert summary(folder(spark, *["x\nx"] * 40), "x", 99) == (30, True, 15, 45, 0)
    assert summary(folder(spark, *["y"] * 201), "x") == (0, True, 200, 200, 0)
    assert summary(folder(spark, *["y"] * 5, size=1 << 20), "x") == (0, True, 2, 2 << 20, 0)
    assert summary(folder(spark, "y", size=3 << 20), "x") == (0, True, 0, 0, 0)
    assert summary(folder(spark, "y").where("false"), "x") == (0, False, 0, 0, 0)


# --- checked overwriting -----------------------------------------------------------------------------------------------


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_edits_of_files(spark, tmp_path):
    for name, data in (("a.md", b"old"), ("b.md", "﻿old".encode()), ("c.md", b"other"), ("d.md", b"old")):
        (tmp_path / name).write_bytes(data)
    at = lambda name: str(tmp_path / name)
    rows = [(at("a.md"), "né", digest(b"old"), True), (at("b.md"), "new", digest("﻿old".encode()), True), (at("c.md"), "new", digest(b"old"), True), (at("d.md"), "new", digest(b"old"), False), (at("e.md"), "new", "", True), (at("d.md"), None, digest(b"old"), True)]
    edits = spark.createDataFrame(rows, "path string, text string, expected_sha256 string, confirmed boolean")
    for _ in range(2):  # a task that runs again finds its work done
        got = [(r.path.rsplit("/")[-1], r.sha256, r.error) for r in files.overwritten(edits.coalesce(1)).collect()]
        assert got == [("a.md", digest("né".encode()), None), ("b.md", digest("﻿new".encode()), None), ("c.md", None, "changed"), ("d.md", None, "unconfirmed"), ("e.md", None, "FileNotFoundError"), ("d.md", None, "no_text")]
    assert (tmp_path / "b.md").read_bytes() == "﻿new".encode() and (tmp_path / "c.md").read_bytes() == b"other" and (tmp_path / "d.md").read_bytes() == b"old"
    assert not [x for x in os.listdir(tmp_path) if x.endswith(".tmp")]


def _write(args):
    return files.write_checked(*args)


def test_of_two_writers_one_wins(tmp_path):
    path = tmp_path / "x.md"
    for n in range(5):
        path.write_bytes(b"old")
        with multiprocessing.get_context("spawn").Pool(4) as pool:
            got = pool.map(_write, [(str(path), f"new {n} {i}" * 1000, digest(b"old")) for i in range(4)])
        winners = [i for i, (_, error) in enumerate(got) if error is None]
        assert len(winners) == 1 and path.read_text() == f"new {n} {winners[0]}" * 1000 and sum(e == "changed" for _, e in got) == 3


# --- rules and profiles as tables --------------------------------------------------------------------------------------


def docs(spark, *texts):
    return spark.createDataFrame([(i, "a.md", t) for i, t in enumerate(texts)], "doc_id long, filename string, text string")


def rule(spark, *rows):
    return rules.rule_frame(spark).unionByName(spark.createDataFrame([(r, s, "own", v, m, p, g, "w {w}", "h") for r, s, v, m, p, g in rows], rules.RULE_KIND))


def test_a_users_rule(spark):
    table = rule(spark, ("U2", None, "error", False, ["red|green", r"(\w)\1\1"], None), ("U1", 3, "warning", True, [r"a\.b", r"x\s+y"], "a.b!"))
    text = "red aaa a.b a.b! `z` x `q` y 可能"
    rows = [(r.col, r.rule_id, r.severity, r.found, r.message, r.review_hint) for r in lint.ordered_scan(docs(spark, text), "general", table).collect()]
    assert rows == [(1, "U2", "error", "red", "w red", "h"), (5, "U2", "error", "aaa", "w aaa", "h"), (9, "U1", "candidate", "a.b", "w a.b", "h"), (22, "U1", "candidate", "x     y", "w x     y", "h")] + [
        (30, "H002", "candidate", "可能", rows[-1][4], rules.HINTS["H002"])]


def test_hits_over_a_mask_in_a_table(spark):
    table = rule(spark, ("U1", 3, "warning", False, [r"x\s+y"], None))
    rows = lint.scan(docs(spark, "| a x `q` y | x |\n|---|---|\n| y | z |"), "general", table).collect()
    assert [(r.ln, r.col, r.found, r.message) for r in rows] == [(1, 5, "x `q` y", "w x `q` y")]


def test_a_users_profile(spark):
    own = spark.createDataFrame([("mine", ["H002", "S001"], {"H001": "error", "C002": "error"}, 9)], rules.PROFILE_KIND)
    profiles = rules.profile_frame(spark).unionByName(own)
    scan = lambda name: [(r.rule_id, r.severity) for r in lint.ordered_scan(docs(spark, "可能大概赋能。" + "长" * 90), name, None, profiles).collect()]
    assert scan("mine") == [("H001", "error"), ("C002", "candidate"), ("D001", "warning")] or scan("mine")[:2] == [("H001", "error"), ("C002", "candidate")]
    assert [r for r, _ in scan("general")][:3] == ["H002", "H001", "C002"] and "S001" in [r for r, _ in scan("nobody")]
    assert "S001" not in [r for r, _ in scan("mine")]


def test_tables_equal_the_constants(spark):
    for profile in [*rules.PROFILES, "unknown"]:
        assert rules.active(profile, rules.rule_frame(spark), rules.profile_frame(spark)) == rules.active(profile)
    with pytest.raises(ValueError):
        rules.active("general", rule(spark, ("H001", None, "error", False, [], None)))
    assert lint.scan(docs(spark, "可能"), "general", rules.rule_frame(spark).where("false")).count() == 0


def test_many_hits_of_one_line(spark):
    text = "可能大概。" * 3000
    found = lint.scan(docs(spark, text)).groupBy("rule_id", "sentence").agg(F.count("*").alias("n"), F.sum("col").alias("s")).collect()
    assert {(r.rule_id, r.sentence, r.n, r.s) for r in found} == {(rule, "可能大概。", 3000, sum(5 * i + col for i in range(3000))) for rule, col in (("H002", 1), ("H001", 3))}
