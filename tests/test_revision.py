"""Patches, contexts and diffs against plain definitions."""

import random
import unicodedata

from hypothesis import given, settings, strategies as st

from penforge.operators import revision
from penforge.plans import revision_queries
from pyspark.sql import functions as F

BITS = ["a", "b", "é", "é", "́", "👍", "🏽", "‍", "👩", "🇩", "🇪", "中", "\n", " ", "😀"]


def goes_on(text, i):
    if not 0 < i < len(text):
        return False
    a, b = text[i - 1], text[i]
    flag = lambda c: "\U0001f1e6" <= c <= "\U0001f1ff"
    return unicodedata.category(b)[0] == "M" or "‍" in (a, b) or "\U0001f3fb" <= b <= "\U0001f3ff" or flag(a) and flag(b)


def plain_patch(b, a):
    """The longest shared head and then tail that end and begin between characters."""
    whole = lambda i, j: not goes_on(b, i) and not goes_on(a, j)
    p = max(i for i in range(min(len(a), len(b)) + 1) if b[:i] == a[:i] and (i == 0 or all(b[:j] == a[:j] for j in range(i))) and (i == 0 or whole(i, i)))
    most = min(len(a), len(b)) - p
    s = max(i for i in range(most + 1) if b[len(b) - i :] == a[len(a) - i :] and (i == 0 or whole(len(b) - i, len(a) - i)))
    return p, b[p : len(b) - s], a[p : len(a) - s]


def pairs_of(n, seed):
    rng = random.Random(seed)
    out = [("", ""), ("abc", "abc"), ("", "x"), ("x", ""), ("e", "é"), ("🇩🇪🇩🇪", "🇩🇪🇩"), ("👩‍👩", "👩‍👍"), ("a" * 50_000 + "b" + "a" * 50_000, "a" * 100_000)]
    while len(out) < n:
        b = "".join(rng.choice(BITS) for _ in range(rng.randrange(12)))
        i, j = sorted(rng.randrange(len(b) + 1) for _ in range(2))
        out.append((b, b[:i] + "".join(rng.choice(BITS) for _ in range(rng.randrange(4))) + b[j:]))
    return out


def test_minimal_patches(spark):
    pairs = pairs_of(400, 1)
    rows = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(pairs)] + [(-1, None, "x")], "id int, before string, after string")
    out = revision.minimal_patches(rows, "id")
    got = {r.id: (r.start, r.before, r.after) for r in out.collect()}
    assert got.pop(-1) == (None, None, None)
    for i, (b, a) in enumerate(pairs):
        if len(b) < 1000:
            assert got[i] == plain_patch(b, a), (b, a)
    applied = rows.select("id", F.col("before").alias("text"), F.col("after").alias("want")).join(out, "id").where("id >= 0")
    assert applied.where(revision.patched(F.col("text"), F.col("start"), F.col("before"), F.col("after")) != F.col("want")).count() == 0


def test_change_context(spark):
    long = "x" * 80 + "é" * 75
    rows = [
        (0, "one\ntwo three\nfour", "three", None), (1, "aXbX", "X", 3), (2, "aXbX", "X", 2), (3, "aXbX", "X", 9), (4, "abc", "zz", None), (5, long + "HERE" + long, "HERE", None),
        (6, "🇩🇪👍🏽a\nb", "a\nb", None), (7, "", "", None), (8, "r\r\nq", "q", None),
    ]
    got = {r.id: tuple(r)[1:] for r in revision.change_context(spark.createDataFrame(rows, "id int, source string, before string, source_start int"), "id").collect()}
    assert got[0] == (None, "one\ntwo ", "three", "\nfour", 2, 5, 2, False, False)
    assert got[1] == (None, "aXb", "X", "", 1, 4, 1, False, False)
    assert got[2][:4] == ("mismatch", "", "X", "") and got[3][:4] == ("invalid", "", "X", "") and got[4] == (None, "", "zz", "", None, None, None, None, None)
    assert got[5][1] == "é" * 70 and got[5][3] == "x" * 70 and got[5][4:] == (1, 156, 1, True, True)
    assert got[6] == (None, "🇩🇪👍🏽", "a\nb", "", 1, 3, 2, False, False)
    assert got[7] == (None, "", "", "", 1, 1, 1, False, False) and got[8][4:6] == (2, 1)


def edits_by_table(a, b):
    """The least number of insertions and deletions, by the table of longest common subsequences."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return len(a) + len(b) - 2 * best[-1][-1]


items = st.lists(st.sampled_from("abc"), max_size=12)


@settings(max_examples=400, deadline=None)
@given(items, items)
def test_edits_are_fewest(a, b):
    found = revision.shortest_edits(a, b)
    assert [t for k, t in found if k != "insert"] == a and [t for k, t in found if k != "delete"] == b
    assert sum(k != "equal" for k, _ in found) == edits_by_table(a, b)


def test_equal_ways_delete_first():
    assert revision.diff(list("ab"), list("ba")) == [("delete", "a"), ("equal", "b"), ("insert", "a")]
    assert revision.diff(list("xay"), list("xby")) == [("equal", "x"), ("delete", "a"), ("insert", "b"), ("equal", "y")]


def test_the_bound_replaces_and_loses_nothing():
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    assert revision.diff(["h", *a, "t"], ["h", *b, "t"]) == [("equal", "h"), ("delete", "".join(a)), ("insert", "".join(b)), ("equal", "t")]
    assert len(revision.diff(a[:100], b[:100])) == 2
    many = ["x"] * 600_000
    assert revision.shortest_edits(["p", *many, "q"], [*many, "r", *many]) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a\n", "b\n", "\n", "cé", "中 👍🏽\n", "end"]), max_size=8).map("".join), st.lists(st.sampled_from(["a\n", "b\n", "\n", "cé", "中 👍\n", "end"]), max_size=8).map("".join))
def test_rows_hold_both_texts(before, after):
    rows = list(revision.diff_rows(before, after))
    side = lambda other: [(o if other == "insert" else n, "".join(t for _, t in parts)) for kind, o, n, parts in rows if kind != other]
    lines = lambda text: [(i, x) for i, x in enumerate(text.removesuffix("\n").split("\n") if text else [], 1)]
    assert side("insert") == lines(before) and side("delete") == lines(after)
    for kind, _, _, parts in rows:
        assert {k for k, _ in parts} <= {"equal", kind}


def test_revision_diff_of_a_table(spark):
    rows = [(1, "a\nold 中 line\nc\n", "a\nnew 中 line\nc\nd\n"), (2, None, ""), (3, "x", None)]
    got = revision.revision_diff(spark.createDataFrame(rows, "id long, before string, after string"), "id").orderBy("id", "row").collect()
    assert [(r.id, r.kind, r.old_line, r.new_line) for r in got] == [(1, "equal", 1, 1), (1, "delete", 2, None), (1, "insert", None, 2), (1, "equal", 3, 3), (1, "insert", None, 4), (3, "delete", 1, None)]
    assert [tuple(p) for p in got[1].parts] == [("delete", "old"), ("equal", " 中 line")]
    assert revision.revision_diff(spark.createDataFrame([], "id long, before string, after string"), "id").count() == 0


def test_a_search_that_gives_up_is_not_begun_and_a_small_table_gives_the_same_path(monkeypatch):
    asked = []
    inserts = revision._inserts
    monkeypatch.setattr(revision, "_inserts", lambda *x: asked.append(1) or inserts(*x))
    line = [chr(0x4E00 + i) for i in range(400)]
    assert revision.shortest_edits(line, list("-- first --\n")) is None and not asked
    assert len(revision.shortest_edits(line[:200], list("-- first --\n"))) == 212 and len(asked) == 212
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice(alphabet) for _ in range(rng.choice([0, 1, 5, 12, 60]))] for alphabet in ("abc", rng.choice(["abc", "cdefgh"])))
        assert revision._edits_by_table(a, b) == revision._edits_by_rounds(a, b)


def test_minimal_patches_query_needs_no_join(spark, tmp_path):
    # rows that share a doc_id are patched each for itself
    spark.createDataFrame([(1, "ne plus"), (1, "le 👩"), (2, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = revision_queries.minimal_patches(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.before, r.after) for r in out.collect()) == [(1, 1, "e", "é"), (1, 1, "e", "é")]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
