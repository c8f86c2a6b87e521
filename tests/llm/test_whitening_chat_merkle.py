import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from penforge.llm import chat, merkle, whitening
from penforge.llm.template import FILTERS, Template, TemplateError, fold, parse

VECTORS = "vec_id long, embedding array<float>, n string"
TURNS = "conv_id long, turn long, role string, text string, part int"
DOCS = "doc_id long, source string, lang string, n_chars long, text string, key string"


# --- whitening ---------------------------------------------------------------------------------------------------------


def test_whitening_equals_dense_linear_algebra(spark):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(300, 40)) @ rng.normal(size=(40, 40)) * 3).astype(np.float32)
    v[:100] = v[0]  # a third of all rows is one vector
    rows = [(i, x.tolist(), "n") for i, x in enumerate(v)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5)).toPandas()
    x = np.floor(64 * v.astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    w = (c @ u / np.sqrt(e))[:, :32]
    white = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(n)].to_numpy()
    assert white.shape == (300, 32) and np.abs(white * np.sign((white * w).sum(0)) - w).max() < 1e-8
    assert np.allclose(np.cov(white.T, bias=True), np.eye(32), atol=1e-8) and got.identity_error.max() < 1e-9
    share = got.drop_duplicates("component").set_index("component").explained
    assert np.allclose(share.loc[range(1, 33)], (e / e.sum())[:32]) and got.n.eq(n).all()
    deviation = got.drop_duplicates("vec_id").set_index("vec_id").deviation.astype(object)
    assert [int(deviation[i]) for i in range(n)] == [int(d) for d in ((n * x - s) ** 2).sum(1)]


@pytest.mark.parametrize("rows, n_rows", [
    ([], 0),
    ([(1, None, "a"), (2, [float("nan"), 1.0], "a"), (3, [None, 1.0], "a"), (4, [float("inf"), 1.0], "a"), (5, [], "a")], 0),
    ([(1, [1.0, 2.0], "a")], 2),  # no variance
    ([(None, [1.0, 2.0], "a"), (2**60, [0.0, 2.5], "a"), (2, [3.0, 4.0], None), (2, [3.0, 4.0], "a"), (3, [7.0], "a")], 9),
])
def test_whitening_of_odd_tables(spark, rows, n_rows):
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == n_rows and {r.vec_id for r in got} <= {r[0] for r in rows}
    assert all((r.whitened is None) == (r.explained is None or r.explained < 1e-9) for r in got)


def test_deviation_beyond_a_long_is_exact(spark):
    rows = [(1, [1e12, 1.0], "a"), (2, [0.0, 2.0], "a")]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(spark.createDataFrame(rows, VECTORS.replace("float", "double"))).collect()}
    x = np.array([[64 * 10**12, 64], [0, 128]], object)
    assert got == {i + 1: int(((2 * x[i] - x.sum(0)) ** 2).sum()) for i in range(2)}


# --- the template language ---------------------------------------------------------------------------------------------


def rendered(source, **given):
    return "".join(t for t, _ in Template(source).render(given.pop("messages", []), **given))


@pytest.mark.parametrize("source, given, want", [
    ("{{ 1 + 2 * 3 }}{# note #} {{ 7 // 2 }}{{ 7 % 4 }}", {}, "7 33"),
    ("{{ a.b['c'] }}|{{ a.x }}|{{ nothing.at.all }}", {"a": {"b": {"c": "d"}}}, "d||"),
    ("a {%- if x == 1 -%} b {%- elif x == 2 -%} c {%- else -%} d {%- endif -%} e", {"x": 2}, "ace"),
    ("{% for x in xs %}{{ loop.index }}{{ x }}{% if not loop.last %},{% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1a,2b"),
    ("{% set y = x ~ '!' %}{{ y | upper }}{{ 'yes' if 'b' in x and not none else 'no' }}", {"x": "ab"}, "AB!yes"),
    (r"{{ 'a\nb\'' | replace('a', x | default('z')) }}", {}, "z\nb'"),
    ("{{ (-1) < 2 or 1 }}{{ xs | join('-') }}{{ xs | length }}", {"xs": ["p", 1, None]}, "Truep-1-3"),
])
def test_templates(source, given, want):
    assert rendered(source, **given) == want
    tree = fold(parse(source, FILTERS), FILTERS)
    assert fold(tree, FILTERS) == tree


def test_constants_are_folded():
    filters = {"upper": str.upper}
    tree = fold(parse("a{{ 'b' ~ 1 + 1 }}{% if 1 > 2 %}x{% elif true %}{{ 'c' | upper }}{% else %}y{% endif %}{{ z }}", filters), filters)
    assert [(n.kind, n.value) for n in tree.children] == [("text", "ab2C"), ("print", None)]


@pytest.mark.parametrize("source", [
    "{{ a", "{% if a %}", "{% endfor %}", "{{ 1 1 }}", "{{ a | open }}", "{% include 'x' %}", "{{ '' + 1 }}", "{{ 'a' * 9 }}", "{{ x.__class__ }}",
    "{% for c in 'abc' %}{% endfor %}", "{{ 1 // 0 }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ messages }}", "{{ $ }}", "{{ 1 < 'a' }}",
])
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        rendered(source, x="text")


def test_streaming_equals_rendering():
    rng = random.Random(5)
    messages = [{"role": rng.choice("ua"), "text": str(i)} for i in range(9)]
    source = "{{ head }}{% for m in messages %}{% if loop.first %}<{% endif %}{{ loop.index }}{% generation %}{{ m.text }}{% endgeneration %}{% if loop.last %}>{% endif %}{% endfor %}tail"
    template = Template(source)
    seen = 0

    def one_by_one():
        nonlocal seen
        for m in messages:
            seen += 1
            yield m

    parts = []
    for i, out in enumerate(template.stream(one_by_one(), head="h")):
        assert seen <= i + 1  # one message is read ahead
        parts += out
    assert template.streams and parts == template.render(messages, head="h")
    assert not Template("{{ messages | length }}{% for m in messages %}{% endfor %}").streams


# --- chat formatting ---------------------------------------------------------------------------------------------------


def by_hand(rows):
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[conv_id] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = ["\\", "### ", "</turn>", "\n", ":", "user", "assistant", "é", "😀", "<", "#", " ", "{{ x }}", "a"]
    word = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", word(4), None]), rng.choice([word(30), None, chat.HOSTILE]), 0) for c in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(None, None, "user", "no id", 0), (None, 1, "assistant", "x" * 500_000, 0), rows[0], rows[0]]
    rows += [(99, t, "assistant", f"turn {t}" * 20, 0) for t in range(400)]  # much of all rows in one conversation
    want = by_hand(rows)
    out = chat.formatted(spark.createDataFrame(rows, TURNS).repartition(7), most=1000)
    assert out.groupBy("conv_id").count().where("conv_id = 99").first()["count"] > 10
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == want
    chars = {r.conv_id: r.n for r in out.groupBy("conv_id").agg(F.sum(F.char_length("text")).alias("n")).collect()}
    assert chars == {c: r.formatted_chars for c, r in got.items()}


def test_chat_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    assert chat.read_back(chat.formatted(empty)).count() == 0
    row = chat.read_back(chat.formatted(chat.with_hostile(empty))).first()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(chat.HOSTILE))


# --- Merkle manifest ---------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """(root, the siblings of each node with their side, from below)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append(("L" if other < place else "R", nodes[other]) if other < len(nodes) else ("-", ""))
        nodes, at = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], [p // 2 for p in at]
    return nodes[0], paths


def manifest_by_hand(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: H(*map(field, (r[0], r[1], r[2], r[3], r[4])))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs]
    below = [tree([leaf(r) for r in g]) for g in groups]
    root, above = tree([sub for sub, _ in below])
    out = []
    for g, (sub, paths), upper in zip(groups, below, above):
        for r, path in zip(g, paths):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            folded = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for side, h in path + upper:
                folded = H(h, folded) if side == "L" else H(folded, h)
            out.append((r[0], leaf(r), sub, root, H(*(h for _, h in path + upper)), folded, folded == root))
    return sorted(out, key=str)


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


@pytest.mark.parametrize("n, levels", [(1, 10), (2, 10), (7, 1), (45, 2), (130, 3)])
def test_manifest_equals_a_plain_tree(spark, n, levels):
    rng = random.Random(n)
    rows = [(i * 3 - 20, rng.choice(["a", None, "ü"]), rng.choice(["en", "en", "en", "de", "日", "", None][: 1 + n]), rng.choice([1, 20, None]), rng.choice(["t", None, "", "é😀"]), "clash") for i in range(n)]
    if n > 2:
        rows += [rows[0], rows[0], (None, "s", "en", 5, "t", "clash"), (None, None, None, None, None, None), (9_000, "s", "xx", 1, "y" * 300_000, "clash")]
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, merkle.manifest(docs.repartition(3), tampered(), levels).collect()), key=str)
    assert got == manifest_by_hand(rows)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "source", "lang", "n_chars", "text", "key"]).astype({"doc_id": "Int64", "n_chars": "Int64"}))
    distinct = [r for r in rows if r[0] is not None and rows.count(r) == 1]
    if len(distinct) == len(rows):
        assert sorted(con.sql(merkle.OP13_SQL).fetchall(), key=str) == got


def test_manifest_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS), tampered()).count() == 0
