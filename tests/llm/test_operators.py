import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from penforge.llm import bpe, decontaminate, exact_dedup, html_text, ngram_join, pii, quality, sharding, token_orc, toxicity

TEXTS = ["", None, "a b c d e f", "A b  c d e\tf", "the cat\nsat on the mat, twice", "x" * 3000, "ünïcode 😀 I'll   go", "a@b.co 1.2.3.4, 4111 1111 1111 1111 +44 20 7946 0958"]
BPE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "clash"), (None, "no id", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, slot string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def test_exact_dedup(docs, empty):
    rows = exact_dedup.DigestIndex(docs.sparkSession).ingest(docs).collect()
    assert len(rows) == 10 and sum(r.kept for r in rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[0].group_size == 2 and by[0].keep_id == 0 and by[3].keep_id == 3  # more code points than 2
    assert exact_dedup.deduplicate(docs).count() == 8
    assert exact_dedup.DigestIndex(empty.sparkSession).ingest(empty).count() == 0


def test_exact_dedup_persists(spark, docs):
    index = exact_dedup.DigestIndex(spark)
    index.ingest(docs)
    again = index.ingest(docs).collect()
    assert len(again) == 10 and not any(r.kept for r in again)


def test_sharding(docs, empty):
    rows = sharding.shard(docs, [1.0] * 4, [1.0] * 5, block_rows=2).collect()
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert all(r.grown_shard in (r.shard, 4) for r in rows)
    assert sharding.shard(empty, [1.0] * 4).count() == 0


def test_bpe(docs, empty):
    own, _ = bpe.codec(BPE, P.PATTERN), None
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rows = {r.doc_id: r for r in bpe.encode_decode(docs, BPE, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(empty, BPE, P.PATTERN).count() == 0


def test_token_orc(spark, docs, tmp_path):
    path = P.path("word_bpe_49k.json")
    token_orc.write_tokens(docs, f"{tmp_path}/orc", path)
    rows = sorted(token_orc.token_index(token_orc.read_tokens(spark, f"{tmp_path}/orc")).collect(), key=lambda r: r.start)
    tokenizer, at = Tokenizer.from_file(path), 0
    texts = dict(enumerate(TEXTS)) | {None: "no id"}
    assert rows[0].doc_id is None and len(rows) == 10
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pii(docs):
    found = {r.doc_id: r for r in pii.summary(pii.find_spans(docs)).collect()}
    assert (found[7].n_email, found[7].n_ip, found[7].n_card, found[7].n_phone) == (1, 1, 1, 1)
    assert found[0].spans == "" and found[0].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_ngram_join(spark):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base).upper().replace(" ", "\n"), " ".join([*base[:59], "z"]), " ".join(base[::-1]), None, "", "a b", "A\tb"]
    rows = {r.doc_id: r for r in ngram_join.join_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [rows[i].component_id for i in range(8)] == [0, 0, 0, 3, 4, 5, 6, 6]
    assert [rows[i].n_shingles for i in range(8)] == [56, 56, 56, 56, 0, 0, 1, 1]


@pytest.mark.parametrize("text, n", [(b"a", 1), (b"a b", 1), (b"a b c", 1), (b"a b c d", 1), (b" \n", 0)])
def test_shingles_of_one_short_document(text, n):
    assert [len(x) for x in ngram_join.shingle_sets([text])] == [n]
    together = ngram_join.shingle_sets([text, b"g h i j k l m n"])
    assert together[0].tolist() == ngram_join.shingle_sets([text])[0].tolist()


def test_one_row_of_each_class_stays(spark):
    text = lambda c, last="z": " ".join([*[f"{c}{i}" for i in range(59)], last])
    rows = [(None, text("a")), (None, text("a", "y")), (None, text("a")), (1, text("b")), (1, text("b", "y")), (1, text("b")), (2, text("b", "x")), (2, text("c")), (3, text("c", "y")), (4, text("d")), (None, text("d", "y"))]
    rows += [(5, ""), (5, ""), (None, None), (6, text("e")), (6, text("f"))]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, more int")
    got = ngram_join.one_of_each(docs).collect()
    assert len({r.more for r in got}) == len(got) and all((r.doc_id, r.text) == rows[r.more] for r in got)
    classes = sorted((r.text or "")[:1] for r in got)
    assert classes == ["", "", "", "a", "b", "c", "d", "e", "f"]
    assert {(r.text[0], r.doc_id) for r in got if r.text} == {("a", None), ("b", 1), ("c", 2), ("d", 4), ("e", 6), ("f", 6)}
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0


def test_ngram_join_of_a_crowd(spark):
    """Copies of one text with few to many edits, more than make a shingle heavy, against all pairs."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(160):
        words = [f"w{j}" for j in range(int(rng.integers(100, 130)))]
        for j in rng.choice(len(words), int(rng.integers(0, 7)), replace=False):
            words[j] = f"e{i}x{j}"
        texts.append(" ".join(words))
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in map(str.split, texts)]
    least = list(range(len(sets)))
    for _ in sets:
        now = [min(least[j] for j, b in enumerate(sets) if 100 * len(a & b) >= 80 * len(a | b)) for a in sets]
        if now == least:
            break
        least = now
    assert 1 < len(set(least)) < len(sets)
    rows = ngram_join.join_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [c for _, c in sorted((r.doc_id, r.component_id) for r in rows)] == least


def test_shared_prefix_is_a_lower_bound(spark):
    rng = np.random.default_rng(4)
    sizes = []
    for _ in range(400):
        b = int(rng.integers(1, 120))
        order = rng.permutation(200)
        y = order[:b]
        x = np.concatenate([y[rng.random(b) < 0.95], order[150 : 150 + rng.integers(0, 1 + b // 10)]])
        if len(x) and 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)):
            prefix = [np.sort(s)[: min(len(s), len(s) - ngram_join.needed(len(s), 80) + 1 + ngram_join.extra(len(s)))] for s in (x, y)]
            sizes.append((len(x), b))
            assert len(np.intersect1d(*prefix)) >= ngram_join.shared_prefix(len(x), b, 80)
    assert len(sizes) > 100
    rows = spark.createDataFrame(sizes, "n int, m int").withColumn("least", ngram_join._shared_prefix(80)).collect()
    assert all(r.least == ngram_join.shared_prefix(r.n, r.m, 80) for r in rows)


def test_divide_skip():
    rng = np.random.default_rng(1)
    for _ in range(200):
        q = np.unique(rng.integers(0, 80, 40).astype(np.uint64))
        c = [np.unique(np.concatenate([q[rng.random(len(q)) < 0.95], rng.integers(0, 90, 3).astype(np.uint64)])) for _ in range(12)]
        want = [100 * len(np.intersect1d(q, x)) >= 80 * len(np.union1d(q, x)) for x in c]
        assert ngram_join.divide_skip(q, c, 80).tolist() == want


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min(row)


def test_myers_and_leaks(spark):
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = ("".join(rng.choice(list("abc"), n)) for n in (12, 40))
        assert decontaminate.myers(decontaminate.masks(item), len(item), text)[0] == distance(item, text)
    item = "the quick brown fox jumps over the lazy dog and then sleeps all day"
    texts = [f"before {item} after", "x " + item.replace("lazy", "lzy").upper(), "clean text of another kind", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, None), (7, "")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 5, 0), (1, 5, 1)}
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {2, 3, 4}
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0


def test_html(spark):
    page = "<body><div class='menu'>x</div><p>one two three four five six seven eight nine</p><p>Own {0} &amp; <b>b</b>old<br>end</p>"
    rows = [(i, f"http://a.b/{i}", page.format(i)) for i in range(4)] + [(8, None, None), (9, "http://c.d", "<article>a<aside>n</aside><p>b</article><footer>f</footer>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Own {i} & bold end" for i in range(4)} | {8: "", 9: "a b"}


def test_html_runs_are_counted_over_a_whole_host(spark):
    """A passage on 3 of 60 pages, which 15 groups hold apart, goes as it does from one group; one on 2 pages stays."""
    shared, rare = " ".join(f"s{i}" for i in range(12)), " ".join(f"r{i}" for i in range(12))
    page = lambda i: "".join(f"<p>{t}</p>" for t in [f"own{i} text", *[shared] * (i % 20 == 0), *[rare] * (i in (5, 50))])
    rows = [(i, f"http://a.b/{i}", page(i)) for i in range(60)] + [(5, "http://a.b/5", page(5)), (99, "http://c.d", f"<p>{shared}</p>")]
    rows += [(100 + i, f"http://e.f/{i}", f"<article>x{i}</article><p>{shared}</p>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, whole = (sorted(map(tuple, html_text.extract(pages, group_pages=n).collect())) for n in (4, 1000))
    assert got == whole and len(got) == len(rows)
    texts = {p: t for p, _, t, _ in got}
    assert [texts[i] for i in (0, 20, 40, 1)] == ["own0 text", "own20 text", "own40 text", "own1 text"]
    assert texts[5] == f"own5 text {rare}" and texts[99] == shared and texts[101] == "x1"


def test_html_body_beside_a_small_article(spark):
    """Unique text around an article that is not the bulk of its page stays; comments that are articles go."""
    body, shared = "the body of page {0} stands in a block beside the teaser", "a line that every page of this host has in its frame"
    pages = [f"<div>{body.format(i)}</div><article>teaser {i}</article><div>{shared}</div>" for i in range(4)]
    long = " ".join(f"w{i}" for i in range(40))
    pages += [f"<article class='post comments-open'>{long}<article class='reply'>r</article><article>part</article></article><div>frame</div>"]
    pages += [f"<main><article class='post has-sidebar'>{long}</article><article class='comment' id=div-comment-5>c</article></main>", "<article class='comment-body'>only a comment</article>"]
    docs = spark.createDataFrame([(i, "http://a.b/", x) for i, x in enumerate(pages)], "page_id long, url string, html string")
    for groups in (256, 2):
        got = [t for _, t in sorted((r.page_id, r.text) for r in html_text.extract(docs, group_pages=groups).collect())]
        assert got == [f"{body.format(i)} teaser {i}" for i in range(4)] + [f"{long} part", long, ""]


def test_runs_equal_brute_force():
    rng = np.random.default_rng(3)
    words = [rng.choice(list("abcd"), 30).tolist() for _ in range(6)]
    got = html_text.covered(list(range(6)), words, 3, 3)
    for w, flags in zip(words, got):
        want = np.zeros(30, bool)
        for i in range(28):
            if sum(any(x[j : j + 3] == w[i : i + 3] for j in range(28)) for x in words) >= 3:
                want[i : i + 3] = True
        assert flags.tolist() == want.tolist()


def test_classifiers(spark):
    good, bad = "a plain line of text with words in it. ", "!!! $$$ ### LOUD ||| "
    rows = [(i, (good if i % 2 else bad) * (3 + i % 5)) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    points = quality.with_statistics(docs)
    got = {r.doc_id: r.predicted for r in quality.scored(points, quality.trained(points, labels)).collect()}
    assert all(got[i] == i % 2 for i in range(80)) and len(got) == 82
    scores = {r.doc_id: r.score for r in toxicity.trained_scores(docs, labels).collect()}
    assert len(scores) == 82 and all((scores[i] >= 0.5) == (i % 2 == 0) for i in range(80))
    assert {r.score for r in toxicity.trained_scores(docs, labels.limit(0)).collect()} == {0.0}
