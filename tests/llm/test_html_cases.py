"""Cases of the main-text operator: losses that names, heads and forms caused, copies of pages, articles without tags."""

import re
import time

import pyarrow.parquet as pq

from penforge.llm import html_text


def words_of(page: str) -> list[tuple[int, str]]:
    return html_text.blocks(page)


def test_names_inside_an_article():
    page = "<article><p class='share-price'>Price up</p><p id='alert'>Alert</p><div class='comments'>x</div><div class='post-comments list'>x</div><div class='share-buttons'>x</div><div class='share-price'>ok</div></article>"
    assert words_of(page) == [(1, "Price up"), (1, "Alert"), (1, "ok")]


def test_open_head_and_form_around_a_page():
    assert words_of("<head><title>t</title><p>hello</p>") == [(0, "hello")]
    assert words_of("<head><title>t</title>text") == [(0, "text")]
    page = "<body><form action=x><input><article><p>inside</p><form>no</form></article><p>button</p></form></body>"
    assert words_of(page) == [(1, "inside")]


def test_copies_without_article_tags_stay(spark):
    """Whole pages that repeat are no frame; the frame around different texts is."""
    text = " ".join(f"w{i}" for i in range(80))
    frame = "one line of the frame that stands on every page of it"
    rows = [(i, "http://a.b/", f"<div>{text}</div>") for i in range(5)]
    rows += [(10 + i, "http://a.b/", f"<div>{frame}</div><div>" + " ".join(f"p{i}x{j}" for j in range(60)) + "</div>") for i in range(5)]
    rows += [(20, "http://a.b/", None), (21, None, "<p>no address</p>")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i][0] == text for i in range(5))
    assert all(got[10 + i][0] == " ".join(f"p{i}x{j}" for j in range(60)) for i in range(5))
    assert got[20] == ("", 0) and got[21] == ("no address", 10)


def test_menus_of_any_length_go(spark):
    """A menu goes however large its share of a page; a page without words of its own stays."""
    rows, want = [], {}
    for n in (10, 30, 60, 120, 500):
        menu = " ".join(f"m{n}x{j}" for j in range(n))
        for i in range(5):
            want[n * 10 + i] = " ".join(f"own{n}x{i}x{j}" for j in range(5))
            rows.append((n * 10 + i, f"http://h{n}/", f"<div>{menu}</div><div>{want[n * 10 + i]}</div>"))
            want[n * 10 + 5 + i] = f"{menu} copied"
            rows.append((n * 10 + 5 + i, f"http://c{n}/", f"<div>{menu} copied</div>"))
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_long_pages_of_odd_tags_are_linear():
    n = 20_000
    for page in ("<div>" * n + "</p>" * n, "<b><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<div></div>" * n, "<head>" * n + "x", "<article>" * n + "x", "<i><div>" + "<b>" * n + "</i>" * n):
        start = time.perf_counter()
        words_of(page)
        assert time.perf_counter() - start < 3


def test_a_very_long_page():
    words = [f"w{i}" for i in range(300_000)]
    page = "<nav>menu</nav><article>" + "".join(f"<p>{' '.join(words[i : i + 50])}</p>" for i in range(0, len(words), 50)) + "</article>"
    assert " ".join(t for _, t in words_of(page)) == " ".join(words)


def test_supplied_pages_equal_their_article():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        own = re.search(r"<article.*?>(.*?)</article>", page, re.S)[1]
        assert [t for _, t in words_of(page)] == [t for _, t in words_of(f"<article>{own}</article>")]


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(rows).count() == 0
    rows = spark.createDataFrame([(1, "http://a.b", "<p>a</p>", "x", 3)], "page_id long, url string, html string, host string, n long")
    assert [tuple(r) for r in html_text.extract(rows).collect()] == [(1, "http://a.b", "a", 1)]
