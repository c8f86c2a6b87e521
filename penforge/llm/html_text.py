"""Main text of pages by a suffix array over each host's pages.

A page becomes blocks of words in page order. The blocks of a host's pages, side by side, are one token stream, sorted
by suffix to the depth of a long run; runs that recur on several distinct pages are boilerplate. What the markup
itself calls the article (article, main) is kept even where pages repeat it, since copies of an article are no
boilerplate, and what it calls navigation, header, footer, aside, form, advert, notice or comment goes at once, an
article within an article or named as a comment with it. What is between goes where the article is the bulk of the page,
at least half of the words that are left; elsewhere the suffix array decides on it, and covered runs are cut out while
the unique runs around them stay. A page without an article or main element is wholly in between. A page with
no words of its own is a copy of other pages and stays as it is; from any other page the recurring runs go, whatever
their share of it. Inside an article class names rule out containers only, by whole names; a form around an article
doesn't rule it out.

A host's pages are dealt by hash into groups of about GROUP_PAGES, so that a host with a third of all pages is many
tasks. A group bounds the suffix array only: the distinct pages of every run are summed over the groups of a host, by a
64-bit hash of the run, and each group learns which of its rarer runs recur on enough pages of the host. That is done
for hosts of several groups on which at least one page is open, that is, on which runs decide anything.

Defined cases: null and empty html, and pages without text, give an empty string; a page without a host is its own
host ''; unclosed and misnested tags close with their nearest open ancestor, and an unclosed comment, script or tag
runs to the end; repeated rows give a row each and count as one page (same page_id); further columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, released, stored

#: Words of a long run, and the distinct pages on which it has to stand.
RUN_WORDS, RUN_PAGES = 8, 3
GROUP_PAGES = 256
#: Groups whose runs are summed in one task.
BUCKET_GROUPS = 32
#: A host with at least this share of all pages is split behind a broadcast of its name: there can be at most 1/share.
LARGE_SHARE = 0.001

#: Elements without main text, in any place.
DROPPED = frozenset("head script style noscript template iframe object svg math canvas nav footer aside form button select textarea dialog menu audio video".split())
#: Elements that hold text but no markup.
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements within a line of text; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that close an open p.
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Names in class, id or role that mark what isn't the article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notice|alert|sidebar|side-bar|nav(?:igation|bar)?|menu|breadcrumbs?|footer|masthead|"
    r"comments?|disqus|respond|replies|related|share|sharing|social|subscribe|newsletter|signup|login|popup|modal|widget|complementary|contentinfo)(?:$|[\s_-])", re.I)  # fmt: skip
#: Elements of running text: inside an article no name rules them out.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split()) | INLINE
#: Names that rule out a container inside an article: whole names, since a div of an article may say share-price of itself.
NAMED_WITHIN = re.compile(
    r"(?:^|\s)(?:[a-z0-9]+[_-])?(?:ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|notice|sidebar|nav(?:igation|bar)?|menu|breadcrumbs?|footer|"
    r"comments?|disqus|respond|replies|related|share|sharing|social|subscribe|newsletter|signup|login|popup|modal|widget|complementary|contentinfo)"
    r"(?:[_-](?:body|item|list|entry|thread|box|bar|block|section|area|container|wrapper|wrap|links?|buttons?|icons?|widgets?|posts?|articles?|stories|form|inner|\d+))*(?:$|\s)", re.I)  # fmt: skip
#: Elements that may stand in a head; any other ends it.
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
#: Names of an article that is a reader's comment: whole names, since an article may say comments-open of itself.
COMMENT = re.compile(r"(?:^|\s)(?:div-|user-|reader-)?(?:comments?|disqus|respond|repl(?:y|ies))(?:[_-](?:body|item|list|entry|content|thread|\d+))*(?:$|\s)", re.I)
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

MAIN, BETWEEN = 1, 0
FORM, GONE = 1, 2


def is_dropped(name: str, attributes: str, in_main: bool, in_article: bool) -> bool:
    if name in DROPPED or name == "header" and not in_main:
        return True
    if name == "article" and any(COMMENT.search(value.strip("\"'")) for key, value in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id", "role")):
        return True
    if attributes and name not in ("html", "body", "main") and (name != "article" or in_article):
        named = NAMED_WITHIN if in_main else NAMED
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True
            if key in ("class", "id", "role") and not (in_main and name in PROSE) and named.search(value):
                return True
    return False


def blocks(html: str) -> list[tuple[int, str]]:
    """(MAIN or BETWEEN, text) of each block that the markup doesn't rule out, in page order."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, bool, int]] = []  # name, dropped (FORM: for a form alone), in main, place of the nearest block element
    places: dict[str, list[int]] = {}  # of each name, where the stack holds it
    line: list[str] = []
    dropped, in_main = 0, False

    def end_block():
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            out.append((MAIN if in_main else BETWEEN, text))
        line.clear()

    def pop():
        nonlocal dropped, in_main
        places[stack.pop()[0]].pop()
        _, dropped, in_main, _ = stack[-1] if stack else ("", 0, False, -1)

    def end_head():
        while places.get("head"):
            pop()

    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        at = m.end()
        name = m[3]
        if m[5] is not None:
            if stack and stack[-1][0] == "head" and not m[5].isspace():
                end_head()
            if not dropped:
                line.append(m[5])
            continue
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            end_block()
        if m[2]:
            # an inline end tag doesn't close blocks around it
            if places.get(name) and (name not in INLINE or places[name][-1] > stack[-1][3]):
                i = places[name][-1]
                while len(stack) > i:
                    pop()
            continue
        if name in VOID or m[4].endswith("/") and name not in DROPPED:
            if name not in IN_HEAD and stack and stack[-1][0] == "head":
                end_head()
            continue
        if name in CLOSES_P:
            i = stack[-1][3] if stack else -1
            if i >= 0 and stack[i][0] == "p":
                while len(stack) > i:
                    pop()
        elif name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            if stack and stack[-1][0] == name:
                pop()
        if name not in IN_HEAD and stack and stack[-1][0] == "head":
            end_head()
        if dropped == FORM and name in ("article", "main"):  # a form around a page
            dropped = 0
        if dropped != GONE and is_dropped(name, m[4], in_main, name == "article" and bool(places.get(name))):
            dropped = FORM if name == "form" else GONE
        in_main = in_main or name in ("article", "main")
        places.setdefault(name, []).append(len(stack))
        stack.append((name, dropped, in_main, len(stack) if name not in INLINE else stack[-1][3] if stack else -1))
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if not dropped:
                line.append(html[at : close.start() if close else len(html)])
            at = close.start() if close else len(html)
    end_block()
    return out


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix), sorted by the first `depth` tokens, by prefix doubling."""
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64)
    n, step = len(tokens), 1
    while step < depth:
        step_by = min(step, depth - step)
        after = np.zeros(n, np.int64)
        if step_by < n:
            after[: n - step_by] = rank[step_by:] + 1
        _, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        rank = rank.astype(np.int64)
        step += step_by
    return np.argsort(rank, kind="stable"), rank


def run_hashes(words: list[str], run_words: int, known: dict[str, int]) -> np.ndarray:
    """The hash of the run that starts at each word; a run needs all its words. known: hashes of words, filled up."""
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    each = np.array([known[w] for w in words], np.uint64)
    n = max(0, len(words) - run_words + 1)
    out, weight = np.zeros(n, np.uint64), 1
    for j in range(run_words if n else 0):
        out += each[j : j + n] * np.uint64(weight)
        weight = weight * 0xD6E8FEB86659FD93 % (1 << 64)
    return out.view(np.int64)


def page_counts(pages: list[int], words: list[list[str]], run_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct run hashes of a group and on how many distinct pages of it each stands."""
    known: dict[str, int] = {}
    of_page: dict[int, list[np.ndarray]] = {}
    for p, w in zip(pages, words):
        of_page.setdefault(p, []).append(run_hashes(w, run_words, known))
    once = [np.unique(np.concatenate(x)) for x in of_page.values()]
    return np.unique(np.concatenate(once) if once else np.zeros(0, np.int64), return_counts=True)


def covered(pages: list[int], words: list[list[str]], run_words: int = RUN_WORDS, run_pages: int = RUN_PAGES, common: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream of words, which of them lie in a run that stands on run_pages distinct pages. pages: of each stream.
    common: hashes of further runs that do, with pages that are not among these."""
    place: dict[str, int] = {}
    parts, number = [], {p: i for i, p in enumerate(dict.fromkeys(pages))}
    for i, w in enumerate(words):
        parts.append([place.setdefault(x, len(place)) for x in w] + [-1 - i])  # an end that equals no other
    sizes = [len(w) for w in words]
    stream = np.array([x for p in parts for x in p], np.int64)
    if not sum(sizes):
        return [np.zeros(n, bool) for n in sizes]
    order, rank = suffix_order(stream, run_words)
    page = np.repeat([number[p] for p in pages], [n + 1 for n in sizes])
    # suffixes that share their first run_words tokens are neighbours in the array; how many pages are they from?
    seen = np.unique(np.stack([rank[order], page[order]], 1), axis=0)
    on = np.bincount(seen[:, 0], minlength=int(rank.max()) + 1)
    often = on[rank] >= run_pages
    ends = np.cumsum([n + 1 for n in sizes])
    if common is not None and len(common):
        known: dict[str, int] = {}
        for e, n, w in zip(ends, sizes, words):
            found = np.isin(run_hashes(w, run_words, known), common)
            often[e - n - 1 : e - n - 1 + len(found)] |= found
    starts = np.flatnonzero(often)
    marks = np.zeros(len(stream) + run_words + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + run_words, -1)
    flag = np.cumsum(marks)[: len(stream)] > 0
    return [flag[e - n - 1 : e - 1] for e, n in zip(ends, sizes)]


def stretches(flag: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))).tolist()
    return list(zip(edges[::2], edges[1::2]))


def is_open(page: list[tuple[int, int]]) -> bool:
    """Whether runs decide on a page, given the part of each block and its number of words."""
    return 2 * sum(n for part, n in page if part == MAIN) < sum(n for _, n in page)


def extract(pages: DataFrame, run_words: int = RUN_WORDS, run_pages: int = RUN_PAGES, group_pages: int = GROUP_PAGES) -> DataFrame:
    """page_id, url, text, n_chars."""
    kind = pa.list_(pa.struct([("part", pa.int8()), ("text", pa.string())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"part": k, "text": t} for k, t in blocks(h or "")] for h in batch.column(3).to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(rows, kind)], ["page_id", "url", "host", "blocks"])

    def open_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h not in seen and is_open([(k, t.count(" ") + 1) for k, t in blocks(text or "")]):
                    seen.add(h)
        yield pa.record_batch([pa.array(sorted(seen), pa.string())], ["host"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    counts = stored(pages.select(host.alias("host")).groupBy("host").agg(F.count("*").alias("n")), "host-pages")
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    counts = counts.withColumn("large", F.col("n") >= max(group_pages + 1, int((total or 0) * LARGE_SHARE)))
    counts = counts.withColumn("groups", F.ceil(F.col("n") / group_pages).cast("int"))
    hosts = F.broadcast(counts.where("large").select("host"))
    rows = pages.select("page_id", "url", host.alias("host"), "html")
    columns = "page_id long, url string, host string, blocks array<struct<part: tinyint, text: string>>"

    def deal(chosen: DataFrame) -> DataFrame:
        """The pages of the chosen rows of counts, in groups."""
        # a large host is dealt by host and group, so none of its pages meet before; the others have few rows for a task
        hot = F.broadcast(chosen.where("large").select("host", "groups"))
        split = rows.join(hot.select("host"), "host").select(rows.columns).mapInArrow(released(cut), columns).join(hot, "host")
        rest = rows.join(hosts, "host", "left_anti").select(rows.columns).mapInArrow(released(cut), columns)
        rest = rest.join(chosen.where(~F.col("large")).select("host", "groups"), "host")
        return split.unionByName(rest).withColumn("grp", F.pmod(F.xxhash64("page_id"), F.col("groups")).cast("int"))

    def streams(found: list[list[dict]]) -> list[list[str]]:
        return [[w for b in page for w in b["text"].split(" ")] for page in found]

    def group_runs(table: pa.Table) -> pa.Table:
        runs, n = page_counts(table["page_id"].to_pylist(), streams(table["blocks"].to_pylist()), run_words)
        n = np.minimum(n, run_pages).astype(np.int32)
        buckets = -(-table["groups"][0].as_py() // BUCKET_GROUPS)
        at = runs.view(np.uint64) % np.uint64(buckets)
        order = np.argsort(at, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
        key = {k: [table[k][0].as_py()] * len(parts) for k in ("host", "grp")}
        return pa.table({
            "host": pa.array(key["host"], pa.string()), "bucket": pa.array([int(at[x[0]]) for x in parts], pa.int32()), "grp": pa.array(key["grp"], pa.int32()),
            "runs": pa.array([runs[x] for x in parts], pa.list_(pa.int64())), "n": pa.array([n[x] for x in parts], pa.list_(pa.int32())),
        })

    def over_groups(table: pa.Table) -> pa.Table:
        """The runs of each group that are too rare in it and common enough on the host."""
        runs, n = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("runs", "n"))
        sizes = [len(x) for x in table["runs"]]
        _, at = np.unique(runs, return_inverse=True)
        told = (np.bincount(at, n)[at] >= run_pages) & (n < run_pages)
        ends = np.cumsum(sizes)
        back = [runs[e - k : e][told[e - k : e]] for e, k in zip(ends, sizes)]
        return pa.table({"host": table["host"], "grp": table["grp"], "runs": pa.array(back, pa.list_(pa.int64()))})

    def decided(table: pa.Table, common: np.ndarray | None) -> pa.Table:
        ids, found = table["page_id"].to_pylist(), table["blocks"].to_pylist()
        flags = covered(ids, streams(found), run_words, run_pages, common)
        texts = []
        for page, flag in zip(found, flags):
            mixed = is_open([(b["part"], b["text"].count(" ") + 1) for b in page])
            if flag.all():
                flag[:] = False
            at, kept = 0, []
            for b in page:
                words = b["text"].split(" ")
                gone = flag[at : at + len(words)]
                at += len(words)
                if b["part"] == MAIN:
                    kept += words
                elif mixed and not gone.all():
                    # a run that only reaches into a block leaves it whole
                    for a, z in stretches(gone):
                        if z - a < run_words:
                            gone[a:z] = False
                    kept += [w for w, x in zip(words, gone) if not x]
            texts.append(" ".join(kept))
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})

    def decide(table: pa.Table) -> pa.Table:
        return decided(table, None)

    def decide_with(table: pa.Table, told: pa.Table) -> pa.Table:
        return decided(table, told["runs"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if told.num_rows else None)

    result = "page_id long, url string, text string, n_chars long"
    by_group = deal(counts).select("host", "grp", "page_id", "url", "blocks").groupBy("host", "grp")
    if (most or 0) <= group_pages:
        return by_group.applyInArrow(decide, result)
    opened = rows.select("host", "html").mapInArrow(released(open_of), "host string").distinct()
    opened = stored(opened.join(counts.where("groups > 1"), "host").select(counts.columns), "open-hosts")
    if not opened.head(1):
        return by_group.applyInArrow(decide, result)
    told = deal(opened).select("host", "grp", "groups", "page_id", "blocks").groupBy("host", "grp")
    told = told.applyInArrow(group_runs, "host string, bucket int, grp int, runs array<long>, n array<int>")
    told = told.groupBy("host", "bucket").applyInArrow(over_groups, "host string, grp int, runs array<long>").where(F.size("runs") > 0)
    return by_group.cogroup(told.groupBy("host", "grp")).applyInArrow(decide_with, result)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
