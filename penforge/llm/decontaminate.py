"""Benchmark decontamination by pigeonhole edit matching.

An item that may be k edits away from a passage is cut into k + 1 pieces, one of which the passage must hold exactly.
All pieces of a bounded chunk of items go into one Aho-Corasick automaton; each hit fixes where the item would begin,
and Myers' bit-parallel algorithm settles the distance in that window. Texts and items are compared in lower case with
white space runs as one space.

Defined cases: null and empty texts and items match nothing; an item shorter than MIN_CHARS must occur exactly, as
whole words; repeated rows and null doc_ids give rows of their own; long texts are searched whole; further columns are
not read; items that repeat give a row each; an empty benchmark gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, released, take_over, whole_text

#: Edits allowed for a character of the item, and the length from which any are.
ERROR_RATE, MIN_CHARS = 0.05, 20
#: Characters of items in one automaton; a larger benchmark makes several, each broadcast and run on its own.
CHUNK_CHARS = 2_000_000


def plain(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """(k, the k + 1 pieces and their places)."""
    k = int(len(item) * rate) if len(item) >= MIN_CHARS else 0
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the item to any substring of text, the end of the first such)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # no carry in: the match may begin anywhere
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        self.items = [(i, plain(t or "")) for i, t in items]
        self.peq = [masks(t) for _, t in self.items]
        self.k = []
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text) in enumerate(self.items):
            k, cut = pieces(text, rate)
            self.k.append(k)
            for at, piece in cut if text else ():
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the plain text) of each item in text, the nearest place of each."""
        if not self.any:
            return []
        text = plain(text)
        seen: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for n, at in where:
                start, k, m = last + 1 - size - at, self.k[n], len(self.items[n][1])
                if best.get(n, (1,))[0] == 0 or start < -k or start + m - k > len(text):
                    continue
                tried = seen.setdefault(n, set())
                if start in tried:
                    continue
                tried.add(start)
                if text.startswith(self.items[n][1], start) and start >= 0:
                    words = (start == 0 or not text[start - 1].isalnum()) and (start + m == len(text) or not text[start + m].isalnum())
                    if k or words:
                        best[n] = (0, start + m)
                    continue
                if k:
                    a = max(0, start - k)
                    distance, end = myers(self.peq[n], m, text[a : start + m + k])
                    if distance <= k and distance < best.get(n, (k + 1,))[0]:
                        best[n] = (distance, a + end)
        return [(self.items[n][0], d, e) for n, (d, e) in best.items()]


@lru_cache(maxsize=4)
def matcher(items: tuple, rate: float) -> Matcher:
    return Matcher(items, rate)


def clear_state() -> None:
    matcher.cache_clear()


def chunks(benchmark: DataFrame) -> Iterator[tuple]:
    """The items in runs of at most CHUNK_CHARS."""
    some, total = [], 0
    for row in benchmark.select("item_id", "text").where("text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        if some and total + len(row.text) > CHUNK_CHARS:
            yield tuple(some)
            some, total = [], 0
        some.append((row.item_id, row.text))
        total += len(row.text)
    if some:
        yield tuple(some)


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance, end_ for each document and each item that it holds within the item's edits."""
    kind = "doc_id long, item_id long, distance int, end_ int"
    out = docs.sparkSession.createDataFrame([], kind)
    for items in chunks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            own = matcher(items, rate)
            for batch in batches:
                rows = [(d.as_py(), *m) for d, t in zip(*batch.columns) for m in own.matches(t.as_py())]
                cols = list(zip(*rows)) if rows else [[]] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "distance", "end_"])

        out = out.unionByName(docs.select("doc_id", whole_text().alias("text")).mapInArrow(released(run, __name__), kind))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no item, with all their columns."""
    def leaks(items: tuple):
        def run(texts: pd.Series) -> pd.Series:
            take_over(__name__)
            own = matcher(items, rate)
            return pd.Series([bool(own.matches(t)) for t in texts], dtype=bool)

        return F.pandas_udf(run, "boolean")

    for items in chunks(benchmark):
        docs = docs.where(~leaks(items)(whole_text()))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
