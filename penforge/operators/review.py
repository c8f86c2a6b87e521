"""What surrounds the lint: feedback, workspace tables, segments, decisions, job events."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.markdown import starts

#: Decisions, and what counts as a number.
DECISIONS = ("KEEP", "REWRITE", "VERIFY", "ASK")
NUMBER = r"(?U)[+\-−]?\d+(?:[.,:/-]\d+)*[%％]?"


def keep_rates(feedback: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in DECISIONS]
    return feedback.groupBy("rule_id").agg(F.count("*").alias("total"), *counts, F.avg((F.col("decision") == "KEEP").cast("int")).alias("keep_rate"))


def text_lines(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return rows.select("doc_id", (F.col("i") + 1).alias("ln"), "line")


def search(docs: DataFrame, literal: str, most: int) -> DataFrame:
    """The first place on each line that holds a literal in any case, in order, `most` at most."""
    col = F.instr(F.lower("line"), literal.lower())
    rows = text_lines(docs.where(F.lower("text").contains(literal.lower())))
    return rows.withColumn("col", col).where("col > 0").orderBy("doc_id", "ln").limit(most).select("doc_id", "ln", "col")


#: Files and bytes that a search looks at, matches that it gives, characters of a snippet and before it.
SEARCH_FILES, SEARCH_BYTES, SEARCH_RESULTS, SNIPPET, SNIPPET_LEAD = 200, 2 * 1024 * 1024, 30, 500, 150
_LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def inspected(files: DataFrame, prefix: str = "", most_files: int = SEARCH_FILES, most_bytes: int = SEARCH_BYTES) -> DataFrame:
    """The files (path, size, content) that a search looks at, in the order of their paths, until one would go beyond a
    budget; `cut` says whether one did. The first rows of the order are a top-k, so nothing else is sorted."""
    first = files.where(F.col("path").startswith(prefix)).orderBy("path").limit(most_files + 1)
    upto = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = first.withColumn("beyond", (F.row_number().over(Window.orderBy("path")) > most_files) | (F.sum("size").over(upto) > most_bytes))
    rows = rows.withColumn("cut", F.max("beyond").over(Window.partitionBy()))
    # a sum only grows, so all files after the first that is beyond are beyond, too
    return rows.where(~F.col("beyond")).drop("beyond")


def search_matches(files: DataFrame, literal: str, most: int = 20, prefix: str = "") -> DataFrame:
    """path, line, col, start_char, end_char, offset, text, snippet_start_char, snippet_end_char: the first place on each
    line that holds a literal in any case, within the budgets, `most` (1 to 30) at most. content null: can't be read."""
    if not literal or prefix.startswith("/") or ".." in prefix.split("/"):
        raise ValueError("no literal, or a path outside the workspace")
    pattern = "(?iu)" + re.sub(r"([^\w\s])", r"\\\1", literal, flags=re.A) if literal.isascii() else f"(?iu)\\Q{literal}\\E"
    content = F.col("content")
    lines, ends = F.split(content, _LINE_ENDS, -1), F.regexp_extract_all(content, F.lit(_LINE_ENDS), F.lit(0))
    rows = inspected(files, prefix).where(content.rlike(pattern)).select("path", F.arrays_zip(lines.alias("line"), F.concat(ends, F.array(F.lit(""))).alias("end")).alias("all"))
    rows = rows.withColumn("before", starts(F.transform("all", lambda x: F.length(x["line"]) + F.length(x["end"]))))
    rows = rows.select("path", F.posexplode(F.arrays_zip(F.col("all.line").alias("line"), F.col("before").alias("begun"))).alias("i", "x")).where(F.col("x.line").rlike(pattern))
    line = F.col("x.line")
    rows = rows.orderBy("path", "i").limit(max(1, min(most, SEARCH_RESULTS)))
    start = F.length(F.get(F.split(line, pattern, 2), 0))
    rows = rows.withColumn("start_char", start)
    begin = F.greatest(F.lit(0), F.least(F.col("start_char") - SNIPPET_LEAD, F.length(line) - SNIPPET))
    end = F.least(F.length(line), begin + SNIPPET)
    return rows.select(
        "path", (F.col("i") + 1).alias("line"), (F.col("start_char") + 1).alias("col"), "start_char", (F.col("start_char") + len(literal)).alias("end_char"), (F.col("x.begun") + F.col("start_char")).alias("offset"),
        F.substring(line, begin + 1, end - begin).alias("text"), begin.alias("snippet_start_char"), end.alias("snippet_end_char"),
    )


def search_summary(files: DataFrame, literal: str, most: int = 20, prefix: str = "") -> DataFrame:
    """One row: n_matches, truncated, scanned_files, scanned_bytes, skipped_files of a search, which ends in the file
    that has its last match."""
    most = max(1, min(most, SEARCH_RESULTS))
    found = search_matches(files, literal, most, prefix).agg(F.count("*").alias("n_matches"), F.max("path").alias("last"))
    looked = inspected(files, prefix).join(F.broadcast(found), F.lit(True)).where((F.col("n_matches") < most) | (F.col("path") <= F.col("last")))
    sums = looked.agg(
        F.count("content").alias("scanned_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("scanned_bytes"), F.count_if(F.col("content").isNull()).alias("skipped_files"), F.coalesce(F.max("cut"), F.lit(False)).alias("cut"),
    )
    one = sums.join(F.broadcast(found), F.lit(True))
    # a first file beyond the budget leaves nothing to look at, yet the search is cut
    any_file = files.where(F.col("path").startswith(prefix)).limit(1).agg(F.count("*").alias("some"))
    one = one.join(F.broadcast(any_file), F.lit(True))
    truncated = (F.col("n_matches") >= most) | F.col("cut") | (F.col("skipped_files") > 0) | ((F.col("scanned_files") + F.col("skipped_files") == 0) & (F.col("some") > 0))
    return one.select("n_matches", truncated.alias("truncated"), "scanned_files", "scanned_bytes", "skipped_files")


def list_page(pages: DataFrame, part: str, cursor: int, size: int) -> DataFrame:
    """url, place, total_matches of one page of the sorted list; the sort is a top-k, not a whole one."""
    found = pages.where(F.lower("url").contains(part.lower())).select("url", "page_id")
    total = found.agg(F.count("*").alias("total_matches"))
    top = found.orderBy("url", "page_id").limit(cursor + size)
    top = top.withColumn("place", F.row_number().over(Window.orderBy("url", "page_id"))).where(F.col("place") > cursor)
    return top.crossJoin(F.broadcast(total)).select("url", "place", "total_matches")


def read_page(docs: DataFrame, start_line: int, most_lines: int, most_chars: int, start_char: int = 0) -> DataFrame:
    """doc_id, ln, line, next_line, next_char: each document from a place on, line feeds between lines counted.

    The line that crosses the budget is returned as far as it fits. next_line and next_char, the same on all rows of a
    document, are the place to read on from; null at the document's end. A document whose first line is shorter than
    start_char, or that has fewer lines than start_line, has no row.
    """
    lines = docs.select("doc_id", F.split("text", "\n", -1).alias("all")).withColumn("total", F.size("all"))
    lines = lines.where((F.col("total") >= start_line) & (F.length(F.get("all", F.lit(start_line - 1))) >= start_char))
    rows = lines.select("doc_id", "total", F.posexplode(F.slice("all", start_line, most_lines)).alias("i", "whole"))
    rows = rows.select("doc_id", "total", (F.col("i") + start_line).alias("ln"), "whole", F.when(F.col("i") == 0, start_char).otherwise(0).alias("at"))
    before = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    room = most_chars - F.coalesce(F.sum(F.length("whole") - F.col("at") + 1).over(before), F.lit(0))
    rows = rows.withColumn("room", room.cast("int")).where("room > 0").withColumn("line", F.expr("substring(whole, at + 1, room)"))
    rows = rows.withColumn("upto", F.col("at") + F.length("line"))
    cut = F.col("upto") < F.length("whole")
    next_line = F.when(cut, F.col("ln")).when(F.col("ln") < F.col("total"), F.col("ln") + 1)
    last = F.max(F.struct("ln", next_line.alias("line"), F.when(cut, F.col("upto")).otherwise(0).alias("char"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("last", last)
    return rows.select("doc_id", "ln", "line", F.col("last.line").alias("next_line"), F.when(F.col("last.line").isNotNull(), F.col("last.char")).alias("next_char"))


def numbers_changed(before: Column, after: Column) -> Column:
    """Whether a rewrite changes the sequence of numbers."""
    return F.regexp_extract_all(before, F.lit(NUMBER), F.lit(0)) != F.regexp_extract_all(after, F.lit(NUMBER), F.lit(0))


def unique_rewrite(docs: DataFrame, before: str, after: str) -> DataFrame:
    """Replaces a passage in the documents where it occurs once: doc_id, col, revised."""
    times = (F.length("text") - F.length(F.replace("text", F.lit(before), F.lit("")))) / len(before)
    return docs.where(times == 1).select("doc_id", F.instr("text", before).cast("long").alias("col"), F.replace("text", F.lit(before), F.lit(after)).alias("revised"))


def requests(events: DataFrame) -> DataFrame:
    """A click opens a request of its user; a row for each, with its first and last event."""
    number = F.sum((F.col("event_type") == "click").cast("long")).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events.withColumn("request", number).groupBy("user_id", "request")
    return rows.agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n_events"))


def segment_bounds(text: str, core: int = 4000, context: int = 300, findings: Sequence[int] = (), most: int = 24) -> list[tuple[int, int, int, int]]:
    """Half-open cores of at most `core` characters, cut at a blank line or else a line's end in their second half, and
    before the finding that would be one more than `most`. findings: offsets."""
    out, at, findings = [], 0, sorted(findings)
    while at < len(text):
        end = min(len(text), at + core)
        if end < len(text):
            for mark in ("\n\n", "\n"):
                cut = text.rfind(mark, at + core // 2, end)
                if cut >= 0:
                    end = cut + len(mark)
                    break
        over = bisect_left(findings, at) + most
        if over < len(findings) and at < findings[over] < end:
            end = findings[over]
        out.append((at, end, max(0, at - context), min(len(text), end + context)))
        at = end
    return out


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg_no, start, end_, context_start, context_end. docs may have offsets, those of each document's findings."""
    given = F.col("offsets").cast("array<int>") if "offsets" in docs.columns else F.lit(None).cast("array<int>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, n, *b) for d, t, o in zip(batch.doc_id, batch.text, batch.offsets) for n, b in enumerate(segment_bounds(t or "", findings=() if o is None else o))]
            yield pd.DataFrame(rows, columns=["doc_id", "seg_no", "start", "end_", "context_start", "context_end"])

    return docs.select("doc_id", "text", given.alias("offsets")).mapInPandas(run, "doc_id long, seg_no int, start int, end_ int, context_start int, context_end int")
