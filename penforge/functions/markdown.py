"""Markdown as columns: roles of lines, headings, and masks that keep every position.

Positions count code points from 1. Masks replace what isn't prose by as many spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\s\x1c-\x1f]"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"(?U)^{BLANK}+|{BLANK}+\z", "")


def line_role(raw: Column) -> Column:
    s = strip(raw)
    return (
        F.when(s == "", "blank").when(s.startswith("```") | s.startswith("~~~"), "fence").when(s.startswith("#"), "heading")
        .when(s.startswith(">"), "blockquote").when(s.startswith("|"), "table").when(s.rlike(r"(?U)\A(?:[-*+]|\d+[.、)])\s"), "list_item")
        .when(raw.startswith("    ") | raw.startswith("\t"), "fence").otherwise("paragraph")
    )


def is_delimiter_row(raw: Column) -> Column:
    cells = F.split(F.regexp_replace(strip(raw), r"\A\||\|\z", ""), r"\|", -1)
    return raw.contains("|") & F.forall(cells, lambda c: strip(c).rlike(r"\A:?-{3,}:?\z"))


def heading_level(raw: Column) -> Column:
    """1 to 6, or null where the line is no heading."""
    n = F.length(F.regexp_extract(strip(raw), r"(?s)\A(#{1,6})(?:[ \t]|\z)", 1))
    return F.when(n > 0, n)


def heading_title(raw: Column) -> Column:
    title = F.regexp_extract(strip(raw), r"(?s)\A#{1,6}(?:[ \t]+|\z)(.*)\z", 1)
    title = F.when(title.rlike(r"\A#+\z"), "").otherwise(F.regexp_replace(title, r"[ \t]+#+\z", ""))
    return F.when(heading_level(raw).isNotNull(), strip(title))


def hits(text: Column, pattern: Column) -> Column:
    """Array of (col, found): the leftmost non-overlapping matches, by lengths of what lies between them."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    before = starts(F.zip_with(parts, found, lambda part, x: F.length(part) + F.length(x)))
    cols = F.zip_with(before, parts, lambda n, part: n + F.length(part) + 1)
    return F.zip_with(cols, found, lambda col, x: F.struct(col.alias("col"), x.alias("found")))


#: Inline spans in the order in which they are masked, links, fences.
_SPANS = [re.compile(p) for p in (r"`[^`\n]*`", r"!\[[^\]\n]*\]\([^)\n]*\)", r"<[^>\n]+>", r"~~[^~\n]+~~")]
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


def _spaces(m: re.Match) -> str:
    return " " * len(m[0])


#: A line without these has nothing to mask.
_MARKS = re.compile(r"[`<~\]]")


def mask_line(line: str) -> str:
    if not _MARKS.search(line):
        return line
    line = _SPANS[0].sub(_spaces, line)
    line = _SPANS[1].sub(_spaces, line)
    line = _LINK.sub(lambda m: " " + m[1] + " " * (len(m[0]) - len(m[1]) - 1), line)
    for span in _SPANS[2:]:
        line = span.sub(_spaces, line)
    return line


def mask_text(text: str) -> str:
    """Fences' bodies, indented code, front matter, comments and inline markup as spaces; lengths and lines stay."""
    out, fence, comment, front, indented, before = [], None, False, False, False, ""
    for number, line in enumerate(text.split("\n")):
        hidden, mark = " " * len(line), _FENCE.match(line)
        if fence:
            closes = mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end() :].strip()
            out.append(line if closes else hidden)
            fence = None if closes else fence
        elif mark:
            fence = mark[1]
            out.append(line)
        elif line.strip() and (line.startswith("    ") or line.startswith("\t")) and (number == 0 or not before.strip() or indented):
            indented = True
            out.append(hidden)
            before = line
            continue
        elif front:
            front = line.strip() != "---"
            out.append(hidden if front else line)
        elif number == 0 and line.strip() == "---":
            front = True
            out.append(line)
        elif not comment and "<!--" not in line:
            out.append(mask_line(line))
        else:
            code = _SPANS[0].sub(lambda m: "x" * len(m[0]), line)
            shown, at = list(line), 0
            while at < len(line):
                if comment:
                    end = code.find("-->", at)
                    stop = len(line) if end < 0 else end + 3
                    shown[at:stop] = " " * (stop - at)
                    at, comment = stop, end < 0
                else:
                    start = code.find("<!--", at)
                    if start < 0:
                        break
                    at, comment = start, True
            out.append(mask_line("".join(shown)))
        indented, before = False, line
    return "\n".join(out)


def masked(text: str) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask_text(t))

    return F.pandas_udf(run, "string")(text)


#: List marks, cells of a delimiter row.
_LIST = re.compile(r"[-*+]\s|\d+[.、)]\s")
_DELIMITER = re.compile(r":?-{3,}:?")
_CELL = re.compile(r"(?:`[^`]*(?:`|\Z)|\\.|[^|`])*", re.S)
#: Roles that end a table which has no leading pipes.
_NO_ROW = frozenset({"blank", "heading", "fence", "blockquote", "list_item"})


def role_of(line: str) -> str:
    """As line_role, of one line on its own."""
    bare = line.strip()
    if not bare:
        return "blank"
    if bare[0].isalpha() and bare is line:  # also where it is Chinese
        return "paragraph"
    for marks, role in ((("```", "~~~"), "fence"), ("#", "heading"), (">", "blockquote"), ("|", "table")):
        if bare.startswith(marks):
            return role
    if _LIST.match(bare):
        return "list_item"
    return "fence" if line.startswith(("    ", "\t")) else "paragraph"


def delimits(line: str) -> bool:
    """As is_delimiter_row, of one line."""
    bare = line.strip()
    return "|" in bare and all(_DELIMITER.fullmatch(c.strip()) for c in bare.removeprefix("|").removesuffix("|").split("|"))


def roles(lines: list[str]) -> list[str]:
    """The role of each line. A row with a pipe above a delimiter row begins a table, which goes on while rows have
    pipes and no role of their own; a delimiter row within it begins no other."""
    out = [role_of(x) for x in lines]
    if not any("|" in x for x in lines):
        return out
    delimiter = [delimits(x) for x in lines]
    inside = False  # of a table that began with a header
    for i, line in enumerate(lines):
        if inside and "|" in line and out[i] not in _NO_ROW or inside == "header":
            out[i], inside = "table", True
            continue
        inside = False
        if i + 1 < len(lines) and out[i] in ("paragraph", "table") and "|" in line and not delimiter[i] and delimiter[i + 1]:
            out[i], inside = "table", "header"
    return out


def table_cells(line: str) -> list[tuple[int, str]]:
    """(column from 1, text) of each cell that isn't blank; pipes in code or after a backslash divide nothing."""
    out, at = [], int(line.startswith("|"))
    while at < len(line) and not delimits(line):
        cell = _CELL.match(line, at)
        if text := cell[0].strip():
            out.append((at + len(cell[0]) - len(cell[0].lstrip()) + 1, text))
        at = cell.end() + 1
    return out


CELLS = "array<struct<col: int, raw: string, masked: string>>"
LAYOUT = {"ln": "int", "raw": "string", "masked": "string", "role": "string", "cells": CELLS}


def layout_of(text: str) -> list[dict]:
    raw, masked = text.split("\n"), mask_text(text).split("\n")
    out = []
    for line, shown, role in zip(raw, masked, roles(raw)):
        cells = table_cells(line) if role == "table" and shown.strip() else []
        out.append({"raw": line, "masked": shown, "role": role, "cells": [{"col": c, "raw": t, "masked": shown[c - 1 : c - 1 + len(t)]} for c, t in cells]})
    return out


#: Rows, or characters of them, that leave a task at once.
ROWS, ROW_CHARS = 10_000, 4_000_000


def spread(docs: DataFrame, keys: list[str], of: Callable[[str], list[tuple]], fields: dict[str, str]) -> DataFrame:
    """keys and fields (name: type) of the rows that `of` gives for each text of docs; a null text has none. No shuffle;
    rows leave in batches, so what many documents give isn't held at once."""
    kinds = {"int": pa.int32(), "string": pa.string(), CELLS: pa.list_(pa.struct([("col", pa.int32()), ("raw", pa.string()), ("masked", pa.string())]))}
    types, names = [kinds[t] for t in fields.values()], [*keys, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, chars = [], [], 0

            def leave() -> pa.RecordBatch:
                of_keys = [c.take(pa.array(own, pa.int32())) for c in batch.columns[: len(keys)]]
                out = pa.record_batch([*of_keys, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)
                own.clear(), rows.clear()
                return out

            for n, text in enumerate(batch.column(len(keys))):
                for row in of(text.as_py()) if text.is_valid else ():
                    own.append(n)
                    rows.append(row)
                    chars += sum(len(x) for x in row if isinstance(x, str))
                    if len(rows) >= ROWS or chars >= ROW_CHARS:
                        yield leave()
                        chars = 0
            if rows:
                yield leave()

    given = docs.select(*keys, "text")
    kind = [f"`{k}` {given.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} {t}" for n, t in fields.items()]
    return given.mapInArrow(run, ", ".join(kind))


def layout(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and LAYOUT: the lines of documents with their masks, roles in context and table cells, in one Python step."""
    rows_of = lambda text: [(ln, *line.values()) for ln, line in enumerate(layout_of(text), 1)]
    return spread(docs, list(keys), rows_of, LAYOUT)


TERMINATORS = "。！？!?；;"
_SENTENCE = re.compile(f"(?<=[{TERMINATORS}])")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*))?", re.S)
_CLOSING = re.compile(r"#+|(.*?)[ \t]+#+", re.S)
_PROSE = ("paragraph", "list_item", "blockquote")

#: What a scan looks at. line: a prose line. row: one of a table, of which all but the cells is line feeds. sentence: one of a
#: paragraph or cell. heading: its title, and in `raw` that of the one before it under the same parent. file: how many
#: lines there are, and the first one. col is where `raw` begins in its line.
PIECES = {"kind": "string", "ln": "int", "col": "int", "text": "string", "raw": "string"}


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, title) of a line, as heading_level and heading_title."""
    m = _HEADING.fullmatch(line.strip())
    if not m:
        return None
    title = (m[2] or "").strip(" \t")
    if closed := _CLOSING.fullmatch(title):
        title = closed[1] or ""
    return len(m[1]), title.strip()


def _sentences(kind_at: tuple[int, int], masked: str, own: str, least: int) -> list[tuple]:
    """The sentences of more than `least` characters of a text that begins at (line, column)."""
    (ln, col), out, at = kind_at, [], 0
    for part in _SENTENCE.split(masked):
        written = own[at : at + len(part)]
        at += len(part)
        bare = written.lstrip()
        if len(part) > least and bare:
            lead = written[: len(written) - len(bare)]
            begun = lead.rfind("\n")
            out.append(("sentence", ln + lead.count("\n"), len(lead) - begun if begun >= 0 else col + len(lead), part, bare.rstrip()))
        begun = written.rfind("\n")
        ln, col = ln + written.count("\n"), len(written) - begun if begun >= 0 else col + len(written)
    return out


def pieces_of(text: str, least: int) -> list[tuple]:
    raw, masked = text.split("\n"), mask_text(text).split("\n")
    out: list[tuple] = [("file", len(raw), 1, "", raw[0])]
    last: dict[int, tuple[int, str]] = {}  # of each level: the line and title of the last heading that has a title
    smaller = [0] * 8  # of each level: the line of the last heading of that or a smaller level
    first = None  # line of the paragraph that is open
    kinds = roles(raw)
    for i, (line, shown, kind) in enumerate(zip(raw, masked, kinds), 1):
        if kind in _PROSE:
            out.append(("line", i, 1, shown, line))
        elif kind == "table" and shown.strip():
            row, at = [], 0
            for col, cell in table_cells(line):
                text_of = shown[col - 1 : col - 1 + len(cell)]
                row += ["\n" * (col - 1 - at), text_of]
                at = col - 1 + len(cell)
                out += _sentences((i, col), text_of, cell, least)
            if row:
                out.append(("row", i, 1, "".join(row) + "\n" * (len(line) - at), line))
        elif kind == "heading" and shown.strip() and (about := heading_of(line)):
            level, title = about
            before = last.get(level)
            sibling = before[1] if before and before[0] > smaller[level - 1] else ""
            out.append(("heading", i, 1, title, line))
            if title:
                out.append(("sibling", i, max(1, line.find(title) + 1), title, sibling + "\n" + line))
                last[level] = i, title
            smaller[level:] = [i] * (8 - level)
        inside = kind == "paragraph" and line.strip() != ""
        if inside and first is None:
            first = i
        if first is not None and (not inside or i == len(raw)):
            end = i if inside else i - 1
            out += _sentences((first, 1), "\n".join(masked[first - 1 : end]), "\n".join(raw[first - 1 : end]), least)
            first = None
    return out


def pieces(docs: DataFrame, *keys: str, least: int) -> DataFrame:
    """keys and PIECES: what is scanned of documents, in the one Python step of a scan. Sentences of at most `least`
    characters are left out."""
    return spread(docs, list(keys), lambda text: pieces_of(text, least), PIECES)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def nothing_gathered() -> Column:
    """What a fold gathers: numbers in short arrays, so that a long one isn't copied for each of them."""
    return F.struct(F.array().cast("array<int>").alias("now"), F.array().cast("array<array<int>>").alias("done"))


def gathered(acc: Column, n: Column) -> Column:
    full = F.size(acc["now"]) >= 256
    return F.struct(
        F.when(full, F.array(n)).otherwise(F.array_append(acc["now"], n)).alias("now"),
        F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
    )


def all_gathered(acc: Column) -> Column:
    return F.flatten(F.array_append(acc["done"], acc["now"]))


def starts(sizes: Column) -> Column:
    """How much stands before each item of an array of sizes."""
    begin = F.struct(F.lit(0).alias("n"), nothing_gathered().alias("out"))
    step = lambda acc, size: F.struct((acc["n"] + size).alias("n"), gathered(acc["out"], acc["n"]).alias("out"))
    return F.aggregate(sizes, begin, step, lambda acc: all_gathered(acc["out"]))


def sentence_at(line: Column, col: Column) -> Column:
    """The sentence of a line that holds a column, without white space around; the line where the column is beyond it."""
    begun = F.regexp_extract(F.substring(line, F.lit(1), col - 1), rf"[^{TERMINATORS}]*\z", 0)
    rest = F.regexp_extract(F.substring(line, col, F.length(line)), rf"\A[^{TERMINATORS}]*[{TERMINATORS}]?", 0)
    return F.when(col > F.length(line), line).otherwise(strip(F.concat(begun, rest)))


def newlines(text: Column) -> Column:
    """CR LF and lone CR as LF, as text files are read; a byte order mark stays."""
    return F.regexp_replace(text, "\r\n?", "\n")
