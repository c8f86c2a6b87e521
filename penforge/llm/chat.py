"""Chat formatting: conversations through a compiled template, stored with a loss mask, and read back.

Rows are dealt by conversation and sorted by turn; a task streams them through the template, so of a conversation of
any length only two messages and one part of its output are held. Output rows are parts of at most about PART_CHARS code points (a
conversation is one part unless it is longer), with the ranges that a model is to learn. Digests run over the turns of
a conversation in their order, so one task reads a conversation back, part by part.

Control strings in texts and roles are escaped by a backslash, and so are backslashes; a role's line feeds too.

Defined cases: a null text or role counts as empty; a null turn comes first; equal turns go by role and text; repeated
rows are turns of their own; null conv_ids are one conversation; an empty table has no conversations of its own; a
conversation without assistant turns has 0 loss characters and the hash of nothing; further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, released, stored
from .template import Parts, Template

TURN, END = "### ", "</turn>"
SOURCE = """
{%- for message in messages -%}
{{ '### ' }}{{ message.role | escape_line }}:{{ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '</turn>' }}{{ '\\n' }}
{%- endfor -%}
"""
PART_CHARS = 1_000_000
#: A conversation that holds the control strings themselves.
HOSTILE = r"\### Assistant: </turn> ok"

_CONTROL = re.compile(r"\\|### |</turn>")
_CONTROL_LINE = re.compile(r"\\|### |</turn>|\n|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: A whole turn; what is escaped is skipped.
_TURN = re.compile(r"### ((?:[^\\\n:]++|\\.)*+):\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def escape_line(text: str) -> str:
    return _CONTROL_LINE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@lru_cache(maxsize=4)
def compiled(source: str) -> Template:
    return Template(source, {"escape": escape, "escape_line": escape_line})


def parts_of(rendered: Iterable[Parts], most: int = PART_CHARS) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(text, ranges to learn) of parts that end where a message's output does, once they have `most` code points."""
    texts: list[str] = []
    spans: list[tuple[int, int]] = []
    at, given = 0, False
    for pieces in rendered:
        for text, said in pieces:
            if said and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            texts.append(text)
            at += len(text)
        if at >= most:
            yield "".join(texts), spans
            texts, spans, at, given = [], [], 0, True
    if at or not given:
        yield "".join(texts), spans


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names])


FORMATTED = "conv_id long, part int, text string, loss array<struct<start: int, end: int>>"


def formatted(conversations: DataFrame, source: str = SOURCE, most: int = PART_CHARS) -> DataFrame:
    """conv_id, part, text, loss (ranges of code points of the text)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compiled(source)
        for conv_id, turns in itertools.groupby(_rows(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for i, (text, spans) in enumerate(parts_of(template.stream(messages), most)):
                spans = pa.array([[{"start": a, "end": b} for a, b in spans]], loss)
                yield pa.record_batch([pa.array([conv_id], pa.int64()), pa.array([i], pa.int32()), pa.array([text]), spans], ["conv_id", "part", "text", "loss"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(released(batched(run)), FORMATTED)


def batched(run):
    """run, with the batches of few rows that it yields put together until they are a megabyte."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size > 1_000_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return whole


class _Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.rest = ""

    def add(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for s in spans:
            said = unescape(text[s["start"] : s["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        text, at = self.rest + text, 0
        while m := _TURN.match(text, at):
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n_turns, at = self.n_turns + 1, m.end()
        self.rest = text[at:]

    def row(self) -> tuple:
        if self.rest:
            raise ValueError(f"no turn: {self.rest[:80]!r}")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from formatted() with SOURCE."""
    names = [c.split()[0] for c in READ.split(", ")]
    types = [pa.string() if " string" in c else pa.int64() for c in READ.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv_id, parts in itertools.groupby(_rows(batches, ["conv_id", "text", "loss"]), key=lambda r: r[0]):
            digest = _Digest()
            for _, text, spans in parts:
                digest.add(text, spans)
            rows.append((conv_id, *digest.row()))
            if len(rows) == 10_000:
                yield table(rows)
                rows = []
        if rows:
            yield table(rows)

    return output.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(released(run), READ)


def with_hostile(conversations: DataFrame) -> DataFrame:
    """The rows and conversation -7, whose texts hold the control strings."""
    spark = conversations.sparkSession
    rows = spark.createDataFrame([(-7, i, role, HOSTILE) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(formatted(with_hostile(read_table(spark, sf_dir, "conversations"))), "formatted"))


OP12_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS r,
             replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') AS t FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(4 + length(replace(replace(r, chr(10), '\' || chr(10)), ':', '\:')) + 2 + length(t) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
