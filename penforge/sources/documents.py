"""Documents behind a gateway: a Spark data source over recorded answers, and what they say as a table.

A recording is a folder of files of JSON lines, {"input_url": ..., "answer": ...}: what was asked for and what came back.
Files are split by bytes, and a line belongs to the split that holds its first byte, so one large file is many tasks and
the driver lists names and sizes alone. The source only cuts records; what an answer means is columns (`files.payload`).

Defined cases: blank lines are no records; a line that is no record is a row with an error (json, object, input_url or
answer) and its place, so nothing is lost and nothing fails the job; an empty folder has no rows; a record that stands
twice is two rows; files whose names begin with _ or . are left out; a last line needs no line feed.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import payload

NAME = "recorded_answers"
#: Bytes of a split, and of the lines that become one batch.
SPLIT_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
COLUMNS = ("input_url", "answer", "file", "start", "error")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it; a path without a scheme is local."""
    path = re.sub(r"\Afile:/+", "/", path)
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path) else (fs.LocalFileSystem(), os.path.abspath(path))


def record(line: bytes) -> tuple[str | None, str | None, str | None]:
    """input_url, answer (JSON text), error of a line."""
    try:
        value = json.loads(line)
    except (ValueError, RecursionError):
        return None, None, "json"
    if not isinstance(value, dict):
        return None, None, "object"
    url = value.get("input_url")
    if not isinstance(url, str) or not url.strip():
        return None, None, "input_url"
    whole = lambda s: s.encode("utf-8", "replace").decode()
    if "answer" not in value:
        return whole(url), None, "answer"
    answer = value["answer"]
    return whole(url), whole(answer) if isinstance(answer, str) else json.dumps(answer), None


def lines_of(file: io.BufferedIOBase, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in [start, end)."""
    at = start
    if start:
        file.seek(start - 1)
        at = start - 1 + len(file.readline())
    while at < end and (line := file.readline()):
        yield at, line
        at += len(line)


class Split(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        super().__init__(None)
        self.file, self.start, self.end = file, start, end


class AnswerReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> Sequence[Split]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "_." and f.size)
        # Spark asks for at least one split
        return [Split(path, at, min(size, at + self.split_bytes)) for path, size in files for at in range(0, size, self.split_bytes)] or [Split(root, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        system, _ = opened(self.path)
        name, rows, n_bytes = os.path.basename(partition.file), [], 0

        def batch() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], COLUMNS)

        with system.open_input_file(partition.file) as raw, io.BufferedReader(raw, 1 << 20) as file:
            for at, line in lines_of(file, partition.start, partition.end):
                if not line.strip():
                    continue
                url, answer, error = record(line)
                rows.append((url, answer, name, at, error))
                n_bytes += len(line)
                if n_bytes >= BATCH_BYTES:
                    yield batch()
                    rows, n_bytes = [], 0
        if rows:
            yield batch()


class AnswerSource(DataSource):
    """spark.read.format("recorded_answers").load(folder): input_url, answer, file, start, error. Option split_bytes."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "input_url string, answer string, file string, start bigint, error string"

    def reader(self, schema) -> AnswerReader:
        size = int(self.options.get("split_bytes", SPLIT_BYTES))
        if not self.options.get("path") or size < 1:
            raise ValueError("a recording needs a path and splits of a byte or more")
        return AnswerReader(self.options["path"], size)


def answers(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(AnswerSource)
    return spark.read.format(NAME).option("split_bytes", split_bytes).load(path)


def documents(spark: SparkSession, path: str, hosts: list[str], suffixes: list[str] = (), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """input_url, document_id, revision, url, xml, error, file, start: a row for each record. The error is the record's
    or the answer's own (a conflict, say) or what is wrong with it; then the document's columns are null."""
    rows = answers(spark, path, split_bytes).withColumn("d", payload(F.col("answer"), F.col("input_url"), hosts, suffixes))
    return rows.select("input_url", "d.document_id", "d.revision", "d.url", "d.xml", F.coalesce("error", "d.error").alias("error"), "file", "start")


def latest(found: DataFrame) -> DataFrame:
    """document_id, revision, url, xml: each document at its highest revision, of equal ones the one recorded last."""
    best = F.max_by(F.struct("revision", "url", "xml"), F.struct("revision", "file", "start")).alias("d")
    return found.where("error IS NULL").groupBy("document_id").agg(best).select("document_id", "d.*")


def record_answers(rows: DataFrame, path: str) -> None:
    """Writes a recording of rows (input_url, answer: JSON text)."""
    rows.select(F.to_json(F.struct("input_url", "answer")).alias("value")).write.text(path)
