"""Files and requests as tables: texts read strictly, a workspace's manifest, feedback lines, document addresses.

Everything is columns over the binaryFile source, so paths, sizes and suffixes prune before contents are read.
"""

from __future__ import annotations

import codecs
import fcntl
import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.markdown import newlines, strip
from ..functions.rules import PROFILES
from ..operators.report import is_walked

#: Suffixes of a workspace's texts, its limits, folders that no walk enters, and the longest request.
WORKSPACE_SUFFIXES, MOST_FILES, MOST_BYTES = (".md", ".txt", ".rst", ".markdown", ".mdx"), 2_000, 2 << 20
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")
MOST_CHARS = 200_000
DECISIONS = ("KEEP", "REWRITE", "VERIFY", "ASK")
BOM = "﻿"


def files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), name, size, content of every file below root, links not followed."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.removeprefix("file:").rstrip("/") + "/"
    whole = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return found.select(F.substring(whole, F.lit(len(base) + 1), F.length(whole)).alias("path"), F.col("length").alias("size"), "content")


def read_texts(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """filename, text of what a walk takes, by name. Bytes that aren't UTF-8 fail the job; CR LF and CR are read as LF;
    a byte order mark stays."""
    taken = files(spark, root).where(is_walked(F.col("path"), skipped))
    return taken.select(F.col("path").alias("filename"), newlines(F.validate_utf8(F.col("content").cast("string"))).alias("text")).orderBy("filename")


def manifest(spark: SparkSession, root: str, most: int = MOST_FILES) -> DataFrame:
    """path, name, size of a workspace's texts, the first `most` by path; contents are not read."""
    found = files(spark, root).select("path", "size")
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    known = F.exists(F.array(*map(F.lit, WORKSPACE_SUFFIXES)), lambda s: F.lower("path").endswith(s))
    hidden = F.exists(folders, lambda x: x.isin(*SKIPPED) | x.startswith("."))
    return found.where(known & ~hidden).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "size").orderBy("path").limit(most)


def bounded(found: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, text, sha256, error of files (path, size, content): text without a byte order mark, null beside an error."""
    raw = F.col("content").cast("string")
    unsafe = F.col("path").startswith("/") | F.exists(F.split("path", "/"), lambda x: x == "..")
    error = F.when(unsafe, "path").when(F.col("size") > most, "size").when(~F.is_valid_utf8(raw), "encoding")
    text = F.when(error.isNull(), F.regexp_replace(raw, f"\\A{BOM}", ""))
    return found.select("path", text.alias("text"), F.when(error.isNull(), F.sha2("content", 256)).alias("sha256"), error.alias("error"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1), text: each file is one row, so its lines have numbers, and blank ones are left out."""
    found = spark.read.format("binaryFile").load(path)
    rows = found.select(F.col("path").alias("file"), F.posexplode(F.split(newlines(F.validate_utf8(F.col("content").cast("string"))), "\n", -1)).alias("i", "text"))
    return rows.select("file", (F.col("i") + 1).alias("line"), "text").where(strip(F.col("text")) != "")


def feedback_error(text: Column) -> Column:
    """Null for a valid record, else the first thing wrong with it: json, object, or the name of a field."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    field = lambda name, t: F.try_variant_get(value, f"$.{name}", t)
    typed = lambda name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant"))
    error = F.when(value.isNull(), "json").when(~kind.startswith("OBJECT"), "object")
    error = error.when(~(typed("schema_version").eqNullSafe(F.lit("BIGINT")) & (field("schema_version", "long") == 1)), "schema_version")
    error = error.when(~F.coalesce(typed("decision").eqNullSafe(F.lit("STRING")) & field("decision", "string").isin(*DECISIONS), F.lit(False)), "decision")
    for name in ("rule", "file"):
        error = error.when(~F.coalesce(typed(name).eqNullSafe(F.lit("STRING")) & (strip(field(name, "string")) != ""), F.lit(False)), name)
    for name in ("line", "column"):
        error = error.when(~F.coalesce(typed(name).eqNullSafe(F.lit("BIGINT")) & (field(name, "long") >= 1), F.lit(False)), name)
    for name in ("text", "reason", "profile", "recorded_at"):
        error = error.when(~typed(name).eqNullSafe(F.lit("STRING")), name)
    return error


def feedback(lines: DataFrame) -> DataFrame:
    """rule_id, decision of valid feedback lines (file, line, text); the first invalid one, by place, fails the job."""
    value = F.parse_json("text")
    checked = lines.withColumn("error", feedback_error(F.col("text")))
    first = checked.where("error IS NOT NULL").orderBy("file", "line").select("file", "line", "error").head()
    if first:
        raise ValueError(f"{first.file}:{first.line}: {first.error}")
    return lines.select(F.variant_get(value, "$.rule", "string").alias("rule_id"), F.variant_get(value, "$.decision", "string").alias("decision"))


def record(records: DataFrame, path: str) -> None:
    """Appends feedback as JSON lines, decisions without white space around and in capitals; an invalid one fails the job."""
    rows = records.withColumns({"decision": F.upper(strip(F.col("decision"))), "schema_version": F.lit(1)})
    wrong = rows.select(feedback_error(F.to_json(F.struct("*"))).alias("error")).where("error IS NOT NULL").head()
    if wrong:
        raise ValueError(f"invalid feedback: {wrong.error}")
    rows.write.mode("append").json(path)


def request_error(text: Column, profile: Column) -> Column:
    """Null for a request that may be scanned, else blank, long or profile."""
    return F.when(F.coalesce(strip(text), F.lit("")) == "", "blank").when(F.length(text) > MOST_CHARS, "long").when(~F.coalesce(profile.isin(*PROFILES), F.lit(False)), "profile")


def document_ref(url: Column, hosts: list[str], suffixes: list[str] = (), kinds: tuple[str, ...] = ("docx", "wiki")) -> Column:
    """kind, token, url, error of an address https://host/kind/token; the query goes, of fragments only share- stays."""
    part = lambda name: F.try_parse_url(F.trim(url), F.lit(name))
    host = F.regexp_replace(F.lower(part("HOST")), r"\.\z", "")
    steps = F.filter(F.split(F.coalesce(part("PATH"), F.lit("")), "/"), lambda x: x != "")
    allowed = host.isin(*hosts)
    for suffix in suffixes:
        allowed = allowed | host.endswith(suffix)
    error = F.when(F.coalesce(F.lower(part("PROTOCOL")) != "https", F.lit(True)), "scheme").when(part("USERINFO").isNotNull(), "credentials").when(host.isNull(), "host")
    error = error.when(~allowed, "host").when((F.size(steps) != 2) | ~F.try_element_at(steps, F.lit(1)).isin(*kinds), "path")
    kind, token = F.try_element_at(steps, F.lit(1)), F.try_element_at(steps, F.lit(2))
    mark = F.when(part("REF").startswith("share-"), F.concat(F.lit("#"), part("REF"))).otherwise("")
    kept = lambda c: F.when(error.isNull(), c)
    return F.struct(kept(kind).alias("kind"), kept(token).alias("token"), kept(F.concat(F.lit("https://"), F.lower(part("HOST")), F.lit("/"), kind, F.lit("/"), token, mark)).alias("url"), error.alias("error"))


def payload(text: Column, input_url: Column, hosts: list[str], suffixes: list[str] = ()) -> Column:
    """document_id, revision, url, xml, error of a recorded answer for a document, the text being JSON.

    The content stands in data.document or, in older answers, in data; both may, if they agree. An answer without an
    address gets the asked one's host. The error is the answer's own type where it isn't ok, else the first of
    invalid_response, ambiguous_content, unresolved_document and missing_revision that applies, in the fields' order.
    """
    value = F.try_parse_json(text)
    get = lambda path, t: F.try_variant_get(value, path, t)
    is_a = lambda path, t: F.coalesce(F.schema_of_variant(get(path, "variant")).startswith(t), F.lit(False))
    words = lambda path: F.when(is_a(path, "STRING"), F.nullif(get(path, "string"), F.lit("")))
    new, old, name = words("$.data.document.content"), words("$.data.content"), words("$.data.document.document_id")
    number = F.when(is_a("$.data.document.revision_id", "BIGINT"), get("$.data.document.revision_id", "long"))
    host = F.try_parse_url(F.trim(input_url), F.lit("HOST"))
    url = F.coalesce(words("$.data.document.url"), F.concat(F.lit("https://"), host, F.lit("/docx/"), name))
    ref = document_ref(F.trim(F.regexp_replace(url, r"(?s)[?#].*", "")), hosts, suffixes)
    same = ref["error"].isNull() & (ref["kind"] == "docx") & (ref["token"] == name)
    own = [F.nullif(get(f"$.error.{k}", "string"), F.lit("")) for k in ("type", "code")]
    error = F.when(~(is_a("$.ok", "BOOLEAN") & F.coalesce(get("$.ok", "boolean"), F.lit(False))), F.coalesce(*own, F.lit("protocol_error")))
    error = error.when(~is_a("$.data", "OBJECT") | ~is_a("$.data.document", "OBJECT"), "invalid_response").when(new != old, "ambiguous_content").when(F.coalesce(new, old).isNull(), "invalid_response")
    error = error.when(name.isNull(), "unresolved_document").when(get("$.data.document.revision_id", "variant").isNull(), "missing_revision")
    error = error.when(F.coalesce(number, F.lit(0)) <= 0, "invalid_response").when(~F.coalesce(same, F.lit(False)), "unresolved_document")
    kept = lambda c: F.when(error.isNull(), c)
    return F.struct(kept(name).alias("document_id"), kept(number).alias("revision"), kept(ref["url"]).alias("url"), kept(F.coalesce(new, old)).alias("xml"), error.alias("error"))


def write_checked(path: str, text: str, expected_sha256: str) -> tuple[str | None, str | None]:
    """(sha256 of the new file, error) of one file that is replaced if its bytes still have a digest.

    Writers of a file wait for each other, so of two that expect the same bytes one wins and the other one finds them
    changed. A byte order mark stays. The new bytes take the old ones' place at once or not at all. A file that has the
    new bytes already counts as written, so that a task may run again.
    """
    folder, name = os.path.split(path)
    try:
        with open(os.path.join(folder, f".{name}.lock"), "w") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)  # goes with the process that holds it
            with open(path, "rb") as f:
                now = f.read()
            new = (codecs.BOM_UTF8 if now.startswith(codecs.BOM_UTF8) else b"") + text.encode()
            digest = hashlib.sha256(new).hexdigest()
            if now == new:
                return digest, None
            if hashlib.sha256(now).hexdigest() != expected_sha256:
                return None, "changed"
            handle, temporary = tempfile.mkstemp(prefix=f".{name}.", suffix=".tmp", dir=folder)
            try:
                with os.fdopen(handle, "wb") as f:
                    f.write(new)
                    f.flush()
                    os.fsync(f.fileno())
                os.chmod(temporary, os.stat(path).st_mode & 0o777)
                os.replace(temporary, path)
            except BaseException:
                os.unlink(temporary)
                raise
            return digest, None
    except OSError as e:
        return None, type(e).__name__


def overwritten(edits: DataFrame) -> DataFrame:
    """path, sha256, error of each edit (path, text, expected_sha256, confirmed): unconfirmed, no_text, changed, or the
    kind of what the file system said. Paths are in a folder that all executors share; edits are written where their
    rows are, in parallel, and none is written until this is run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, text, expected, confirmed in zip(*(c.to_pylist() for c in batch.columns)):
                done.append((path, None, "unconfirmed") if not confirmed else (path, None, "no_text") if text is None else (path, *write_checked(path, text, expected)))
            yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*done)] if done else [pa.array([], pa.string())] * 3, ["path", "sha256", "error"])

    return edits.select("path", "text", "expected_sha256", "confirmed").mapInArrow(run, "path string, sha256 string, error string")
