"""Reports and the choice of files: finding lines, summary, exit gate, walked paths, ignore files, profiles."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, functions as F

#: Suffixes that a walk takes.
SUFFIXES = (".md", ".txt", ".rst", ".markdown")
RANKS = {"error": 3, "warning": 2, "suggestion": 1, "candidate": 0}


def _wide(text: Column, n: int) -> Column:
    """Padded to n code points; rpad would also cut longer ones."""
    return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(0), n - F.char_length(text))))


def finding_lines(findings: DataFrame) -> DataFrame:
    """doc_id, ln, col, rule_id, line: a report line of each finding."""
    place = F.concat_ws(":", "filename", F.col("ln").cast("string"), F.col("col").cast("string"))
    line = F.concat(place, F.lit("  "), _wide(F.col("rule_id"), 5), F.lit(" "), _wide(F.col("severity"), 10), F.lit(" "), F.col("category"), F.lit("  「"), F.col("found"), F.lit("」"))
    return findings.select("doc_id", "ln", "col", "rule_id", line.alias("line"))


def totals(findings: DataFrame) -> DataFrame:
    """filename, n_findings for each file with findings, and filename null for all of them."""
    return findings.rollup("filename").agg(F.count("*").alias("n_findings"))


def exit_code(findings: DataFrame, level: str) -> DataFrame:
    """One row: 1 if a finding reaches the level, else 0; 0 without findings."""
    rank = F.coalesce(*[F.when(F.col("severity") == name, F.lit(n)) for name, n in RANKS.items()])
    return findings.agg((F.coalesce(F.max(rank), F.lit(-1)) >= RANKS[level]).cast("int").alias("exit_code"))


def is_walked(path: Column, skipped: tuple[str, ...]) -> Column:
    """Whether a walk of directories takes a path: of known suffix, in no skipped or dotted directory."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    known = F.lit(False)
    for suffix in SUFFIXES:
        known = known | path.endswith(suffix)
    hidden = F.exists(folders, lambda x: x.isin(*skipped) | (x.startswith(".") & ~x.isin(".", "..")))
    return known & ~hidden


def walked(files: DataFrame, skipped: tuple[str, ...]) -> DataFrame:
    """The distinct paths that a walk of directories takes."""
    return files.where(is_walked(F.col("path"), skipped)).select("path").distinct()


def not_ignored(files: DataFrame, lines: list[str]) -> DataFrame:
    """Without the paths that an ignore file's lines name: a line ending in / is a prefix, another one a shell pattern
    for the path or its last part; blank lines and lines that begin with # say nothing."""
    base = F.element_at(F.split("path", "/"), -1)
    gone = F.lit(False)
    for line in lines:
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line.endswith("/"):
            gone = gone | F.col("path").startswith(line)
        else:
            pattern = fnmatch.translate(line).replace(r"\Z", r"\z").replace("(?>", "(?:")
            gone = gone | F.col("path").rlike("^" + pattern) | base.rlike("^" + pattern)
    return files.where(~gone)


def effective_profile(filename: Column, asked: str) -> Column:
    """A profile that was asked for stays; else instruction documents get their own."""
    return F.when(filename.endswith("SKILL.md") & F.lit(asked == "general"), F.lit("instruction")).otherwise(F.lit(asked))


def message_lines(findings: DataFrame) -> DataFrame:
    """doc_id, ln, col, rule_id, line: report lines with messages; what was found follows a message that names nothing."""
    place = F.concat_ws(":", "filename", F.col("ln").cast("string"), F.col("col").cast("string"))
    named = F.when((F.col("found") != "") & ~F.col("message").contains("「"), F.concat(F.lit(" 「"), "found", F.lit("」"))).otherwise("")
    line = F.concat(place, F.lit("  "), _wide(F.col("rule_id"), 5), F.lit(" "), _wide(F.col("severity"), 10), F.lit(" "), F.col("category"), F.lit("  "), F.col("message"), named)
    return findings.select("doc_id", "ln", "col", "rule_id", line.alias("line"))


def summary(findings: DataFrame) -> DataFrame:
    """One row: how many findings in all and in each file that has any; files are counted before they meet."""
    files = findings.groupBy("filename").agg(F.count("*").alias("n"))
    each = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("filename", "n"))), lambda x: F.concat(x["filename"], F.lit(": "), x["n"].cast("string"))), "  ")
    text = F.concat(F.lit("✖ "), F.sum("n").cast("string"), F.lit(" 处（"), each, F.lit("）"))
    return files.agg(F.coalesce(text, F.lit("✅ 未发现坏味")).alias("summary"))


def public(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """The public form of findings, with the lines before and after: rule, type, severity, category, message,
    review_hint, file, line, column, text, sentence, before, after."""
    lines = docs.select(F.col("doc_id").alias("of"), F.split("text", "\n", -1).alias("lines"))
    rows = findings.join(lines, F.col("doc_id").eqNullSafe(F.col("of")))
    kind = F.when(F.col("severity") == "candidate", "candidate").otherwise("lint")
    return rows.select(
        F.col("rule_id").alias("rule"), kind.alias("type"), "severity", "category", "message", "review_hint", F.col("filename").alias("file"), F.col("ln").alias("line"),
        F.col("col").alias("column"), F.col("found").alias("text"), "sentence", F.try_element_at("lines", F.when(F.col("ln") > 1, F.col("ln") - 1)).alias("before"), F.try_element_at("lines", F.col("ln") + 1).alias("after"),
    )


def write_json(findings: DataFrame, docs: DataFrame, path: str) -> None:
    """The public form as JSON lines, nulls written."""
    public(findings, docs).write.option("ignoreNullFields", "false").json(path)
