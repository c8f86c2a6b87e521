"""What belongs to a review session as a whole: its fingerprint, totals, latencies, choices kept, the offline walkthrough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.markdown import strip
from .decisions import json_string
from .review import DECISIONS

#: Rewrites (before, after, reason) that the walkthrough proposes where a passage stands once, and
#: questions (before, action, reason) that it asks where a passage stands at all; the rule it names.
DEMO_REWRITES = (
    ("总而言之，", "", "删除不承载信息的套话引导词。"),
    ("进行分析", "分析", "删除冗余动词，保留原意。"),
    ("为了更好地提升用户体验，我们将会对系统进行优化。", "我们将优化系统，改善用户体验。", "压缩目的套话，不添加性能承诺。"),
)
DEMO_QUESTIONS = (
    ("所有用户都认为这个功能非常好，效率提升了 80%。", "VERIFY", "需要用户调研样本与效率测试基线；演示没有这些证据，因此保留原文待核实。"),
    ("请相关同事尽快处理这个问题。", "ASK", "请作者补充负责人、具体问题和截止时间。"),
)
DEMO_RULE = "SEMANTIC_DEMO"


def fingerprint(text: Column, profile: Column, filename: Column, model: Column, base_url: Column, workspace: Column, uses_workspace: Column) -> Column:
    """The digest of what a session depends on; null text counts as empty. Keys are no part of it."""
    address = F.regexp_replace(strip(base_url), r"/+\z", "")
    parts = [F.sha2(F.coalesce(text, F.lit("")), 256), profile, filename, strip(model), address, workspace]
    flag = F.when(uses_workspace, "true").otherwise("false")
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *map(json_string, parts), flag), F.lit("]")), 256)


def retained_choices(previous: DataFrame, following: DataFrame, choices: DataFrame) -> DataFrame:
    """doc_id, id, choice: choices (doc_id, id, choice) that outlive a new result. A rewrite keeps its choice where the
    earlier result has it with the same action, before, after and source_start (null equals null). ids are unique in a
    result; other choices than accepted and rejected go."""
    keys, fields = ["doc_id", "id"], ["action", "before", "after", "source_start"]
    old = previous.select(*keys, F.struct(*fields).alias("old"))
    new = following.where("action = 'REWRITE'").select(*keys, F.struct(*fields).alias("new"))
    made = choices.where(F.col("choice").isin("accepted", "rejected")).select(*keys, "choice")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}"))
    return new.join(made, keys).join(old, keys).where(same).select(*keys, "choice")


def result_totals(decisions: DataFrame, batches: DataFrame) -> DataFrame:
    """session, n_decisions, n_semantic, model_calls: decisions (session, finding_id; without one it is semantic) and
    batches (session, calls) are each summed before they meet; a session of either is a row."""
    made = decisions.groupBy("session").agg(F.count("*").alias("n_decisions"), F.count_if(F.col("finding_id").isNull()).alias("n_semantic"))
    asked = batches.groupBy("session").agg(F.sum("calls").alias("model_calls"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return made.join(asked, "session", "full").select("session", *map(none, ("n_decisions", "n_semantic", "model_calls")))


def latencies(samples: DataFrame) -> DataFrame:
    """name, n, median, p95 of samples (name, ms). p95 is a sample: of 30 the 29th, of n the one at 0.95 n, rounded up."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)")
    return samples.groupBy("name").agg(F.count("ms").alias("n"), F.median("ms").alias("median"), p95.alias("p95"))


def feedback_totals(feedback: DataFrame) -> DataFrame:
    """rule_id, is_total, total, n_keep ... n_ask, keep_rate of each rule and of all feedback (rule_id, decision)."""
    counts = [F.count_if(F.col("decision") == d).alias(f"n_{d.lower()}") for d in DECISIONS]
    rows = feedback.rollup("rule_id").agg(F.grouping("rule_id").cast("boolean").alias("is_total"), F.count("*").alias("total"), *counts)
    return rows.withColumn("keep_rate", F.try_divide(F.col("n_keep").cast("double"), F.col("total")))


def demo_decisions(docs: DataFrame) -> DataFrame:
    """doc_id, decisions (rule, action, before, after, reason), revised: the walkthrough of each document, without a
    model. Rewrites go into the text one after the other; null text has no decisions and stays null."""
    fields = ("rule", "action", "before", "after", "reason")
    made = lambda *values: F.struct(*[F.lit(v).alias(k) for k, v in zip(fields, (DEMO_RULE, *values))])
    text, none = F.col("text"), F.array().cast("array<struct<rule:string,action:string,before:string,after:string,reason:string>>")
    parts = []
    for before, after, reason in DEMO_REWRITES:
        once = (F.length(text) - F.length(F.replace(text, F.lit(before), F.lit("")))) == len(before)
        parts.append(F.when(once, F.array(made("REWRITE", before, after, reason))).otherwise(none))
    for before, action, reason in DEMO_QUESTIONS:
        parts.append(F.when(text.contains(before), F.array(made(action, before, "", reason))).otherwise(none))
    rows = docs.select("doc_id", "text", F.concat(*parts).alias("decisions"))

    def put(t: Column, d: Column) -> Column:
        at = F.instr(t, d["before"])
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), d["after"], F.substring(t, at + F.length(d["before"]), F.length(t)))).otherwise(t)

    rewrites = F.filter("decisions", lambda d: d["action"] == "REWRITE")
    return rows.select("doc_id", "decisions", F.aggregate(rewrites, text, put).alias("revised"))


def list_files(files: DataFrame, query: str = "", cursor: int = 0, size: int = 30) -> DataFrame:
    """path, place, next_cursor, total_matches of a page of the sorted paths that hold a query in any case; next_cursor is
    null on the last page. cursor 0 to 2,000, size 1 to 50. The page is a top-k: only its rows and those before are sorted."""
    if not 0 <= cursor <= 2_000 or not 1 <= size <= 50:
        raise ValueError("cursor or size out of range")
    found = files.select("path").where(F.lower("path").contains(query.lower()))
    page = found.orderBy("path").limit(cursor + size)
    page = page.agg(F.array_sort(F.collect_list("path")).alias("all")).select(F.posexplode(F.slice("all", cursor + 1, size)).alias("i", "path"))
    total = found.agg(F.count("*").alias("total_matches"))  # one row
    upto = F.lit(cursor + size).cast("long")
    return page.crossJoin(F.broadcast(total)).select("path", (F.col("i") + cursor + 1).alias("place"), F.when(upto < F.col("total_matches"), upto).alias("next_cursor"), "total_matches")
