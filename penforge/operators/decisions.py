"""The algebra of review decisions: approval of patches, merging of related ones, binding to segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values.
SUPPLEMENT, DISAGREE = "语义补充", "两路审查结论或修改方案不一致，需核实后再决定。"


def approval(approved: DataFrame, patches: DataFrame) -> DataFrame:
    """patch_id, state for each id of either: ok, missing (approved but no patch), extra, or duplicate in either."""
    a = approved.groupBy("patch_id").agg(F.count("*").alias("n_a"))
    b = patches.groupBy("patch_id").agg(F.count("*").alias("n_b"))
    state = F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate").when(F.col("n_b").isNull(), "missing").when(F.col("n_a").isNull(), "extra").otherwise("ok")
    return a.join(b, "patch_id", "full").select("patch_id", state.alias("state"))


def merge_related(static: DataFrame, related: DataFrame) -> DataFrame:
    """Static decisions (finding_id, action, before, after, reason), each with its related ones (finding_id, seq, rule,
    action, before, after, reason) folded in by seq. Where they differ, the author is asked, or facts are checked."""
    parts = F.struct("seq", "rule", "action", "before", "after", "reason")
    given = related.groupBy("finding_id").agg(F.array_sort(F.collect_list(parts)).alias("more"))
    rows = static.join(given, "finding_id", "left")
    start = F.struct("action", "before", "after", "reason")

    def fold(acc: Column, x: Column) -> Column:
        differs = (acc["action"] != x["action"]) | ((acc["action"] == "REWRITE") & ~(acc["before"].eqNullSafe(x["before"]) & acc["after"].eqNullSafe(x["after"])))
        asked = F.when((acc["action"] == "VERIFY") | (x["action"] == "VERIFY"), F.lit("VERIFY")).otherwise(F.lit("ASK"))
        added = F.concat(acc["reason"], F.lit(f"\n{SUPPLEMENT}（"), x["rule"], F.lit("，"), x["action"], F.lit("）："), x["reason"])
        return F.struct(
            F.when(differs, asked).otherwise(acc["action"]).alias("action"), acc["before"].alias("before"),
            F.when(differs, F.lit("")).otherwise(acc["after"]).alias("after"),
            F.when(differs, F.concat(added, F.lit("\n" + DISAGREE))).otherwise(added).alias("reason"),
        )

    none = F.array().cast("array<struct<seq:int,rule:string,action:string,before:string,after:string,reason:string>>")
    return rows.withColumn("m", F.aggregate(F.coalesce("more", none), start, fold)).select("finding_id", "m.*")


def segment_of(findings: DataFrame, segments: DataFrame) -> DataFrame:
    """Findings (doc_id, offset, ...) with the seg_no whose half-open core holds them; equi-joined on the document."""
    inside = (F.col("f.offset") >= F.col("s.start")) & (F.col("f.offset") < F.col("s.end_"))
    return findings.alias("f").join(segments.alias("s"), (F.col("f.doc_id") == F.col("s.doc_id")) & inside).select("f.*", "s.seg_no")


# --- rewrites: links, coverage, conflicts, revised texts --------------------------------------------------------------

#: Why a rewrite becomes a question.
NUMERIC = "改写涉及数字、日期或版本等数值文本的增删或变化，请补充依据并确认目标表述。"
OVERLAPS = "该建议与另一处改写重叠，需要人工确认。"
CROSSES = "该改写跨越分段边界，请阅读全文后人工确认。"


def place_of(text: Column, before: Column, start: Column) -> Column:
    """Where a passage stands, from 0: at start if it does stand there, without a start at its only place; else null."""
    times = F.try_divide(F.length(text) - F.length(F.replace(text, before, F.lit(""))), F.length(before))
    trusted = F.when((start >= 0) & (F.substring(text, start + 1, F.length(before)) == before), start)
    return F.when(F.coalesce(before, F.lit("")) == "", None).when(start.isNotNull(), trusted).when(times == 1, F.instr(text, before) - 1)


def verified_links(semantic: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, seq, finding_id: the claimed links (semantic: doc_id, seq, before, source_start, related) whose finding
    (doc_id, finding_id, offset, found) lies within the passage. Equi-joined on the document and the finding."""
    placed = semantic.join(docs.select("doc_id", "text"), "doc_id").withColumn("at", place_of(F.col("text"), F.col("before"), F.col("source_start")))
    claimed = placed.where("at IS NOT NULL").select("doc_id", "seq", "at", (F.col("at") + F.length("before")).alias("upto"), F.explode(F.array_distinct("related")).alias("finding_id"))
    inside = claimed.join(findings, ["doc_id", "finding_id"]).where((F.col("found") != "") & (F.col("offset") >= F.col("at")) & (F.col("offset") + F.length("found") <= F.col("upto")))
    return inside.select("doc_id", "seq", "finding_id")


def coverage(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """finding_id, state for every finding (finding_id, rule) and decision (finding_id, rule): ok, missing, unknown,
    duplicate, or rule where they name different ones."""
    given = decisions.groupBy("finding_id").agg(F.count("*").alias("n"), F.min("rule").alias("decided"))
    both = findings.select("finding_id", "rule").join(given, "finding_id", "full")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("rule").isNull(), "unknown").when(F.col("n") > 1, "duplicate").when(F.col("rule") != F.col("decided"), "rule").otherwise("ok")
    return both.select("finding_id", state.alias("state"))


def resolve_rewrites(decisions: DataFrame, docs: DataFrame, changed) -> DataFrame:
    """Decisions (doc_id, lane, seq, action, before, after, reason, source_start) with action, after and reason settled
    and their place at: static ones first, then semantic ones, each by seq. A rewrite that changes numbers, or overlaps
    an accepted one, becomes a question; one whose passage has no single place is `invalid`. changed: of two columns,
    whether their numbers differ. The decisions of a document are folded within its row."""
    rows = decisions.join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.withColumn("at", place_of(F.col("text"), F.col("before"), F.col("source_start")).cast("int")).withColumn("numeric", changed(F.col("before"), F.col("after")))
    rank = F.when(F.col("lane") == "static", 0).otherwise(1).alias("rank")
    item = F.struct(rank, "seq", "lane", "action", "before", "after", "reason", "at", "numeric")
    folded = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    span = "array<struct<a:int,b:int>>"
    start = F.struct(F.array().cast(span).alias("taken"), F.slice("all", 1, 0).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        end = d["at"] + F.length(d["before"])
        rewrite = d["action"] == "REWRITE"
        hit = F.exists(acc["taken"], lambda t: (d["at"] < t["b"]) & (end > t["a"]))
        state = F.when(~rewrite, "kept").when(d["at"].isNull() | (d["before"] == d["after"]), "invalid").when(d["numeric"], "numeric").when(hit, "overlap").otherwise("taken")
        asked = state.isin("numeric", "overlap")
        settled = F.struct(
            d["rank"].alias("rank"), d["seq"].alias("seq"), d["lane"].alias("lane"), F.when(asked, "ASK").when(state == "invalid", "INVALID").otherwise(d["action"]).alias("action"), d["before"].alias("before"),
            F.when(asked, "").otherwise(d["after"]).alias("after"), F.concat(F.when(state == "numeric", NUMERIC).when(state == "overlap", OVERLAPS).otherwise(""), d["reason"]).alias("reason"), d["at"].alias("at"), d["numeric"].alias("numeric"),
        )
        taken = F.when(state == "taken", F.concat(acc["taken"], F.array(F.struct(d["at"].alias("a"), end.alias("b"))))).otherwise(acc["taken"])
        return F.struct(taken.alias("taken"), F.concat(acc["out"], F.array(settled)).alias("out"))

    out = folded.select("doc_id", F.explode(F.aggregate("all", start, step, lambda acc: acc["out"])).alias("d"))
    return out.select("doc_id", "d.lane", "d.seq", "d.action", "d.before", "d.after", "d.reason", "d.at")


def revised_texts(decisions: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, revised: every document with its accepted rewrites (doc_id, action, at, before, after, none overlapping)
    put in from right to left."""
    edits = decisions.where("action = 'REWRITE'").groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("at", "before", "after")))).alias("edits"))
    rows = docs.select("doc_id", "text").join(edits, "doc_id", "left")
    put = lambda t, e: F.concat(F.substring(t, F.lit(1), e["at"]), e["after"], F.substring(t, e["at"] + F.length(e["before"]) + 1, F.length(t)))
    none = F.array().cast("array<struct<at:int,before:string,after:string>>")
    return rows.select("doc_id", F.aggregate(F.coalesce("edits", none), F.col("text"), put).alias("revised"))


def accepted_only(decisions: DataFrame, choices: DataFrame) -> DataFrame:
    """The rewrites that a user accepted; choices: decision_id, choice."""
    return decisions.where("action = 'REWRITE'").join(choices.where("choice = 'accepted'").select("decision_id").distinct(), "decision_id", "left_semi")


def global_offsets(decisions: DataFrame, segments: DataFrame) -> DataFrame:
    """Decisions of segments (doc_id, seg_no, finding_id, action, before, after, reason, offset from the context's
    start) at places of the document: at, and action, after and reason where a rewrite crosses its segment's core.
    Semantic ones outside the core belong to another segment and go. segments: doc_id, seg_no, start, end_, context_start."""
    rows = decisions.join(segments.select("doc_id", "seg_no", "start", "end_", "context_start"), ["doc_id", "seg_no"])
    rows = rows.withColumn("at", F.col("context_start") + F.col("offset"))
    rows = rows.where(F.col("finding_id").isNotNull() | ((F.col("at") >= F.col("start")) & (F.col("at") < F.col("end_"))))
    crosses = (F.col("action") == "REWRITE") & ((F.col("at") < F.col("start")) | (F.col("at") + F.length("before") > F.col("end_")))
    return rows.select(
        "doc_id", "seg_no", "finding_id", F.when(crosses, "ASK").otherwise(F.col("action")).alias("action"), "before", F.when(crosses, "").otherwise(F.col("after")).alias("after"),
        F.when(crosses, F.concat(F.lit(CROSSES), "reason")).otherwise(F.col("reason")).alias("reason"), "at",
    )


def json_string(text: Column) -> Column:
    """A text as a JSON string, null as null; of escaped control characters the hex digits are small."""
    quoted = F.regexp_replace(F.to_json(F.array(text)), r"(?s)\A\[(.*)\]\z", "$1")

    def small(part: Column) -> Column:
        for digit in "ABCDEF":
            part = F.regexp_replace(part, rf"\\u00([01]){digit}", rf"\\u00$1{digit.lower()}")
        return part

    # between escaped backslashes, a backslash begins an escape
    fixed = F.array_join(F.transform(F.split(quoted, r"\\\\", -1), small), "\\\\")
    return F.when(quoted.rlike(r"\\u00[01][A-F]"), fixed).otherwise(quoted)


def decision_id(finding_id: Column, at: Column, rule: Column, before: Column, after: Column) -> Column:
    """static-N, or semantic-place-hash of a JSON list of rule, before and after."""
    quoted = [json_string(c) for c in (rule, before, after)]
    digest = F.substring(F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]")), 256), 1, 16)
    return F.when(finding_id.isNotNull(), F.concat(F.lit("static-"), finding_id.cast("string"))).otherwise(F.concat(F.lit("semantic-"), at.cast("string"), F.lit("-"), digest))


def clarification(text: Column, before: Column, start: Column) -> Column:
    """(left, passage): the line around a passage, 400 characters on each side at most; null where it has no one place."""
    at = place_of(text, before, start)
    end = at + F.length(before)
    begun = at - F.length(F.element_at(F.split(F.substring(text, F.lit(1), at), "\n", -1), -1))
    rest = F.length(F.element_at(F.split(F.substring(text, end + 1, F.length(text)), "\n", -1), 1))
    left, right = F.greatest(begun, at - 400), F.least(end + rest, end + 400)
    wide = right - left > 2000
    left, right = F.when(wide, at).otherwise(left), F.when(wide, end).otherwise(right)
    found = F.struct(left.alias("left"), F.substring(text, left + 1, right - left).alias("passage"))
    return F.when(at.isNotNull() & (F.length(before) <= 2000), found)


def progress(segments: DataFrame, done: DataFrame) -> DataFrame:
    """doc_id, total, completed, reviewed_chars: segments (doc_id, seg_no, start, end_) against those done (doc_id, seg_no)."""
    marked = segments.join(done.select("doc_id", "seg_no").distinct().withColumn("done", F.lit(True)), ["doc_id", "seg_no"], "left")
    chars = F.sum(F.when(F.col("done"), F.col("end_") - F.col("start")).otherwise(0))
    return marked.groupBy("doc_id").agg(F.count("*").alias("total"), F.count("done").alias("completed"), chars.alias("reviewed_chars"))


# --- answers of a review lane -----------------------------------------------------------------------------------------

#: Actions, and how rules of the lane that reads the whole text begin.
ACTIONS, SEMANTIC = ("KEEP", "REWRITE", "VERIFY", "ASK"), "SEMANTIC_"


def parse_lane(content: Column, lane: str, n_findings: Column) -> Column:
    """summary, decisions, error, item of a lane's answer: JSON, in a fence or not. error is the first thing wrong, item
    the number of the decision that has it. Whether a static lane covers its findings is coverage()'s to say."""
    bare = F.regexp_extract(F.regexp_replace(content, r"(?U)\A\s+|\s+\z", ""), r"(?s)\A(?:```[^\n]*\n(?=.*\n[^\S\n]*```\z))?(.*?)(?:(?<=\n)[^\S\n]*```)?\z", 1)
    value = F.try_parse_json(bare)
    trimmed = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")

    def field(of: Column, path: str, kind: str, t: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(of, path, "variant")).startswith(kind), F.try_variant_get(of, path, t))

    def nothing(of: Column, path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(of, path, "variant")) == "VOID", F.lit(True))

    items = field(value, "$.decisions", "ARRAY", "array<variant>")
    summary = trimmed(field(value, "$.summary", "STRING", "string"))

    def checked(d: Column, i: Column) -> Column:
        rule, reason = (trimmed(field(d, f"$.{k}", "STRING", "string")) for k in ("rule", "reason"))
        action, number = field(d, "$.action", "STRING", "string"), field(d, "$.finding_index", "BIGINT", "long")
        related = field(d, "$.related_finding_indexes", "ARRAY", "array<variant>")
        linked = F.transform(related, lambda x: field(x, "$", "BIGINT", "long"))
        given = {k: F.when(F.try_variant_get(d, f"$.{k}", "variant").isNull(), "").otherwise(field(d, f"$.{k}", "STRING", "string")) for k in ("before", "after")}
        blank = lambda c: F.coalesce(c, F.lit("")) == ""
        error = F.when(~F.schema_of_variant(d).startswith("OBJECT"), "object").when(blank(rule), "rule").when(~nothing(d, "$.finding_index") & (F.coalesce(number, F.lit(0)) < 1), "finding_index")
        error = error.when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "action").when(blank(reason), "reason").when(given["before"].isNull() | given["after"].isNull(), "before/after")
        if lane == "semantic":
            error = error.when(related.isNull() | F.exists(linked, lambda x: ~F.coalesce(x.between(1, n_findings), F.lit(False))), "related").when(F.size(F.array_distinct(linked)) != F.size(linked), "related twice")
            late = F.when(~nothing(d, "$.finding_index"), "indexed").when(~rule.startswith(SEMANTIC), "rule name").when(action == "KEEP", "keep")
        else:
            linked = F.array().cast("array<bigint>")
            late = F.when(nothing(d, "$.finding_index"), "not indexed")
        return F.struct(
            (i + 1).alias("item"), error.alias("early"), late.alias("late"), number.alias("finding_index"), rule.alias("rule"), action.alias("action"), reason.alias("reason"),
            given["before"].alias("before"), given["after"].alias("after"), linked.alias("related"),
        )

    rows = F.transform(items, checked)
    first = lambda k: F.try_element_at(F.filter(rows, lambda r: r[k].isNotNull()), F.lit(1))
    early, late = first("early"), first("late")
    error = F.when(value.isNull(), "json").when(~F.schema_of_variant(value).startswith("OBJECT"), "object").when(F.coalesce(summary, F.lit("")) == "", "summary").when(items.isNull(), "decisions")
    error = error.when(early.isNotNull(), early["early"]).when(late.isNotNull(), late["late"])
    item = F.when(value.isNotNull() & items.isNotNull() & (F.coalesce(summary, F.lit("")) != ""), F.coalesce(early["item"], late["item"]))
    good = F.transform(rows, lambda r: F.struct(*[r[k].alias(k) for k in ("finding_index", "rule", "action", "reason", "before", "after", "related")]))
    return F.struct(F.when(error.isNull(), summary).alias("summary"), F.when(error.isNull(), good).alias("decisions"), error.alias("error"), item.alias("item"))
