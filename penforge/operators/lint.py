"""Findings: lines against rules, one row for each hit."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import rules
from ..functions.markdown import TERMINATORS, all_gathered, gathered, heading_level, heading_title, hits, layout, let, line_role, masked, nothing_gathered, pieces, sentence_at, starts, strip

PROSE = ("paragraph", "list_item", "blockquote")


def lines(docs: DataFrame, mask: bool = True) -> DataFrame:
    """doc_id, filename, ln, raw, masked, role. Stays within the row: no shuffle."""
    rows = docs.withColumn("masked_text", masked("text") if mask else F.col("text"))
    pairs = F.arrays_zip(F.split("text", "\n", -1).alias("raw"), F.split("masked_text", "\n", -1).alias("masked"))
    rows = rows.select("doc_id", "filename", F.posexplode(pairs).alias("i", "line"))
    return rows.select("doc_id", "filename", (F.col("i") + 1).alias("ln"), F.col("line.raw").alias("raw"), F.col("line.masked").alias("masked")).withColumn("role", line_role(F.col("raw")))


def pattern_findings(prose: DataFrame, patterns: list[rules.Pattern]) -> DataFrame:
    """One row for each (line, col, rule): of overlapping patterns of a rule at one place the first stays.

    The rule pack is one constant array; a line is repeated only for the patterns that it holds, and only hits are
    shuffled.
    """
    pack = F.array(*[
        F.struct(*[F.lit(v).alias(k) for k, v in p._asdict().items() if k != "guard"], F.lit(p.guard).cast("string").alias("guard"), F.lit(not set(p.pattern) & set("([\\")).alias("plain"))
        for p in patterns
    ])
    text = F.col("masked")
    held = F.filter(pack, lambda p: F.when(p["plain"], F.contains(text, p["pattern"])).otherwise(F.rlike(text, p["pattern"])))
    rows = prose.where(F.col("role").isin(*PROSE)).withColumn("p", F.explode(held))
    rows = rows.withColumn("hit", F.explode(hits(text, F.col("p.pattern")))).where(strip(F.col("hit.found")) != "")
    rest = F.substring(F.col("raw"), F.col("hit.col"), F.length("raw"))
    rows = rows.where(F.col("p.guard").isNull() | ~F.rlike(rest, F.concat(F.lit(r"\A(?:"), F.col("p.guard"), F.lit(")"))))
    best = F.min(F.struct("p.pat_ord", "hit.found")).alias("best")
    return rows.groupBy("doc_id", "filename", "ln", "hit.col", "p.rule_id", "p.category", "p.severity").agg(best).select("doc_id", "filename", "ln", "col", "rule_id", "category", "severity", "best.found")


def headings(prose: DataFrame) -> DataFrame:
    """doc_id, ln, level, title, raw, parent: the line of the nearest earlier heading of a smaller level (0: none)."""
    # a line that the document's mask hides wholly (code, front matter, a comment) is no heading
    found = prose.where("role = 'heading'").where(strip(F.col("masked")) != "").withColumns({"level": heading_level(F.col("raw")), "title": heading_title(F.col("raw"))}).where("level IS NOT NULL")
    before = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    last = {f"l{i}": F.coalesce(F.max(F.when(F.col("level") == i, F.col("ln"))).over(before), F.lit(0)) for i in range(1, 7)}
    parent = F.lit(0)
    for i in range(1, 6):
        parent = F.when(F.col("level") > i, F.greatest(parent, F.col(f"l{i}"))).otherwise(parent)
    return found.withColumns(last).withColumn("parent", parent).drop(*last)


def heading_gaps(prose: DataFrame) -> DataFrame:
    """Numbered headings that skip a number after their previous sibling."""
    rows = headings(prose).where("title <> ''").withColumn("number", _number(F.col("title")))
    siblings = Window.partitionBy("doc_id", "parent", "level").orderBy("ln")
    return rows.withColumn("prev", F.lag("number").over(siblings)).where(_skips(F.col("prev"), F.col("number")))


def paragraphs(prose: DataFrame) -> DataFrame:
    """doc_id, first_ln, n_lines, text: runs of paragraph lines."""
    rows = prose.where(F.col("role") == "paragraph")
    island = F.col("ln") - F.row_number().over(Window.partitionBy("doc_id").orderBy("ln"))
    rows = rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("ln").alias("first_ln"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("ln", "masked"))).alias("parts"))
    return rows.select("doc_id", "first_ln", "n_lines", F.array_join(F.col("parts.masked"), "\n").alias("text"))


def long_sentences(prose: DataFrame, most: int) -> DataFrame:
    """Sentences of paragraphs that are longer than `most` and mostly Chinese."""
    rows = paragraphs(prose).select("doc_id", "first_ln", F.explode(F.split("text", "(?<=[。！？!?；;])", -1)).alias("sentence"))
    bare = F.regexp_replace("sentence", rf"(?U)[*_`\s\x1c-\x1f]", "")
    share = F.try_divide(F.length(F.regexp_replace("sentence", "[^一-鿿]", "")), F.length("sentence"))
    return rows.withColumn("n", F.length(bare)).where((F.col("n") > most) & (share >= 0.3))


def lint(docs: DataFrame, profile: str = "general", only: str | None = None, mask: bool = True) -> DataFrame:
    """Findings of the pattern rules under a profile: doc_id, filename, ln, col, rule_id, category, severity, found."""
    return pattern_findings(lines(docs, mask), rules.rule_patterns(profile, only))


# --- the whole scan: patterns on prose and in table cells, long sentences, headings, large files ---------------------


def laid_out(docs: DataFrame) -> DataFrame:
    """doc_id, filename, ln, raw, masked, role, cells, in context; one Python step, no shuffle."""
    return layout(docs, "doc_id", "filename")


_SPECIAL = set(r".^$*+?{}[]\|()")


def _quoted(x: str | int | None) -> str:
    """A value as a literal of Spark SQL; one parsed expression is built much faster than thousands of columns."""
    if isinstance(x, str):
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "NULL" if x is None else str(x)


def _holds(column: str, pattern: str) -> str:
    return f"{column} RLIKE {_quoted(pattern)}" if set(pattern) & _SPECIAL else f"contains({column}, {_quoted(pattern)})"


def _holds_any(column: str, patterns: list[str]) -> Column:
    """Whether a text holds a hit: plain patterns by search, the others in one expression but for those with a
    back-reference, whose groups would be others."""
    alone = [p for p in patterns if not set(p) & _SPECIAL or re.search(r"\\[1-9k]", p)]
    joined = "|".join(f"(?:{p})" for p in patterns if p not in alone)
    return F.expr(" OR ".join([*(_holds(column, p) for p in dict.fromkeys(alone)), *([f"{column} RLIKE {_quoted(joined)}"] if joined else [])]) or "false")


def line_findings(active: list[rules.Active]) -> Column:
    """Array of (col, rule: its place in active, found, sentence) of a line with the columns text (masked) and raw.

    Sentences, places where a guard holds and hits are laid out as events in order of their column, and one pass over
    them keeps the last sentence begun and what was seen at the present column. Every step is linear in the line or
    sorts its events.
    """
    text, raw = F.col("text"), F.col("raw")
    pack = [(n, m, p) for n, rule in enumerate(active) for m, p in enumerate(rule.patterns)]
    guards = sorted({r.guard for r in active if r.guard and r.patterns})
    # events: col, kind (0 sentence, 1 guard, 2 hit), what, order of the pattern, text
    event = lambda col, kind, what, nth, x: F.struct(col.cast("int").alias("col"), F.lit(kind).alias("kind"), what.cast("int").alias("what"), nth.cast("int").alias("nth"), x.alias("x"))
    cut = F.split(raw, f"(?<=[{TERMINATORS}])", -1)
    sentences = F.zip_with(starts(F.transform(cut, lambda x: F.length(x))), cut, lambda n, x: event(n + 1, 0, F.lit(0), F.lit(0), strip(x)))
    kinds = F.expr("array(" + ", ".join(f"named_struct('p', {_quoted(p)}, 'rule', {n}, 'nth', {m})" for n, m, p in pack) + ")")
    held = F.array_compact(F.expr("array(" + ", ".join(f"CASE WHEN {_holds('text', p)} THEN {i} END" for i, (_, _, p) in enumerate(pack)) + ")"))
    found = F.flatten(F.transform(held, lambda i: F.transform(hits(text, F.get(kinds, i)["p"]), lambda h: event(h["col"], 2, F.get(kinds, i)["rule"], F.get(kinds, i)["nth"], h["found"]))))
    events = [sentences, F.filter(found, lambda e: strip(e["x"]) != "")]
    for g, guard in enumerate(guards):
        # a match of no width before which the line is cut: all places where the guard holds, but for the first one
        before = F.split(raw, f"(?=(?:{guard}))", -1)
        places = F.slice(starts(F.transform(before, lambda x: F.length(x))), 2, F.greatest(F.size(before) - 1, F.lit(0)))
        places = F.concat(F.when(raw.rlike(rf"\A(?:{guard})"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), places)
        events.append(F.when(raw.rlike(guard), F.transform(places, lambda n: event(n + 1, 1, F.lit(-1 - g), F.lit(0), F.lit("")))).otherwise(F.slice(sentences, 1, 0)))
    events = F.array_sort(F.concat(*events))
    guard_of = F.lit([-1 - guards.index(r.guard) if r.guard in guards else 0 for r in active])
    none = F.array().cast("array<int>")

    def step(acc: Column, e: Column) -> Column:
        """Only numbers are carried along: for each event whether it is a finding."""
        seen = F.when(acc["at"] == e["col"], acc["seen"]).otherwise(none)
        # a rule is found once at a place, and not where its guard holds
        new = (e["kind"] == 2) & ~F.array_contains(seen, e["what"]) & ~F.array_contains(seen, F.get(guard_of, e["what"]))
        return let(new, lambda new: F.struct(
            e["col"].alias("at"),
            F.when((e["kind"] == 1) | new, F.array_append(seen, e["what"])).otherwise(seen).alias("seen"),
            gathered(acc["out"], new.cast("int")).alias("out"),
        ))

    begin = F.struct(F.lit(0).alias("at"), none.alias("seen"), nothing_gathered().alias("out"))
    flags = lambda ev: F.aggregate(ev, begin, step, lambda acc: all_gathered(acc["out"]))
    kept = lambda ev: F.array_compact(F.zip_with(ev, flags(ev), lambda e, flag: F.when((e["kind"] == 0) | (flag == 1), e)))

    def together(kept: Column) -> Column:
        """Findings beside the sentences that they follow: each sentence as often as it has findings."""
        heads = F.array_compact(F.transform(kept, lambda e, i: F.when(e["kind"] == 0, i)))
        counts = lambda at: F.zip_with(at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(kept))), lambda a, b: b - a - 1)
        texts = F.transform(F.filter(kept, lambda e: e["kind"] == 0), lambda e: e["x"])
        often = let(heads, lambda at: F.flatten(F.zip_with(texts, counts(at), lambda x, n: F.array_repeat(x, n))))
        return F.zip_with(F.filter(kept, lambda e: e["kind"] == 2), often, lambda h, x: F.struct(h["col"].alias("col"), h["what"].alias("rule"), h["x"].alias("found"), x.alias("sentence")))

    return let(events, lambda ev: let(kept(ev), together))


def _number(title: Column) -> Column:
    return F.regexp_extract(title, r"(?U)\A(\d+(?:\.\d+)*)(?:\.|[、\s]|\z)", 1)


def _skips(prev: Column, number: Column) -> Column:
    """Whether a heading's number leaves one out after its sibling's."""
    bare = lambda c: F.transform(F.split(c, r"\."), lambda x: F.regexp_replace(x, r"\A0+(?=.)", ""))
    a, b = bare(prev), bare(number)
    same = (F.size(a) == F.size(b)) & (F.slice(a, 1, F.size(a) - 1) == F.slice(b, 1, F.size(b) - 1))
    x, y = F.element_at(a, -1), F.element_at(b, -1)
    # numbers of more digits than a decimal has are told apart by length and text; then any greater one is a gap
    greater = (F.length(y) > F.length(x)) | ((F.length(y) == F.length(x)) & (y > x))
    return (prev != "") & (number != "") & same & F.coalesce(F.try_subtract(y.try_cast("decimal(38,0)"), x.try_cast("decimal(38,0)")) > 1, greater)


def scan(docs: DataFrame, profile: str = "general", rule_table: DataFrame | None = None, profile_table: DataFrame | None = None) -> DataFrame:
    """Every finding of documents (doc_id, filename, text) under a profile: doc_id, filename, ln, col, rule_id,
    category, severity, found, message, sentence, review_hint, seq; ordered_scan() has them in report order.

    One Python step lays a document out in pieces; what is found in a piece is an expression over it, so a scan is one
    pass without a shuffle. rule_table, profile_table: as rules.rule_frame() and profile_frame() give them, with a user's rows.
    One row for each (ln, col, rule). An unknown profile counts as general; a null text has no findings; repeated
    rows are documents of their own.
    """
    active, most = rules.active(profile, rule_table, profile_table)
    at = {r.rule_id: n for n, r in enumerate(active)}
    rows = pieces(docs, "doc_id", "filename", least=most)
    text, raw, kind = F.col("text"), F.col("raw"), F.col("kind")
    one = lambda name, col, found, sentence, w: F.struct(col.cast("int").alias("col"), F.lit(at.get(name)).cast("int").alias("rule"), found.alias("found"), sentence.alias("sentence"), w.alias("w"))
    empty = F.lit("")
    ways = []  # (of which pieces, the findings of one)
    if patterns := [p for r in active for p in r.patterns]:
        twice = [n for n, r in enumerate(active) if r.rule_id == "D001"]
        word = lambda f: F.when(f["rule"].isin(twice), F.substring(f["found"], F.lit(1), F.shiftright(F.length(f["found"]), 1))).otherwise(found(f))
        # what is masked within a hit is found as it is written in a table, and as it is masked in prose
        found = lambda f: F.when((kind == "row") & F.contains(f["found"], F.lit(" ")), F.substring(raw, f["col"], F.length(f["found"]))).otherwise(f["found"])
        hit = F.transform(line_findings(active), lambda f: F.struct(f["col"].alias("col"), f["rule"].alias("rule"), found(f).alias("found"), f["sentence"].alias("sentence"), word(f).alias("w")))
        ways.append((kind.isin("line", "row") & _holds_any("text", patterns), hit))
    if "S001" in at:
        size = F.length(F.regexp_replace(text, r"(?U)[*_`\s\x1c-\x1f]", ""))
        chinese = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
        ways.append(((kind == "sentence") & (size > most) & (chinese >= 0.3 * size), F.array(one("S001", F.col("col"), raw, raw, size.cast("string")))))
    if "DOC001" in at:
        ways.append(((kind == "heading") & (text == ""), F.array(one("DOC001", F.lit(1), empty, strip(raw), empty))))
    if "DOC002" in at:
        prev, number = _number(F.substring_index(raw, "\n", 1)), _number(text)
        ways.append(((kind == "sibling") & _skips(prev, number), F.array(one("DOC002", F.col("col"), empty, strip(F.element_at(F.split(raw, "\n"), -1)), F.concat_ws("\n", prev, number)))))
    if "A900" in at:
        large = (kind == "file") & F.col("filename").endswith("SKILL.md") & (F.col("ln") > rules.MOST_LINES)
        ways.append((large, F.array(one("A900", F.lit(1), empty, sentence_at(raw, F.lit(1)), F.col("ln").cast("string")))))
    if not ways:
        ways.append((F.lit(False), F.array(one("", F.lit(1), empty, empty, empty))))
    kept = reduce(lambda a, b: a | b, [c for c, _ in ways])
    rows = rows.where(kept).withColumn("f", F.explode(F.coalesce(*[F.when(c, x) for c, x in ways])))
    rows = rows.select("doc_id", "filename", F.when(kind == "file", 1).otherwise(F.col("ln")).alias("ln"), "f.*")
    fields = ("rule_id", "category", "severity", "message", "review_hint", "seq")
    about = F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {_quoted(getattr(r, k))}" for k in fields) + ")" for r in active or [rules.Active("", 0, "", "", [], None, "", "")]) + ")")
    rows = rows.withColumn("r", F.get(about, F.col("rule")))
    limit = F.when(F.col("r.rule_id") == "A900", F.lit(str(rules.MOST_LINES))).otherwise(F.lit(str(most)))
    message = F.col("r.message")
    for mark, value in (("{w}", F.col("w")), ("{len}", F.col("w")), ("{max}", limit), ("{prev}", F.split("w", "\n")[0]), ("{curr}", F.element_at(F.split("w", "\n"), -1))):
        message = F.replace(message, F.lit(mark), value)
    return rows.select("doc_id", "filename", "ln", "col", "r.rule_id", "r.category", "r.severity", "found", message.alias("message"), "sentence", "r.review_hint", "r.seq")


def ordered_scan(docs: DataFrame, profile: str = "general", rule_table: DataFrame | None = None, profile_table: DataFrame | None = None) -> DataFrame:
    return scan(docs, profile, rule_table, profile_table).orderBy("filename", "doc_id", "ln", "col", "seq")
