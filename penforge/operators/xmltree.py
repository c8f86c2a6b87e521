"""Block XML as tables: text runs with their nodes, blocks in canonical form, sections with fingerprints, findings bound
to nodes, patches checked against all that and put in.

Only parsing and serialising are Python; binding, ownership and checks are joins and windows over the tables. A document
over the size limit, with a declaration, not well formed, nested deeper than DEEPEST, or with a block whose id attributes
differ gives one row with an error; a null document gives none. Offsets count code points. A path names a node by child
numbers from its block, "/" between; a last -1 is the text after that child; the block's own text has an empty path.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

LIMIT, DEEPEST = 20 * 2**20, 300
#: Rows that leave a task at once, or characters of the documents they come from.
BATCH_ROWS, BATCH_CHARS = 10_000, 4_000_000

# Names of the block language.
KEYS = ("id", "block-id", "block_id")
VOLATILE = frozenset({"id", "block-id", "block_id", "revision-id", "revision_id"})
INLINE = frozenset({"b", "em", "u", "del", "span", "a", "i", "strong"})
EXCLUDED = frozenset({"pre", "code", "grid", "img", "source", "whiteboard", "sheet", "bitable", "cite", "synced"})
OMITTED = frozenset({"title", "synced_reference", "synced_source", "synced-reference", "synced-source"})
ROWS, CELLS, TABLE_PARTS = frozenset({"tr", "table_row"}), frozenset({"td", "th", "table_cell", "cell"}), frozenset({"thead", "tbody", "tfoot"})
MARKS = {"li": "- ", "checkbox": "- ", "blockquote": "> ", "p": "", "callout": ""}
HEADING = re.compile(r"h[1-9]\Z")
LEAD_IN = "文档开头"
STRUCTURE_RULES = ("DOC001", "DOC002")

RUN_KIND = "doc_id long, seq int, pos int, block_id string, path string, start int, end_ int, text string, writable boolean, reason string, line_starts array<int>, error string"
BLOCK_KIND = "doc_id long, pos int, block_id string, level int, title string, canonical string, error string"
PATCHED_KIND = "doc_id long, revised string, fingerprints array<string>"


def _name(node) -> str:
    return node.tag.rsplit("}", 1)[-1].lower()


def _keys(block) -> set[str]:
    return {block.get(k) for k in KEYS} - {None, ""}


def _key(block) -> str | None:
    return next(iter(_keys(block)), None)


def parse(xml: str):
    """(root, None), or (None, why it can't be read)."""
    if len(xml) > LIMIT or len(xml.encode("utf-8", "replace")) > LIMIT:
        return None, "xml_limit"
    shout = xml.upper()
    if "<!DOCTYPE" in shout or "<!ENTITY" in shout:
        return None, "unsafe_xml"
    try:
        root = ElementTree.fromstring(f"<document>{xml}</document>")
    except ElementTree.ParseError:
        return None, "malformed_xml"
    layer, depth = [root], 0
    while layer:
        layer, depth = [c for node in layer for c in node], depth + 1
        if depth > DEEPEST:
            return None, "too_deep"
    return (None, "ambiguous_block_id") if any(len(_keys(b)) > 1 for b in root) else (root, None)


# A piece is (path, text, writable, reason); a path of None marks characters that stand in no node.


def _made(text: str):
    return None, text, False, None


def _walk(node, path: tuple, writable: bool, reason: str | None, in_link: bool = False) -> Iterator[tuple]:
    if node.text:
        yield path, node.text, writable, reason
    for i, child in enumerate(node):
        here, name = (*path, i), _name(child)
        if in_link or name in INLINE or (writable and name in ("p", "li")):
            yield from _walk(child, here, writable, reason, name == "a" and not in_link)
        elif name == "br":
            yield _made("\n")
        elif name not in OMITTED:
            yield from _walk(child, here, False, None if name in EXCLUDED else reason)
        if child.tail:
            yield (*here, -1), child.tail, writable, reason


def _table_rows(node, path: tuple = ()) -> Iterator[list[tuple[tuple, object]]]:
    loose = []
    for i, child in enumerate(node):
        name, here = _name(child), (*path, i)
        if name in ROWS:
            yield [((*here, j), c) for j, c in enumerate(child) if _name(c) in CELLS]
        elif name in TABLE_PARTS:
            yield from _table_rows(child, here)
        elif name in CELLS and not path:
            loose.append((here, child))
    yield loose


def _pieces(block) -> Iterator[tuple]:
    name, owned = _name(block), _key(block) is not None
    if name in OMITTED or name in EXCLUDED:
        return
    if name == "table":
        for n, row in enumerate(r for r in _table_rows(block) if r):
            yield _made("\n|" if n else "|")
            for path, cell in row:
                yield _made(" ")
                yield from _walk(cell, path, False, "table_cell")
                yield _made(" |")
    elif name in ("ol", "ul"):
        n = 0
        for i, child in enumerate(block):
            item = _name(child) == "li"
            if item:
                n += 1
                yield _made(("\n" if n > 1 else "") + (f"{n}. " if name == "ol" else "- "))
            yield from _walk(child, (i,), item and owned, None)
    elif HEADING.match(name):
        yield _made("#" * int(name[1]) + " ")
        yield from _walk(block, (), False, None)
    else:
        if MARKS.get(name):
            yield _made(MARKS[name])
        yield from _walk(block, (), name in MARKS and owned, None)


def text_runs(xml: str) -> Iterator[tuple]:
    """The rows of RUN_KIND but for the document's id; the texts by seq are the document's text."""
    root, error = parse(xml)
    if error:
        yield (0, *[None] * 9, error)
        return
    seq = at = 0
    for pos, block in enumerate(root):
        for n, (path, text, writable, reason) in enumerate(_pieces(block)):
            gap = [(None, "\n\n", False, None)] if n == 0 and at else []
            for p, t, w, r in [*gap, (path, text, writable, reason)]:
                key = None if p is None else _key(block)
                starts = [at + m.end() for m in re.finditer("\n", t)]
                yield seq, pos, key, None if p is None else "/".join(map(str, p)), at, at + len(t), t, w and key is not None, r, starts, None
                seq, at = seq + 1, at + len(t)


_SPECIAL = re.compile(r"[\\<>()^@=]")


def canonical(node) -> str:
    """A form equal for equal structure and text whatever the ids and revisions; markup in texts is escaped."""
    safe = lambda s: _SPECIAL.sub(r"\\\g<0>", s)
    named = "".join(f" @{safe(k)}={safe(v)}" for k, v in sorted(node.attrib.items()) if k not in VOLATILE)
    inner = "".join(f"({canonical(c)}^{safe(c.tail or '')})" for c in node)
    return f"<{_name(node)}{named}>{safe(node.text or '')}{inner}</{_name(node)}>"


def block_rows(xml: str) -> Iterator[tuple]:
    root, error = parse(xml)
    if error:
        yield (*[None] * 5, error)
        return
    for pos, block in enumerate(root):
        head = bool(HEADING.match(_name(block)))
        yield pos, _key(block), int(_name(block)[1]) if head else None, "".join(block.itertext()) if head else None, canonical(block), None


def _table(docs: DataFrame, read, kind: str) -> DataFrame:
    """The rows that read gives for each document; those of several documents leave a task together, in batches of about
    BATCH_ROWS rows or BATCH_CHARS characters of documents."""
    names = [c.split()[0] for c in kind.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, types[c.split()[1]]) for n, c in zip(names, kind.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0

        def leave() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, xml, *more in zip(*[c.to_pylist() for c in batch.columns]):
                if xml is not None:
                    rows += [(doc_id, *r) for r in read(xml, *more)]
                    chars += len(xml)
                if rows and (len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS):
                    yield leave()
                    chars = 0
        if rows:
            yield leave()

    return docs.mapInArrow(run, kind)


def runs(docs: DataFrame) -> DataFrame:
    """RUN_KIND of documents (doc_id, xml). Every synthetic character is in a run without a path."""
    return _table(docs.select(F.col("doc_id").cast("long"), "xml"), text_runs, RUN_KIND)


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCK_KIND of documents (doc_id, xml): one row for each top-level block."""
    return _table(docs.select(F.col("doc_id").cast("long"), "xml"), block_rows, BLOCK_KIND)


# --- sections ---------------------------------------------------------------------------------------------------------


def placed(given: DataFrame) -> DataFrame:
    """Blocks without an error, each with open_ (the headings it stands under, itself included: level, pos, step), the
    locator of the innermost section and its level. Windows of one document: one shuffle."""
    doc = Window.partitionBy("doc_id").orderBy("pos")
    before, upto = doc.rowsBetween(Window.unboundedPreceding, -1), doc.rowsBetween(Window.unboundedPreceding, 0)
    level, levels = F.col("level"), range(1, 10)
    above = [F.when(level > i, F.max(F.when(level == i, F.col("pos"))).over(before)) for i in levels]
    rows = given.where("error IS NULL").withColumn("parent", F.greatest(F.lit(-1), *above))
    nth = F.row_number().over(Window.partitionBy("doc_id", "parent", "title").orderBy("pos"))
    rows = rows.withColumn("step", F.concat("title", F.lit("["), nth.cast("string"), F.lit("]")))
    latest = {f"h{i}": F.last(F.when(level == i, F.struct("level", "pos", "step")), True).over(upto) for i in levels}
    rows = rows.withColumns(latest)
    still, seen = [], F.lit(-1)
    for i in levels:
        still.append(F.when(F.col(f"h{i}.pos") > seen, F.col(f"h{i}")))
        seen = F.greatest(seen, F.col(f"h{i}.pos"))
    lead = F.array(F.struct(F.lit(0).alias("level"), F.lit(-1).alias("pos"), F.lit(LEAD_IN).alias("step")))
    found = F.array_compact(F.array(*still))
    rows = rows.withColumn("open_", F.when(F.size(found) > 0, found).otherwise(lead))
    return rows.select("doc_id", "pos", "block_id", "level", "title", "canonical", "open_", F.array_join("open_.step", "/").alias("locator"), F.element_at("open_.level", -1).alias("depth"))


def sections(rows: DataFrame) -> DataFrame:
    """doc_id, locator, title, level, first, last (positions of blocks), fingerprint of each section of placed blocks.

    A section reaches to the next heading of its level or a smaller one, so those of parents hold those of children: a
    block counts once for each heading above it, nine at most.
    """
    each = rows.select("doc_id", "pos", "canonical", "title", "locator", F.explode("open_").alias("s"))
    head = F.struct("title", "locator")
    held = each.groupBy("doc_id", F.col("s.pos").alias("at"), F.col("s.level").alias("level")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.max(F.when(F.col("pos") == F.col("s.pos"), head)).alias("head"),
        F.array_sort(F.collect_list(F.struct("pos", "canonical"))).alias("parts"),
    )
    digest = F.concat(F.lit("sha256:"), F.sha2(F.array_join("parts.canonical", ""), 256))
    named = lambda c: F.coalesce(F.col(f"head.{c}"), F.lit(LEAD_IN)).alias(c)
    return held.select("doc_id", named("locator"), named("title"), "level", "first", "last", digest.alias("fingerprint"))


def owners(rows: DataFrame) -> DataFrame:
    """doc_id, block_id, locator, n_blocks: the deepest section that holds a block of this id, of equal ones that with the
    longest locator; null if there are two such. n_blocks counts the blocks of the id."""
    rank = F.struct(F.col("depth"), F.length("locator").alias("size"))
    place = F.struct(F.col("depth"), F.length("locator").alias("size"), F.element_at("open_.pos", -1).alias("at"), F.col("locator"))
    held = rows.where("block_id IS NOT NULL").groupBy("doc_id", "block_id").agg(F.count("*").alias("n_blocks"), F.max(rank).alias("top"), F.collect_set(place).alias("all"))
    best = F.filter("all", lambda p: (p["depth"] == F.col("top.depth")) & (p["size"] == F.col("top.size")))
    return held.withColumn("best", best).select("doc_id", "block_id", F.when(F.size("best") == 1, F.col("best")[0]["locator"]).alias("locator"), "n_blocks")


# --- findings bound to nodes ------------------------------------------------------------------------------------------

#: Characters of a cell by which findings and runs of a document meet.
CELL = 4096


def _cells(start, end):
    return F.explode(F.sequence(F.floor(start / CELL), F.floor((end - 1) / CELL)))


def bind(findings: DataFrame, given: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, finding_id, status, writable, reason, block_id, path, source_start, source_end, locator of each finding
    (doc_id, finding_id, ln, col, found) in the text of runs, by the first of these that holds:

    unmapped (not in the text at its line and column), empty_match, synthetic_span (touches characters of no node or of
    a block without an id), cross_node, source_mismatch (its block's id is another's too), exact with the reason
    table_cell, unsupported_block, duplicate_source (another writable run holds the same words), exact and writable.
    Findings and runs meet by document and cell of CELL characters, not all with all of a document.
    """
    good = given.where("error IS NULL")
    sizes = good.groupBy("doc_id").agg(F.max("end_").alias("size"))
    starts = sizes.select("doc_id", F.lit(0).alias("at")).unionByName(good.select("doc_id", F.explode("line_starts").alias("at")))
    starts = starts.withColumn("ln", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")))
    wanted = findings.select(F.col("doc_id").cast("long").alias("doc_id"), "finding_id", "ln", "col", F.coalesce("found", F.lit("")).alias("found"))
    wanted = wanted.join(starts, ["doc_id", "ln"], "left").join(sizes, "doc_id", "left")
    a = F.when((F.col("col") >= 1) & (F.col("at") + F.col("col") - 1 <= F.col("size")), F.col("at") + F.col("col") - 1)
    wanted = wanted.withColumn("a", a).withColumn("b", F.col("a") + F.length("found")).drop("at", "size", "ln", "col")
    left = wanted.where("a IS NOT NULL AND found <> ''").withColumn("cell", _cells(F.col("a"), F.col("b")))
    right = good.select("doc_id", "seq", "block_id", "path", "start", "end_", "text", "writable", "reason", _cells(F.col("start"), F.col("end_")).alias("cell"))
    low, high = F.greatest("a", "start"), F.least("b", "end_")
    met = left.join(right, ["doc_id", "cell"]).where((low < high) & (F.col("cell") == F.floor(low / CELL)))
    piece = F.struct("seq", F.expr("substring(text, greatest(a, start) - start + 1, least(b, end_) - greatest(a, start))").alias("part"))
    node = F.struct("seq", "block_id", "path", (F.col("a") - F.col("start")).alias("source_start"), (F.col("b") - F.col("start")).alias("source_end"), "writable", "reason")
    over = met.groupBy("doc_id", "finding_id").agg(
        F.array_join(F.array_sort(F.collect_list(piece))["part"], "").alias("stands"), F.count("*").alias("n_runs"), F.min(node).alias("node"),
        F.bool_or(F.col("block_id").isNull() | F.col("path").isNull()).alias("synthetic"), F.collect_set("block_id").alias("ids"),
    )
    rows = wanted.join(over, ["doc_id", "finding_id"], "left").withColumn("one", F.when(F.size("ids") == 1, F.col("ids")[0]))
    rows = rows.join(owned.withColumnRenamed("block_id", "one"), ["doc_id", "one"], "left")
    status = (
        F.when(F.col("a").isNull(), "unmapped").when(F.col("found") == "", "empty_match").when(~F.col("stands").eqNullSafe(F.col("found")), "unmapped")
        .when(F.col("synthetic"), "synthetic_span").when(F.col("n_runs") > 1, "cross_node").when(F.coalesce("n_blocks", F.lit(1)) > 1, "source_mismatch")
        .when(F.col("node.writable"), "exact").when(F.col("node.reason") == "table_cell", "exact").otherwise("unsupported_block")
    )
    rows = rows.withColumn("status", status)
    words = rows.where("status = 'exact' AND node.writable").select("doc_id", "found").distinct()
    holding = words.join(good.where("writable").select("doc_id", "text"), "doc_id").where(F.contains("text", "found"))
    often = holding.groupBy("doc_id", "found").agg(F.count("*").alias("n_holding"))
    rows = rows.join(often, ["doc_id", "found"], "left")
    again = (F.col("status") == "exact") & F.col("node.writable") & (F.col("n_holding") > 1)
    rows = rows.withColumn("status", F.when(again, "duplicate_source").otherwise(F.col("status")))
    writable = F.coalesce((F.col("status") == "exact") & F.col("node.writable"), F.lit(False))
    mapped = F.col("status").isin("exact", "source_mismatch", "unsupported_block", "duplicate_source")
    of_node = [F.when(mapped, F.col(f"node.{c}")).alias(c) for c in ("path", "source_start", "source_end")]
    return rows.select(
        "doc_id", "finding_id", "status", writable.alias("writable"), F.when(writable, None).when(F.col("status") == "exact", "table_cell").otherwise(F.col("status")).alias("reason"),
        F.when(mapped | (F.col("status") == "cross_node"), F.col("one")).alias("block_id"), *of_node, F.when(~F.col("status").isin("unmapped", "empty_match"), F.col("locator")).alias("locator"),
    )


# --- patches ----------------------------------------------------------------------------------------------------------


def patch_failures(patches: DataFrame, plans: DataFrame, given: DataFrame, parts: DataFrame, owned: DataFrame, findings: DataFrame, bound: DataFrame) -> DataFrame:
    """doc_id, patch_id, failure of each patch (doc_id, patch_id, seq, locator, fingerprint, block_id, path, source_start,
    source_end, before, after, rule) of a plan (doc_id, plan_locator, plan_fingerprint); failure is null for a good one.

    A plan's section that is missing, ambiguous or changed fails all its patches; then the first that holds, in the
    order written below. findings (finding_id, rule, found) and bound say what may be patched.
    """
    here = parts.groupBy("doc_id", F.col("locator").alias("plan_locator")).agg(F.count("*").alias("n_sections"), F.min("fingerprint").alias("now"))
    rows = patches.join(plans, "doc_id").join(here, ["doc_id", "plan_locator"], "left")
    rows = rows.join(owned.withColumnRenamed("locator", "owner"), ["doc_id", "block_id"], "left")
    node = given.where("path IS NOT NULL AND block_id IS NOT NULL").groupBy("doc_id", "block_id", "path").agg(F.max("text").alias("text"), F.bool_and("writable").alias("may"))
    rows = rows.join(node, ["doc_id", "block_id", "path"], "left")
    known = bound.where("writable").join(findings.select("doc_id", "finding_id", "rule", F.col("found").alias("before")), ["doc_id", "finding_id"])
    keys = ["doc_id", "block_id", "path", "source_start", "source_end", "rule", "before"]
    rows = rows.join(known.select(*keys).distinct().withColumn("known", F.lit(True)), keys, "left")
    earlier = Window.partitionBy("doc_id", "block_id", "path").orderBy("source_start", "seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("taken", F.max("source_end").over(earlier))
    stands = F.substring(F.col("text"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    failure = (
        F.when(F.col("n_sections").isNull(), "missing_section").when(F.col("n_sections") > 1, "ambiguous_section").when(F.col("now") != F.col("plan_fingerprint"), "section_changed")
        .when(~F.col("locator").eqNullSafe(F.col("plan_locator")), "section_mismatch").when(~F.col("fingerprint").eqNullSafe(F.col("plan_fingerprint")), "fingerprint_mismatch")
        .when((F.coalesce("before", F.lit("")) == "") | F.col("before").eqNullSafe(F.col("after")), "noop_patch").when(F.col("rule").isin(*STRUCTURE_RULES), "unsupported_block")
        .when(~F.coalesce((F.col("source_start") >= 0) & (F.col("source_end") > F.col("source_start")), F.lit(False)), "invalid_offsets")
        .when(~F.col("owner").eqNullSafe(F.col("plan_locator")), "block_outside_section").when(F.col("n_blocks") > 1, "block_not_found")
        .when(~stands.eqNullSafe(F.col("before")), "source_mismatch").when(~F.col("may"), "unsupported_block").when(F.col("known").isNull(), "finding_mismatch")
        .when(F.col("taken") > F.col("source_start"), "overlapping_patches")
    )
    return rows.select("doc_id", "patch_id", failure.alias("failure"))


def _put_in(xml: str, edits: list[dict], first: int, last: int) -> Iterator[tuple]:
    root, error = parse(xml)
    if error:
        return
    by_block: dict[str, list[dict]] = {}
    for e in sorted(edits, key=lambda e: e["seq"]):
        by_block.setdefault(e["block_id"], []).append(e)
    where, prints = {_key(b): b for b in root}, []
    for key, group in by_block.items():
        for e in sorted(group, key=lambda e: -e["source_start"]):
            node, steps = where[key], [int(s) for s in e["path"].split("/") if s]
            for s in steps:
                node = node if s < 0 else node[s]
            part = "tail" if steps[-1:] == [-1] else "text"
            old = getattr(node, part)
            setattr(node, part, old[: e["source_start"]] + e["after"] + old[e["source_end"] :])
        prints.append("sha256:" + sha256("".join(map(canonical, root[first : last + 1])).encode()).hexdigest())
    yield escape(root.text or "") + "".join(ElementTree.tostring(b, encoding="unicode") for b in root), prints


def patched(docs: DataFrame, patches: DataFrame, plans: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, revised, fingerprints: documents (doc_id, xml) with patches that passed, put in block by block in the order
    of seq and from right to left in a block, and the plan's section's fingerprint after each block. Only texts of nodes
    change, so tags, attributes and positions stay. The patches of one document are gathered into its row."""
    span = plans.select("doc_id", F.col("plan_locator").alias("locator")).join(parts, ["doc_id", "locator"]).select("doc_id", "first", "last")
    edits = patches.groupBy("doc_id").agg(F.collect_list(F.struct("seq", "block_id", "path", "source_start", "source_end", "after")).alias("edits"))
    rows = docs.select(F.col("doc_id").cast("long"), "xml").join(edits, "doc_id").join(span, "doc_id")
    return _table(rows.select("doc_id", "xml", "edits", "first", "last"), _put_in, PATCHED_KIND)


def fingerprint_failures(derived: DataFrame, plans: DataFrame) -> DataFrame:
    """doc_id, failure: whether a plan's expected fingerprints are as many as the blocks written, none empty, and equal."""
    rows = derived.join(plans, "doc_id")
    many = (F.size("expected") != F.size("fingerprints")) | F.exists("expected", lambda x: F.coalesce(x, F.lit("")) == "")
    failure = F.when(F.coalesce(many, F.lit(True)), "expected_fingerprints_mismatch").when(F.col("expected") != F.col("fingerprints"), "expected_fingerprint_mismatch")
    return rows.select("doc_id", failure.alias("failure"))


def remapped(patches: DataFrame, given: DataFrame, parts: DataFrame, owned: DataFrame) -> DataFrame:
    """doc_id, patch_id, block_id, failure of patches (doc_id, patch_id, locator, path, source_start, source_end, before)
    whose block ids are stale, in a later state of their documents.

    The new block is the only one of the patch's section that has the words at the path and offsets; the words are never
    searched for. Joined by document and path. A block's id has to be its alone. failure: missing_section,
    ambiguous_section, remap_failed, block_outside_section (a deeper section owns it), or null.
    """
    span = parts.groupBy("doc_id", "locator").agg(F.count("*").alias("n_sections"), F.min("first").alias("first"), F.max("last").alias("last"))
    single = owned.where("n_blocks = 1").select("doc_id", "block_id", F.col("locator").alias("owner"))
    nodes = given.where("path IS NOT NULL AND block_id IS NOT NULL").join(single, ["doc_id", "block_id"]).select("doc_id", "path", "pos", "text", "block_id", "owner")
    asked = patches.select("doc_id", "patch_id", "locator", "path", "source_start", "source_end", "before").join(span, ["doc_id", "locator"], "left")
    stands = F.expr("substring(text, source_start + 1, source_end - source_start) = before AND source_start >= 0 AND pos BETWEEN first AND last")
    held = asked.join(nodes, ["doc_id", "path"]).where(stands).groupBy("doc_id", "patch_id").agg(F.count("*").alias("n"), F.min("block_id").alias("block_id"), F.min("owner").alias("owner"))
    out = asked.join(held, ["doc_id", "patch_id"], "left")
    failure = (
        F.when(F.col("n_sections").isNull(), "missing_section").when(F.col("n_sections") > 1, "ambiguous_section").when(F.coalesce("n", F.lit(0)) != 1, "remap_failed")
        .when(~F.col("owner").eqNullSafe(F.col("locator")), "block_outside_section")
    )
    return out.withColumn("failure", failure).select("doc_id", "patch_id", F.when(F.col("failure").isNull(), F.col("block_id")).alias("block_id"), "failure")
