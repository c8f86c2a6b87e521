"""Revisions: minimal patches, the context of a change, and diffs, over tables of texts before and after."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.graphemes import clusters, continued, first_whole, last_whole

#: Edits and steps after which a diff gives up and replaces what lies between.
MOST_EDITS, MOST_STEPS = 256, 1_000_000
#: Fixed value: clusters of context on either side of a change.
RADIUS = 70


# --- minimal patches ---------------------------------------------------------------------------------------------------


#: Enough for a text of any length.
_STEPS = [1 << k for k in range(30, -1, -1)]


def _alike(piece: Callable[[str, Column, Column], Column], most: Column) -> Column:
    """How many characters, at most `most`, two texts have in common from one side: what is alike grows by the longest
    steps first. piece(text, n, m) are the m characters after n from that side."""
    longer = lambda n, m: F.when((m <= most - n) & (piece("b", n, m) == piece("a", n, m)), n + m).otherwise(n)
    return F.aggregate(F.lit(_STEPS), F.lit(0), longer)


def minimal_patches(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, start, before, after: what is left of texts (before, after) without the context that they share, so that
    edits at other places of a line can stand beside it. No patch begins or ends inside a character. start counts code
    points from 0; equal texts give an empty patch; a null text gives nulls."""
    own = pairs.select(*keys, F.col("before").alias("b"), F.col("after").alias("a"))
    own = own.withColumns({"nb": F.char_length("b"), "na": F.char_length("a")})
    own = own.withColumn("p", _alike(lambda x, n, m: F.substring(F.col(x), n + 1, m), F.least("nb", "na")))
    inside = continued(F.col("b"), F.col("p")) | continued(F.col("a"), F.col("p"))
    shared = F.substring("b", 1, F.col("p"))
    own = own.withColumn("p", F.when(inside, F.col("p") - last_whole(shared)).otherwise(F.col("p")))
    own = own.withColumn("s", _alike(lambda x, n, m: F.substring(F.col(x), F.col("n" + x) - n - m + 1, m), F.least("nb", "na") - F.col("p")))
    inside = (F.col("s") > 0) & (continued(F.col("b"), F.col("nb") - F.col("s")) | continued(F.col("a"), F.col("na") - F.col("s")))
    shared = F.substring(F.col("b"), F.col("nb") - F.col("s") + 1, F.col("s"))
    own = own.withColumn("s", F.when(inside, F.col("s") - first_whole(shared)).otherwise(F.col("s")))
    rest = lambda x, n: F.substring(F.col(x), F.col("p") + 1, F.col(n) - F.col("p") - F.col("s"))
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    return own.select(*keys, *[F.when(both, c).alias(n) for n, c in (("start", F.col("p")), ("before", rest("b", "nb")), ("after", rest("a", "na")))])


def patched(text: Column, start: Column, before: Column, after: Column) -> Column:
    """text with `after` in place of `before` at `start`."""
    end = start + F.char_length(before)
    return F.concat(F.substring(text, F.lit(1), start), after, F.substring(text, end + 1, F.char_length(text)))


# --- context -----------------------------------------------------------------------------------------------------------


def change_context(changes: DataFrame, *keys: str, radius: int = RADIUS) -> DataFrame:
    """keys, error, before, focus, after, line, column, end_line, clipped_before, clipped_after of changes (source,
    before, source_start). Context and columns are counted in clusters, source_start in code points from 0.

    Without a start the first occurrence counts; where there is none, only `focus` is filled. A start outside the text
    or not before `before` is an error, not a place.
    """
    source, text, given = F.col("source"), F.col("before"), F.col("source_start")
    found = F.when(text == "", 0).otherwise(F.expr("instr(source, before)") - 1)
    error = F.when((given < 0) | (given > F.char_length(source)), "invalid").when(F.substring(source, given + 1, F.char_length(text)) != text, "mismatch")
    rows = changes.withColumn("error", F.when(given.isNotNull(), error))
    rows = rows.withColumn("at", F.when(F.col("error").isNotNull(), -1).otherwise(F.coalesce(given, found)))
    placed = F.col("at") >= 0
    end = F.col("at") + F.char_length(text)
    rows = rows.withColumns({"lead": F.substring(source, F.lit(1), F.greatest(F.col("at"), F.lit(0))), "trail": F.substring(source, end + 1, F.char_length(source)), "upto": F.substring(source, F.lit(1), end)})
    rows = rows.withColumns({"lead_c": clusters(F.col("lead")), "trail_c": clusters(F.col("trail"))})
    lines = lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit(""))) + 1
    last = F.element_at(F.split("lead", "\n", -1), -1)
    n = F.size("lead_c")
    kept = lambda x: F.when(placed, x)
    context = {
        "before": F.array_join(F.slice("lead_c", F.greatest(n - radius + 1, F.lit(1)), F.lit(radius)), ""),
        "after": F.array_join(F.slice("trail_c", 1, radius), ""),
    }
    return rows.select(
        *keys, "error", F.when(placed, context["before"]).otherwise("").alias("before"), text.alias("focus"), F.when(placed, context["after"]).otherwise("").alias("after"),
        kept(lines(F.col("lead"))).alias("line"), kept(F.size(clusters(last)) + 1).alias("column"), kept(lines(F.col("upto"))).alias("end_line"),
        kept(n > radius).alias("clipped_before"), kept(F.size("trail_c") > radius).alias("clipped_after"),
    )


# --- diffs -------------------------------------------------------------------------------------------------------------

Part = tuple[str, str]  # (equal, delete or insert; text)
_CLUSTER = regex.compile(r"\X")
_LINE = regex.compile(r"[^\n]*\n|[^\n]+\Z")


def shortest_edits(a: list[str], b: list[str]) -> list[Part] | None:
    """The path of the greedy O(ND) search. None where it takes more edits or steps than allowed.

    d edits cost d * d / 2 steps at least, and what the two don't have in common must all be edited. So a search that is
    bound to give up isn't begun, and where a table of all places is smaller than the search, it gives the same path."""
    least = len(a) + len(b) - 2 * sum((Counter(a) & Counter(b)).values())
    if least > MOST_EDITS:
        return None
    cells = len(a) * len(b)
    small = cells < least * least // 2 and cells + (MOST_EDITS + 1) * (MOST_EDITS + 2) // 2 <= MOST_STEPS
    return _edits_by_table(a, b) if small else _edits_by_rounds(a, b)


def _edits_by_rounds(a: list[str], b: list[str]) -> list[Part] | None:
    """furthest[k] is how far in `a` the paths of d edits get on diagonal k, and each round is kept, so that the path can
    be walked back."""
    furthest, rounds, steps = {1: 0}, [], 0
    for d in range(min(len(a) + len(b), MOST_EDITS) + 1):
        rounds.append(dict(furthest))
        for k in range(-d, d + 1, 2):
            insert = _inserts(furthest, k, d)
            x = furthest[k + 1] if insert else furthest[k - 1] + 1
            begun, y = x, x - k
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            steps += 1 + x - begun
            if steps > MOST_STEPS:
                return None
            furthest[k] = x
            if x >= len(a) and y >= len(b):
                return _walked_back(a, b, rounds)
    return None


def _edits_by_table(a: list[str], b: list[str]) -> list[Part] | None:
    """The path of the greedy search from the edits that each place (x, y) takes. How far in `a` d edits get on a
    diagonal is its last place with at most d; no place of the path looks at one outside the table."""
    table = [list(range(len(b) + 1))]
    for n, item in enumerate(a, 1):
        above, row, left = table[-1], [n], n
        for y, other in enumerate(b):
            left = above[y] if item == other else 1 + min(left, above[y + 1])
            row.append(left)
        table.append(row)
    x, y = len(a), len(b)
    if table[x][y] > MOST_EDITS:
        return None

    def furthest(x: int, y: int, d: int) -> int:
        """Of the places up to (x, y) on its diagonal, the last one that d edits reach."""
        while x >= 0 and y >= 0 and table[x][y] > d:
            x, y = x - 1, y - 1
        return x if y >= 0 else -1

    out: list[Part] = []
    for d in range(table[x][y], 0, -1):
        k = x - y
        near = {k - 1: furthest(x - 1, y, d - 1), k + 1: furthest(x, y - 1, d - 1)}
        insert = _inserts(near, k, d)
        to_x = near[k + 1 if insert else k - 1]
        run = min(x - to_x, y - (to_x - (k + 1 if insert else k - 1)))
        out += [("equal", t) for t in reversed(a[x - run : x])]
        x, y = x - run, y - run
        if insert:
            y -= 1
            out.append(("insert", b[y]))
        else:
            x -= 1
            out.append(("delete", a[x]))
    out += [("equal", t) for t in reversed(a[:x])]
    return out[::-1]


def _inserts(furthest: dict[int, int], k: int, d: int) -> bool:
    """Whether the d-th edit on the way to diagonal k is an insertion; of equal ways the deletion is taken."""
    return k == -d or k != d and furthest[k - 1] < furthest[k + 1]


def _walked_back(a: list[str], b: list[str], rounds: list[dict[int, int]]) -> list[Part]:
    out: list[Part] = []
    x, y = len(a), len(b)
    for d in range(len(rounds) - 1, 0, -1):
        insert = _inserts(rounds[d], x - y, d)
        before = x - y + 1 if insert else x - y - 1
        to_x = rounds[d][before]
        to_y = to_x - before
        # the run of equal items that ends here began after the edit
        run = min(x - to_x, y - to_y)
        out += [("equal", t) for t in reversed(a[x - run : x])]
        x, y = x - run, y - run
        if insert:
            y -= 1
            out.append(("insert", b[y]))
        else:
            x -= 1
            out.append(("delete", a[x]))
    out += [("equal", t) for t in reversed(a[:x])]
    return out[::-1]


def diff(left: list[str], right: list[str]) -> list[Part]:
    """Parts that give left without the insertions and right without the deletions. What both begin and end with is
    taken off first; where the search gives up, all that lies between is one deletion and one insertion."""
    n = min(len(left), len(right))
    head = next((i for i in range(n) if left[i] != right[i]), n)
    tail = next((i for i in range(n - head) if left[-1 - i] != right[-1 - i]), n - head)
    a, b = left[head : len(left) - tail], right[head : len(right) - tail]
    edits = shortest_edits(a, b)
    between = [("delete", "".join(a)), ("insert", "".join(b))] if edits is None else edits
    out: list[Part] = []
    for kind, text in [("equal", "".join(left[:head])), *between, ("equal", "".join(left[len(left) - tail :]))]:
        if text and out and out[-1][0] == kind:
            out[-1] = kind, out[-1][1] + text
        elif text:
            out.append((kind, text))
    return out


def _rows_of(parts: list[Part], without: str) -> list[list[Part]]:
    """The parts of one side of a hunk by line."""
    rows: list[list[Part]] = [[]]
    for kind, text in parts:
        if kind != without:
            for i, piece in enumerate(text.split("\n")):
                if i:
                    rows.append([])
                if piece:
                    rows[-1].append((kind, piece))
    return rows if rows[-1] else rows[:-1]


def diff_rows(before: str, after: str, first: int = 1) -> Iterator[tuple[str, int | None, int | None, list[Part]]]:
    """(kind, old line, new line, parts): lines that stay appear once; of each hunk the deleted rows come before the
    inserted ones, with what changed inside them marked by cluster."""
    old = new = first
    blocks = diff(_LINE.findall(before), _LINE.findall(after))
    at = 0
    while at < len(blocks):
        if blocks[at][0] == "equal":
            for line in _LINE.findall(blocks[at][1]):
                yield "equal", old, new, [("equal", line.removesuffix("\n"))]
                old, new = old + 1, new + 1
            at += 1
            continue
        sides = {"delete": "", "insert": ""}
        while at < len(blocks) and blocks[at][0] != "equal":
            sides[blocks[at][0]] += blocks[at][1]
            at += 1
        parts = diff(_CLUSTER.findall(sides["delete"]), _CLUSTER.findall(sides["insert"]))
        for row in _rows_of(parts, "insert"):
            yield "delete", old, None, row
            old += 1
        for row in _rows_of(parts, "delete"):
            yield "insert", None, new, row
            new += 1


_PARTS = "array<struct<kind: string, text: string>>"
DIFF_KIND = f"row int, kind string, old_line int, new_line int, parts {_PARTS}"


def revision_diff(pairs: DataFrame, key: str) -> DataFrame:
    """key, row, kind, old_line, new_line, parts: unified rows of texts (before, after); null texts count as empty.
    A pair is worked on where it is; rows leave a task in batches, so a long diff isn't held."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
        types = [pa.int32(), pa.string(), pa.int32(), pa.int32(), parts]
        for batch in batches:
            for i, (before, after) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                rows = [(n, k, o, w, [{"kind": c, "text": t} for c, t in p]) for n, (k, o, w, p) in enumerate(diff_rows(before, after))]
                for some in (rows[j : j + 10_000] for j in range(0, len(rows), 10_000)):
                    columns = [pa.array(c, t) for c, t in zip(zip(*some), types)]
                    keys = batch.column(0).take(pa.array([i] * len(some), pa.int32()))
                    yield pa.record_batch([keys, *columns], [key, "row", "kind", "old_line", "new_line", "parts"])

    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return pairs.select(key, text("before").alias("before"), text("after").alias("after")).mapInArrow(run, f"{key} {kind}, {DIFF_KIND}")
