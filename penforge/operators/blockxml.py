"""Block XML: a document's blocks as text with spans that say where each block stands and whether it may be written.

Headings, list items, quotes, paragraphs and tables are read; blocks are two line feeds apart, empty ones are left out.
A document type or entity declaration is refused, since an expansion could grow without bound: such a document, and one
that isn't well formed, gives one row with an error. A null document gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

#: Resources that are no prose, and metadata.
EXCLUDED, OMITTED = frozenset({"pre", "code", "grid", "img"}), frozenset({"title", "synced_reference", "synced_source"})
KIND = "doc_id long, seq int, block_id string, kind string, start int, end_ int, text string, writable boolean, error string"
NAMES = [c.split()[0] for c in KIND.split(", ")]


def _name(node) -> str:
    return node.tag.rsplit("}", 1)[-1].lower() if isinstance(node.tag, str) else ""


def _inline(node) -> str:
    out = [node.text or ""]
    for child in node:
        if (name := _name(child)) == "br":
            out.append("\n")
        elif name and name not in OMITTED and name not in EXCLUDED:
            out.append(_inline(child))
        out.append(child.tail or "")
    return "".join(out)


def _blocks(node) -> Iterator[tuple[str | None, str, str, str, bool]]:
    """(block id, kind, prefix, text, writable)."""
    for child in node:
        name = _name(child)
        if not name or name in OMITTED or name in EXCLUDED:
            continue
        key = child.get("id") or child.get("block-id") or child.get("block_id")
        if name in ("ol", "ul"):
            for n, item in enumerate((x for x in child if _name(x) == "li"), 1):
                own = item.get("id") or item.get("block-id") or item.get("block_id")
                yield own, "list_item", f"{n}. " if name == "ol" else "- ", _inline(item), own is not None
        elif name == "table":
            for row in (x for x in child.iter() if _name(x) == "tr"):
                cells = [_inline(c).strip() for c in row if _name(c) in ("td", "th")]
                if any(cells):
                    yield key, "table_row", "", "| " + " | ".join(cells) + " |", False
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456789":
            yield key, "heading", "#" * int(name[1]) + " ", _inline(child), False
        elif name in ("li", "checkbox"):
            yield key, "list_item", "- ", _inline(child), key is not None
        elif name == "blockquote":
            yield key, "blockquote", "> ", _inline(child), key is not None
        else:
            yield key, "paragraph", "", _inline(child), key is not None and name in ("p", "callout")


def project(xml: str) -> list[tuple]:
    """(seq, block_id, kind, start, end, text, writable, error); places are of code points, without the prefix."""
    if any(x in xml.upper() for x in ("<!DOCTYPE", "<!ENTITY")):
        return [(0, None, None, None, None, None, None, "declaration")]
    try:
        root = ElementTree.fromstring(f"<document>{xml}</document>")
    except ElementTree.ParseError:
        return [(0, None, None, None, None, None, None, "not well formed")]
    out, at = [], 0
    for key, kind, prefix, text, writable in _blocks(root):
        if text.strip():
            start = at + len(prefix)
            out.append((len(out), key, kind, start, start + len(text), text, writable, None))
            at = start + len(text) + 2
    return out


def spans(docs: DataFrame) -> DataFrame:
    """The rows of KIND for each document (doc_id, xml)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = [(doc_id, *r) for r in project(xml)] if xml is not None else []
                if rows:
                    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], NAMES)

    return docs.select("doc_id", "xml").mapInArrow(run, KIND)
