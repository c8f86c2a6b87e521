"""Answers that arrive in pieces: a preview of an unfinished JSON string, and the events of a response stream."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, functions as F

#: What of an answer a preview looks at, and shows; characters of an unfinished end that are left out.
PREVIEW_FROM, PREVIEW_CHARS, PREVIEW_CUT = 6_000, 500, 6
#: Bytes of a response, places of tool calls, ends that count.
MOST_BYTES, MOST_TOOLS, ENDS = 4 * 1024 * 1024, 32, ("stop", "tool_calls")


def summary_preview(content: Column) -> Column:
    """The decoded part of the string `summary` in an answer that may break off anywhere; an unfinished escape waits
    for its rest. '' where there is none yet, or where more than an unfinished end can't be decoded."""
    rest = F.regexp_extract(F.substring(content, 1, PREVIEW_FROM), r'(?s)"summary"\s*:\s*"(.*)', 1)
    # where the string ends: at a quote that isn't escaped, or before a backslash that has nothing after it
    plain = F.regexp_replace(rest, r"(?s)\\.", "..")
    end = F.when(F.contains(plain, F.lit('"')), F.instr(plain, '"') - 1).otherwise(F.char_length(plain) - plain.endswith("\\").cast("int"))
    value = F.substring(rest, F.lit(1), end)
    # no expression repeats a group here: long texts would be a long way down its recursion
    tokens = F.regexp_extract_all(value, F.lit(r'(?s)\\u[0-9a-fA-F]{4}|\\["\\/bfnrt]|[^\\\x00-\x1f]+|.'), F.lit(0))
    bad = F.array_position(F.transform(tokens, lambda t: t.rlike(r"(?s)\A[\\\x00-\x1f]\z")), F.lit(True)).cast("int")
    whole = F.array_join(F.when(bad > 0, F.slice(tokens, F.lit(1), bad - 1)).otherwise(tokens), "")
    decoded = F.get_json_object(F.concat(F.lit('{"s":"'), whole, F.lit('"}')), "$.s")
    return F.when(F.char_length(value) - F.char_length(whole) > PREVIEW_CUT, "").otherwise(F.coalesce(F.substring(decoded, 1, PREVIEW_CHARS), F.lit("")))


class BadAnswer(Exception):
    """Its text is one of the statuses malformed, truncated, too_large, not_utf8."""


class Reassembly:
    """The events of one response, fed with bytes that may be cut anywhere: inside a line, an escape or a character.

    Lines that begin with `data:` are gathered until an empty line; together they are one event, a JSON object or
    [DONE]. Only what is needed to go on is kept, at most MOST_BYTES, and it can be stored (state) and taken up again.
    """

    def __init__(self, state: dict[str, Any] | None = None):
        self.s = state or {"rest": b"", "bytes": 0, "data": [], "content": "", "tools": {}, "status": "open"}

    @property
    def over(self) -> bool:
        return self.s["status"] not in ("open", "finished")

    def feed(self, piece: bytes) -> None:
        s = self.s
        if self.over:
            return
        *lines, s["rest"] = (s["rest"] + piece).split(b"\n")
        try:
            for line in lines:
                self._line(line + b"\n")
                if self.over:
                    return
            if s["bytes"] + len(s["rest"]) > MOST_BYTES:
                raise BadAnswer("too_large")
        except BadAnswer as e:
            s["status"] = str(e)

    def end(self) -> None:
        """No more will come."""
        s = self.s
        if self.over:
            return
        try:
            if s["rest"]:
                self._line(s["rest"])
            if s["data"] and not self.over:
                self._event("\n".join(s["data"]))
        except BadAnswer as e:
            s["status"] = str(e)
        s["status"] = {"open": "interrupted", "finished": "done"}.get(s["status"], s["status"])

    def _line(self, line: bytes) -> None:
        s = self.s
        s["bytes"] += len(line)
        if s["bytes"] > MOST_BYTES:
            raise BadAnswer("too_large")
        try:
            text = line.decode().rstrip("\r\n")
        except UnicodeDecodeError:
            raise BadAnswer("not_utf8") from None
        if text.startswith("data:"):
            s["data"].append(text[5:].lstrip(" "))
        elif not text and s["data"]:
            data, s["data"] = "\n".join(s["data"]), []
            self._event(data)

    def _event(self, data: str) -> None:
        s = self.s
        if data == "[DONE]":
            s["status"] = "done"
            return
        try:
            chunk = json.loads(data)
            choices = chunk.get("choices", [])
            if not isinstance(choices, list) or not choices and "error" in chunk:
                raise BadAnswer("malformed")
            if not choices:
                return
            delta, end = choices[0].get("delta", {}), choices[0].get("finish_reason")
            s["content"] += _text(delta.get("content"))
            for tool in delta.get("tool_calls") or []:
                at = tool.get("index")
                if type(at) is not int or not 0 <= at < MOST_TOOLS:
                    raise BadAnswer("malformed")
                call, given = s["tools"].setdefault(at, {"id": "", "name": "", "arguments": ""}), tool.get("function") or {}
                for key, more in (("id", tool.get("id") or None), ("name", given.get("name")), ("arguments", given.get("arguments"))):
                    call[key] += _text(more)
        except (ValueError, TypeError, AttributeError, KeyError, IndexError):
            raise BadAnswer("malformed") from None
        if end is not None:
            if end not in ENDS:
                raise BadAnswer("truncated")
            s["status"] = "finished"  # but the rest is read, and may still be bad

    def row(self) -> tuple[str, str | None, list[dict]]:
        """(status, content, tool calls in order); only a finished answer has content."""
        s = self.s
        good = s["status"] == "done"
        return s["status"], s["content"] if good else None, [{"index": i, **s["tools"][i]} for i in sorted(s["tools"])] if good else []


def _text(value: Any) -> str:
    if value is not None and not isinstance(value, str):
        raise BadAnswer("malformed")
    return value or ""
