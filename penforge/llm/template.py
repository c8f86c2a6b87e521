"""A small template language, compiled: parsed into a syntax tree, folded where constant, turned into closures.

    {{ expression }}   {# comment #}   {% set name = expression %}
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% for name in expression %} {% endfor %}, with loop.first, loop.last, loop.index, loop.index0
    {% generation %} {% endgeneration %}: what a model is to learn to say

A dash inside a tag takes the white space beside it. Expressions: texts, whole numbers, true, false, none, names,
a.key and a['key'], + - * // %, ~ (joins as text), comparisons, in, not, and, or, `x if c else y`, and x | filter.

The language is a sandbox: an attribute is only ever a key of a mapping, a filter only one of those given, a loop only
over a list, and * only of numbers, so a template can neither reach Python nor grow its output but by its loops.
Unknown names and keys are none; none prints as nothing. Anything else that doesn't fit is a TemplateError.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

Scope = dict[str, Any]
Parts = list[tuple[str, bool]]  # (text, whether a model is to say it)


class TemplateError(ValueError):
    pass


class Node(NamedTuple):
    kind: str
    value: Any = None
    children: tuple = ()


_TAG = re.compile(r"\{([{%#])(-?)(.*?)(-?)([}%#])\}", re.S)
_CLOSING = {"{": "}", "%": "%", "#": "#"}
_TOKEN = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(//|==|!=|<=|>=|[-+*%~<>()\[\].|,]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_KEYWORDS = {"if", "else", "and", "or", "not", "in"}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        number, text, name, sign = m.groups()
        if number:
            out.append(("const", int(number)))
        elif text:
            out.append(("const", re.sub(r"(?s)\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1])))
        elif name in _WORDS:
            out.append(("const", _WORDS[name]))
        elif name:
            out.append(("word" if name in _KEYWORDS else "name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return [*out, ("end", None)]


#: Two-sided operators from the loosest to the tightest.
_LEVELS = [{"or"}, {"and"}, {"not"}, {"==", "!=", "<", "<=", ">", ">=", "in"}, {"~"}, {"+", "-"}, {"*", "//", "%"}]


class _Reader:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.items, self.at, self.filters = _tokens(source), 0, filters

    def take(self, *values: str) -> str | None:
        kind, value = self.items[self.at]
        if kind in ("word", "sign") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        kind, value = self.items[self.at]
        if kind != "name":
            raise TemplateError(f"a name is missing before {value!r}")
        self.at += 1
        return value

    def whole(self) -> Node:
        node = self.choice()
        if self.items[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.level(0)
        if self.take("if"):
            condition = self.level(0)
            self.need("else")
            node = Node("choice", None, (condition, node, self.choice()))
        return node

    def level(self, n: int) -> Node:
        if n == len(_LEVELS):
            return self.filtered()
        if _LEVELS[n] == {"not"}:
            return Node("not", None, (self.level(n),)) if self.take("not") else self.level(n + 1)
        node = self.level(n + 1)
        while sign := self.take(*_LEVELS[n]):
            node = Node("binary", sign, (node, self.level(n + 1)))
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            name, given = self.name(), []
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    given.append(self.choice())
                    if not self.take(","):
                        self.need(")")
                        break
            node = Node("filter", name, (node, *given))
        return node

    def reached(self) -> Node:
        if self.take("("):
            node = self.choice()
            self.need(")")
        elif self.take("-"):
            return Node("binary", "-", (Node("const", 0), self.reached()))
        elif self.items[self.at][0] == "const":
            node = Node("const", self.items[self.at][1])
            self.at += 1
        else:
            node = Node("name", self.name())
        while True:
            if self.take("."):
                node = Node("key", None, (node, Node("const", self.name())))
            elif self.take("["):
                node = Node("key", None, (node, self.choice()))
                self.need("]")
            else:
                return node


def parse(source: str, filters: dict[str, Callable]) -> Node:
    """The syntax tree; its root is a block."""
    blocks: list[tuple[str, Any, list[Node]]] = [("root", None, [])]
    at, bare = 0, False  # bare: white space at the start of the next text goes

    def text(piece: str, to_end: bool) -> None:
        piece = piece.lstrip() if bare else piece
        piece = piece.rstrip() if to_end else piece
        if piece:
            blocks[-1][2].append(Node("text", piece))

    def close(*kinds: str) -> tuple[str, Any, list[Node]]:
        if blocks[-1][0] not in kinds:
            raise TemplateError(f"end of {' or '.join(kinds)} within {blocks[-1][0]}")
        return blocks.pop()

    def branch_closed(kind: str, value: Any, body: list[Node]) -> Node:
        """value of a branch: the conditions and bodies before it, and its own condition (none for else)."""
        before, condition = value
        return Node("if", None, (*before, condition or Node("const", True), Node("block", None, tuple(body))))

    for m in _TAG.finditer(source):
        opened, left, inner, right, closed = m.groups()
        if _CLOSING[opened] != closed:
            raise TemplateError(f"unfinished tag {m[0]!r}")
        text(source[at : m.start()], bool(left))
        at, bare = m.end(), bool(right)
        if opened == "{":
            blocks[-1][2].append(Node("print", None, (_Reader(inner, filters).whole(),)))
        elif opened == "%":
            word, _, rest = inner.strip().partition(" ")
            target, _, value = rest.partition("=") if word == "set" else ("", "", rest)
            read = _Reader(value, filters)
            if word == "set":
                blocks[-1][2].append(Node("set", _Reader(target, filters).name(), (read.whole(),)))
            elif word == "if":
                blocks.append(("if", ((), read.whole()), []))
            elif word in ("elif", "else"):
                _, (before, condition), body = close("if")
                blocks.append(("if" if word == "elif" else "else", ((*before, condition, Node("block", None, tuple(body))), read.whole() if word == "elif" else None), []))
            elif word == "endif":
                node = branch_closed(*close("if", "else"))
                blocks[-1][2].append(node)
            elif word == "for":
                target = read.name()
                read.need("in")
                blocks.append(("for", (target, read.whole()), []))
            elif word == "endfor":
                _, (target, over), body = close("for")
                blocks[-1][2].append(Node("for", target, (over, Node("block", None, tuple(body)))))
            elif word == "generation":
                if any(b[0] == "generation" for b in blocks):
                    raise TemplateError("generation within generation")
                blocks.append(("generation", None, []))
            elif word == "endgeneration":
                _, _, body = close("generation")
                blocks[-1][2].append(Node("generation", None, (Node("block", None, tuple(body)),)))
            else:
                raise TemplateError(f"no tag {word!r}")
    if re.search(r"\{[{%#]", source[at:]):
        raise TemplateError("unfinished tag")
    text(source[at:], False)
    if len(blocks) > 1:
        raise TemplateError(f"{blocks[-1][0]} isn't closed")
    return Node("block", None, tuple(blocks[0][2]))


def _binary(sign: str, a: Any, b: Any) -> Any:
    if sign == "~":
        return shown(a) + shown(b)
    if sign in ("==", "!="):
        return (a == b) == (sign == "==")
    try:
        if sign == "in":
            return a in b
        if sign in ("<", "<=", ">", ">="):
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[sign]
        if sign == "+" and isinstance(a, str) and isinstance(b, str):
            return a + b
        if isinstance(a, int) and isinstance(b, int):
            return {"+": int.__add__, "-": int.__sub__, "*": int.__mul__, "//": int.__floordiv__, "%": int.__mod__}[sign](a, b)
    except (TypeError, ZeroDivisionError) as e:
        raise TemplateError(f"{sign}: {e}") from e
    raise TemplateError(f"{sign} doesn't fit {type(a).__name__} and {type(b).__name__}")


def shown(value: Any) -> str:
    if isinstance(value, str):
        return value
    if value is None:
        return ""
    if isinstance(value, (bool, int)):
        return str(value)
    raise TemplateError(f"{type(value).__name__} can't be printed")


def _key(held: Any, key: Any) -> Any:
    if isinstance(held, dict):
        return held.get(key)
    if isinstance(held, list) and isinstance(key, int):
        return held[key] if -len(held) <= key < len(held) else None
    if held is None:
        return None
    raise TemplateError(f"{type(held).__name__} has no keys")


def fold(node: Node, filters: dict[str, Callable]) -> Node:
    """The same tree with what doesn't depend on names computed: constant expressions, branches that are always or
    never taken, printed constants and texts side by side."""
    children = tuple(fold(c, filters) for c in node.children)
    node = Node(node.kind, node.value, children)
    fixed = all(c.kind == "const" for c in children)
    if node.kind in ("binary", "not", "key", "choice", "filter") and fixed:
        try:
            return Node("const", _value(node, filters)({}))
        except TemplateError:
            return node  # an error only where it is reached
    if node.kind == "choice" and children[0].kind == "const":
        return children[1] if children[0].value else children[2]
    if node.kind == "binary" and node.value in ("and", "or") and children[0].kind == "const":
        return children[1] if bool(children[0].value) == (node.value == "and") else children[0]
    if node.kind == "print" and fixed and isinstance(children[0].value, (str, int, type(None))):
        return Node("text", shown(children[0].value))
    if node.kind == "if":
        kept: list[Node] = []
        for condition, body in zip(children[::2], children[1::2]):
            if condition.kind == "const" and not condition.value:
                continue
            kept += [condition, body]
            if condition.kind == "const":
                break
        if kept and kept[0].kind == "const":
            return kept[1]
        return Node("if", None, tuple(kept)) if kept else Node("block")
    if node.kind == "block":
        flat: list[Node] = []
        for c in (y for x in children for y in (x.children if x.kind == "block" else (x,))):
            if c.kind == "text" and flat and flat[-1].kind == "text":
                flat[-1] = Node("text", flat[-1].value + c.value)
            elif c != Node("text", ""):
                flat.append(c)
        return Node("block", None, tuple(flat))
    return node


def _value(node: Node, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    """A closure that computes an expression."""
    value = node.value
    if node.kind == "const":
        return lambda scope: value
    if node.kind == "name":
        return lambda scope: scope.get(value)
    parts = [_value(c, filters) for c in node.children]
    if node.kind == "not":
        return lambda scope: not parts[0](scope)
    if node.kind == "choice":
        condition, yes, no = parts
        return lambda scope: yes(scope) if condition(scope) else no(scope)
    if node.kind == "filter":
        return _guarded(value, filters[value], parts)
    a, b = parts
    if node.kind == "key":
        return lambda scope: _key(a(scope), b(scope))
    if value == "and":
        return lambda scope: a(scope) and b(scope)
    if value == "or":
        return lambda scope: a(scope) or b(scope)
    return lambda scope: _binary(value, a(scope), b(scope))


def _guarded(name: str, run: Callable, parts: list[Callable[[Scope], Any]]) -> Callable[[Scope], Any]:
    def of(scope: Scope) -> Any:
        try:
            return run(*[p(scope) for p in parts])
        except (TypeError, AttributeError) as e:
            raise TemplateError(f"{name}: {e}") from e

    return of


def _turns(items: Iterable) -> Iterator[tuple[Any, dict[str, Any]]]:
    """Each item with its loop variables; one item is read ahead."""
    nothing, i = object(), 0
    items = iter(items)
    now = next(items, nothing)
    while now is not nothing:
        after = next(items, nothing)
        yield now, {"first": i == 0, "last": after is nothing, "index0": i, "index": i + 1}
        now, i = after, i + 1


def _writer(node: Node, filters: dict[str, Callable], said: bool = False) -> Callable[[Scope, Parts], None]:
    """A closure that appends what a node prints."""
    if node.kind == "text":
        part = (node.value, said)
        return lambda scope, out: out.append(part)
    if node.kind == "print":
        value = _value(node.children[0], filters)
        return lambda scope, out: out.append((shown(value(scope)), said))
    if node.kind == "set":
        name, value = node.value, _value(node.children[0], filters)
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if node.kind == "generation":
        return _writer(node.children[0], filters, True)
    if node.kind == "if":
        ways = [(_value(c, filters), _writer(b, filters, said)) for c, b in zip(node.children[::2], node.children[1::2])]

        def choose(scope: Scope, out: Parts) -> None:
            for condition, body in ways:
                if condition(scope):
                    return body(scope, out)

        return choose
    if node.kind == "for":
        name, over, body = node.value, _value(node.children[0], filters), _writer(node.children[1], filters, said)

        def repeat(scope: Scope, out: Parts) -> None:
            items = over(scope)
            if items is not None and not isinstance(items, list):
                raise TemplateError(f"{type(items).__name__} can't be looped over")
            for item, loop in _turns(items or []):
                body(scope | {name: item, "loop": loop}, out)

        return repeat
    writers = [_writer(c, filters, said) for c in node.children]

    def all_of(scope: Scope, out: Parts) -> None:
        for write in writers:
            write(scope, out)

    return all_of


def _names(node: Node) -> int:
    """How often `messages` is looked at."""
    return (node.kind == "name" and node.value == "messages") + sum(map(_names, node.children))


#: What a template may call.
FILTERS: dict[str, Callable] = {
    "trim": lambda x: x.strip(), "upper": lambda x: x.upper(), "lower": lambda x: x.lower(), "title": lambda x: x.title(),
    "length": len, "default": lambda x, y: y if x is None else x, "replace": lambda x, a, b: x.replace(a, b),
    "join": lambda x, by="": by.join(map(shown, x)),
}


class Template:
    """A compiled template. render() gives a whole conversation; stream() gives what each message adds, and of a
    template whose only use of `messages` is one loop outside all blocks, it never holds more than two messages."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        filters = FILTERS | (filters or {})
        self.tree = fold(parse(source, filters), filters)
        own = self.tree.children
        loops = [i for i, c in enumerate(own) if c.kind == "for" and c.children[0] == Node("name", "messages")]
        self.streams = len(loops) == 1 and _names(self.tree) == 1
        self.whole = _writer(self.tree, filters)
        if self.streams:
            at = loops[0]
            self.name = own[at].value
            self.head, self.tail = (_writer(Node("block", None, part), filters) for part in (own[:at], own[at + 1 :]))
            self.body = _writer(own[at].children[1], filters)

    def render(self, messages: list[dict], **given: Any) -> Parts:
        out: Parts = []
        self.whole({**given, "messages": list(messages)}, out)
        return out

    def stream(self, messages: Iterable[dict], **given: Any) -> Iterator[Parts]:
        if not self.streams:
            yield self.render(list(messages), **given)
            return
        scope: Scope = dict(given)
        out: Parts = []
        self.head(scope, out)
        yield out
        for message, loop in _turns(messages):
            out = []
            self.body(scope | {self.name: message, "loop": loop}, out)
            yield out
        out = []
        self.tail(scope, out)
        yield out
