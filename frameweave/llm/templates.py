"""Compiler for a small sandboxed chat-template language.

A template is text with `{{ expression }}` and `{% statement %}`:

    {% for m in messages %} .. {% endfor %}     {% if e %} .. {% elif e %} .. {% else %} .. {% endif %}
    {% set name = e %}                          {% generation %} .. {% endgeneration %}

Expressions have texts, integers, true, false, none, names, attributes of the message and of `loop`
(index, index0, first, last), == != < <= > >= in, and or not, + ~ (join) %, parentheses and the filters
escape, escape_name, trim, upper, lower and default(e). There are no calls, no indexing and no access to
Python objects, so a template can only read its message and its variables.

The text is parsed into a syntax tree, constant parts are folded, and every node becomes a Python
closure. `generation` marks the output that a model is trained on. Messages are taken one by one, so
a conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class TemplateError(ValueError):
    """The template is not in the language."""


# ---- syntax tree --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Attr:
    base: "Expr"
    name: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple["Expr", ...]


Expr = Const | Name | Attr | Op


@dataclass(frozen=True)
class Output:
    expr: Expr


@dataclass(frozen=True)
class Set:
    name: str
    expr: Expr


@dataclass(frozen=True)
class If:
    cases: tuple[tuple[Expr, tuple["Node", ...]], ...]


@dataclass(frozen=True)
class For:
    name: str
    body: tuple["Node", ...]


@dataclass(frozen=True)
class Generation:
    body: tuple["Node", ...]


Node = Output | Set | If | For | Generation

# ---- reading ------------------------------------------------------------------------------------

_PARTS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(\d+)|([A-Za-z_]\w*)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(==|!=|<=|>=|[-<>+~%().|,=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", '"': '"', "'": "'"}
_WORDS = {"true": True, "false": False, "none": None}


class _Reader:
    """Recursive descent over the tokens of one expression or statement."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while text[at:].strip():
            m = _TOKENS.match(text, at)
            if not m:
                raise TemplateError(f"unreadable: {text[at:].strip()[:40]!r}")
            kind = ("number", "name", "text", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign"):
            value = self.tokens[self.at][1]
            return value if value in values else None
        return None

    def take(self, *values: str) -> str | None:
        found = self.peek(*values)
        self.at += found is not None
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self) -> Expr:
        return self.chain(("or",), lambda: self.chain(("and",), self.negation))

    def chain(self, signs: tuple[str, ...], inner: Callable[[], Expr]) -> Expr:
        left = inner()
        while sign := self.take(*signs):
            left = Op(sign, (left, inner()))
        return left

    def negation(self) -> Expr:
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Expr:
        left = self.sum()
        sign = self.take("==", "!=", "<=", ">=", "<", ">", "in")
        return Op(sign, (left, self.sum())) if sign else left

    def sum(self) -> Expr:
        return self.chain(("+", "~"), lambda: self.chain(("%",), self.filtered))

    def filtered(self) -> Expr:
        value = self.primary()
        while self.take("|"):
            name = self.name()
            if name == "default":
                self.need("(")
                value = Op("default", (value, self.expression()))
                self.need(")")
            elif name in FILTERS:
                value = Op(name, (value,))
            else:
                raise TemplateError(f"unknown filter {name!r}")
        return value

    def primary(self) -> Expr:
        if self.take("("):
            value = self.expression()
            self.need(")")
            return value
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(text))
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), text[1:-1], flags=re.S))
        if kind != "name" or text in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {text!r}")
        if text in _WORDS:
            return Const(_WORDS[text])
        value: Expr = Name(text)
        while self.take("."):
            value = Attr(value, self.name())
        return value


def parse(source: str) -> tuple[Node, ...]:
    """Syntax tree of a template; raises TemplateError for anything outside the language."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PARTS.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("do", m[2]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    position = 0

    def block(*ends: str) -> tuple[tuple[Node, ...], _Reader | None, str | None]:
        nonlocal position
        nodes: list[Node] = []
        while position < len(parts):
            kind, text = parts[position]
            position += 1
            if kind == "text":
                nodes.append(Output(Const(text)))
                continue
            reader = _Reader(text)
            if kind == "out":
                nodes.append(Output(reader.expression()))
                reader.end()
                continue
            word = reader.name()
            if word in ends:
                return tuple(nodes), reader, word
            nodes.append(statement(word, reader))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(nodes), None, None

    def statement(word: str, reader: _Reader) -> Node:
        if word == "set":
            name = reader.name()
            reader.need("=")
            node: Node = Set(name, reader.expression())
            reader.end()
            return node
        if word == "for":
            name = reader.name()
            reader.need("in")
            if reader.name() != "messages":
                raise TemplateError("only messages can be looped over")
            reader.end()
            body, rest, _ = block("endfor")
            rest.end()
            return For(name, body)
        if word == "generation":
            reader.end()
            body, rest, _ = block("endgeneration")
            rest.end()
            return Generation(body)
        if word == "if":
            cases = []
            test: Expr = reader.expression()
            reader.end()
            while True:
                body, rest, end = block("elif", "else", "endif")
                cases.append((test, body))
                if end == "endif":
                    rest.end()
                    return If(tuple(cases))
                test = rest.expression() if end == "elif" else Const(True)
                rest.end()
        raise TemplateError(f"unknown statement {word!r}")

    return block()[0]


# ---- folding ------------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _plus(a: object, b: object) -> object:
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


def _less(a: object, b: object) -> bool:
    same = isinstance(a, str) == isinstance(b, str) and a is not None and b is not None
    return same and a < b


FILTERS: dict[str, Callable[[str], str]] = {}

_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": _less,
    ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: a == b or _less(a, b),
    ">=": lambda a, b: a == b or _less(b, a),
    "in": lambda a, b: _text(a) in _text(b),
    "+": _plus,
    "~": lambda a, b: _text(a) + _text(b),
    "%": lambda a, b: a % b if isinstance(a, int) and isinstance(b, int) and b else 0,
    "not": lambda a: not a,
    "default": lambda a, b: b if a is None else a,
}


def _apply(op: str, args: list) -> object:
    return FILTERS[op](_text(args[0])) if op in FILTERS else _OPERATIONS[op](*args)


def fold_expr(e: Expr) -> Expr:
    """The same expression with constant parts evaluated."""
    if isinstance(e, Attr):
        return Attr(fold_expr(e.base), e.name)
    if not isinstance(e, Op):
        return e
    args = tuple(map(fold_expr, e.args))
    if e.op in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (e.op == "and") else args[0]
        return Op(e.op, args)
    if all(isinstance(a, Const) for a in args):
        return Const(_apply(e.op, [a.value for a in args]))
    return Op(e.op, args)


def fold(nodes: Iterable[Node]) -> tuple[Node, ...]:
    """The same tree with constants evaluated, settled branches chosen and adjacent texts joined."""
    out: list[Node] = []

    def put(node: Node) -> None:
        if isinstance(node, Output) and isinstance(node.expr, Const):
            text = _text(node.expr.value)
            if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                text = out.pop().expr.value + text
            if text:
                out.append(Output(Const(text)))
        else:
            out.append(node)

    for node in nodes:
        if isinstance(node, Output):
            put(Output(fold_expr(node.expr)))
        elif isinstance(node, Set):
            put(Set(node.name, fold_expr(node.expr)))
        elif isinstance(node, For):
            put(For(node.name, fold(node.body)))
        elif isinstance(node, Generation):
            put(Generation(fold(node.body)))
        else:
            cases = []
            for test, body in node.cases:
                test = fold_expr(test)
                if isinstance(test, Const) and not test.value:
                    continue
                cases.append((test, fold(body)))
                if isinstance(test, Const):
                    break
            if cases and isinstance(cases[0][0], Const):
                for inner in cases[0][1]:
                    put(inner)
            elif cases:
                put(If(tuple(cases)))
    return tuple(out)


# ---- closures -----------------------------------------------------------------------------------


@dataclass
class State:
    """Variables, and the pieces rendered so far as (text, is generated)."""

    names: dict[str, object] = field(default_factory=dict)
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    generating: bool = False


def _compile_expr(e: Expr) -> Callable[[dict], object]:
    if isinstance(e, Const):
        return lambda names, v=e.value: v
    if isinstance(e, Name):
        return lambda names, n=e.name: names.get(n)
    if isinstance(e, Attr):
        base, name = _compile_expr(e.base), e.name

        def attribute(names: dict) -> object:
            found = base(names)
            return found.get(name) if isinstance(found, dict) else None

        return attribute
    args = [_compile_expr(a) for a in e.args]
    if e.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if e.op == "or":
        return lambda names: args[0](names) or args[1](names)
    if e.op in FILTERS:
        one, use = args[0], FILTERS[e.op]
        return lambda names: use(_text(one(names)))
    use = _OPERATIONS[e.op]
    if len(args) == 1:
        return lambda names: use(args[0](names))
    return lambda names: use(args[0](names), args[1](names))


def _compile_nodes(nodes: tuple[Node, ...]) -> Callable[[State], None]:
    steps = [_compile_node(n) for n in nodes]

    def run(state: State) -> None:
        for step in steps:
            step(state)

    return run


def _compile_node(node: Node) -> Callable[[State], None]:
    if isinstance(node, Output):
        value = _compile_expr(node.expr)

        def put(state: State) -> None:
            text = _text(value(state.names))
            if text:
                state.pieces.append((text, state.generating))

        return put
    if isinstance(node, Set):
        value, name = _compile_expr(node.expr), node.name
        return lambda state: state.names.__setitem__(name, value(state.names))
    if isinstance(node, Generation):
        body = _compile_nodes(node.body)

        def generate(state: State) -> None:
            before, state.generating = state.generating, True
            body(state)
            state.generating = before

        return generate
    if isinstance(node, If):
        cases = [(_compile_expr(test), _compile_nodes(body)) for test, body in node.cases]

        def choose(state: State) -> None:
            for test, body in cases:
                if test(state.names):
                    body(state)
                    return

        return choose
    raise TemplateError("a loop must stand at the top of the template")


class Template:
    """A compiled template: what precedes the loop over messages, its body, and what follows.

    `render_message` renders one message given its place in the conversation, so the messages
    of a conversation may be rendered apart from each other; a variable set in the loop holds
    for that message only.
    """

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        loops = [i for i, n in enumerate(self.tree) if isinstance(n, For)]
        if len(loops) != 1:
            raise TemplateError("a template has one loop over messages")
        at = loops[0]
        self.variable = self.tree[at].name
        self._before = _compile_nodes(self.tree[:at])
        self._body = _compile_nodes(self.tree[at].body)
        self._after = _compile_nodes(self.tree[at + 1 :])

    def render_message(self, message: dict, index: int, last: bool) -> list[tuple[str, bool]]:
        """Pieces (text, is generated) of message number `index`, with the head and tail of the
        conversation at its first and last message."""
        state = State()
        self._before(state)
        if index:
            state.pieces.clear()
        state.names[self.variable] = message
        state.names["loop"] = {"index": index + 1, "index0": index, "first": index == 0, "last": last}
        self._body(state)
        if last:
            del state.names[self.variable], state.names["loop"]
            self._after(state)
        return state.pieces

    def render(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        """Pieces of a whole conversation, message by message; none if there are no messages."""
        held, index = None, 0
        for message in messages:
            if held is not None:
                yield from self.render_message(held, index, False)
                index += 1
            held = message
        if held is not None:
            yield from self.render_message(held, index, True)


# ---- reversible escaping ------------------------------------------------------------------------

#: Signs that begin or could imitate a control string, each escaped by a backslash.
ESCAPED = "\\<#"
_NEEDS = re.compile(f"[{re.escape(ESCAPED)}]")
_ESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """Backslash before every sign that a control string begins with."""
    return _NEEDS.sub(r"\\\g<0>", text)


def escape_name(text: str) -> str:
    """`escape` for a name that a colon ends: its own colons are escaped too."""
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


FILTERS |= {"escape": escape, "escape_name": escape_name, "trim": str.strip, "upper": str.upper, "lower": str.lower}
