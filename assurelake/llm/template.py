"""Compiler of a small sandboxed template language for chats.

A template is text with `{{ expression }}`, `{# comment #}` and the statements `{% for x in list %} ...
{% else %} ... {% endfor %}`, `{% if %} / {% elif %} / {% else %} / {% endif %}`, `{% set x = expression %}` and
`{% generation %} ... {% endgeneration %}`, which marks what a model is to learn. A `-` inside the brackets
strips white space on that side.

Expressions: strings, integers, true, false, none, lists, names, `x.key`, `x[key]`, `x | filter(arguments)`,
`a if test else b`, or, and, not, comparisons, in, `~` (joins as text), + - * // %. That is all: there are no
calls but the filters given to the compiler, keys are looked up in mappings and places in lists only, never
attributes of Python objects.

1. The source is parsed to a syntax tree.
2. Constants are folded: expressions of constants, branches with a constant test, loops over an empty list,
   neighbouring texts. What can't be evaluated (1 // 0) is an error of the template.
3. For each node a Python closure is made; running the outermost renders.

An unknown name, filter or statement is an error when the template is compiled; a missing key or place is
none, and none is written as nothing. What a loop's body sets is seen in its later rounds, not after it. In a
loop, `loop.index`, `loop.index0`, `loop.first` and `loop.last` are known.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, fields, is_dataclass


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Unary:
    op: str
    x: object


@dataclass(frozen=True)
class Binary:
    op: str
    a: object
    b: object


@dataclass(frozen=True)
class Choice:
    test: object
    yes: object
    no: object


@dataclass(frozen=True)
class Filter:
    name: str
    x: object
    args: tuple


@dataclass(frozen=True)
class ListOf:
    items: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    x: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (test, body)
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    x: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_OPENING = re.compile(r"\{([{%#])(-?)")
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([0-9]+)|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[<>+\-*%~|.,()\[\]=]))", re.DOTALL)
_CLOSING = {"{": re.compile(r"\s*(-?)\}\}"), "%": re.compile(r"\s*(-?)%\}")}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LITERALS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


def _lexed(source: str) -> list[tuple[str, object]]:
    """("text", string), ("out", tokens) and ("do", tokens) in order; a token is (kind, value)."""
    out: list[tuple[str, object]] = []
    at, strip = 0, False
    while m := _OPENING.search(source, at):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        out.append(("text", text.rstrip() if m[2] else text))
        at = m.end()
        if m[1] == "#":
            end = source.find("#}", at)
            if end < 0:
                raise TemplateError("a comment isn't closed")
            strip, at = source[end - 1] == "-" and end > at, end + 2
            continue
        tokens: list[tuple[str, object]] = []
        while not (close := _CLOSING[m[1]].match(source, at)):
            t = _TOKEN.match(source, at)
            if not t:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            at = t.end()
            if t[1]:
                tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), t[1][1:-1], flags=re.DOTALL)))
            elif t[2]:
                tokens.append(("const", int(t[2])))
            elif t[3] in _LITERALS:
                tokens.append(("const", _LITERALS[t[3]]))
            else:
                tokens.append(("name", t[3]) if t[3] else ("op", t[4]))
        strip, at = bool(close[1]), close.end()
        out.append(("out" if m[1] == "{" else "do", tokens))
    out.append(("text", source[at:].lstrip() if strip else source[at:]))
    return out


class _Expression:
    """Recursive descent over the tokens of one expression."""

    LEVELS = ((("or",),), (("and",),), None, (("==",), ("!=",), ("<",), (">",), ("<=",), (">=",), ("in",), ("not", "in")), (("~",),), (("+",), ("-",)), (("*",), ("//",), ("%",)))

    def __init__(self, tokens: list, filters: Mapping):
        self.tokens, self.at, self.filters = tokens, 0, filters

    def ahead(self, *values: str) -> bool:
        some = self.tokens[self.at : self.at + len(values)]
        return [v for k, v in some if k != "const"] == list(values)

    def take(self, *values: str) -> bool:
        found = self.ahead(*values)
        self.at += len(values) * found
        return found

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def whole(self) -> object:
        x = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is unexpected")
        return x

    def choice(self) -> object:
        x = self.level(0)
        if self.take("if"):
            test = self.level(0)
            x = Choice(test, x, self.choice() if self.take("else") else Const(None))
        return x

    def level(self, n: int) -> object:
        if n == len(self.LEVELS):
            return self.signed()
        if self.LEVELS[n] is None:
            return Unary("not", self.level(n)) if self.take("not") else self.level(n + 1)
        x = self.level(n + 1)
        while op := next((o for o in self.LEVELS[n] if self.take(*o)), None):
            x = Binary(" ".join(op), x, self.level(n + 1))
        return x

    def signed(self) -> object:
        return Unary("-", self.signed()) if self.take("-") else self.filtered()

    def filtered(self) -> object:
        x = self.primary()
        while True:
            if self.take("."):
                x = Item(x, Const(self.name()))
            elif self.take("["):
                x = Item(x, self.choice())
                self.need("]")
            elif self.take("|"):
                name = self.name()
                if name not in self.filters:
                    raise TemplateError(f"no filter {name!r}")
                x = Filter(name, x, self.listed(")") if self.take("(") else ())
            else:
                return x

    def listed(self, close: str) -> tuple:
        items: list = []
        while not self.take(close):
            items.append(self.choice())
            if not self.ahead(close):
                self.need(",")
        return tuple(items)

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", None)
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def primary(self) -> object:
        if self.take("("):
            x = self.choice()
            self.need(")")
            return x
        if self.take("["):
            return ListOf(self.listed("]"))
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.name())


class _Parser:
    def __init__(self, source: str, filters: Mapping, known: Iterable[str]):
        self.parts, self.at, self.filters, self.known = _lexed(source), 0, filters, set(known)

    def expression(self, tokens: list) -> object:
        x = _Expression(tokens, self.filters).whole()
        unknown = names(x) - self.known
        if unknown:
            raise TemplateError(f"unknown name {min(unknown)!r}")
        return x

    def body(self, *ends: str) -> tuple[tuple, list]:
        """Nodes up to a statement in `ends`, and that statement's tokens."""
        out: list = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(Text(value))
            elif kind == "out":
                out.append(Output(self.expression(value)))
            elif value and value[0][1] in ends:
                return tuple(out), value
            else:
                out.append(self.statement(value))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(out), []

    def statement(self, tokens: list) -> object:
        word, rest = (tokens[0][1], tokens[1:]) if tokens else ("", [])
        if word == "if":
            branches, other, test = [], (), self.expression(rest)
            while True:
                body, end = self.body("elif", "else", "endif")
                branches.append((test, body))
                if end[0][1] == "elif":
                    test = self.expression(end[1:])
                    continue
                if end[0][1] == "else":
                    other = self.body("endif")[0]
                return If(tuple(branches), other)
        if word == "for":
            if len(rest) < 3 or rest[0][0] != "name" or rest[1] != ("name", "in"):
                raise TemplateError("for needs a name and a list")
            name, over, outside = rest[0][1], self.expression(rest[2:]), self.known
            self.known = outside | {name, "loop"}
            body, end = self.body("else", "endfor")
            self.known = outside
            return For(name, over, body, self.body("endfor")[0] if end[0][1] == "else" else ())
        if word == "set":
            if len(rest) < 3 or rest[0][0] != "name" or rest[1] != ("op", "="):
                raise TemplateError("set needs a name and a value")
            x = self.expression(rest[2:])
            self.known = self.known | {rest[0][1]}
            return Set(rest[0][1], x)
        if word == "generation":
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"no statement {word!r}")


def names(node: object) -> set[str]:
    """The names that a tree reads."""
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, tuple):
        return set().union(*map(names, node))
    if is_dataclass(node):
        return set().union(*(names(getattr(node, f.name)) for f in fields(node)))
    return set()


def as_text(x: object) -> str:
    return "" if x is None else x if isinstance(x, str) else ("false", "true")[x] if isinstance(x, bool) else str(x)


def _item(of: object, key: object) -> object:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, list) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_OPERATIONS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "~": lambda a, b: as_text(a) + as_text(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b,
    "*": lambda a, b: a * b, "//": lambda a, b: a // b, "%": lambda a, b: a % b,
}


class _Folder:
    def __init__(self, filters: Mapping):
        self.filters = filters

    def constant(self, node: object) -> object:
        """The node's value as a constant, once all that it is made of is constant."""
        try:
            return Const(expression(node, self.filters)({}))
        except (TypeError, ValueError, ArithmeticError, LookupError) as e:
            raise TemplateError(f"a constant expression fails: {e}") from e

    def expression(self, x: object) -> object:
        if isinstance(x, (Const, Name)):
            return x
        if isinstance(x, Choice):
            test = self.expression(x.test)
            if isinstance(test, Const):
                return self.expression(x.yes if test.value else x.no)
            return Choice(test, self.expression(x.yes), self.expression(x.no))
        made = {}
        for f in fields(x):
            v = getattr(x, f.name)
            made[f.name] = tuple(map(self.expression, v)) if isinstance(v, tuple) else self.expression(v) if is_dataclass(v) else v
        x = type(x)(**made)
        if isinstance(x, Binary) and x.op in ("and", "or") and isinstance(x.a, Const):
            return x.b if bool(x.a.value) == (x.op == "and") else x.a
        if isinstance(x, Binary) and x.op == "~" and isinstance(x.a, Binary) and x.a.op == "~" and isinstance(x.a.b, Const) and isinstance(x.b, Const):
            return Binary("~", x.a.a, self.constant(Binary("~", x.a.b, x.b)))  # joining is associative
        parts = [v for y in made.values() for v in (y if isinstance(y, tuple) else (y,)) if is_dataclass(v)]
        return self.constant(x) if all(isinstance(p, Const) for p in parts) else x

    def body(self, nodes: tuple) -> tuple:
        out: list = []
        for n in (m for node in nodes for m in self.node(node)):
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + n.value)
            elif n != Text(""):
                out.append(n)
        return tuple(out)

    def node(self, n: object) -> tuple:
        if isinstance(n, Output):
            return self.output(self.expression(n.x))
        if isinstance(n, If):
            branches = []
            for test, body in n.branches:
                test = self.expression(test)
                if isinstance(test, Const) and not test.value:
                    continue
                branches.append((test, self.body(body)))
                if isinstance(test, Const):  # always taken: nothing after it is
                    return branches[0][1] if len(branches) == 1 else (If(tuple(branches[:-1]), branches[-1][1]),)
            other = self.body(n.other)
            return (If(tuple(branches), other),) if branches else other
        if isinstance(n, For):
            over = self.expression(n.over)
            if over in (Const(None), Const([])):
                return self.body(n.other)
            return (For(n.name, over, self.body(n.body), self.body(n.other)),)
        if isinstance(n, Set):
            return (Set(n.name, self.expression(n.x)),)
        if isinstance(n, Generation):
            body = self.body(n.body)
            return (Generation(body),) if body else ()
        return (n,)

    def output(self, x: object) -> tuple:
        """What is joined is written piece by piece, so that constant pieces become text."""
        if isinstance(x, Const):
            return (Text(as_text(x.value)),)
        if isinstance(x, Binary) and x.op == "~":
            return self.output(x.a) + self.output(x.b)
        return (Output(x),)


def expression(x: object, filters: Mapping) -> Callable[[dict], object]:
    """A closure from the variables to the value."""

    def sub(y: object) -> Callable[[dict], object]:
        return expression(y, filters)

    if isinstance(x, Const):
        value = x.value
        return lambda v: value
    if isinstance(x, Name):
        name = x.name
        return lambda v: v.get(name)
    if isinstance(x, Item):
        of, key = sub(x.of), sub(x.key)
        return lambda v: _item(of(v), key(v))
    if isinstance(x, Unary):
        a = sub(x.x)
        return (lambda v: not a(v)) if x.op == "not" else (lambda v: -a(v))
    if isinstance(x, Binary):
        a, b = sub(x.a), sub(x.b)
        if x.op == "and":
            return lambda v: a(v) and b(v)
        if x.op == "or":
            return lambda v: a(v) or b(v)
        op = _OPERATIONS[x.op]
        return lambda v: op(a(v), b(v))
    if isinstance(x, Choice):
        test, yes, no = sub(x.test), sub(x.yes), sub(x.no)
        return lambda v: yes(v) if test(v) else no(v)
    if isinstance(x, Filter):
        f, of, args = filters[x.name], sub(x.x), tuple(map(sub, x.args))
        return (lambda v: f(of(v), *[a(v) for a in args])) if args else (lambda v: f(of(v)))
    items = tuple(map(sub, x.items))
    return lambda v: [i(v) for i in items]


class Out:
    """Rendered text, its length, and the spans that are marked for learning."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)

    def text(self) -> str:
        return "".join(self.parts)


Renderer = Callable[[dict, Out], None]


def renderer(nodes: tuple, filters: Mapping) -> Renderer:
    """A closure that writes the nodes."""
    steps = tuple(_step(n, filters) for n in nodes)
    if len(steps) == 1:
        return steps[0]

    def run(v: dict, out: Out) -> None:
        for s in steps:
            s(v, out)

    return run


def _step(n: object, filters: Mapping) -> Renderer:
    if isinstance(n, Text):
        value = n.value
        return lambda v, out: out.write(value)
    if isinstance(n, Output):
        x = expression(n.x, filters)
        return lambda v, out: out.write(as_text(x(v)))
    if isinstance(n, Set):
        name, x = n.name, expression(n.x, filters)

        def put(v: dict, out: Out) -> None:
            v[name] = x(v)

        return put
    if isinstance(n, If):
        branches = tuple((expression(t, filters), renderer(b, filters)) for t, b in n.branches)
        other = renderer(n.other, filters)

        def choose(v: dict, out: Out) -> None:
            for test, body in branches:
                if test(v):
                    return body(v, out)
            return other(v, out)

        return choose
    if isinstance(n, For):
        name, over, body, other = n.name, expression(n.over, filters), renderer(n.body, filters), renderer(n.other, filters)

        def loop(v: dict, out: Out) -> None:
            items = over(v) or []
            if not isinstance(items, list):
                raise TemplateError("a loop needs a list")
            inner = dict(v)
            for i, x in enumerate(items):
                inner[name], inner["loop"] = x, position(i, i + 1 == len(items))
                body(inner, out)
            if not items:
                other(v, out)

        return loop
    body = renderer(n.body, filters)

    def mark(v: dict, out: Out) -> None:
        start = out.size
        body(v, out)
        if out.size > start:
            out.spans.append((start, out.size))

    return mark


def position(i: int, last: bool) -> dict:
    return {"index0": i, "index": i + 1, "first": i == 0, "last": last}


class Template:
    """A compiled template. `variables` are the names that rendering gives it."""

    def __init__(self, source: str, variables: Iterable[str], filters: Mapping[str, Callable]):
        self.filters = filters
        self.tree = _Parser(source, filters, variables).body()[0]
        self.folded = _Folder(filters).body(self.tree)
        self._render = renderer(self.folded, filters)

    def render(self, **values: object) -> tuple[str, list[tuple[int, int]]]:
        """The text and the marked spans, in code points."""
        out = Out()
        self._render(dict(values), out)
        return out.text(), out.spans

    def item_by_item(self, name: str) -> tuple[Renderer, str, Renderer, Renderer] | None:
        """(head, loop variable, body, tail) if the list `name` is read by one outermost loop alone, so
        that its items can be rendered one after the other without holding them; else None."""
        loops = [i for i, n in enumerate(self.folded) if isinstance(n, For) and n.over == Name(name) and not n.other]
        if len(loops) != 1:
            return None
        at = loops[0]
        loop = self.folded[at]
        if name in names((self.folded[:at], loop.body, self.folded[at + 1 :])):
            return None
        return renderer(self.folded[:at], self.filters), loop.name, renderer(loop.body, self.filters), renderer(self.folded[at + 1 :], self.filters)
