"""A small template language for conversations: parsed to a syntax tree, constants folded, compiled to Python closures.

Text, ``{{ expression | filter }}``, ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}``, ``{% generation %}`` (what it
encloses is under the loss mask); ``-`` inside a delimiter strips white space beside it. Expressions: strings, whole numbers,
true, false, none, names, ``a.b`` (a key of a mapping), ``==  !=  +  not  and  or``, brackets. There are no calls, no
attributes and no names besides the given ones and those of loops, so a template reaches nothing else.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

Piece = tuple[str, bool]
FILTERS: dict[str, Callable[[Any], str]] = {"trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower()}


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: str


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass
class Out:
    value: Any


@dataclass
class For:
    name: str
    of: Any
    body: list = field(default_factory=list)


@dataclass
class If:
    cases: list = field(default_factory=list)  # (condition, body)


@dataclass
class Generation:
    body: list = field(default_factory=list)


_MARK = re.compile(r"\{\{(-?)(?P<value>.*?)(-?)\}\}|\{%(-?)(?P<statement>.*?)(-?)%\}", re.S)
_LEXEME = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|[+.|()]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str, scope: set[str], filters: dict):
        self.scope, self.filters, self.lexemes, at = scope, filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            number, single, double, name, sign = m.groups()
            text = single if single is not None else double
            if number:
                self.lexemes.append(("value", int(number)))
            elif text is not None:
                self.lexemes.append(("value", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.S)))
            else:
                self.lexemes.append(("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = 0

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.lexemes) and self.lexemes[self.at][0] != "value" and self.lexemes[self.at][1] in wanted:
            self.at += 1
            return self.lexemes[self.at - 1][1]
        return None

    def whole(self):
        node = self.filtered()
        if self.at < len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r}")
        return node

    def filtered(self):
        node = self.either()
        while self.take("|"):
            kind, name = self.lexemes[self.at] if self.at < len(self.lexemes) else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"unknown filter {name!r}")
            self.at += 1
            node = Op(f"|{name}", (node,))
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = Op("or", (node, self.both()))
        return node

    def both(self):
        node = self.negated()
        while self.take("and"):
            node = Op("and", (node, self.negated()))
        return node

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        node = self.added()
        while sign := self.take("==", "!="):
            node = Op(sign, (node, self.added()))
        return node

    def added(self):
        node = self.atom()
        while self.take("+"):
            node = Op("+", (node, self.atom()))
        return node

    def atom(self):
        if self.at >= len(self.lexemes):
            raise TemplateError("an expression ends too early")
        if self.take("("):
            node = self.filtered()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        else:
            kind, value = self.lexemes[self.at]
            self.at += 1
            if kind == "value":
                node = Const(value)
            elif kind == "name" and value in ("true", "false", "none"):
                node = Const({"true": True, "false": False, "none": None}[value])
            elif kind == "name" and value in self.scope:
                node = Name(value)
            else:
                raise TemplateError(f"unknown name {value!r}")
        while self.take("."):
            kind, value = self.lexemes[self.at] if self.at < len(self.lexemes) else ("", "")
            if kind != "name":
                raise TemplateError("a key must follow a full stop")
            self.at += 1
            node = Key(node, value)
        return node


def parse(source: str, names: Iterable[str] = ("messages",), filters: dict | None = None) -> list:
    """The syntax tree; unknown names, filters and statements and unbalanced blocks raise :class:`TemplateError`."""
    filters = FILTERS | (filters or {})
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    scope = [set(names)]
    at = 0
    strip = False
    for m in _MARK.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] else text
        if text:
            stack[-1][2].append(Out(Const(text)))
        strip, at = bool(m[3] or m[6]), m.end()
        if m["value"] is not None:
            stack[-1][2].append(Out(_Expression(m["value"], scope[-1], filters).whole()))
            continue
        body = m["statement"]
        word, _, rest = body.strip().partition(" ")
        if word == "for":
            parts = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not parts:
                raise TemplateError(f"cannot read the loop {body!r}")
            node = For(parts[1], _Expression(parts[2], scope[-1], filters).whole())
            stack[-1][2].append(node)
            stack.append(("for", node, node.body))
            scope.append(scope[-1] | {parts[1], "loop"})
        elif word == "if":
            node = If([(_Expression(rest, scope[-1], filters).whole(), [])])
            stack[-1][2].append(node)
            stack.append(("if", node, node.cases[0][1]))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            node = stack.pop()[1]
            node.cases.append((_Expression(rest, scope[-1], filters).whole() if word == "elif" else Const(True), []))
            stack.append(("if", node, node.cases[-1][1]))
        elif word == "generation":
            node = Generation()
            stack[-1][2].append(node)
            stack.append(("generation", node, node.body))
        elif word.startswith("end") and len(stack) > 1 and word[3:] == stack[-1][0]:
            if stack.pop()[0] == "for":
                scope.pop()
        else:
            raise TemplateError(f"unexpected {{% {body.strip()} %}}")
    if len(stack) > 1:
        raise TemplateError(f"{{% {stack[-1][0]} %}} is not closed")
    text = source[at:].lstrip() if strip else source[at:]
    if text:
        root.append(Out(Const(text)))
    return root


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_APPLY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "+": lambda a, b: _text(a) + _text(b), "not": lambda a: not a}


def _folded(node: Any, filters: dict) -> Any:
    if isinstance(node, Key):
        return Key(_folded(node.of, filters), node.key)
    if not isinstance(node, Op):
        return node
    args = tuple(_folded(a, filters) for a in node.args)
    if node.op in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
    if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
        apply = (lambda x: filters[node.op[1:]](_text(x))) if node.op[0] == "|" else _APPLY[node.op]
        return Const(apply(*(a.value for a in args)))
    return Op(node.op, args)


def fold(body: list, filters: dict | None = None) -> list:
    """The same tree with constant expressions computed, constant conditions decided and neighbouring texts joined."""
    filters = FILTERS | (filters or {})
    out: list = []
    for node in body:
        if isinstance(node, Out):
            new: list = [Out(_folded(node.value, filters))]
        elif isinstance(node, For):
            new = [For(node.name, _folded(node.of, filters), fold(node.body, filters))]
        elif isinstance(node, Generation):
            inner = fold(node.body, filters)
            new = [Generation(inner)] if inner else []
        else:
            cases = []
            for condition, inner in node.cases:
                condition = _folded(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold(inner, filters)))
                if isinstance(condition, Const):
                    break
            new = cases[0][1] if cases and isinstance(cases[0][0], Const) else [If(cases)] if cases else []
        for node in new:
            if isinstance(node, Out) and isinstance(node.value, Const):
                text = _text(node.value.value)
                if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(out[-1].value.value + text))
                elif text:
                    out.append(Out(Const(text)))
            else:
                out.append(node)
    return out


def _value(node: Any, filters: dict) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env[n]
    if isinstance(node, Key):
        of, key = _value(node.of, filters), node.key

        def keyed(env: dict) -> Any:
            found = of(env)
            return found.get(key) if isinstance(found, dict) else None

        return keyed
    args = [_value(a, filters) for a in node.args]
    if node.op[0] == "|":
        apply, a = filters[node.op[1:]], args[0]
        return lambda env: apply(_text(a(env)))
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.op == "not":
        return lambda env: not args[0](env)
    apply = _APPLY[node.op]
    return lambda env: apply(args[0](env), args[1](env))


def _closure(body: list, masked: bool, filters: dict) -> Callable[[dict], Iterator[Piece]]:
    steps = [_step(node, masked, filters) for node in body]

    def run(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return run


def _step(node: Any, masked: bool, filters: dict) -> Callable[[dict], Iterable[Piece]]:
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            ready = ((node.value.value, masked),)
            return lambda env: ready
        value = _value(node.value, filters)
        return lambda env: ((_text(value(env)), masked),)
    if isinstance(node, Generation):
        return _closure(node.body, True, filters)
    if isinstance(node, If):
        cases = [(_value(c, filters), _closure(b, masked, filters)) for c, b in node.cases]

        def choose(env: dict) -> Iterable[Piece]:
            return next((body(env) for condition, body in cases if condition(env)), ())

        return choose
    of, body = _value(node.of, filters), _closure(node.body, masked, filters)

    def loop(env: dict) -> Iterator[Piece]:
        items = iter(of(env) or ())
        item = next(items, items)
        index = 0
        while item is not items:
            after = next(items, items)
            yield from body(env | {node.name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": after is items}})
            item, index = after, index + 1

    return loop


def compile_template(source: str, names: Iterable[str] = ("messages",), filters: dict | None = None) -> Callable[[dict], Iterator[Piece]]:
    """A function from the given names' values to (text, under the loss mask) pieces. Lists may be iterators if looped over once."""
    filters = FILTERS | (filters or {})
    return _closure(fold(parse(source, names, filters), filters), False, filters)
