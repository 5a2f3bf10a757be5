"""Model text: lines of ``lhs op rhs`` with operators =~ ~ ~~ := < > ==, comments, labels and modifiers."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

NAME = r"[A-Za-z_.][A-Za-z0-9_.]*"
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
TERM = re.compile(rf"^\s*(?:(?P<mod>start\(\s*{NUMBER}\s*\)|NA|{NUMBER}|{NAME})\s*\*\s*)?(?P<name>{NAME})\s*$")


class ModelError(ValueError):
    pass


@dataclass(frozen=True)
class Line:
    """One parameter. value: fixed at; start: begins at; free: freed explicitly (NA)."""

    lhs: str
    op: str
    rhs: str
    value: float | None = None
    start: float | None = None
    label: str | None = None
    free: bool = False

    @property
    def key(self) -> str:
        return self.lhs + self.op + self.rhs


@dataclass
class Spec:
    lines: list[Line] = field(default_factory=list)
    constraints: list[tuple[str, str, float]] = field(default_factory=list)
    defines: list[tuple[str, str]] = field(default_factory=list)


def parse(text: str) -> Spec:
    """Statements end at a line end or ``;``; ``#`` and ``//`` begin comments. Several names joined by + on
    either side stand for a line each. ``a < 1``-like lines bound a labelled parameter."""
    spec = Spec()
    for raw in text.splitlines():
        for part in re.split(r"#|//", raw, maxsplit=1)[0].split(";"):
            if statement := part.strip():
                _statement(statement, spec)
    return spec


def _statement(s: str, spec: Spec) -> None:
    if ":=" in s:
        name, expression = s.split(":=", 1)
        spec.defines.append((name.strip(), expression.strip()))
        return
    m = re.match(rf"^(?P<lhs>[^=~<>]+?)\s*(?P<op>=~|~~|~|<=|>=|==|<|>)\s*(?P<rhs>.+)$", s)
    if not m:
        raise ModelError(f"not a model line: {s}")
    lhs, op, rhs = m["lhs"], m["op"], m["rhs"]
    if op in ("<", ">", "<=", ">=", "=="):
        if not re.fullmatch(NUMBER, rhs.strip()):
            raise ModelError(f"a bound must be a number: {s}")
        spec.constraints.append((lhs.strip(), op[0] if op != "==" else op, float(rhs)))
        return
    for left in lhs.split("+"):
        if not re.fullmatch(NAME, left.strip()):
            raise ModelError(f"not a name: {left.strip()}")
        for term in re.split(r"(?<![eE*])\+", rhs):
            if not (t := TERM.match(term)):
                raise ModelError(f"not a term: {term.strip()} in {s}")
            mod, value, start, label, free = t["mod"], None, None, None, False
            if mod == "NA":
                free = True
            elif mod and mod.startswith("start"):
                start = float(mod[mod.index("(") + 1 : -1])
            elif mod and re.fullmatch(NUMBER, mod):
                value = float(mod)
            elif mod:
                label = mod
            spec.lines.append(Line(left.strip(), op, t["name"], value, start, label, free))


FUNCTIONS = {"exp": math.exp, "log": math.log, "sqrt": math.sqrt, "abs": abs}


def evaluate(expression: str, values: Mapping[str, float]) -> float:
    """A defined parameter: + - * / ^, unary minus (below ^), parentheses, exp log sqrt abs pow. What cannot
    be evaluated, an unknown name too, is NaN."""
    tokens = re.findall(rf"(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|{NAME}|[-+*/^(),]", expression)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def total() -> float:
        x = product()
        while peek() in ("+", "-"):
            x = x + product() if take() == "+" else x - product()
        return x

    def product() -> float:
        x = sign()
        while peek() in ("*", "/"):
            x = x * sign() if take() == "*" else x / sign()
        return x

    def sign() -> float:
        if peek() == "-":
            take()
            return -sign()
        return power()

    def power() -> float:
        x = atom()
        if peek() == "^":
            take()
            return x ** sign()
        return x

    def atom() -> float:
        t = take()
        if t == "(":
            x = total()
            take()
            return x
        if peek() == "(" and re.fullmatch(NAME, t):
            take()
            args = [total()]
            while peek() == ",":
                take()
                args.append(total())
            take()
            return args[0] ** args[1] if t == "pow" else FUNCTIONS[t](args[0])
        return float(t) if re.fullmatch(r"(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", t) else values[t]

    try:
        x = total()
        return float(x) if at == len(tokens) and not isinstance(x, complex) else math.nan
    except (KeyError, IndexError, ValueError, ZeroDivisionError, OverflowError):
        return math.nan
