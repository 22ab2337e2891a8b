"""The formula language: a closed grammar, parsed once and lowered to Column expressions.

    choice  := or ['?' choice ':' choice]        or := and ('||' and)*      and := equal ('&&' equal)*
    equal   := order (('=='|'==='|'!='|'!==') order)*    order := sum (('<'|'<='|'>'|'>=') sum)*
    sum     := product (('+'|'-') product)*     product := power (('*'|'/'|'%') power)*
    power   := unary ['**' power]               unary := ('-'|'+'|'!') unary | atom
    atom    := number | field | constant | name '(' [choice (',' choice)*] ')' | '(' choice ')'

A field is the longest known name that stands at a place between word borders; names may hold
spaces, CJK characters and symbols. Nothing is ever evaluated as code.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pivolith.functions import numeric as N

_INSIDE = re.compile(r"[A-Za-z0-9_一-鿿]")
_NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_$一-鿿][\w$.一-鿿]*")
_SIGN = re.compile(r"===|!==|\*\*|==|!=|<=|>=|&&|\|\||[-+*/%()<>!?:,]")
CONSTANTS = {"Infinity": float("inf"), "NaN": float("nan"), "undefined": float("nan"), "true": 1.0, "false": 0.0, "null": 0.0, "Math.PI": 3.141592653589793, "Math.E": 2.718281828459045}
Node = tuple


class FormulaError(ValueError):
    """A formula that isn't in the grammar, or that names an unknown field."""


def _tokens(text: str, fields: Sequence[str]) -> list[tuple[str, str]]:
    known = sorted((f for f in fields if f), key=len, reverse=True)
    out, at = [], 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        named = _NAME.match(text, at)
        if named and (named[0].startswith("Math.") or named[0] in ("DIV", "IFERROR", "num") and text[named.end() :].lstrip().startswith("(")):
            out.append(("name", named[0]))
            at = named.end()
            continue
        field = next((f for f in known if text.startswith(f, at) and not (at and _INSIDE.match(text[at - 1]) and _INSIDE.match(f[0])) and not (_INSIDE.match(f[-1]) and _INSIDE.match(text[at + len(f) : at + len(f) + 1]))), None)
        if field:
            out.append(("field", field))
            at += len(field)
            continue
        for kind, pattern in (("number", _NUMBER), ("name", _NAME), ("sign", _SIGN)):
            m = pattern.match(text, at)
            if m:
                out.append((kind, m[0]))
                at = m.end()
                break
        else:
            raise FormulaError(f"unexpected {text[at]!r} at {at} in {text!r}")
    return [*out, ("end", "")]


_LEVELS = (("||",), ("&&",), ("==", "===", "!=", "!=="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "/", "%"))


def parse(text: str, fields: Sequence[str], aliases: Mapping[str, str] | None = None) -> Node:
    """The syntax tree: ('num', x), ('field', name), ('call', name, args), ('op', sign, args).

    aliases: other spellings of fields; a field of that very name comes first."""
    spelt = {a: f for a, f in (aliases or {}).items() if a not in fields and f in fields}
    tokens = _tokens(text, [*fields, *spelt])
    at = 0

    def take(*signs: str) -> str | None:
        nonlocal at
        if tokens[at][0] == "sign" and tokens[at][1] in signs:
            at += 1
            return tokens[at - 1][1]
        return None

    def need(sign: str) -> None:
        if not take(sign):
            raise FormulaError(f"{sign!r} expected in {text!r}")

    def choice() -> Node:
        test = level(0)
        if not take("?"):
            return test
        yes = choice()
        need(":")
        return ("op", "?", (test, yes, choice()))

    def level(k: int) -> Node:
        if k == len(_LEVELS):
            return power()
        left = level(k + 1)
        while sign := take(*_LEVELS[k]):
            left = ("op", sign, (left, level(k + 1)))
        return left

    def power() -> Node:
        base = unary()
        return ("op", "**", (base, power())) if take("**") else base

    def unary() -> Node:
        sign = take("-", "+", "!")
        return ("op", f"unary{sign}", (unary(),)) if sign else atom()

    def atom() -> Node:
        nonlocal at
        kind, said = tokens[at]
        at += 1
        if kind == "number":
            return ("num", float(said))
        if kind == "field":
            return ("field", spelt.get(said, said))
        if kind == "name" and take("("):
            args = []
            if not take(")"):
                args.append(choice())
                while take(","):
                    args.append(choice())
                need(")")
            if said not in FUNCTIONS:
                raise FormulaError(f"unknown function {said!r}")
            return ("call", said, tuple(args))
        if kind == "name" and said in CONSTANTS:
            return ("num", CONSTANTS[said])
        if (kind, said) == ("sign", "("):
            inner = choice()
            need(")")
            return inner
        raise FormulaError(f"unknown name {said!r} in {text!r}" if kind == "name" else f"unexpected {said or 'end'!r} in {text!r}")

    tree = choice()
    if tokens[at][0] != "end":
        raise FormulaError(f"unexpected {tokens[at][1]!r} in {text!r}")
    return tree


def used(tree: Node) -> list[str]:
    """The fields of a tree, in order of first use."""
    if tree[0] == "field":
        return [tree[1]]
    return list(dict.fromkeys(f for part in (tree[2] if tree[0] in ("op", "call") else ()) for f in used(part)))


def _true(x: Column) -> Column:
    return (x != 0) & ~F.isnan(x)


def _flag(test: Column) -> Column:
    return F.when(test, 1.0).otherwise(0.0)


def _compare(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: _flag(test(a, b) & ~F.isnan(a) & ~F.isnan(b))


_equal = _compare(lambda a, b: a == b)
_OPERATORS: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": N.divide,
    "%": lambda a, b: F.when((b == 0) | F.isnan(b), float("nan")).otherwise(F.try_mod(a, b)),
    "**": F.pow, "unary-": lambda a: -a, "unary+": lambda a: a, "unary!": lambda a: _flag(~_true(a)),
    "<": _compare(lambda a, b: a < b), "<=": _compare(lambda a, b: a <= b), ">": _compare(lambda a, b: a > b), ">=": _compare(lambda a, b: a >= b),
    "==": _equal, "===": _equal, "!=": lambda a, b: 1.0 - _equal(a, b), "!==": lambda a, b: 1.0 - _equal(a, b),
    "&&": lambda a, b: F.when(_true(a), b).otherwise(a), "||": lambda a, b: F.when(_true(a), a).otherwise(b),
    "?": lambda t, a, b: F.when(_true(t), a).otherwise(b),
}


def _whole(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(N.finite(x) & (F.abs(x) < 1e15), f(F.when(N.finite(x) & (F.abs(x) < 1e15), x).otherwise(0.0)).cast("double")).otherwise(x)


def _extreme(f: Callable[..., Column]) -> Callable[..., Column]:
    """NaN if any argument is."""
    return lambda *a: F.when(reduce(lambda x, y: x | y, map(F.isnan, a)), float("nan")).otherwise(f(*a)) if len(a) > 1 else a[0]


_log = lambda f: lambda x: F.when(x > 0, f(x)).when(x == 0, float("-inf")).otherwise(float("nan"))
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "num": lambda x: F.nanvl(x, F.lit(0.0)),
    "DIV": lambda a, b, fb=None: N.div(F.nanvl(a, F.lit(0.0)), F.nanvl(b, F.lit(0.0)), F.lit(0.0) if fb is None else fb),
    "IFERROR": lambda v, fb=None: N.iferror(v, F.lit(0.0) if fb is None else fb),
    "Math.abs": F.abs, "Math.ceil": _whole(F.ceil), "Math.floor": _whole(F.floor), "Math.round": N.js_round, "Math.trunc": _whole(lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "Math.sqrt": F.sqrt, "Math.cbrt": F.cbrt, "Math.pow": F.pow, "Math.exp": F.exp, "Math.sign": F.signum,
    "Math.log": _log(F.ln), "Math.log10": _log(F.log10), "Math.log2": _log(F.log2),
    "Math.asin": F.asin, "Math.acos": F.acos, "Math.atan2": F.atan2, "Math.sinh": F.sinh, "Math.cosh": F.cosh, "Math.tanh": F.tanh,
    "Math.asinh": F.asinh, "Math.acosh": F.acosh, "Math.atanh": F.atanh, "Math.expm1": F.expm1,
    "Math.log1p": lambda x: F.when(x > -1, F.log1p(x)).when(x == -1, float("-inf")).otherwise(float("nan")),
    "Math.hypot": lambda *a: F.sqrt(reduce(lambda x, y: x + y, [x * x for x in a])), "Math.fround": lambda x: x.cast("float").cast("double"),
    "Math.sin": F.sin, "Math.cos": F.cos, "Math.tan": F.tan, "Math.atan": F.atan,
    "Math.min": _extreme(F.least), "Math.max": _extreme(F.greatest),
}


def lower(tree: Node, field: Callable[[str], Column]) -> Column:
    """The tree as a double Column; field(name) gives a field's number."""
    if tree[0] == "num":
        return F.lit(tree[1])
    if tree[0] == "field":
        return field(tree[1])
    try:
        return (FUNCTIONS if tree[0] == "call" else _OPERATORS)[tree[1]](*[lower(x, field) for x in tree[2]])
    except TypeError as e:
        raise FormulaError(f"wrong number of arguments for {tree[1]}") from e


def in_order(formulas: Mapping[str, Node]) -> tuple[list[str], set[str]]:
    """Formula names in an order in which each stands after those it uses, and those that can't be
    ordered: members of a cycle and what uses them. Their value is 0."""
    done: list[str] = []
    while ready := [n for n, t in formulas.items() if n not in done and all(f not in formulas or f in done for f in used(t))]:
        done += ready
    return done, set(formulas) - set(done)
