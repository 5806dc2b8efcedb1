"""A rule expression language: the CEL subset of rules, patterns and scripts.

Literals, fields, `== != < <= > >= && || ! + - * / % in ?:`, lists, `has(f)`, `size(x)`, string methods
(`contains`, `startsWith`, `endsWith`, `matches`), `int() double() string()`, `abs() min() max()`. An
expression compiles to a Column (the rule then runs in the JVM) or is evaluated on a dict (for predicates that
look at earlier captures). An error or a missing field makes the whole expression null, and a null rule is
false; `&&` and `||` need only the side that decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

MAX_LENGTH, MAX_DEPTH = 1024, 32


class CelError(ValueError):
    """The expression can't be parsed."""


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+[uU]?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%<>!?:()\[\],.]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, str]]:
    if len(text) > MAX_LENGTH:
        raise CelError(f"longer than {MAX_LENGTH} characters")
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise CelError(f"unexpected {text[at]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser:
    LEVELS = (("||",), ("&&",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("*", "/", "%"))

    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _tokens(text), 0, 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.tokens[self.at][0] in ("op", "name", "end") else ""

    def take(self, want: str | None = None) -> str:
        kind, value = self.tokens[self.at]
        if want is not None and (kind == "str" or value != want):
            raise CelError(f"expected {want!r}, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> tuple:
        out = self.ternary()
        if self.tokens[self.at][0] != "end":
            raise CelError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def ternary(self) -> tuple:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise CelError(f"nested deeper than {MAX_DEPTH}")
        test = self.binary(0)
        if self.peek() == "?" and self.tokens[self.at][0] == "op":
            self.take()
            yes = self.ternary()
            self.take(":")
            test = ("?", test, yes, self.ternary())
        self.depth -= 1
        return test

    def binary(self, level: int) -> tuple:
        if level == len(self.LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in self.LEVELS[level]:
            left = (self.take(), left, self.binary(level + 1))
        return left

    def unary(self) -> tuple:
        if self.peek() in ("!", "-") and self.tokens[self.at][0] == "op":
            self.depth += 1
            if self.depth > MAX_DEPTH:
                raise CelError(f"nested deeper than {MAX_DEPTH}")
            out = ("not" if self.take() == "!" else "neg", self.unary())
            self.depth -= 1
            return out
        return self.postfix()

    def postfix(self) -> tuple:
        out = self.primary()
        while self.peek() in (".", "[") and self.tokens[self.at][0] == "op":
            if self.take() == "[":
                out = ("index", out, self.ternary())
                self.take("]")
            else:
                name = self.take()
                out = ("call", name, [out, *self.arguments()]) if self.peek() == "(" else ("field", out, name)
        return out

    def arguments(self) -> list[tuple]:
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.ternary())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return args

    def primary(self) -> tuple:
        kind, value = self.tokens[self.at]
        if kind == "num":
            self.at += 1
            return ("lit", int(value.rstrip("uU")) if re.fullmatch(r"\d+[uU]?", value) else float(value))
        if kind == "str":
            self.at += 1
            return ("lit", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1]))
        if kind == "name":
            self.at += 1
            if value in ("true", "false"):
                return ("lit", value == "true")
            if value == "null":
                return ("lit", None)
            return ("call", value, self.arguments()) if self.peek() == "(" and self.tokens[self.at][0] == "op" else ("name", value)
        if value == "(":
            self.take()
            out = self.ternary()
            self.take(")")
            return out
        if value == "[":
            self.take()
            items = []
            while self.peek() != "]":
                items.append(self.ternary())
                if self.peek() != "]":
                    self.take(",")
            self.take("]")
            return ("list", items)
        raise CelError(f"unexpected {value!r}")


def parse(text: str) -> tuple:
    return _Parser(text).whole()


def names(node: tuple) -> set[str]:
    """The free names of an expression; a nested field counts as its first name."""
    if node[0] == "name":
        return {node[1]}
    parts = node[2] if node[0] in ("call", "apply") else node[1] if node[0] == "list" else node[1:]
    return set().union(*(names(p) for p in parts if isinstance(p, tuple)), set())


_METHODS = {"contains", "startsWith", "endsWith", "matches", "size", "has", "int", "double", "string", "abs", "min", "max", "lowerAscii", "upperAscii"}


def column_of(node: tuple, types: dict[str, str]) -> Column:
    return _column(node, types)[0]


def condition_of(node: tuple, types: dict[str, str]) -> Column:
    """As a filter: whatever isn't true is false."""
    return _column(("truth", node), types)[0]


def to_column(text: str, types: dict[str, str]) -> Column:
    """The expression as a Column; types: the columns that exist. Null where it errs."""
    return _column(parse(text), types)[0]


def predicate(text: str, types: dict[str, str]) -> Column:
    """As a filter: whatever isn't true is false."""
    c, kind = _column(parse(text), types)
    return F.coalesce(c, F.lit(False)) if kind == "bool" else F.lit(False)


_INT = {"tinyint", "smallint", "int", "bigint"}


def _kind(t: str) -> str:
    return "int" if t in _INT else "num" if t in ("double", "float") or t.startswith("decimal") else "bool" if t == "boolean" else "str" if t == "string" else "other"


def _column(node: tuple, types: dict[str, str]) -> tuple[Column, str]:
    op = node[0]
    null = (F.lit(None), "null")
    if op == "lit":
        v = node[1]
        return F.lit(v), "null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "num" if isinstance(v, float) else "str"
    if op == "name":
        return (F.col(f"`{node[1]}`"), _kind(types[node[1]])) if node[1] in types else null
    if op == "field":
        return (F.col(f"`{node[1][1]}`.`{node[2]}`"), "other") if node[1][0] == "name" and node[1][1] in types else null
    if op == "call" and node[1] == "has":
        arg = node[2][0]
        name = arg[1] if arg[0] == "name" else arg[2]
        return (F.col(f"`{name}`").isNotNull() if name in types else F.lit(False)), "bool"
    if op == "not":
        c, k = _column(node[1], types)
        return (~c, "bool") if k == "bool" else null
    if op == "neg":
        c, k = _column(node[1], types)
        return (-c, k) if k in ("int", "num") else null
    if op == "?":
        (t, tk), (a, ak), (b, bk) = (_column(n, types) for n in node[1:])
        if tk != "bool":
            return null
        if "null" in (ak, bk) or ak == bk or {ak, bk} == {"int", "num"}:
            return F.when(t, a).when(~t, b), "num" if {ak, bk} == {"int", "num"} else bk if ak == "null" else ak
        if "list" in (ak, bk):  # a column holds one type only
            return null
        return F.when(t, a.cast("string")).when(~t, b.cast("string")), "str"
    if op in ("&&", "||"):
        (a, ak), (b, bk) = _column(node[1], types), _column(node[2], types)
        a, b = (c if k == "bool" else F.lit(None).cast("boolean") for c, k in ((a, ak), (b, bk)))
        return (a & b if op == "&&" else a | b), "bool"
    if op == "list":
        return F.array(*[_column(n, types)[0] for n in node[1]]), "list"
    if op == "in":
        (a, _), (b, bk) = _column(node[1], types), _column(node[2], types)
        return (F.array_contains(b, a), "bool") if bk in ("list", "other") else null
    if op in ("==", "!=", "<", "<=", ">", ">="):
        (a, ak), (b, bk) = _column(node[1], types), _column(node[2], types)
        comparable = ak == bk or {ak, bk} <= {"int", "num"} or "other" in (ak, bk)
        if not comparable:  # different types are unequal; their order is an error
            return (F.lit(op == "!="), "bool") if op in ("==", "!=") and "null" not in (ak, bk) else null
        return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], "bool"
    if op in ("+", "-", "*", "/", "%"):
        (a, ak), (b, bk) = _column(node[1], types), _column(node[2], types)
        if op == "+" and ak == bk == "str":
            return F.concat(a, b), "str"
        if not {ak, bk} <= {"int", "num"}:
            return null
        if ak == bk == "int":
            a, b = a.cast("bigint"), b.cast("bigint")
            if op == "/":
                return F.when(b != 0, _div(a, b)), "int"
            if op == "%":
                return F.try_mod(a, b), "int"
            return {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), "int"
        a, b = a.cast("double"), b.cast("double")
        if op == "%":
            return null
        from .absent import divide

        return (divide(a, b) if op == "/" else {"+": a + b, "-": a - b, "*": a * b}[op]), "num"
    if op == "index":
        (a, _), (i, _) = _column(node[1], types), _column(node[2], types)
        return F.get(a, i.cast("int")), "other"
    if op == "call":
        return _call_column(node[1], [_column(n, types) for n in node[2]]) or null
    # what policies and scripts compile to, beyond the language itself
    if op == "truth":  # true, or else false
        c, k = _column(node[1], types)
        return (F.coalesce(c, F.lit(False)) if k == "bool" else F.lit(False)), "bool"
    if op == "collect":  # the distinct values whose conditions hold: condition, value, condition, value ...
        held = [F.when(_column(("truth", t), types)[0], _column(v, types)[0]) for t, v in zip(node[1::2], node[2::2], strict=True)]
        return F.array_distinct(F.array_compact(F.array(*held))), "list"
    if op == "apply":  # a registered function over Columns
        return node[1][1](*[_column(n, types)[0] for n in node[2]]), node[1][2]
    if op == "has":
        c, k = _column(node[1], types)
        return (c.isNotNull() if k != "null" else F.lit(False)), "bool"
    if op == "isfalse":
        c, k = _column(node[1], types)
        return (F.coalesce(~c, F.lit(False)) if k == "bool" else F.lit(False)), "bool"
    if op == "throw":
        return null
    raise CelError(f"unknown {op!r}")


def _div(a: Column, b: Column) -> Column:
    """Integer division towards zero."""
    return F.call_function("div", a, F.when(b != 0, b).otherwise(F.lit(1)))


def _call_column(name: str, args: list[tuple[Column, str]]) -> tuple[Column, str] | None:
    c = [a[0] for a in args]
    k = [a[1] for a in args]
    if name in ("contains", "startsWith", "endsWith", "matches") and k == ["str", "str"]:
        return {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith, "matches": F.rlike}[name](*c), "bool"
    if name == "size" and len(c) == 1:
        return (F.length(c[0]) if k[0] == "str" else F.size(c[0])).cast("bigint"), "int"
    if name in ("lowerAscii", "upperAscii") and k == ["str"]:
        return (F.lower if name == "lowerAscii" else F.upper)(c[0]), "str"
    if name in ("int", "double", "string") and len(c) == 1:
        to = {"int": "bigint", "double": "double", "string": "string"}[name]
        return c[0].try_cast(to), {"int": "int", "double": "num", "string": "str"}[name]
    if name == "abs" and k[0] in ("int", "num"):
        return F.abs(c[0]), k[0]
    if name in ("floor", "ceil") and k in (["int"], ["num"]):
        return (F.floor if name == "floor" else F.ceil)(c[0].cast("double")).cast("double"), "num"
    if name == "sqrt" and k in (["int"], ["num"]):
        return F.when(c[0] >= 0, F.sqrt(c[0].cast("double"))), "num"
    if name in ("min", "max") and len(c) > 1:
        return (F.least if name == "min" else F.greatest)(*c), k[0]
    return None


class _Fail(Exception):
    pass


def evaluate(node: tuple, env: dict):
    """The value on a dict; raises _Fail (see `true_on`) where the expression errs."""
    op = node[0]
    if op == "lit":
        return node[1]
    if op == "name":
        if env.get(node[1]) is None:
            raise _Fail(node[1])
        return env[node[1]]
    if op == "field":
        try:
            return evaluate(node[1], env)[node[2]]
        except (KeyError, TypeError) as e:
            raise _Fail from e
    if op == "call" and node[1] == "has":
        arg = node[2][0]
        return env.get(arg[1] if arg[0] == "name" else arg[2]) is not None
    if op in ("&&", "||"):
        decides = op == "||"
        seen = []
        for n in node[1:]:
            try:
                v = evaluate(n, env)
            except _Fail:
                v = None
            if v is decides:
                return decides
            seen.append(v)
        if any(not isinstance(v, bool) for v in seen):
            raise _Fail(op)
        return not decides
    if op == "?":
        t = evaluate(node[1], env)
        if not isinstance(t, bool):
            raise _Fail(op)
        return evaluate(node[2] if t else node[3], env)
    if op == "list":
        return [evaluate(n, env) for n in node[1]]
    if op == "truth":
        return true_on(node[1], env)
    if op == "collect":
        held = [value_on(v, env) for t, v in zip(node[1::2], node[2::2], strict=True) if true_on(t, env)]
        return list(dict.fromkeys(v for v, error in held if error is None and v is not None))
    if op in ("has", "isfalse"):
        v, error = value_on(node[1], env)
        return (error is None and v is not None) if op == "has" else v is False
    if op in ("throw", "apply"):
        raise _Fail(op)
    args = [evaluate(n, env) for n in (node[2] if op == "call" else node[1:])]
    try:
        return (_CALLS[node[1]] if op == "call" else _OPS[op])(*args)
    except (TypeError, KeyError, ValueError, ZeroDivisionError, IndexError, OverflowError) as e:
        raise _Fail(op) from e


def _number(f: Callable, whole: Callable | None = None) -> Callable:
    def run(a, b):
        if isinstance(a, bool) or isinstance(b, bool):
            raise TypeError
        if isinstance(a, int) and isinstance(b, int) and whole:
            return whole(a, b)
        return f(a, b)

    return run


def _order(f: Callable) -> Callable:
    def run(a, b):
        if isinstance(a, str) != isinstance(b, str) or isinstance(a, bool) != isinstance(b, bool):
            raise TypeError
        return f(a, b)

    return run


def _float_div(a: float, b: float) -> float:
    if b:
        return a / b
    return float("nan") if not a or a != a else float("inf") if a > 0 else float("-inf")


def _mod(a, b):
    if not (isinstance(a, int) and isinstance(b, int)):
        raise TypeError
    return int(math.fmod(a, b))


_OPS: dict[str, Callable] = {
    "not": lambda a: (not a) if isinstance(a, bool) else _raise(), "neg": lambda a: -a if not isinstance(a, (bool, str)) else _raise(),
    "==": lambda a, b: type(a) is type(b) and a == b or (not isinstance(a, (bool, str)) and not isinstance(b, (bool, str)) and a == b),
    "!=": lambda a, b: not _OPS["=="](a, b), "<": _order(lambda a, b: a < b), "<=": _order(lambda a, b: a <= b), ">": _order(lambda a, b: a > b), ">=": _order(lambda a, b: a >= b),
    "in": lambda a, b: a in b, "index": lambda a, i: a[i],
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(lambda x, y: x + y)(a, b), "-": _number(lambda a, b: a - b), "*": _number(lambda a, b: a * b),
    "/": _number(_float_div, lambda a, b: int(a / b)), "%": _mod,
}
_CALLS: dict[str, Callable] = {
    "contains": lambda a, b: b in a, "startsWith": lambda a, b: a.startswith(b), "endsWith": lambda a, b: a.endswith(b), "matches": lambda a, b: re.search(b, a) is not None,
    "floor": lambda a: float(math.floor(a)), "ceil": lambda a: float(math.ceil(a)), "sqrt": lambda a: math.sqrt(a),
    "size": len, "int": lambda a: int(float(a)) if not isinstance(a, int) else int(a), "double": float, "string": str, "abs": abs, "min": min, "max": max, "lowerAscii": lambda a: a.lower(), "upperAscii": lambda a: a.upper(),
}


def _raise():
    raise TypeError


def true_on(node: tuple, env: dict) -> bool:
    """Whether the expression is true; an error or another type is false."""
    try:
        return evaluate(node, env) is True
    except _Fail:
        return False


def value_on(node: tuple, env: dict):
    """(value, error) of the expression."""
    try:
        return evaluate(node, env), None
    except _Fail as e:
        return None, str(e) or "error"
