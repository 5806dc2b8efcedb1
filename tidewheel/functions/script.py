"""Scripts with statements, compiled to one expression and so to one Column.

    fn heat(x) { if x > 30 { "hot" } else { "cold" } }
    let doubled = v * 2;
    for i in 0..3 { doubled += i; }
    if doubled > limit { return heat(doubled); }
    "low"

`let`, `const`, assignments (`= += -= *= /=`), `if`/`else if`/`else` as statement and as value, `return`, `throw`,
functions, and `for` over ranges and lists whose bounds are known beforehand; the last expression is the value.
Variables become the expressions they hold, branches conditional expressions, loops repeat their body: nothing runs in
Python on a table. `while`, `loop` and closures would need a run for each row and raise. `Limits` bounds the expression's
size and the depth of calls, where an interpreter would count steps.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from . import cel
from .cel import CelError


class ScriptError(CelError):
    """The script can't be parsed, or is over a limit."""


@dataclass(frozen=True)
class Limits:
    operations: int | None = 100_000
    call_levels: int | None = 32


_TOKEN = re.compile(r"""\s*(?:(?P<skip>//[^\n]*|/\*.*?\*/)|(?P<num>\d+\.(?!\.)\d*(?:[eE][+-]?\d+)?|\d+)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|\.\.=?|[-+*/%<>!?:()\[\],.{};=]))""", re.S)
#: Names of calls, by the rule language's own name for them.
_CALLS = {"len": "size", "to_upper": "upperAscii", "to_lower": "lowerAscii", "starts_with": "startsWith", "ends_with": "endsWith", "to_float": "double", "to_int": "int", "to_string": "string", "ceiling": "ceil"}
_WORDS = {"while", "loop", "do", "switch", "try", "import", "export"}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ScriptError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return [*out, ("end", "")]


class _Parser(cel._Parser):
    """The rule language's expressions, with `if` as one, and statements: (kind, ...)."""

    def __init__(self, text: str):
        self.tokens, self.at, self.depth = _tokens(text), 0, 0
        self.functions: dict[str, tuple[list[str], list]] = {}

    def script(self) -> list:
        out = []
        while self.tokens[self.at][0] != "end":
            if self.peek() == "fn":
                self.function()
            else:
                out.append(self.statement())
        return out

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise ScriptError(f"expected a name, found {value!r}")
        return self.take()

    def function(self) -> None:
        self.take("fn")
        name, args = self.name(), []
        self.take("(")
        while self.peek() != ")":
            args.append(self.name())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        self.functions[name] = (args, self.block())

    def block(self) -> list:
        self.take("{")
        out = []
        while self.peek() != "}":
            if self.tokens[self.at][0] == "end":
                raise ScriptError("a block stays open")
            out.append(self.statement())
        self.take("}")
        return out

    def statement(self) -> tuple:
        word = self.peek()
        if word in _WORDS:
            raise ScriptError(f"{word!r} isn't supported")
        if word in ("let", "const"):
            self.take()
            name = self.name()
            self.take("=")
            out = ("let", name, self.ternary())
        elif word in ("return", "throw"):
            self.take()
            out = (word, ("lit", None) if self._ends() else self.ternary())
        elif word == "if":
            out = self.branch()
            if self.peek() == ";":
                self.take()
            return out
        elif word == "for":
            return self.loop()
        elif self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] in [("op", o) for o in ("=", "+=", "-=", "*=", "/=")]:
            name, sign = self.take(), self.take()
            value = self.ternary()
            out = ("set", name, value if sign == "=" else (sign[0], ("name", name), value))
        else:
            out = ("value", self.ternary())
        if self.peek() == ";":
            self.take()
            return ("do", *out[1:]) if out[0] == "value" else out
        if not self._ends():
            raise ScriptError(f"expected ';', found {self.tokens[self.at][1]!r}")
        return out

    def _ends(self) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "end" or (kind == "op" and value in (";", "}"))

    def branch(self) -> tuple:
        self.take("if")
        test = self.ternary()
        yes, no = self.block(), []
        if self.peek() == "else":
            self.take()
            no = [self.branch()] if self.peek() == "if" else self.block()
        return ("if", test, yes, no)

    def loop(self) -> tuple:
        self.take("for")
        name = self.name()
        self.take("in")
        first = self.ternary()
        if self.peek() in ("..", "..="):
            closed = self.take() == "..="
            first = ("range", first, self.ternary(), closed)
        return ("for", name, first, self.block())

    def primary(self) -> tuple:
        if self.peek() == "if" and self.tokens[self.at][0] == "name":
            return ("block", [self.branch()])
        return super().primary()


class Script:
    """A parsed script; node() is its expression."""

    def __init__(self, source: str, functions: dict[str, tuple] | None = None, limits: Limits = Limits()):  # noqa: B008  frozen
        p = _Parser(source)
        self.statements = p.script()
        self.functions, self.given, self.limits = p.functions, dict(functions or {}), limits
        self.node()

    def node(self) -> tuple:
        return _Run(self).block(self.statements, {}, 0)[0] or ("lit", None)


def _returns(statements: list) -> bool:
    return any(s[0] in ("return", "throw") or (s[0] == "if" and (_returns(s[2]) or _returns(s[3]))) or (s[0] == "for" and _returns(s[3])) for s in statements)


class _Run:
    """Runs statements over expressions instead of values."""

    def __init__(self, script: Script):
        self.script, self.made = script, 0

    def _made(self, node: tuple, size: int = 1) -> tuple:
        self.made += size
        if self.script.limits.operations is not None and self.made > self.script.limits.operations:
            raise ScriptError(f"more than {self.script.limits.operations} operations")
        return node

    def block(self, statements: list, env: dict, level: int) -> tuple[tuple | None, dict]:
        """The value of the last expression (or of a return) and the variables after it."""
        for i, s in enumerate(statements):
            kind, rest = s[0], statements[i + 1 :]
            if kind in ("let", "set"):
                if kind == "set" and s[1] not in env:
                    raise ScriptError(f"{s[1]!r} isn't a variable")
                env = env | {s[1]: self.put(s[2], env, level)}
            elif kind == "return":
                return self.put(s[1], env, level), env
            elif kind == "throw":
                return ("throw", self.put(s[1], env, level)), env
            elif kind == "do":
                self.put(s[1], env, level)
            elif kind == "value":
                return self.put(s[1], env, level), env
            elif kind == "for":
                turns = [("let", s[1], n) for n in self.turns(s[2], env, level)]
                return self.block([t for turn in turns for t in (turn, *[("do", *x[1:]) if x[0] == "value" else x for x in s[3]])] + rest, env, level)
            else:
                test = self.put(s[1], env, level)
                if not rest or _returns(s[2]) or _returns(s[3]):  # each side goes on by itself
                    (yes, ye), (no, ne) = (self.block([*self._void(side, rest), *rest], env, level) for side in s[2:])
                    return self._made(("?", test, yes or ("lit", None), no or ("lit", None))), self._merge(test, env, ye, ne)
                (_, ye), (_, ne) = (self.block(side, env, level) for side in s[2:])
                env = self._merge(test, env, ye, ne)
        return None, env

    @staticmethod
    def _void(side: list, rest: list) -> list:
        """A side whose last value isn't the block's, as statements follow."""
        return [("do", *x[1:]) if x[0] == "value" else x for x in side] if rest else side

    def _merge(self, test: tuple, env: dict, yes: dict, no: dict) -> dict:
        return {k: v if yes[k] is v and no[k] is v else self._made(("?", test, yes[k], no[k])) for k, v in env.items()}

    def turns(self, over: tuple, env: dict, level: int) -> list[tuple]:
        if over[0] == "range":
            ends = [self.put(e, env, level) for e in over[1:3]]
            if any(e[0] != "lit" or not isinstance(e[1], int) for e in ends):
                raise ScriptError("a range needs bounds that are known beforehand")
            n = ends[1][1] + over[3] - ends[0][1]
            self._made(over, max(0, n))
            return [("lit", i) for i in range(ends[0][1], ends[0][1] + n)]
        items = self.put(over, env, level)
        if items[0] != "list":
            raise ScriptError("`for` goes over lists that are known beforehand")
        return items[1]

    def put(self, node: tuple, env: dict, level: int) -> tuple:
        """The expression with variables and functions put in."""
        op = node[0]
        if op == "lit":
            return node
        if op == "name":
            return self._made(env.get(node[1], node), self._size(env[node[1]]) if node[1] in env else 1)
        if op == "block":
            return self.block(node[1], env, level)[0] or ("lit", None)
        if op == "list":
            return ("list", [self.put(n, env, level) for n in node[1]])
        if op == "field":
            return self._made(("field", self.put(node[1], env, level), node[2]))
        if op == "call":
            args = [self.put(n, env, level) for n in node[2]] if node[1] != "has" else node[2]
            return self.call(node[1], args, level)
        return self._made((op, *[self.put(n, env, level) for n in node[1:]]))

    def call(self, name: str, args: list[tuple], level: int) -> tuple:
        if name in self.script.functions:
            if self.script.limits.call_levels is not None and level >= self.script.limits.call_levels:
                raise ScriptError(f"calls deeper than {self.script.limits.call_levels}")
            takes, body = self.script.functions[name]
            if len(takes) != len(args):
                raise ScriptError(f"{name} takes {len(takes)} arguments")
            return self.block(body, dict(zip(takes, args, strict=True)), level + 1)[0] or ("lit", None)
        if name in self.script.given:
            return self._made(("apply", self.script.given[name], args))
        return self._made(("call", _CALLS.get(name, name), args))

    def _size(self, node: tuple) -> int:
        parts = node[2] if node[0] in ("call", "apply") else node[1] if node[0] == "list" else node[1:]
        return 1 + sum(self._size(p) for p in parts if isinstance(p, tuple) and p and isinstance(p[0], str))


def registered(name: str, f: Callable, kind: str) -> tuple:
    """A function over Columns for scripts; kind: of its value, one of int, num, str, bool."""
    if kind not in ("int", "num", "str", "bool"):
        raise ValueError(f"unknown kind {kind!r}")
    return name, f, kind


def thrown(node: tuple) -> tuple:
    """The message that a script throws on a row, null where it doesn't."""
    if node[0] == "throw":
        return node[1]
    if node[0] == "?":
        return ("?", node[1], thrown(node[2]), thrown(node[3]))
    return ("lit", None)
