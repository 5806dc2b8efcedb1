"""Policies in the rule syntax of packages, defaults, conditions and sets, compiled to Columns.

    package access
    default allow := false
    floor := 10
    allow if { input.role == data.admin_role }
    allow if { not suspended; input.score > floor }
    suspended if input.state in {"off", "held"}
    deny contains msg if { input.score < 0; msg := "negative" }
    big(x) if x > 100

Bodies are conditions, one a line or apart by `;`; all must hold. Rules of one name are alternatives, the first whose
body holds gives the value. `name := value`, `not`, `some x in list`, `list[_]`, membership, sets and arrays, functions
of one body, `else`, static `data`, other packages' rules as `data.package.rule`, and the built-ins of `_BUILTINS` are
there; comprehensions, `with`, `every` and objects are not, and raise when the policy is added. What can't be decided
doesn't hold, so `not` of it does. Rules can't be recursive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .cel import CelError, parse


class PolicyError(ValueError):
    """The policy can't be parsed."""


#: Built-ins, by the rule language's own name for them.
_BUILTINS = {"startswith": "startsWith", "endswith": "endsWith", "contains": "contains", "lower": "lowerAscii", "upper": "upperAscii", "count": "size", "abs": "abs", "to_number": "double", "floor": "floor", "ceil": "ceil"}
_UNSUPPORTED = re.compile(r"\b(with|every|import rego\.v0)\b")
_HEAD = re.compile(r"(?P<name>[A-Za-z_]\w*)(?:\((?P<args>[^()]*)\)|\[(?P<key>[^\]]+)\]|\s+contains\s+(?P<member>.+?))?(?:\s*:?=\s*(?P<value>.+?))?\s*", re.S)
TRUE, ANY = ("lit", True), ("name", "_")
_BOOLEAN = {"==", "!=", "<", "<=", ">", ">=", "&&", "||", "not", "in", "truth", "has"}


@dataclass
class Alternative:
    args: list[str]
    value: tuple
    body: list[tuple[str, object, tuple]]  # kind, variable, expression


@dataclass
class Definition:
    alternatives: list[Alternative] = field(default_factory=list)
    members: bool = False
    default: tuple | None = None


def _bare(text: str) -> str:
    """The text with strings and comments blanked, of equal length."""
    return re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|#[^\n]*", lambda m: " " * len(m[0]) if m[0][0] == "#" else "x" * len(m[0]), text)


def _split(text: str) -> list[str]:
    """Statements apart by newlines and `;` outside of brackets."""
    bare, out, depth, start = _bare(text), [], 0, 0
    for i, c in enumerate(bare):
        depth += (c in "({[") - (c in ")}]")
        if depth < 0:
            raise PolicyError("a bracket closes that isn't open")
        if depth == 0 and c in "\n;":
            out.append((start, i))
            start = i + 1
    if depth:
        raise PolicyError("a bracket stays open")
    said = ["".join(c if b != " " or c.isspace() else " " for c, b in zip(text[a:b_], bare[a:b_], strict=True)).strip() for a, b_ in [*out, (start, len(text))]]
    return [s for s in said if s]


def _expression(text: str) -> tuple:
    bare = _bare(text)
    if _UNSUPPORTED.search(bare) or re.search(r"[\[{][^\]}]*[^|]\|[^|]", bare) or re.search(r"\{[^}]*:(?!=)", bare):
        raise PolicyError(f"not supported: {text}")
    listed = "".join({"{": "[", "}": "]"}.get(c, c) if b in "{}" else c for c, b in zip(text, bare, strict=True))
    listed = re.sub(r"`([^`]*)`", lambda m: '"' + m[1].replace("\\", "\\\\").replace('"', '\\"') + '"', listed)
    try:
        return parse(listed)
    except CelError as e:
        raise PolicyError(f"{text}: {e}") from e


def _body(text: str) -> list[tuple[str, object, tuple]]:
    out = []
    for s in _split(text):
        if m := re.fullmatch(r"some\s+(\w+)\s+in\s+(.+)", s, re.S):
            out.append(("some", m[1], _expression(m[2])))
        elif m := re.fullmatch(r"(\w+)\s*:=\s*(.+)", s, re.S):
            out.append(("let", m[1], _expression(m[2])))
        elif m := re.fullmatch(r"not\s+(.+)", s, re.S):
            out.append(("not", None, _expression(m[1])))
        else:
            out.append(("holds", None, _expression(s)))
    return out


class Module:
    """One package's rules."""

    def __init__(self, text: str):
        said = _split(text)
        if not said or not (m := re.fullmatch(r"package\s+([\w.]+)", said[0])):
            raise PolicyError("a policy begins with its package")
        self.package, self.rules = m[1], {}
        for s in said[1:]:
            if not re.match(r"import\s", s):
                self._rule(s)

    def _rule(self, text: str) -> None:
        if m := re.fullmatch(r"default\s+(\w+)\s*:?=\s*(.+)", text, re.S):
            self.rules.setdefault(m[1], Definition()).default = _expression(m[2])
            return
        head, *rest = self._parts(text)
        m = _HEAD.fullmatch(head[0])
        if not m or m["name"] == "else":
            raise PolicyError(f"not a rule: {head[0]}")
        d = self.rules.setdefault(m["name"], Definition())
        member = m["member"] or m["key"]
        d.members = d.members or member is not None
        args = [a.strip() for a in (m["args"] or "").split(",") if a.strip()]
        d.alternatives.append(Alternative(args, _expression(member or m["value"] or "true"), _body(head[1])))
        for said, body in rest:
            e = re.fullmatch(r"else(?:\s*:?=\s*(.+?))?\s*", said, re.S)
            if not e or d.members:
                raise PolicyError(f"not a rule: {said}")
            d.alternatives.append(Alternative(args, _expression(e[1] or "true"), _body(body)))

    @staticmethod
    def _parts(text: str) -> list[tuple[str, str]]:
        """(head, body) of a rule and of each `else` after it."""
        out = []
        while text:
            bare = _bare(text)
            plain = re.match(r"[^{]*?\sif\s+(?![\s{])", bare)
            block = re.search(r"(?:\sif)?\s*\{", bare)
            if plain and (not block or plain.end() <= block.start() + 1):
                out.append((text[: plain.end()].rstrip().removesuffix("if").rstrip(), text[plain.end() :]))
                return out
            if not block or re.search(r":?=\s*$", bare[: block.start()]) or re.search(r"\bin\s*$", bare[: block.start()]):
                out.append((text, ""))  # no body: a constant, its value perhaps a set
                return out
            depth, end = 0, None
            for i in range(block.end() - 1, len(bare)):
                depth += (bare[i] == "{") - (bare[i] == "}")
                if depth == 0:
                    end = i
                    break
            out.append((text[: block.start()].strip(), text[block.end() : end]))
            text = text[end + 1 :].strip()
        return out


class Policies:
    """Modules by package and static data; compiles a query `data.package.rule` to an expression."""

    def __init__(self):
        self.modules: dict[str, list[Module]] = {}

    def add(self, text: str) -> Module:
        m = Module(text)
        self.modules.setdefault(m.package, []).append(m)
        return m

    def definition(self, package: str, name: str) -> Definition | None:
        found = [m.rules[name] for m in self.modules.get(package, []) if name in m.rules]
        if not found:
            return None
        defaults = [d.default for d in found if d.default is not None]
        return Definition([a for d in found for a in d.alternatives], any(d.members for d in found), defaults[0] if defaults else None)

    def query(self, path: str, data: dict) -> tuple:
        package, _, name = path.removeprefix("data.").rpartition(".")
        if self.definition(package, name) is None:
            raise KeyError(path)
        return _Compiler(self, data).rule(package, name, ())


class _Compiler:
    def __init__(self, policies: Policies, data: dict):
        self.policies, self.data = policies, data

    def rule(self, package: str, name: str, within: tuple, args: list[tuple] = ()) -> tuple:
        if (package, name) in within:
            raise PolicyError(f"{package}.{name} asks for itself")
        d = self.policies.definition(package, name)
        within = (*within, (package, name))
        ways = []
        for a in d.alternatives:
            if len(a.args) != len(args):
                raise PolicyError(f"{name} takes {len(a.args)} arguments")
            ways += self.body(a, package, within, dict(zip(a.args, args, strict=True)))
        if d.members:
            return ("collect", *[p for w in ways for p in w])
        out = self.within(d.default, package, within, {}) if d.default is not None else ("lit", None)
        for holds, value in reversed(ways):
            out = value if holds == TRUE else ("?", holds, value, out)
        return out

    def body(self, a: Alternative, package: str, within: tuple, bound: dict) -> list[tuple[tuple, tuple]]:
        """(condition, value) of each way in which the body may hold: `some` over a static list gives one for each member."""
        ways = [(TRUE, dict(bound))]
        for kind, name, node in a.body:
            after = []
            for holds, env in ways:
                e = self.within(node, package, within, env)
                if kind == "let":
                    after.append((holds, env | {name: e}))
                elif kind == "some":
                    if e[0] != "list":
                        raise PolicyError("`some` goes over lists that are known beforehand")
                    after += [(holds, env | {name: item}) for item in e[1]]
                else:
                    test = ("truth", self._told(e))
                    test = ("not", test) if kind == "not" else test
                    after.append((test if holds == TRUE else ("&&", holds, test), env))
            ways = after
        return [(holds, self.within(a.value, package, within, env)) for holds, env in ways]

    @staticmethod
    def _told(e: tuple) -> tuple:
        """A condition that is a value holds where the value is there and not false."""
        if e[0] in _BOOLEAN or e[0] == "lit" and isinstance(e[1], bool):
            return e
        return ("&&", ("has", e), ("not", ("isfalse", e)))

    def within(self, node: tuple, package: str, within: tuple, env: dict) -> tuple:
        """The expression with variables, data, input and rules put in."""
        op = node[0]
        again = lambda n: self.within(n, package, within, env)
        if op == "lit":
            return node
        if op == "name":
            if node[1] in env:
                return env[node[1]]
            if self.policies.definition(package, node[1]):
                return self.rule(package, node[1], within)
            raise PolicyError(f"unknown name {node[1]!r}")
        if op in ("field", "index") and (path := self._path(node)) is not None:
            return self._known(path, package, within)
        if op in ("field", "index"):
            return (op, again(node[1]), node[2] if op == "field" else again(node[2]))
        if op == "list":
            return ("list", [again(n) for n in node[1]])
        if op == "call":
            return self._call(node, package, within, env)
        if op == "==":  # list[_] == x: some member is x
            for a, b in (node[1:], node[:0:-1]):
                if a[0] == "index" and a[2] == ANY:
                    return ("in", again(b), again(a[1]))
        parts = [again(n) for n in node[1:]]
        if op == "in" and parts[1][0] == "lit":
            raise PolicyError("`in` needs a list")
        return (op, *parts)

    def _call(self, node: tuple, package: str, within: tuple, env: dict) -> tuple:
        name, args = node[1], node[2]
        if name == "match" and len(args) == 3 and args[0] == ("name", "regex"):
            pattern, text = (self.within(n, package, within, env) for n in args[1:])
            return ("call", "matches", [text, pattern])
        args = [self.within(n, package, within, env) for n in args]
        if self.policies.definition(package, name):
            return self.rule(package, name, within, args)
        if name not in _BUILTINS:
            raise PolicyError(f"unknown function {name!r}")
        return ("call", _BUILTINS[name], args)

    @staticmethod
    def _path(node: tuple) -> list[str] | None:
        """input.a.b or data.a.b as its parts; None if it begins otherwise or holds an index that isn't a string."""
        parts = []
        while node[0] in ("field", "index"):
            key = node[2] if node[0] == "field" else node[2][1] if node[2][0] == "lit" else None
            if not isinstance(key, str):
                return None
            parts.append(key)
            node = node[1]
        return [node[1], *reversed(parts)] if node[0] == "name" and node[1] in ("input", "data") else None

    def _known(self, path: list[str], package: str, within: tuple) -> tuple:
        if path[0] == "input":
            out = ("name", path[1])
            for p in path[2:]:
                out = ("field", out, p)
            return out
        if self.policies.definition(".".join(path[1:-1]), path[-1]):
            return self.rule(".".join(path[1:-1]), path[-1], within)
        held = self.data
        for p in path[1:]:
            held = held.get(p) if isinstance(held, dict) else None
        if isinstance(held, dict):
            raise PolicyError(f"{'.'.join(path)} is an object")
        return ("list", [("lit", v) for v in held]) if isinstance(held, list) else ("lit", held)
