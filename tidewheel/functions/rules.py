"""Rule engines over DataFrames: filters, prioritised rules with actions, policies, named scripts.

Everything compiles to Columns; a rule that errs on a row is false there, and a policy denies.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from .cel import CelError, column_of, condition_of, parse, predicate, to_column
from .policy import Policies
from .script import Limits, Script, registered, thrown

ACTIONS = ("log", "alert", "record", "tag", "ignore", "custom")


def _types(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


def cel_filter(df: DataFrame, expr: str) -> DataFrame:
    """Rows on which the expression is true; a bad expression raises at once."""
    return df.filter(predicate(expr, _types(df)))


def cel_filter_result(df: DataFrame, expr: str) -> DataFrame:
    """All rows with `passed` and `error`: `not a bool or failed` where there is no true or false."""
    try:
        c = to_column(expr, _types(df)).cast("boolean")
    except CelError as e:
        return df.withColumns({"passed": F.lit(None).cast("boolean"), "error": F.lit(str(e))})
    return df.withColumns({"passed": c, "error": F.when(c.isNull(), "evaluation failed")})


@dataclass(frozen=True)
class Rule:
    name: str
    condition: str
    action: str = "log"
    params: dict = field(default_factory=dict)
    priority: int | None = None
    enabled: bool = True

    def __post_init__(self):
        if self.action not in ACTIONS:
            raise ValueError(f"unknown action {self.action!r}")
        parse(self.condition)


class RuleEngine:
    """Rules by ascending priority, without one last, ties in the order they were added; disabled ones are left out."""

    def __init__(self, rules: list[Rule] = ()):
        self.rules: list[Rule] = []
        for r in rules:
            self.add_rule(r)

    def add_rule(self, rule: Rule) -> RuleEngine:
        if rule.enabled:
            self.rules = sorted([*self.rules, rule], key=lambda r: (r.priority is None, r.priority or 0))
        return self

    @classmethod
    def from_config(cls, config: dict | list) -> RuleEngine:
        rows = config.get("rules", []) if isinstance(config, dict) else config
        return cls([Rule(r["name"], r.get("condition", r.get("expression", "")), r.get("action", "log"), r.get("params", {}), r.get("priority"), r.get("enabled", True)) for r in rows])

    @classmethod
    def from_json(cls, text: str) -> RuleEngine:
        return cls.from_config(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str) -> RuleEngine:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("YAML rules need the yaml package") from e
        return cls.from_config(yaml.safe_load(text))

    @classmethod
    def from_file(cls, path: str) -> RuleEngine:
        text = Path(path).read_text()
        return cls.from_json(text) if path.endswith(".json") else cls.from_yaml(text)

    def matched(self, df: DataFrame) -> Column:
        """array<struct<rule, action, params, priority>> of the rules that hold, in order."""
        types = _types(df)
        one = [F.when(predicate(r.condition, types), F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(json.dumps(r.params, sort_keys=True)).alias("params"), F.lit(r.priority).cast("int").alias("priority"))) for r in self.rules]
        if not one:
            return F.array().cast("array<struct<rule:string,action:string,params:string,priority:int>>")
        return F.array_compact(F.array(*one))

    def evaluate(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rules", self.matched(df))

    def evaluate_first(self, df: DataFrame) -> DataFrame:
        return df.withColumn("rule", F.get(self.matched(df), 0))


def cel_route(df: DataFrame, engine: RuleEngine) -> DataFrame:
    """Each row with its rules."""
    return engine.evaluate(df)


def cel_route_matched(df: DataFrame, engine: RuleEngine) -> DataFrame:
    """Rows that some rule matches."""
    return engine.evaluate(df).filter(F.size("rules") > 0)


def evaluate_rules(df: DataFrame, rules_json: str, id_col: str = "id") -> DataFrame:
    """item_id, matched_rules (names)."""
    engine = RuleEngine.from_json(rules_json)
    return df.select(F.col(id_col).alias("item_id"), F.transform(engine.matched(df), lambda r: r["rule"]).alias("matched_rules"))


@dataclass(frozen=True)
class PolicyConfig:
    """budget_ms: 0 answers nothing, every row is out of time; more bounds nothing, since policies have no loops."""

    budget_ms: int | None = None

    def __post_init__(self):
        if self.budget_ms is not None and self.budget_ms < 0:
            raise ValueError("a budget can't be negative")


class PolicyEngine:
    """Policies over rows and static data; what no rule allows is denied.

    Packages of rules (see functions.policy) are asked for by `data.<package>.<rule>`; the row is their `input`.
    Beside them there are plain named policies: a name and alternatives, expressions that read scalar data as
    `data_<name>`.
    """

    def __init__(self):
        self.policies: dict[str, list[str]] = {}
        self.packages = Policies()
        self.data: dict[str, object] = {}

    def add_policy(self, name: str, rules: list[str] | str) -> PolicyEngine:
        """A package's text (it begins with `package`), or a named policy's alternatives."""
        if isinstance(rules, str) and re.match(r"(\s|#[^\n]*\n)*package\s", rules):
            self.packages.add(rules)
            return self
        rules = [rules] if isinstance(rules, str) else list(rules)
        for r in rules:
            parse(r)
        self.policies.setdefault(name, []).extend(rules)
        return self

    def add_policy_from_file(self, path: str) -> PolicyEngine:
        """A package, or from JSON named policies."""
        if not path.endswith(".json"):
            return self.add_policy(Path(path).stem, Path(path).read_text())
        for name, rules in json.loads(Path(path).read_text()).items():
            self.add_policy(name, rules)
        return self

    def add_policy_directory(self, path: str) -> PolicyEngine:
        for p in sorted(Path(path).iterdir()):
            if p.suffix in (".json", ".rego"):
                self.add_policy_from_file(str(p))
        return self

    def add_data(self, data: dict) -> PolicyEngine:
        self.data.update(data)
        return self

    def add_data_from_file(self, path: str) -> PolicyEngine:
        return self.add_data(json.loads(Path(path).read_text()))

    def _with_data(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"data_{k}": F.lit(v) for k, v in self.data.items() if not isinstance(v, (dict, list))}) if self.data else df

    def filter(self, df: DataFrame, query: str, config: PolicyConfig = PolicyConfig()) -> DataFrame:  # noqa: B008  frozen
        return self.filter_result(df, query, config).filter("allowed").drop("allowed", "error")

    def filter_result(self, df: DataFrame, query: str, config: PolicyConfig = PolicyConfig()) -> DataFrame:  # noqa: B008
        """All rows with `allowed`, and `error` where no rule could be decided."""
        if config.budget_ms == 0:
            return df.withColumns({"allowed": F.lit(False), "error": F.lit("out of time")})
        if query.startswith("data."):
            try:
                node = self.packages.query(query, self.data)
            except KeyError:
                return df.withColumns({"allowed": F.lit(False), "error": F.lit(f"unknown query {query}")})
            types = _types(df)
            decided = condition_of(("has", node), types)
            return df.withColumns({"allowed": condition_of(node, types), "error": F.when(~decided, "evaluation failed")})
        if query not in self.policies:
            return df.withColumns({"allowed": F.lit(False), "error": F.lit(f"unknown query {query}")})
        d = self._with_data(df)
        types = _types(d)
        each = [to_column(r, types).cast("boolean") for r in self.policies[query]]
        allowed, failed = F.lit(False), F.lit(True)
        for c in each:
            allowed, failed = allowed | F.coalesce(c, F.lit(False)), failed & c.isNull()
        out = d.withColumns({"allowed": allowed, "error": F.when(failed, "evaluation failed")})
        return out.drop(*[c for c in d.columns if c not in df.columns])

    def value(self, df: DataFrame, query: str, name: str = "value") -> DataFrame:
        """The value of a package's rule (for a set its members as an array), null where it has none."""
        return df.withColumn(name, column_of(self.packages.query(query, self.data), _types(df)))


class ScriptEngine:
    """Named scripts (see functions.script): filters, projections and enrichments of rows."""

    def __init__(self, limits: Limits = Limits()):  # noqa: B008  frozen
        self.scripts: dict[str, str] = {}
        self.functions: dict[str, tuple] = {}
        self.limits = limits

    def register(self, name: str, f: Callable[..., Column], kind: str) -> ScriptEngine:
        """A function over Columns that scripts may call; kind: of its value, one of int, num, str, bool."""
        self.functions[name] = registered(name, f, kind)
        return self

    def compile(self, name: str, source: str) -> ScriptEngine:
        self._script(source)
        self.scripts[name] = source
        return self

    def load_file(self, path: str) -> ScriptEngine:
        return self.compile(Path(path).stem, Path(path).read_text())

    def load_directory(self, path: str, suffix: str = ".rhai") -> ScriptEngine:
        for p in sorted(Path(path).glob(f"*{suffix}")):
            self.load_file(str(p))
        return self

    def source(self, script: str) -> str:
        return self.scripts.get(script, script)

    def _script(self, source: str) -> tuple:
        return Script(source, self.functions, self.limits).node()

    def _node(self, script: str) -> tuple:
        return self._script(self.source(script))

    def eval(self, df: DataFrame, script: str) -> Column:
        return column_of(self._node(script), _types(df))

    def filter(self, df: DataFrame, script: str) -> DataFrame:
        return df.filter(condition_of(self._node(script), _types(df)))

    def map(self, df: DataFrame, script: str, name: str = "value") -> DataFrame:
        """Only the script's value; null where it errs."""
        return df.select(self.eval(df, script).alias(name))

    def enrich(self, df: DataFrame, script: str, name: str = "value") -> DataFrame:
        return df.withColumn(name, self.eval(df, script))

    def result(self, df: DataFrame, script: str, name: str = "value") -> DataFrame:
        """The row, the value, and `error` where there is none: what the script throws, or that it failed."""
        node, types = self._node(script), _types(df)
        c = column_of(node, types)
        said = column_of(("call", "string", [thrown(node)]), types)
        return df.withColumns({name: c, "error": F.when(c.isNull(), F.coalesce(said, F.lit("evaluation failed")))})

    def filter_result(self, df: DataFrame, script: str) -> DataFrame:
        """All rows with `passed`, and `error` where the script gives no true or false."""
        out = self.result(df, script, "passed")
        if dict(out.dtypes)["passed"] == "boolean":
            return out
        return out.withColumns({"passed": F.lit(None).cast("boolean"), "error": F.coalesce("error", F.lit("not a bool"))})

    def map_result(self, df: DataFrame, script: str, name: str = "value") -> DataFrame:
        """Only the value and `error`."""
        return self.result(df, script, name).select(name, "error")

    def enrich_result(self, df: DataFrame, script: str, name: str = "value") -> DataFrame:
        return self.result(df, script, name)
