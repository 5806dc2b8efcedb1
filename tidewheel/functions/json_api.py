"""compute_indicator: operators by name with a JSON configuration, over rows given as JSON or as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import operators  # noqa: F401  attaches the operators to Series
from ..operators.combinators import keyed_window_join
from ..plans import Count, Flow, Time

#: Names and how their configuration is read.
_WINDOWED = ("sma", "sum", "count", "min", "max", "variance", "std", "median", "rank", "skewness", "kurtosis", "wma", "ema", "rsi", "zscore", "dc_remove", "normalize_range", "stochastic_k")
_PERIOD = ("rsi_wilder", "momentum", "rate_of_change", "williams_r_n", "cci_n", "trima", "dema_n", "tema_n", "trix_n", "kama_n", "cmo_n", "linearreg_slope_n")
_PLAIN = ("prev", "cumsum", "cummax", "cummin", "cumprod", "cummean", "pct_change", "log_return", "peak_decline", "rate", "acceleration", "abs", "sqrt", "ln", "log10", "log2", "exp", "floor", "ceil", "round")


def indicator(x, config: dict) -> dict:
    """Outputs by name of an indicator over a series."""
    name = config["indicator"]
    window = Time(config["windowMs"]) if "windowMs" in config else Count(config.get("period", config.get("window", 14)))
    if name in _WINDOWED:
        return {name: getattr(x, name)(window)}
    if name in _PERIOD:
        return {name: getattr(x, name)(int(config.get("period", 14)))}
    if name in _PLAIN:
        return {name: getattr(x, name)()}
    if name == "bollinger":
        return dict(zip(("middle", "upper", "lower"), x.bollinger_bands(window, float(config.get("k", 2.0))), strict=True))
    if name == "macd":
        return dict(zip(("line", "signal", "histogram"), x.macd_n(int(config.get("fast", 12)), int(config.get("slow", 26)), int(config.get("signal", 9))), strict=True))
    if name == "cross":
        return {"cross": x.cross(float(config["threshold"]))}
    if name == "quantile":
        return {"quantile": x.quantile(window, float(config["q"]))}
    raise ValueError(f"unknown indicator {name!r}")


def compute_indicator(df: DataFrame, config: dict | str, ts: str = "ts", value: str = "value", key: str | None = None, order: str | None = None, unique_ts: bool = False) -> DataFrame:
    """The rows with the indicator's outputs as columns."""
    config = json.loads(config) if isinstance(config, str) else config
    flow = Flow(df, ts, key, order or (), unique_ts=unique_ts)
    return flow.select(**indicator(flow.prop(value), config))


def compute_json(spark: SparkSession, rows_json: str, config_json: str) -> str:
    """The same from a JSON array of {ts, value} to a JSON array with the outputs; for small inputs."""
    rows = json.loads(rows_json)
    df = spark.createDataFrame([(i, int(r["ts"]), float(r["value"])) for i, r in enumerate(rows)], "seq bigint, ts bigint, value double")
    out = compute_indicator(df, config_json, order="seq").orderBy("seq").drop("seq")
    return json.dumps([r.asDict() for r in out.collect()])


def detect_cross_json(spark: SparkSession, rows_json: str, config_json: str) -> str:
    """{ts, value, direction} of the crossings of config's threshold; direction `rising`, `falling` or `both`."""
    c, rows = json.loads(config_json), json.loads(rows_json)
    wanted = c.get("direction", "both").lower()
    if wanted not in ("rising", "falling", "both"):
        raise ValueError(f"unknown direction {wanted!r}")
    df = spark.createDataFrame([(i, int(r["ts"]), float(r["value"])) for i, r in enumerate(rows)], "seq bigint, ts bigint, value double")
    out = compute_indicator(df, {"indicator": "cross", "threshold": c["threshold"]}, order="seq")
    hits = out.withColumn("direction", F.lower("cross")).filter("direction in ('rising', 'falling')")
    if wanted != "both":
        hits = hits.filter(F.col("direction") == wanted)
    return json.dumps([{"ts": r["ts"], "value": r["value"], "direction": r["direction"]} for r in hits.orderBy("seq").collect()])


def evaluate_rules_json(rules: str, items_json: str, yaml: bool = False) -> str:
    """{item_id, matched_rules} of each item of a JSON array, its fields flat; for small inputs. Rules are JSON, or YAML."""
    from .cel import parse, true_on
    from .rules import RuleEngine

    engine = RuleEngine.from_yaml(rules) if yaml else RuleEngine.from_json(rules)
    conditions = [(r.name, parse(r.condition)) for r in engine.rules]
    items = json.loads(items_json)
    return json.dumps([{"item_id": str(item.get("id", i)), "matched_rules": [n for n, c in conditions if true_on(c, item)]} for i, item in enumerate(items)])


def tumbling_json(spark: SparkSession, rows_json: str, config_json: str) -> str:
    """{windowStart, windowEnd, count, sum} of the rows that the allowed lateness accepts."""
    from ..operators.keyed import tumbling_sum_count

    c, rows = json.loads(config_json), json.loads(rows_json)
    df = spark.createDataFrame([("", i, int(r["ts"]), float(r["value"])) for i, r in enumerate(rows)], "key string, seq bigint, ts bigint, value double")
    out = tumbling_sum_count(df, "key", "ts", "seq", "value", int(c["sizeMs"]), int(c.get("allowedLatenessMs", 0))).orderBy("window_start")
    return json.dumps([{"windowStart": r["window_start"], "windowEnd": r["window_end"], "count": r["count"], "sum": r["sum"]} for r in out.collect()])


def window_join_keyed(left: DataFrame, right: DataFrame, key: str, ts: str, window: int) -> DataFrame:
    """Pairs of equal key (a missing one counts as empty) with the right row up to `window` later, and deltaMs."""
    l2 = left.select(*[F.col(c).alias(f"left_{c}") for c in left.columns])
    r2 = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns])
    k = lambda side: F.coalesce(F.col(f"{side}_{key}").cast("string"), F.lit(""))
    met = keyed_window_join(l2, r2, k("left"), k("right"), F.col(f"left_{ts}"), F.col(f"right_{ts}"), window)
    return met.withColumn("deltaMs", F.col(f"right_{ts}") - F.col(f"left_{ts}"))
