"""Combinators of streams: merges, window joins, thinning, batches, partitions, groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .keyed import Emitter, emit


def merge_by_timestamp(streams: list[DataFrame], ts: str, order: str) -> DataFrame:
    """All rows by time; ties by stream and order. Adds `source`, the stream's number."""
    if not streams:
        raise ValueError("no streams to merge")
    out = None
    for i, s in enumerate(streams):
        one = s.withColumn("source", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(ts, "source", order)


def _beside(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, window: int, carried: Column, make: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """left with the columns of make(a bucket's rows by time), which see `__row`, what is carried of a right row.

    Both sides are one table in buckets of time as wide as the window: a right row goes to its own bucket and its
    neighbours, a left row to its own. Frames over a bucket see all that is in reach, so no pair is shuffled or sorted.
    """
    made = make(Window.partitionBy("__b").orderBy("__t"))
    if clash := set(made) & set(left.columns):
        raise ValueError(f"outputs named like columns: {', '.join(sorted(clash))}")
    bucket = lambda c: F.floor(F.col(c) / F.lit(max(1, window))).cast("bigint")
    near = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__left"), F.col(left_ts).alias("__t"), bucket(left_ts).alias("__b"))
    far = right.filter(F.col(right_ts).isNotNull()).select(F.col(right_ts).alias("__t"), carried.alias("__row"), F.explode(F.array(*[bucket(right_ts) + i for i in (-1, 0, 1)])).alias("__b"))
    rows = near.unionByName(far, allowMissingColumns=True)
    return rows.withColumns(made).filter(F.col("__left").isNotNull()).select("__left.*", *[F.col(f"`{n}`") for n in made])


def window_join(left: DataFrame, right: DataFrame, left_id: str, left_ts: str, right_ts: str, window: int, collect: list[str]) -> DataFrame:
    """Each left row with `matches`, an array of the right rows within `window` on either side (both ends included).

    Left rows without a match keep an empty array. Where only numbers of the matches are wanted, window_totals()
    doesn't make the arrays, which together hold every pair. left_id may repeat.
    """
    reach = max(0, window)

    def make(at: WindowSpec) -> dict[str, Column]:
        held = F.collect_list(F.when(F.col("__row").isNotNull() & F.lit(window >= 0), F.struct(F.col("__t"), F.col("__row")))).over(at.rangeBetween(-reach, reach))
        return {"matches": F.transform(F.sort_array(held), lambda m: m["__row"])}

    return _beside(left, right, left_ts, right_ts, reach, F.struct(*collect), make)


def window_totals(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, window: int, sums: dict[str, str]) -> DataFrame:
    """Each left row with `n`, the number of right rows within `window` on either side, and sums of their columns.

    sums: output name to a right column. Times and these columns are whole numbers: a total is a running one less
    an earlier one, in constant time a row however many rows are in reach. Without matches, totals are 0.
    """
    if window < 0:
        raise ValueError("a window can't be negative")
    whole = ("tinyint", "smallint", "int", "bigint")
    for df, c in [(left, left_ts), (right, right_ts), *[(right, c) for c in sums.values()]]:
        if (kind := dict(df.dtypes)[c]) not in whole:
            raise ValueError(f"{c} is {kind}; whole numbers are needed")

    def make(at: WindowSpec) -> dict[str, Column]:
        until, before = at.rangeBetween(Window.unboundedPreceding, window), at.rangeBetween(Window.unboundedPreceding, -window - 1)
        total = lambda c: F.coalesce(F.sum(c).over(until), F.lit(0)) - F.coalesce(F.sum(c).over(before), F.lit(0))
        return {"n": F.count("__row").over(until) - F.count("__row").over(before)} | {n: total(F.col("__row")[n]) for n in sums}

    rows = [F.col(f"`{c}`").cast("bigint").alias(n) for n, c in sums.items()]
    return _beside(*[d.withColumn(c, F.col(f"`{c}`").cast("bigint")) for d, c in ((left, left_ts), (right, right_ts))], left_ts, right_ts, window, F.struct(*rows, F.lit(True).alias("__is")), make)


def keyed_window_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, left_ts: Column, right_ts: Column, window: int) -> DataFrame:
    """Pairs of equal key with the right row's time in [left, left + window].

    Rows meet by key and a bucket of time as wide as the window, so a hot key is many tasks' work; a right row goes to
    its own bucket and the one before.
    """
    bucket = lambda c: F.floor(c / F.lit(max(1, window))).cast("bigint")
    near = left.withColumn("__left_bucket", bucket(left_ts))
    far = right.withColumn("__right_bucket", F.explode(F.array(bucket(right_ts), bucket(right_ts) - 1)))
    met = near.join(far, (left_key == right_key) & (F.col("__left_bucket") == F.col("__right_bucket")) & (right_ts >= left_ts) & (right_ts <= left_ts + window))
    return met.drop("__left_bucket", "__right_bucket")


class _Dedupe(Emitter):
    """Also a rate limit: a row is kept if `window` has passed since the last kept one."""

    def __init__(self, window: int):
        self.window, self.last = window, None

    def record(self, ts, row):
        if self.last is not None and ts - self.last < self.window:
            return []
        self.last = ts
        return [row]


class _KeepLast(Emitter):
    """Trailing throttle: the newest of a span comes out when the next span begins, and at the end."""

    def __init__(self, interval: int):
        self.interval, self.last, self.pending = interval, None, None

    def record(self, ts, row):
        out = []
        if self.last is None:
            self.last = ts
            return [row]
        if self.pending is not None and ts - self.last >= self.interval:
            out.append(self.pending[1])
            self.last = self.pending[0]
        self.pending = (ts, row)
        return out

    def flush(self):
        return [self.pending[1]] if self.pending is not None else []


def _thin(df: DataFrame, keys: list[str], ts: str, order: str, make) -> DataFrame:
    columns = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    return emit(df, keys, [ts, order], ts, make, columns, ", ".join(f"`{c}` {types[c]}" for c in [*keys, *columns]))


def dedupe_by_key(df: DataFrame, key: str, ts: str, order: str, window: int) -> DataFrame:
    """Drops rows less than `window` after the key's last kept row; dropped rows don't prolong the wait."""
    return _thin(df, [key], ts, order, lambda: _Dedupe(window))


def rate_limit(df: DataFrame, ts: str, order: str, interval: int, key: str | None = None) -> DataFrame:
    """The first row, then the next at least `interval` after the last kept one; without a key the whole table is one stream (one task)."""
    return _thin(df, [key] if key else [], ts, order, lambda: _Dedupe(interval))


def rate_limit_keep_last(df: DataFrame, ts: str, order: str, interval: int, key: str | None = None) -> DataFrame:
    return _thin(df, [key] if key else [], ts, order, lambda: _KeepLast(interval))


def batch_by_time(df: DataFrame, key: str, ts: str, arrival: str, interval: int, collect: list[str]) -> DataFrame:
    """key, bucket, items: runs of consecutive arrivals of one bucket; a row out of order splits a batch."""
    step = max(1, interval)
    w = Window.partitionBy(key).orderBy(arrival)
    d = df.withColumn("__b", F.call_function("div", F.col(ts), F.lit(step)) * step)
    d = d.withColumn("__new", F.coalesce((F.col("__b") != F.lag("__b").over(w)).cast("int"), F.lit(1)))
    d = d.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = d.groupBy(key, "__run").agg(F.first("__b").alias("bucket"), F.sort_array(F.collect_list(F.struct(F.col(arrival).alias("__a"), F.struct(*collect).alias("__row")))).alias("__m"))
    return held.select(key, F.col("__run").alias("batch"), "bucket", F.transform("__m", lambda m: m["__row"]).alias("items"))


def partition(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """Rows on which the predicate is true, and all others."""
    holds = F.coalesce(pred, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def partition_lazy(df: DataFrame, pred: Column, name: str = "matched") -> DataFrame:
    return df.withColumn(name, F.coalesce(pred, F.lit(False)))


def partition_by(pred: Column) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """partition() to be called on a table."""
    return lambda df: partition(df, pred)


def partition_lazy_by(pred: Column, name: str = "matched") -> Callable[[DataFrame], DataFrame]:
    """partition_lazy() for DataFrame.transform."""
    return lambda df: partition_lazy(df, pred, name)


def fork(df: DataFrame, n: int) -> list[DataFrame]:
    """The same lazy table n times."""
    return [df] * n


def group_by_key(df: DataFrame, key: str, arrival: str, collect: list[str]) -> DataFrame:
    """key, items in order of arrival."""
    held = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(arrival).alias("__a"), F.struct(*collect).alias("__row")))).alias("__m"))
    return held.select(key, F.transform("__m", lambda m: m["__row"]).alias("items"))
