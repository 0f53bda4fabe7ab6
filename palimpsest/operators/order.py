"""Positions, running aggregates and earlier rows over an order, without one task for a key or for all rows.

Keys of up to RANGE_ROWS rows are windows of their own.  The rows of larger keys, and of an order without keys, are dealt
by ranges of the order: each range works on its own, in a window of one key and range, and what the ranges before amount
to (a row for each key and range) is added, so a key that holds most rows is spread over all ranges.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written

#: Rows of a key that one task takes.
RANGE_ROWS = 2_000_000


def _quantiles(df: DataFrame, column: str, parts: int) -> list[float]:
    at = [i / parts for i in range(1, parts)]
    return df.select(F.col(column).cast("double").alias("o")).where("o is not null").stat.approxQuantile("o", at, 0.1 / parts) if at else []


def range_of(df: DataFrame, order: list[str], parts: int | None = None) -> Column:
    """The range of each row, from 0, by its first order column, and by the second where one value of the first has more than a range.

    A range is named by bounds drawn once, so that all reads agree even if a task runs again.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = Counter(_quantiles(df, order[0], parts))
    bounds: list[tuple[float, float]] = []
    for value, times in sorted(drawn.items()):
        bounds.append((value, float("inf")))
        if times > 1 and len(order) > 1:
            own = df.where(F.col(order[0]).cast("double") == value)
            bounds += [(value, b) for b in sorted(set(_quantiles(own, order[1], times)))]
    if not bounds:
        return F.lit(0)
    if all(b == float("inf") for _, b in bounds):
        return _below(F.array(*[F.lit(a) for a, _ in bounds]), len(bounds), F.col(order[0]).cast("double"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    steps = F.array(*[pair(F.lit(a), F.lit(b)) for a, b in sorted(bounds)])
    second = F.coalesce(F.col(order[1]).cast("double"), F.lit(float("-inf"))) if len(order) > 1 else F.lit(0.0)
    return _below(steps, len(bounds), pair(F.coalesce(F.col(order[0]).cast("double"), F.lit(float("-inf"))), second))


def _below(bounds: Column, n: int, value: Column) -> Column:
    """How many of ``n`` sorted bounds are below a value, by halving: a row takes log n steps, not n."""
    halves = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) < value, step).otherwise(0))


def by_crowd(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys of up to RANGE_ROWS rows, and those of larger keys (None if there are none)."""
    crowd = written(df.groupBy(*keys).count().where(F.col("count") > RANGE_ROWS).drop("count"), "crowd")
    if crowd.isEmpty():
        return df, None
    crowd = crowd.select(*[F.col(k).alias(f"_crowd{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_crowd{i}")) for i, k in enumerate(keys)])
    return df.join(crowd, same, "left_anti"), df.join(crowd, same, "left_semi")


def with_running(df: DataFrame, order: list[str], made: dict[str, tuple[str, str]], keys: list[str] | None = None, parts: int | None = None, before: bool = False) -> DataFrame:
    """Columns over the rows up to and with this one (``before``: without it) of its key, in order.

    ``made`` maps a name to (kind, expression); the kind is ``sum``, ``max``, or ``last`` for the last value that is not null.
    Ties of the order must agree, except in sums, whose order among them is open.
    """
    keys = keys or []
    if keys and parts is None:
        small, large = by_crowd(df, keys)
        few = _windowed(small, order, made, keys, before)
        return few if large is None else few.unionByName(_ranged(large, order, made, keys, parts, before))
    return _ranged(df, order, made, keys, parts, before)


def _call(kind: str, x: str) -> str:
    return {"sum": f"sum({x})", "max": f"max({x})", "last": f"last({x}, true)"}[kind]


def _windowed(df: DataFrame, order: list[str], made: dict[str, tuple[str, str]], keys: list[str], before: bool) -> DataFrame:
    frame = f"over (partition by {', '.join(f'`{k}`' for k in keys)} order by {', '.join(order)} rows between unbounded preceding and {'1 preceding' if before else 'current row'})"
    of = {n: F.expr(f"{_call(kind, x)} {frame}") for n, (kind, x) in made.items()}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[(F.coalesce(c, F.lit(0)) if made[n][0] == "sum" else c).alias(n) for n, c in of.items()])


def _ranged(df: DataFrame, order: list[str], made: dict[str, tuple[str, str]], keys: list[str], parts: int | None, before: bool) -> DataFrame:
    by = ", ".join(f"`{k}`" for k in [*keys, "_range"])
    frame = f"over (partition by {by} order by {', '.join(order)} rows between unbounded preceding and {'1 preceding' if before else 'current row'})"
    ranged = df.withColumn("_range", range_of(df, order, parts))
    place = F.struct(*order)
    total = {
        name: F.max_by(F.expr(x), F.when(F.expr(x).isNotNull(), place)) if kind == "last" else F.expr(_call(kind, x)) for name, (kind, x) in made.items()
    }
    sums = ranged.groupBy(*keys, "_range").agg(*[c.alias(f"_{n}") for n, c in total.items()])
    # A row for each key and range: windows of no more rows than there are ranges.
    above = f"over ({'partition by ' + ', '.join(f'`{k}`' for k in keys) if keys else ''} order by _range rows between unbounded preceding and 1 preceding)"
    sums = sums.select(*keys, "_range", *[F.expr(f"{_call(kind, f'_{n}')} {above}").alias(f"_{n}") for n, (kind, _) in made.items()])
    out = ranged.select("*", *[F.expr(f"{_call(kind, x)} {frame}").alias(f"_own_{n}") for n, (kind, x) in made.items()])
    same = F.col("l._range") == F.col("r._range")
    for k in keys:
        same &= F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`"))
    joined = out.alias("l").join(sums.alias("r"), same)
    joined_by = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "last": lambda a, b: F.coalesce(b, a)}
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns if c not in made], *[joined_by[kind](F.col(f"r._{n}"), F.col(f"l._own_{n}")).alias(n) for n, (kind, _) in made.items()])


def with_running_sum(df: DataFrame, order: list[str], value: str, name: str, parts: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``name``: the sum of ``value`` up to and with this row."""
    return with_running(df, order, {name: ("sum", value)}, keys, parts)


def with_position(df: DataFrame, order: list[str], name: str, start: int = 1, parts: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """``name``: consecutive numbers from ``start``, for each key."""
    out = with_running(df, order, {name: ("sum", "1L")}, keys, parts)
    return out.withColumn(name, F.col(name) + (start - 1))
