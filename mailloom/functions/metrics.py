"""Metrics as column expressions. ``undefined`` names what a ratio over nothing is: zero, nan or null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.operators.rounds import written


def ratio(a: Column, b: Column, undefined: str = "null") -> Column:
    value = F.try_divide(a.cast("double"), b.cast("double"))
    return {"null": value, "zero": F.coalesce(value, F.lit(0.0)), "nan": F.coalesce(value, F.lit(float("nan")))}[undefined]


def f1(p: Column, r: Column) -> Column:
    """0 when both are 0; null or NaN when one is."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval; (0, 1) when n is 0."""
    n = n.cast("double")
    p = F.try_divide(k.cast("double"), n)
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), middle - half))
    return low, F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), middle + half))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, by the rule floor(x * 10**d + 0.5) / 10**d."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def probability_bin(p: Column, bins: int = 10) -> Column:
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def nearest_ranks(df: DataFrame, by: list[str], value: str, ranks: dict[str, float | tuple[float, Callable[[Column], Column]]], whole: Callable[[Column], Column] = F.bround) -> DataFrame:
    """For each group and each p of ``ranks`` (name: p, or p and its own ``whole``) the value at index whole(p * (n - 1)) of the sorted values.

    A mergeable sketch brackets all ranks to within 2 / 10,000 of the rows in one pass; in a second one rows below
    the brackets are counted and only those inside are grouped by value, so no group's values are gathered. Nulls do not count.
    """
    asked = {n: r if isinstance(r, tuple) else (r, whole) for n, r in ranks.items()}
    edges = [x for p, _ in asked.values() for x in (max(0.0, p - 2e-4), min(1.0, p + 2e-4))]
    v = F.col(value)
    rows = df.where(v.isNotNull())
    sketch = rows.groupBy(*by).agg(F.count(value).alias("__n"), F.percentile_approx(value, edges, 10_000).alias("__near"))
    each = [F.struct(F.lit(name).alias("name"), f(F.lit(p) * (F.col("__n") - 1)).cast("long").alias("rank"), F.col("__near")[2 * i].alias("low"), F.col("__near")[2 * i + 1].alias("high")) for i, (name, (p, f)) in enumerate(asked.items())]
    bounds = sketch.select(*by, F.array(*each).alias("__asked"))
    rows = rows.join(bounds, by) if by else rows.crossJoin(F.broadcast(bounds))  # one row
    # a row below a bracket is counted under a null value, one inside under its own, one above nowhere
    told = F.filter("__asked", lambda b: v <= b["high"])
    place = rows.select(*by, F.explode(told).alias("__b"), v.alias("__v")).select(*by, "__b.name", "__b.rank", F.when(F.col("__v") >= F.col("__b.low"), F.col("__v")).alias("__v"))
    counts = place.groupBy(*by, "name", "rank", "__v").agg(F.count("*").alias("__k"))
    ahead = F.sum("__k").over(Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("__v")))
    found = counts.withColumn("__upto", ahead).where(F.col("__v").isNotNull() & (F.col("__upto") > F.col("rank"))).groupBy(*by, "name").agg(F.min("__v").alias("__v"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in asked])


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place from 1 in an order, without one task for all rows: places inside ranges, and how many rows lie in the ranges before."""
    placed = written(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")  # the range's number and the place in it
    part = F.shiftrightunsigned("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each range
    out = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return out.select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1).alias(name))
