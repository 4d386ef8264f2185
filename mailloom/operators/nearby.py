"""Joins in time: the last row before another (as-of), and rows near each other, both cut by time so that no party is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (seconds * 1_000_000))


def asof(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, seconds: int, inclusive: bool = True) -> DataFrame:
    """``left`` with ``last``: the row of ``right`` of the same ``by`` with the latest time before (or at) its own; null if none.

    ``right`` is unique by (``by``, time). One shuffle by (``by``, bucket of time) for a sort inside each bucket; what
    a bucket inherits comes from a summary of one row for each bucket. Null keys and times meet nothing.
    """
    fields = F.struct(*[F.col(c) for c in right.columns])
    none = F.lit(None).cast(right.select(fields.alias("r")).schema["r"].dataType)
    own = left.select(F.col(by).alias("k"), F.col(left_ts).alias("t"), F.struct("*").alias("l"), none.alias("r"), F.lit(1 if inclusive else 0).alias("side"))
    other = right.where(F.col(by).isNotNull() & F.col(right_ts).isNotNull()).select(F.col(by).alias("k"), F.col(right_ts).alias("t"), F.lit(None).cast(own.schema["l"].dataType).alias("l"), fields.alias("r"), F.lit(0 if inclusive else 1).alias("side"))
    rows = own.unionByName(other).withColumn("b", bucket(F.col("t"), seconds))
    inside = Window.partitionBy("k", "b").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    summary = rows.where("k is not null and t is not null").groupBy("k", "b").agg(F.max_by("r", F.when(F.col("r").isNotNull(), F.col("t"))).alias("newest"))
    ahead = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select("k", "b", F.last("newest", ignorenulls=True).over(ahead).alias("carried"))
    found = rows.withColumn("here", F.last("r", ignorenulls=True).over(inside)).where("l is not null").join(carried, ["k", "b"], "left")
    met = F.col("k").isNotNull() & F.col("t").isNotNull()
    return found.select("l.*", F.when(met, F.coalesce("here", "carried")).alias("last"))


def near(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """(l, r): rows of the same ``by`` at most ``seconds`` apart, as structs. Inner: rows that meet nothing are not there.

    Buckets are ``seconds`` long; a right row is in its own and both neighbours, so each pair meets in
    the left row's bucket once, and a party's rows are spread over its buckets.
    """
    a = left.select(F.struct("*").alias("l"), F.col(by).alias("k"), bucket(F.col(left_ts), seconds).alias("b"))
    b = bucket(F.col(right_ts), seconds)
    other = right.select(F.struct("*").alias("r"), F.col(by).alias("k"), F.explode(F.array(b - 1, b, b + 1)).alias("b"))
    apart = F.unix_micros(F.col(f"l.{left_ts}").cast("timestamp")) - F.unix_micros(F.col(f"r.{right_ts}").cast("timestamp"))
    return a.join(other, ["k", "b"]).where(F.abs(apart) <= seconds * 1_000_000).select("l", "r")
