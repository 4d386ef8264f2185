"""Structural detectors: overlaps, order and timing of commitments, drift against a party's own past, calibration."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)


def overlaps(intervals: DataFrame, resource: str, start: str, end: str, key: str) -> DataFrame:
    """(resource, key, n_overlaps): how many other intervals [start, end) of its resource each interval meets.

    Others that start before its end, less those that end by its start: two running
    counts over one sort, so no pair of intervals is ever made. Intervals are not empty.
    """
    edges = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("opens")), F.struct(F.col(end).alias("t"), F.lit(0).alias("opens")))
    events = intervals.select(resource, key, F.explode(edges).alias("e")).select(resource, key, "e.t", "e.opens")
    upto = Window.partitionBy(resource).orderBy("t", "opens").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("started", F.sum("opens").over(upto)).withColumn("ended", F.sum(1 - F.col("opens")).over(upto))
    met = F.max(F.when(F.col("opens") == 0, F.col("started"))) - F.max(F.when(F.col("opens") == 1, F.col("ended"))) - 1
    return seen.groupBy(resource, key).agg(met.alias("n_overlaps"))


def early_successors(steps: DataFrame, chain: str, order: list[str], start: str, end: Column) -> DataFrame:
    """``steps`` whose start lies before the end of the step ahead of them in their chain."""
    w = Window.partitionBy(chain).orderBy(*order)
    return steps.withColumn("previous_end", F.lag(end).over(w)).where(F.col(start) < F.col("previous_end"))


def against_own_past(rows: DataFrame, who: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with number and sum of the values that their author had before, and the last of them."""
    past = Window.partitionBy(who).orderBy(*order).rowsBetween(*BEFORE)
    last = Window.partitionBy(who).orderBy(*order)
    return rows.withColumns({"past_n": F.count(value).over(past), "past_sum": F.coalesce(F.sum(value).over(past), F.lit(0)), "previous": F.lag(value).over(last)})


def silences(rows: DataFrame, who: str, ts: str, order: str, factor: int = 3, least: int = 3) -> DataFrame:
    """Rows whose gap in whole seconds to the one before is over ``factor`` times the mean of the ``least`` or more gaps before it."""
    w = Window.partitionBy(who).orderBy(ts, order)
    gap = F.unix_timestamp(F.col(ts).cast("timestamp")) - F.unix_timestamp(F.lag(F.col(ts).cast("timestamp")).over(w))
    out = against_own_past(rows.withColumn("gap", gap), who, [ts, order], "gap")
    return out.where((F.col("past_n") >= least) & (F.col("gap") * F.col("past_n") > factor * F.col("past_sum")))


def matched(rows: DataFrame, id_col: str, detectors: dict[str, Column]) -> DataFrame:
    """(id, n_matched, first): how many detectors match, and the first by name."""
    hits = F.filter(F.array(*[F.when(d, F.lit(n)) for n, d in sorted(detectors.items())]), lambda x: x.isNotNull())
    return rows.select(id_col, F.size(hits).alias("n_matched"), F.get(hits, F.lit(0)).alias("first"))


def association(rows: DataFrame, signal: str, outcome: str) -> DataFrame:
    """(signal, n11, n10, n01, n00, chi2) of each signal value with a boolean outcome over all rows."""
    totals = rows.agg(F.count("*").alias("n"), F.count_if(outcome).alias("yes"))
    by = rows.groupBy(signal).agg(F.count("*").alias("m"), F.count_if(outcome).alias("n11")).crossJoin(F.broadcast(totals))  # one row
    cells = by.select(signal, "n11", (F.col("m") - F.col("n11")).alias("n10"), (F.col("yes") - F.col("n11")).alias("n01"), (F.col("n") - F.col("m") - F.col("yes") + F.col("n11")).alias("n00"))
    a, b, c, d = (F.col(x).cast("double") for x in ("n11", "n10", "n01", "n00"))
    return cells.withColumn("chi2", F.try_divide((a + b + c + d) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d)))


def calibrated(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """``preds`` with ``p_calibrated``, isotonic in p_positive, fitted on the labelled ones."""
    features = VectorAssembler(inputCols=["p_positive"], outputCol="__p", handleInvalid="skip")
    rated = labels.where(F.col("label").isin("positive", "negative"))
    known = preds.join(rated, "id").select("p_positive", (F.col("label") == "positive").cast("double").alias("__y"))
    model = IsotonicRegression(featuresCol="__p", labelCol="__y", predictionCol="p_calibrated").fit(features.transform(known))
    return model.transform(features.transform(preds)).drop("__p")


def stale(rows: DataFrame, who: str, order: list[str], ts: str, assumed: Column, used: Column, days: int) -> DataFrame:
    """Rows that use an assumption whose last statement by their party is over ``days`` days old, with its time (``stated_at``)."""
    w = Window.partitionBy(who).orderBy(*order).rowsBetween(*BEFORE)
    out = rows.withColumn("stated_at", F.last(F.when(assumed, F.col(ts)), ignorenulls=True).over(w))
    return out.where(used & (F.col("stated_at") < F.timestamp_add("DAY", F.lit(-days), F.col(ts))))


def downstream(messages: DataFrame, thread: str, order: str, size: Column) -> DataFrame:
    """``messages`` with ``impact``: the sum of ``size`` over the messages behind them in their thread."""
    w = Window.partitionBy(thread).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    return messages.withColumn("impact", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
