"""Calibration of probabilities on labelled items: Platt's logistic fit and isotonic blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.operators.rounds import written


def points(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """(p, pos, n): labelled items by their probability; all that a calibration needs of them. Null probabilities are left out."""
    rated = labels.where(F.col("label").isin("positive", "negative")).select("id", "label")
    known = preds.select("id", F.col("p_positive").alias("p")).where("p is not null").join(rated, "id")
    return known.groupBy("p").agg(F.count_if(F.col("label") == "positive").alias("pos"), F.count("*").alias("n"))


def platt(at: DataFrame, rounds: int = 8) -> tuple[float, float]:
    """(a, b) of P = 1 / (1 + exp(-(a p + b))) by Newton's steps on ``points``, targets smoothed for small samples.

    Each step is one aggregation of five sums. Without labels, or where a step is singular, it stays where it is.
    """
    at = written(at, "points")
    total = at.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    high, low = (total["pos"] + 1) / (total["pos"] + 2), 1 / (total["n"] - total["pos"] + 2)
    a = b = 0.0
    for _ in range(rounds):
        mu = 1 / (1 + F.exp(-(F.lit(a) * F.col("p") + F.lit(b))))
        g, w, p = F.col("pos") * (high - mu) + (F.col("n") - F.col("pos")) * (low - mu), F.col("n") * mu * (1 - mu), F.col("p")
        s = at.agg(F.sum(g * p).alias("ga"), F.sum(g).alias("gb"), F.sum(w * p * p).alias("aa"), F.sum(w * p).alias("ab"), F.sum(w).alias("bb")).first()
        det = s["aa"] * s["bb"] - s["ab"] ** 2 if s["bb"] is not None else 0.0
        if abs(det) < 1e-12:
            break
        a, b = a + (s["bb"] * s["ga"] - s["ab"] * s["gb"]) / det, b + (s["aa"] * s["gb"] - s["ab"] * s["ga"]) / det
    return a, b


def platt_probability(p: Column, fit: tuple[float, float]) -> Column:
    return 1 / (1 + F.exp(-(F.lit(fit[0]) * p + F.lit(fit[1]))))


BLOCK = "low double, high double, pos long, n long"


def _pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adjacent blocks merged while the one behind is not higher; sorted in, sorted out."""
    stack: list[list] = []
    for frame in frames:
        for block in frame[["low", "high", "pos", "n"]].itertuples(index=False, name=None):
            now = list(block)
            while stack and stack[-1][2] * now[3] >= now[2] * stack[-1][3]:
                low, _, pos, n = stack.pop()
                now = [low, now[1], pos + now[2], n + now[3]]
            stack.append(now)
    yield pd.DataFrame(stack, columns=["low", "high", "pos", "n"])


def isotonic_blocks(at: DataFrame, parts: int = 64) -> DataFrame:
    """(low, high, pos, n, value): the blocks of the isotonic fit of ``points``, rising.

    Ranges of p are pooled apart, then ever fewer ranges of the blocks that are left, down to one. Pooling is
    associative, so the result does not depend on the ranges; a smooth fit of m points has about m to the power 1/3 blocks.
    """
    blocks = at.select(F.col("p").alias("low"), F.col("p").alias("high"), "pos", "n")
    while True:
        blocks = written(blocks.repartitionByRange(parts, "low").sortWithinPartitions("low").mapInPandas(_pooled, BLOCK), "blocks")
        if parts == 1:
            return blocks.withColumn("value", F.col("pos") / F.col("n"))
        parts = max(1, parts // 8)


def isotonic_probability(preds: DataFrame, blocks: DataFrame) -> DataFrame:
    """``preds`` with ``p_calibrated``: the value of the block at or below p_positive, of the first block below all; null stays null.

    Probabilities are looked up once each: predictions and blocks meet by distinct p.
    """
    own = preds.where("p_positive is not null").select(F.col("p_positive").alias("low")).distinct()
    rows = own.select("low", F.lit(None).cast("double").alias("value"), F.lit(1).alias("asked")).unionByName(blocks.select("low", "value", F.lit(0).alias("asked")))
    bins = rows.withColumn("bin", F.floor(F.col("low") * 1000))
    inside = Window.partitionBy("bin").orderBy("low", "asked").rowsBetween(Window.unboundedPreceding, 0)
    heads = bins.groupBy("bin").agg(F.max_by("value", F.when(F.col("asked") == 0, F.col("low"))).alias("last"))  # 1001 bins at most
    ahead = heads.select("bin", F.last("last", ignorenulls=True).over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    least = blocks.agg(F.min_by("value", "low").alias("least"))
    known = bins.withColumn("here", F.last("value", ignorenulls=True).over(inside)).where("asked = 1").join(F.broadcast(ahead), "bin").crossJoin(F.broadcast(least))
    fitted = known.select(F.col("low").alias("p_positive"), F.coalesce("here", "carried", "least").alias("p_calibrated"))
    return preds.join(fitted, "p_positive", "left").select(*preds.columns, "p_calibrated")
