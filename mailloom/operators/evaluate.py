"""Scorecards: pool-and-extrapolate estimates of a rare-positive detector.

``preds``: id, prediction, p_positive, ordinal; ``labels``: id, label, sample_role,
ordinal. ``ordinal`` is the input order; of several rows of an id the last counts.
``by`` names grouping columns of ``preds`` (runs, variants): all scorecards are one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.metrics import f1, probability_bin, ratio, wilson


def last_wins(df: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """One row per key, the last in input order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def trusted(preds: DataFrame, sources: tuple[str, ...] | None) -> DataFrame:
    """``preds`` with p_positive only where its ``p_source`` is one of ``sources``: a fallback says nothing about calibration.

    None, or a table without that column, leaves all of them.
    """
    if sources is None or "p_source" not in preds.columns:
        return preds
    return preds.withColumn("p_positive", F.when(F.col("p_source").isin(*sources), F.col("p_positive")))


def confusion(preds: DataFrame, labels: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn over labelled ids (labels joined on id; small, so broadcast by Catalyst when it fits)."""
    joined = preds.join(labels.where(F.col("label").isin("positive", "negative")), "id")
    pos, said = F.col("label") == "positive", F.col("prediction")
    return joined.groupBy(*(by or [])).agg(
        F.count_if(pos & said).alias("tp"), F.count_if(~pos & said).alias("fp"), F.count_if(pos & ~said).alias("fn"), F.count_if(~pos & ~said).alias("tn")
    )


def precision_recall(cells: DataFrame, undefined: str = "zero") -> DataFrame:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), undefined)
    r = ratio(F.col("tp"), F.col("tp") + F.col("fn"), undefined)
    return cells.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def scorecard(preds: DataFrame, labels: DataFrame, by: list[str] | None = None, sources: tuple[str, ...] | None = ("logprob",), corpus_size: int | None = None, random_sample_size: int | None = None) -> DataFrame:
    """One row per group: counts, precision, extrapolated misses, recall with bounds, f1 and Brier score (over probabilities of ``sources``).

    Sizes that are given are echoed, and where ``preds`` has them so are ``model_id`` and ``prompt_hash`` of the first prediction.

    Predictions and labels are read once each: several rows of an id become one before they are joined.
    """
    by = by or ["__all"]
    preds = trusted(preds.withColumn("__all", F.lit(0)) if by == ["__all"] else preds, sources)
    echoed = [F.min_by(c, "ordinal").alias(c) for c in ("model_id", "prompt_hash") if c in preds.columns]
    of_run = preds.groupBy(*by).agg(*echoed) if echoed else None
    last = F.max_by(F.struct("prediction", "p_positive"), "ordinal")
    p = preds.groupBy(*by, "id").agg(last.alias("last"), F.count("*").alias("repeats")).select(*by, "id", "repeats", "last.*")
    role, is_pos = F.coalesce("sample_role", F.lit("")), F.col("label") == "positive"
    sampled = (role == "random_sample") & F.col("label").isin("positive", "negative")
    each = labels.groupBy("id").agg(
        F.max_by("label", "ordinal").alias("own_label"),
        F.count("*").alias("label_rows"),
        F.count_if(role.startswith("pool") & is_pos).alias("pool_positive"),
        F.count_if(sampled).alias("sampled"),
        F.count_if(sampled & is_pos).alias("sampled_positive"),
    )
    rated, pos = F.col("own_label").isin("positive", "negative"), F.col("own_label") == "positive"
    said = F.col("prediction")
    missed = lambda c: F.coalesce(F.sum(F.when(~said, F.col(c))), F.lit(0))
    main = p.join(each, "id", "left").groupBy(*by).agg(
        F.sum("repeats").alias("predictions_total"),
        F.coalesce(F.sum("label_rows"), F.lit(0)).alias("labels_total"),
        F.count_if(said).alias("model_positive"),
        F.count_if(~said).alias("model_negative"),
        F.count_if(said & pos).alias("tp"),
        F.count_if(said & rated & ~pos).alias("fp"),
        F.count_if(~said & F.col("label_rows").isNotNull()).alias("labeled_negative"),
        F.count_if(~said & rated).alias("legacy_n"),
        F.count_if(~said & pos).alias("legacy_k"),
        missed("pool_positive").alias("pool_fn"),
        missed("sampled").alias("random_n"),
        missed("sampled_positive").alias("random_k"),
        F.avg(F.when(rated, F.pow(F.col("p_positive") - pos.cast("int"), 2))).alias("brier"),
        F.count_if(rated & F.col("p_positive").isNotNull()).alias("brier_n"),
    )
    pooled = labels.agg(F.coalesce(F.max(role.startswith("pool")), F.lit(False)).alias("pool_role"))
    out = main.crossJoin(F.broadcast(pooled))  # one row
    legacy = ~F.col("pool_role") & (F.col("random_n") == 0)
    out = out.withColumn("sample_n", F.when(legacy, F.col("legacy_n")).otherwise(F.col("random_n"))).withColumn("sample_k", F.when(legacy, F.col("legacy_k")).otherwise(F.col("random_k")))
    low, high = wilson(F.col("sample_k"), F.col("sample_n"))
    out = out.withColumn("fn_rate", F.coalesce(ratio(F.col("sample_k"), F.col("sample_n")), F.lit(0.0))).withColumn("fn_lo", low).withColumn("fn_hi", high)
    out = out.withColumn("n_unsampled", F.col("model_negative") - F.col("labeled_negative")).withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    out = out.withColumn("est_fn", F.col("pool_fn") + F.col("fn_rate") * F.col("n_unsampled"))

    def recall(rate: str, otherwise: float | None):
        missed = F.col("pool_fn") + F.col(rate) * F.col("n_unsampled")
        value = ratio(F.col("tp"), F.col("tp") + missed)
        undefined = F.col("precision").isNull() | (F.col("tp") + F.col("est_fn") == 0)
        return F.when(undefined, F.lit(otherwise).cast("double")).otherwise(F.coalesce(value, F.lit(1.0)))

    out = out.withColumn("recall", recall("fn_rate", None)).withColumn("recall_lo", recall("fn_hi", 0.0)).withColumn("recall_hi", recall("fn_lo", 1.0))
    out = out.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("pool_unlabeled", F.col("model_positive") - F.col("tp") - F.col("fp"))
    out = out.drop("legacy_n", "legacy_k", "random_n", "random_k", "pool_role")
    out = out if of_run is None else out.join(of_run, by)
    given = {k: F.lit(v).cast("long") for k, v in (("corpus_size", corpus_size), ("random_sample_size", random_sample_size)) if v is not None}
    return out.withColumns(given).drop("__all") if given else out.drop("__all")


def orphan_labels(preds: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(preds, "id", "left_anti").select("id").distinct()


def reliability(preds: DataFrame, labels: DataFrame, bins: int = 10, sources: tuple[str, ...] | None = ("logprob",)) -> DataFrame:
    """Every bin, empty ones with bounds and n only, over probabilities of ``sources``."""
    joined = trusted(preds, sources).join(labels.where(F.col("label").isin("positive", "negative")), "id").where("p_positive is not null")
    table = joined.groupBy(probability_bin(F.col("p_positive"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p_positive").alias("mean_p"), F.avg((F.col("label") == "positive").cast("int")).alias("frac_positive")
    )
    spine = preds.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(table, "bin", "left").select("bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_p", "frac_positive")


def spread(df: DataFrame, value: str) -> DataFrame:
    """n, min, max, mean, range and sample deviation (0 below two values) of the values that are not null."""
    v = F.col(value)
    return df.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), (F.max(v) - F.min(v)).alias("range"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"))


def cell_items(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, cell) of labelled ids: tp, fp, fn or tn."""
    rated = labels.where(F.col("label").isin("positive", "negative"))
    pos = F.col("label") == "positive"
    cell = F.when(pos & F.col("prediction"), "tp").when(F.col("prediction"), "fp").when(pos, "fn").otherwise("tn")
    return preds.join(rated, "id").select("id", cell.alias("cell"))


def without(labels: DataFrame, excluded: DataFrame) -> DataFrame:
    """Labels whose id is not used in a prompt's examples."""
    return labels.join(excluded.select("id"), "id", "left_anti")
