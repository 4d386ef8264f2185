"""Comparison of runs and variants: ``votes`` has run, id, prediction, p_positive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions.metrics import probability_bin


def complete_votes(votes: DataFrame, runs: int) -> DataFrame:
    """(id, n_pos) of the ids that every run has."""
    return votes.groupBy("id").agg(F.countDistinct("run").alias("r"), F.count_if("prediction").alias("n_pos")).where(F.col("r") == runs).select("id", "n_pos")


def vote_histogram(votes: DataFrame, runs: int) -> DataFrame:
    return complete_votes(votes, runs).groupBy("n_pos").agg(F.count("*").alias("n"))


def unstable(votes: DataFrame, runs: int) -> DataFrame:
    return complete_votes(votes, runs).where((F.col("n_pos") > 0) & (F.col("n_pos") < runs))


def pairwise(votes: DataFrame, runs: list) -> DataFrame:
    """(run_i, run_j, n_compared, disagree, pos_to_neg, neg_to_pos) of each pair of runs.

    One aggregation over ids gathers their votes as a map of at most as many entries
    as there are runs; pairs come out of it, so votes are shuffled once and never joined.
    """
    maps = votes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("run", "prediction"))).alias("m"))
    pairs = [F.struct(F.lit(a).alias("run_i"), F.lit(b).alias("run_j")) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    each = maps.select("m", F.explode(F.array(*pairs)).alias("p")).select("p.run_i", "p.run_j", F.col("m")[F.col("p.run_i")].alias("a"), F.col("m")[F.col("p.run_j")].alias("b")).where("a is not null and b is not null")
    return each.groupBy("run_i", "run_j").agg(F.count("*").alias("n_compared"), F.count_if(F.expr("a <> b")).alias("disagree"), F.count_if(F.expr("a and not b")).alias("pos_to_neg"), F.count_if(F.expr("not a and b")).alias("neg_to_pos"))


def flip_asymmetry(pairs: DataFrame) -> DataFrame:
    out = pairs.agg(F.sum("pos_to_neg").alias("pos_to_neg"), F.sum("neg_to_pos").alias("neg_to_pos"))
    total = F.col("pos_to_neg") + F.col("neg_to_pos")
    return out.withColumn("pct_pos_to_neg", F.coalesce(F.try_divide(F.col("pos_to_neg") * 100.0, total), F.lit(0.0)))


def stability_by_bin(votes: DataFrame, runs: int, first: object) -> DataFrame:
    """Stable and unstable ids by the first run's probability; only bins with ids."""
    p = votes.where(F.col("run") == F.lit(first)).select("id", "p_positive")
    joined = complete_votes(votes, runs).join(p, "id")
    return joined.groupBy(probability_bin(F.coalesce("p_positive", F.lit(0.0))).alias("bin")).agg(
        F.count("*").alias("total"), F.count_if(F.col("n_pos") == 0).alias("stable_neg"), F.count_if(F.col("n_pos") == runs).alias("stable_pos"), F.count_if((F.col("n_pos") > 0) & (F.col("n_pos") < runs)).alias("unstable")
    )


def label_confusion(v1: DataFrame, v2: DataFrame) -> DataFrame:
    return v1.select("id", F.col("label").alias("v1")).join(v2.select("id", F.col("label").alias("v2")), "id").groupBy("v1", "v2").agg(F.count("*").alias("n"))


def flips(a: DataFrame, b: DataFrame) -> DataFrame:
    j = a.select("id", F.col("prediction").alias("a")).join(b.select("id", F.col("prediction").alias("b")), "id")
    return j.agg(F.count_if(F.expr("a and b")).alias("agree_pos"), F.count_if(F.expr("not a and not b")).alias("agree_neg"), F.count_if(F.expr("a and not b")).alias("pos_to_neg"), F.count_if(F.expr("not a and b")).alias("neg_to_pos"))


def best_run(scores: DataFrame, key: str, value: str = "f1") -> DataFrame:
    """The key of the greatest value; null and 0 count as -1, ties go to the smallest key."""
    return scores.agg(F.max_by(key, F.struct(F.coalesce(F.nullif(F.col(value), F.lit(0.0)), F.lit(-1.0)), -F.col(key))).alias(key))


def common_votes(votes: DataFrame, runs: int) -> DataFrame:
    """The votes on ids that every run has."""
    return votes.join(complete_votes(votes, runs).select("id"), "id", "left_semi")


def flips_of(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, from_positive) of the ids whose prediction changed."""
    j = a.select("id", F.col("prediction").alias("a")).join(b.select("id", F.col("prediction").alias("b")), "id")
    return j.where("a <> b").select("id", F.col("a").alias("from_positive"))


def decision(scores: DataFrame, good: float, fair: float, least_precision: float) -> DataFrame:
    """``scores`` with ``branch``: adopt, refine, imprecise or reject; an undefined f1 or precision is rejected."""
    f1, p = F.coalesce(F.nanvl("f1", F.lit(None)), F.lit(-1.0)), F.coalesce(F.nanvl("precision", F.lit(None)), F.lit(-1.0))
    branch = F.when((f1 >= good) & (p >= least_precision), "adopt").when((f1 >= fair) & (p >= least_precision), "refine").when(f1 >= fair, "imprecise").otherwise("reject")
    return scores.withColumn("branch", branch)


def rate_flags(preds: DataFrame, most_positive: float, by: list[str]) -> DataFrame:
    """Share of positives of each group in per cent, and whether it is over what the hypothesis allows."""
    out = preds.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("prediction").alias("n_pos"))
    pct = F.try_divide(F.col("n_pos") * 100.0, "n")
    return out.withColumn("pct_positive", pct).withColumn("falsified", F.coalesce(pct > most_positive, F.lit(False)))


def promotion(scores: DataFrame, least_f1: float = 0.65, least_precision: float = 0.70, marginal: float = 0.50) -> DataFrame:
    """``scores`` with ``verdict``: promote, imprecise (only the f1 is high enough), marginal or reject; an undefined f1 is rejected."""
    f1, p = F.coalesce(F.nanvl("f1", F.lit(None)), F.lit(-1.0)), F.coalesce(F.nanvl("precision", F.lit(None)), F.lit(-1.0))
    verdict = F.when((f1 >= least_f1) & (p >= least_precision), "promote").when(f1 >= least_f1, "imprecise").when(f1 >= marginal, "marginal").otherwise("reject")
    return scores.withColumn("verdict", verdict)


def across_corpora(scores: DataFrame, reference: DataFrame, band: float = 0.10) -> DataFrame:
    """``scores`` with ``transfer``: does the f1 lie within, above or below the band around the one of ``reference`` (one row)? Null if either is undefined."""
    apart = F.nanvl("f1", F.lit(None)) - F.nanvl("__reference", F.lit(None))
    joined = scores.crossJoin(F.broadcast(reference.select(F.col("f1").alias("__reference"))))
    return joined.withColumn("transfer", F.when(F.abs(apart) <= band, "within").when(apart > band, "above").when(apart < -band, "below")).drop("__reference")


def usable_probabilities(cards: DataFrame, most_brier: float = 0.18) -> DataFrame:
    """``cards`` with ``usable``: is the Brier score low enough to use probabilities as they are? No if there is none."""
    return cards.withColumn("usable", F.coalesce(F.col("brier") <= most_brier, F.lit(False)))
