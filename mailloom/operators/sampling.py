"""Seeded sampling for labelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labeling_sheet(preds: DataFrame, k: int = 100, seed: int = 42) -> DataFrame:
    """Every predicted positive (pool) and ``k`` negatives of least md5(seed:id) (random_sample): a sample without replacement."""
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    pool = preds.where("prediction").select("id", F.lit("pool").alias("sample_role"))
    sample = preds.where("not prediction").orderBy(rank).limit(k).select("id", F.lit("random_sample").alias("sample_role"))
    return pool.unionByName(sample)


def sheet_rows(preds: DataFrame, corpus: DataFrame, k: int = 100, seed: int = 42) -> DataFrame:
    """The ten columns of a labelling sheet; what the corpus or a prediction lacks is empty."""
    chosen = labeling_sheet(preds, k, seed).join(preds.drop("sample_role"), "id").join(corpus, "id", "left")
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    return chosen.select(
        "sample_role", "id", "prediction", "p_positive", text("evidence_quote", "model_evidence_quote"), text("rationale", "model_rationale"),
        *[text(c, c) for c in ("from_raw", "subject", "date", "body_text")],
    )
