"""The rules that decide about a detector, over systems of known miss and false alarm rates, so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.operators import compare, escalate, evaluate
from mailloom.plans.queries import CELLS, CORPUS_SQL, SWEEP_SQL, corpus, four, query, rates, table

# system: salt, and of 1000 toxic documents so many missed, of 1000 others so many reported
SYSTEMS = {"strong": (0, 50, 2), "loud": (137, 50, 70), "base": (401, 550, 20), "near": (13, 500, 20), "weak": (77, 800, 250), "silent": (5, 1000, 0)}
TIERS = {"cheap": (0, 130, 2), "frontier": (500, 30, 2)}


def answers(spark: SparkSession, d: str, systems: dict[str, tuple[int, int, int]]) -> DataFrame:
    """(system, id, prediction, p_positive, ordinal) for every document; one without a rating counts as not toxic, a silent system gives no probability."""
    docs = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    each = F.array(*[F.struct(F.lit(k).alias("system"), *[F.lit(v).alias(c) for c, v in zip(("salt", "miss", "alarm"), rule, strict=True)]) for k, rule in systems.items()])
    rows = docs.select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"), F.explode(each).alias("s")).select("doc_id", "toxic", "s.*")
    chance = (F.col("doc_id") * 7919 + F.col("salt")) % 1000
    said = F.when(F.col("toxic"), chance >= F.col("miss")).otherwise(chance < F.col("alarm"))
    p = F.when(F.col("system") != "silent", F.when(said, 0.95).otherwise(0.05))
    return rows.select("system", F.col("doc_id").alias("id"), said.alias("prediction"), p.alias("p_positive"), F.col("doc_id").alias("ordinal"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, d, "labels").select(i.alias("id"), F.when(F.col("toxic") == 1, "positive").otherwise("negative").alias("label"), F.lit("random_sample").alias("sample_role"), i.alias("ordinal"))


def _answers_sql(systems: dict[str, tuple[int, int, int]]) -> str:
    rules = ", ".join(f"('{k}', {salt}, {miss}, {alarm})" for k, (salt, miss, alarm) in systems.items())
    return f"""rated AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS label FROM labels),
said AS (SELECT system, doc_id AS id, CASE WHEN toxic = 1 THEN (doc_id * 7919 + salt) % 1000 >= miss ELSE (doc_id * 7919 + salt) % 1000 < alarm END AS pred
 FROM documents LEFT JOIN labels USING (doc_id), (VALUES {rules}) s(system, salt, miss, alarm))"""


@query(
    f"WITH {_answers_sql(SYSTEMS)}, c AS (SELECT system, {CELLS}, CASE WHEN system <> 'silent' THEN avg(pow(CASE WHEN pred THEN 0.95 ELSE 0.05 END - (label = 'positive')::int, 2)) END AS brier FROM said JOIN rated USING (id) GROUP BY system),"
    + """ s AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c),
b AS (SELECT s.*, s.f1 - o.f1 AS apart FROM s, s o WHERE o.system = 'base')
SELECT system, CASE WHEN f1 >= 0.65 AND precision >= 0.70 THEN 'promote' WHEN f1 >= 0.65 THEN 'imprecise' WHEN f1 >= 0.50 THEN 'marginal' ELSE 'reject' END AS verdict,
 CASE WHEN abs(apart) <= 0.10 THEN 'within' WHEN apart > 0.10 THEN 'above' WHEN apart < -0.10 THEN 'below' END AS transfer, coalesce(brier <= 0.18, false) AS usable, """
    + four("precision", "recall", "f1", "brier")
    + " FROM b"
)
def adoption_rules(spark, d):
    """Promotion, transfer to a second corpus and use of probabilities, by the thresholds that the engine has by default."""
    said, rated = answers(spark, d, SYSTEMS), ratings(spark, d)
    squared = F.avg(F.pow(F.col("p_positive") - (F.col("label") == "positive").cast("int"), 2))
    brier = said.join(rated, "id").groupBy("system").agg(squared.alias("brier"))
    scores = evaluate.precision_recall(evaluate.confusion(said, rated, ["system"]), "null").join(brier, "system")
    judged = compare.usable_probabilities(compare.across_corpora(compare.promotion(scores), scores.where("system = 'base'")))
    return rates(judged.select("system", "verdict", "transfer", "usable", "precision", "recall", "f1", "brier"), "precision", "recall", "f1", "brier")


_TIERS_SQL = (
    # the sweep's SQL over other tiers: what it reads as runs 0 and 1 and as labels are the cheap and the frontier system and the ratings
    SWEEP_SQL.replace(CORPUS_SQL, CORPUS_SQL.rstrip() + f", {_answers_sql(TIERS)}\n")
    .replace("FROM runs JOIN corpus USING (id) WHERE run = 0 AND NOT pred)", "FROM said JOIN corpus USING (id) WHERE system = 'cheap' AND NOT pred)")
    .replace("FROM runs c JOIN runs b ON b.id = c.id AND b.run = 1 AND c.run = 0", "FROM said c JOIN said b ON b.id = c.id AND b.system = 'frontier' AND c.system = 'cheap'")
    .replace("FROM f JOIN lab USING (id) WHERE label <> 'unsure'", "FROM f JOIN rated USING (id)")
)


@query(
    _TIERS_SQL
    + ", t AS (SELECT *, f1 >= 0.90 AS good, f1 >= (SELECT f1 FROM sweep WHERE pool = 'P_full') - 0.05 AS close FROM sweep) "
    + f"SELECT pool, pool_size, good, close, pool = (SELECT pool FROM t WHERE good AND close ORDER BY pool_size, pool LIMIT 1) AS chosen, {four('precision', 'recall', 'f1')} FROM t"
)
def escalation_verdicts(spark, d):
    """Each pool by the rule for the operating point, and the smallest one that the rule allows."""
    tiers = answers(spark, d, TIERS)
    cheap, frontier = (tiers.where(F.col("system") == k) for k in TIERS)
    judged = escalate.judged_pools(escalate.pool_sweep(cheap, frontier, corpus(spark, d), ratings(spark, d)))
    allowed = F.min(F.when(F.expr("good and close"), F.struct("pool_size", "pool"))).alias("best")
    out = judged.crossJoin(F.broadcast(judged.agg(allowed))).withColumn("chosen", F.col("pool") == F.col("best.pool"))
    return rates(out.select("pool", "pool_size", "good", "close", "chosen", "precision", "recall", "f1"), "precision", "recall", "f1")
