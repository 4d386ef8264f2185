"""Scorecards, rules, and comparisons of runs and tiers beyond the headline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions import metrics as M
from mailloom.functions import subjects as S
from mailloom.functions import text as X
from mailloom.operators import compare, escalate, evaluate, sampling
from mailloom.plans.queries import CELLS, CONTEXT_WITH, CORPUS_SQL, RUN_SQL, RUNS, SWEEP_SQL, attributed, confusion_counts, corpus, escalation_pool_sweep, four, labels, query, rates, run, runs, table

PRF_SQL = (
    RUN_SQL.rstrip()
    + f", c AS (SELECT run, {CELLS} FROM runs JOIN lab USING (id) WHERE label <> 'unsure' GROUP BY run), "
    + """prf AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c)
"""
)


def scores(spark, d, undefined: str = "null") -> DataFrame:
    return evaluate.precision_recall(confusion_counts(spark, d), undefined)


@query(
    RUN_SQL
    + """, c AS (SELECT count_if(pred AND label = 'positive')::bigint AS tp, count_if(NOT pred AND label IN ('positive', 'negative'))::bigint AS sample_n,
 count_if(NOT pred AND label = 'positive')::bigint AS sample_k, count_if(NOT pred AND label IS NULL)::bigint AS n_unsampled FROM runs LEFT JOIN lab USING (id) WHERE run = 1),
e AS (SELECT *, sample_k / sample_n AS fn_rate, fn_rate * n_unsampled AS est_fn, tp / (tp + est_fn) AS recall FROM c) SELECT tp, sample_n, sample_k, n_unsampled, """
    + four("fn_rate", "est_fn", "recall")
    + " FROM e"
)
def scorecard_legacy_fallback(spark, d):
    """Labels without roles: all labelled negatives are the sample."""
    plain = labels(spark, d).withColumn("sample_role", F.lit(None).cast("string"))
    out = evaluate.scorecard(run(spark, d, 1), plain).select("tp", "sample_n", "sample_k", "n_unsampled", "fn_rate", "est_fn", "recall")
    return rates(out, "fn_rate", "est_fn", "recall")


@query(
    RUN_SQL
    + f""", c AS (SELECT run, {CELLS} FROM (SELECT run, id, pred AND run > 0 AS pred FROM runs) JOIN lab USING (id) WHERE label <> 'unsure' GROUP BY run),
e AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
SELECT run, p IS NULL AS undefined, p IS NULL AS nan, floor(p * 10000 + 0.5) / 10000.0 AS precision, floor(CASE WHEN p IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * 10000 + 0.5) / 10000.0 AS f1 FROM e"""
)
def prf_undefined(spark, d):
    """A run without positives has no precision: null or NaN, as asked for."""
    silent = runs(spark, d).withColumn("prediction", F.col("prediction") & (F.col("run") > 0))
    cells = evaluate.confusion(silent, labels(spark, d), ["run"])
    null, nan = evaluate.precision_recall(cells, "null"), evaluate.precision_recall(cells, "nan")
    out = null.join(nan.select("run", F.isnan("f1").alias("nan")), "run").withColumn("undefined", F.col("precision").isNull())
    return rates(out.select("run", "undefined", "nan", "precision", "f1"), "precision", "f1")


@query(
    """WITH c AS (SELECT coalesce(source, 'none') AS source, count(*) AS n, count_if(toxic = 1)::bigint AS k FROM documents JOIN labels USING (doc_id) GROUP BY 1),
w AS (SELECT *, k / n AS p, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n) AS half,
 greatest(0, mid - half) AS low, least(1, mid + half) AS high FROM c) SELECT source, n, k, """
    + four("low", "high")
    + " FROM w"
)
def wilson_bounds(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy(F.coalesce("source", F.lit("none")).alias("source"))
    rows = rows.agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    low, high = M.wilson(F.col("k"), F.col("n"))
    return rates(rows.withColumns({"low": low, "high": high}), "low", "high")


@query(
    PRF_SQL.rstrip()
    + ", s AS (SELECT count(f1) AS n, min(f1) AS min, max(f1) AS max, avg(f1) AS mean, max(f1) - min(f1) AS range, coalesce(stddev_samp(f1), 0) AS stdev FROM prf) SELECT n, "
    + four("min", "max", "mean", "range", "stdev")
    + " FROM s"
)
def metric_spread(spark, d):
    return rates(evaluate.spread(scores(spark, d), "f1"), "min", "max", "mean", "range", "stdev")


@query(PRF_SQL + "SELECT run FROM prf ORDER BY coalesce(nullif(f1, 0), -1) DESC, run LIMIT 1")
def best_depth_argmax(spark, d):
    """Runs stand for quote depths."""
    return compare.best_run(scores(spark, d), "run")


@query(PRF_SQL + "SELECT run, CASE WHEN f1 >= 0.2 AND precision >= 0.15 THEN 'adopt' WHEN f1 >= 0.1 AND precision >= 0.15 THEN 'refine' WHEN f1 >= 0.1 THEN 'imprecise' ELSE 'reject' END AS branch FROM prf")
def decision_branch(spark, d):
    return compare.decision(scores(spark, d), 0.2, 0.1, 0.15).select("run", "branch")


@query(RUN_SQL + "SELECT run, count(*) AS n, count_if(pred)::bigint AS n_pos, floor(count_if(pred) * 100.0 / count(*) * 10000 + 0.5) / 10000.0 AS pct_positive, count_if(pred) * 100.0 / count(*) > 20 AS falsified FROM runs GROUP BY run")
def rate_flags(spark, d):
    return rates(compare.rate_flags(runs(spark, d), 20.0, ["run"]), "pct_positive")


@query(
    RUN_SQL
    + """SELECT run, avg(CASE WHEN label IN ('positive', 'negative') THEN pow(p - (label = 'positive')::int, 2) END) <= 0.35 AS usable, abs(count_if(pred) / count(*) - 0.2) <= 0.1 AS within_band
FROM runs LEFT JOIN lab USING (id) GROUP BY run"""
)
def calibration_rule(spark, d):
    """Whether a run's Brier score is low enough to use it, and its rate of positives is near a reference."""
    card = evaluate.scorecard(runs(spark, d), labels(spark, d), ["run"])
    rate = F.col("model_positive") / F.col("predictions_total")
    return card.select("run", (F.col("brier") <= 0.35).alias("usable"), (F.abs(rate - 0.2) <= 0.1).alias("within_band"))


@query(RUN_SQL + "SELECT id, CASE WHEN label = 'positive' AND pred THEN 'tp' WHEN pred THEN 'fp' WHEN label = 'positive' THEN 'fn' ELSE 'tn' END AS cell FROM runs JOIN lab USING (id) WHERE run = 1 AND label <> 'unsure'")
def cell_items(spark, d):
    return evaluate.cell_items(run(spark, d, 1), labels(spark, d))


TIER_SQL = (
    CORPUS_SQL.rstrip()
    + """, pool AS (SELECT id FROM corpus WHERE regexp_matches(subject, '(?i)\\[VOTE\\b|\\[DISCUSS\\b|\\bproposal\\b')),
tiers AS (SELECT CASE run WHEN 0 THEN 'cheap' ELSE 'frontier' END AS tier, id, pred FROM runs WHERE run < 2
 UNION ALL SELECT 'combined', a.id, CASE WHEN a.id IN (SELECT id FROM pool) THEN b.pred ELSE a.pred END FROM runs a JOIN runs b ON a.id = b.id AND a.run = 0 AND b.run = 1)
""".replace("\\\\", "\\")
)


def borderline(spark, d) -> DataFrame:
    return corpus(spark, d).where(escalate.is_borderline(F.col("subject"))).select("id")


@query(TIER_SQL + f", c AS (SELECT tier, {CELLS} FROM tiers JOIN lab USING (id) WHERE label <> 'unsure' GROUP BY tier), e AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM c) SELECT tier, tp, fp, fn, tn, {four('precision', 'recall', 'f1')} FROM e")
def escalation_combined(spark, d):
    out = escalate.three_scores(run(spark, d, 0), run(spark, d, 1), borderline(spark, d), labels(spark, d))
    return rates(out, "precision", "recall", "f1")


@query(TIER_SQL + "SELECT count(*) AS pool_size, count(label) AS labeled, count_if(label = 'positive')::bigint AS positive, count_if(label = 'negative')::bigint AS negative FROM pool LEFT JOIN lab USING (id)")
def pool_label_overlap(spark, d):
    return escalate.pool_overlap(borderline(spark, d), labels(spark, d))


@query(RUN_SQL + "SELECT a.id, CASE WHEN b.pred THEN 'new' ELSE 'lost' END AS kind, label FROM runs a JOIN runs b ON a.id = b.id AND a.run = 0 AND b.run = 1 AND a.pred <> b.pred LEFT JOIN lab ON lab.id = a.id")
def moved_items(spark, d):
    return escalate.moved(run(spark, d, 0), run(spark, d, 1), labels(spark, d))


@query(SWEEP_SQL + "SELECT pool, pool_size FROM sweep WHERE f1 >= 0.01 AND f1 >= (SELECT f1 FROM sweep WHERE pool = 'P_full') - 0.05 ORDER BY pool_size, pool LIMIT 1")
def operating_point(spark, d):
    return escalate.smallest_good_pool(escalation_pool_sweep(spark, d), least_f1=0.01).select("pool", "pool_size")


@query(RUN_SQL + f"SELECT run, {CELLS} FROM runs JOIN lab USING (id) WHERE label <> 'unsure' AND id % 10 <> 3 GROUP BY run")
def fewshot_excluded(spark, d):
    """Items used as examples are not scored."""
    shown = corpus(spark, d).where("id % 10 = 3")
    return evaluate.confusion(runs(spark, d), evaluate.without(labels(spark, d), shown), ["run"])


@query(
    RUN_SQL
    + """, v AS (SELECT * FROM runs WHERE NOT (run = 2 AND id % 9 = 0)), k AS (SELECT id FROM v GROUP BY id HAVING count(DISTINCT run) = 3)
SELECT a.run AS run_i, b.run AS run_j, count(*) AS n_compared, count_if(a.pred <> b.pred)::bigint AS disagree, count_if(a.pred AND NOT b.pred)::bigint AS pos_to_neg, count_if(NOT a.pred AND b.pred)::bigint AS neg_to_pos
FROM v a JOIN v b ON a.id = b.id AND a.run < b.run JOIN k ON k.id = a.id GROUP BY 1, 2"""
)
def variant_pairwise_common(spark, d):
    """Variants are compared over the ids that all of them have."""
    votes = runs(spark, d).where("not (run = 2 and id % 9 = 0)")
    return compare.pairwise(compare.common_votes(votes, len(RUNS)), list(range(len(RUNS))))


@query(RUN_SQL + "SELECT id FROM runs WHERE run = 0 AND pred INTERSECT SELECT id FROM runs WHERE run = 1 AND pred")
def common_ids_intersect(spark, d):
    return run(spark, d, 0).where("prediction").select("id").intersect(run(spark, d, 1).where("prediction").select("id"))


@query(RUN_SQL + "SELECT a.id, a.pred AS from_positive FROM runs a JOIN runs b ON a.id = b.id AND a.run = 0 AND b.run = 2 AND a.pred <> b.pred")
def flipped_items(spark, d):
    return compare.flips_of(run(spark, d, 0), run(spark, d, 2))


@query(
    CORPUS_SQL
    + """, s AS (SELECT id FROM runs WHERE run = 0 AND NOT pred ORDER BY md5('42:' || id) LIMIT 100), x AS (SELECT id, 'pool' AS sample_role FROM runs WHERE run = 0 AND pred UNION ALL SELECT id, 'random_sample' FROM s)
SELECT sample_role, id, pred AS prediction, p AS p_positive, CASE WHEN pred THEN 'p' || id ELSE '' END AS model_evidence_quote, '' AS model_rationale, CASE WHEN id % 3 = 0 THEN '' ELSE 'u' || id || '@example.org' END AS from_raw,
 CASE WHEN id % 3 = 0 THEN '' ELSE subject END AS subject, '' AS date, CASE WHEN id % 3 = 0 THEN '' ELSE body END AS body_text FROM x JOIN runs USING (id) JOIN corpus USING (id) WHERE run = 0"""
)
def labeling_sheet_rows(spark, d):
    """The sheet's ten columns; every third mail is missing from the corpus."""
    preds = run(spark, d, 0).select("id", "prediction", "p_positive", F.when(F.col("prediction"), F.concat(F.lit("p"), "id")).alias("evidence_quote"), F.lit(None).cast("string").alias("rationale"))
    mails = corpus(spark, d).where("id % 3 <> 0").select("id", F.concat(F.lit("u"), "id", F.lit("@example.org")).alias("from_raw"), "subject", F.lit(None).cast("string").alias("date"), F.col("body").alias("body_text"))
    return sampling.sheet_rows(preds, mails)


@query(CONTEXT_WITH + "SELECT count(*) AS n, count_if(contains(own, 'the'))::bigint AS own, count_if(contains(body, 'the') AND NOT contains(own, 'the'))::bigint AS quoted_only FROM ctx JOIN msg USING (id)")
def evidence_provenance(spark, d):
    """Whether a piece of evidence lies in the author's own words or in what they quote."""
    rows = attributed(spark, d).select("body", X.message_context("body")["new_content"].alias("own"))
    own = F.contains("own", F.lit("the"))
    return rows.agg(F.count("*").alias("n"), F.count_if(own).alias("own"), F.count_if(F.contains("body", F.lit("the")) & ~own).alias("quoted_only"))


@query(CORPUS_SQL + "SELECT count(*) AS n, count_if(NOT regexp_matches(lower(subject), '^(re:|fwd:)'))::bigint AS roots, median(length(body)) AS median_chars, floor(avg(length(body)) * 10000 + 0.5) / 10000.0 AS mean_chars, count_if(regexp_matches(subject, '(?i)\\[VOTE\\b'))::bigint AS votes, count_if(regexp_matches(subject, '(?i)\\[DISCUSS\\b'))::bigint AS discussions FROM corpus".replace("\\\\", "\\"))
def mail_profile(spark, d):
    s, size = F.col("subject"), F.length("body")
    return rates(
        corpus(spark, d).agg(
            F.count("*").alias("n"), F.count_if(S.is_root(s)).alias("roots"), F.median(size).alias("median_chars"), F.avg(size).alias("mean_chars"),
            F.count_if(S.matches(s, S.VOTE)).alias("votes"), F.count_if(S.matches(s, S.DISCUSS)).alias("discussions"),
        ),
        "mean_chars",
    )
