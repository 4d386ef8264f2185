"""The engine's operators as queries over the given tables, each with the SQL of its result.

Messages are made from ``conversations`` (a turn quotes the two before it),
predictions and runs by arithmetic on document ids, labels from ``labels``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.functions import metrics as M
from mailloom.functions import subjects as S
from mailloom.functions import text as X
from mailloom.operators import compare, escalate, evaluate, sampling, scoring, versions
from mailloom.sources import files
from mailloom.sources.mail import month_spine

RUNS = (0, 137, 401)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def runs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    each = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.array(*[F.lit(s) for s in RUNS])).alias("run", "salt"))
    p = ((F.col("id") * 7919 + F.col("salt")) % 1000) / 1000.0
    return each.select("run", "id", p.alias("p_positive"), (p >= 0.8).alias("prediction"), F.col("id").alias("ordinal"))


def run(spark: SparkSession, d: str, k: int) -> DataFrame:
    return runs(spark, d).where(F.col("run") == k)


def labels(spark: SparkSession, d: str) -> DataFrame:
    id_, p0 = F.col("doc_id"), (F.col("doc_id") * 7919 % 1000) / 1000.0
    label = F.when(id_ % 37 == 0, "unsure").when(F.col("toxic") == 1, "positive").otherwise("negative")
    return table(spark, d, "labels").select(id_.alias("id"), label.alias("label"), F.when(p0 >= 0.8, "pool").otherwise("random_sample").alias("sample_role"), id_.alias("ordinal"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    quoted = lambda n, mark: F.coalesce(F.concat(F.lit("\n" + mark), F.regexp_replace(F.lag("text", n).over(w), "\n", "\n" + mark)), F.lit(""))
    first = F.first(F.substring("text", 1, 40)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    subject = F.concat(F.when(F.col("turn") > 0, "Re: ").otherwise(""), first)
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "role", subject.alias("subject"), F.concat(F.col("text"), quoted(1, "> "), quoted(2, "> > ")).alias("body"))


def vote_mails(spark: SparkSession, d: str) -> DataFrame:
    """A mail for each event, about one version for each user."""
    e = table(spark, d, "events").select("ts", "event_id", F.concat(F.lit("1."), F.pmod(F.col("user_id"), F.lit(10)), F.lit("."), F.floor(F.col("user_id") / 10) % 100, F.lit("-"), "user_id").alias("v"), "event_type")
    tag = F.when(F.col("event_type") == "signup", "[VOTE] ").when(F.col("event_type") == "purchase", "[VOTE PASSED] ").when(F.col("event_type") == "error", "[VOTE CLOSED] ").otherwise("")
    return e.select(F.col("event_id").alias("id"), "ts", F.concat(tag, F.lit("release "), "v").alias("subject"), F.lit("").alias("body"))


RUN_SQL = """WITH runs AS (SELECT r.run, doc_id AS id, ((doc_id * 7919 + r.salt) % 1000) / 1000.0 AS p,
  ((doc_id * 7919 + r.salt) % 1000) >= 800 AS pred FROM documents, (VALUES (0, 0), (1, 137), (2, 401)) r(run, salt)),
lab AS (SELECT doc_id AS id, CASE WHEN doc_id % 37 = 0 THEN 'unsure' WHEN toxic = 1 THEN 'positive' ELSE 'negative' END AS label,
  CASE WHEN doc_id * 7919 % 1000 >= 800 THEN 'pool' ELSE 'random_sample' END AS sample_role FROM labels),
msg AS (SELECT conv_id || '-' || turn AS id, role, CASE WHEN turn > 0 THEN 'Re: ' ELSE '' END || first_value(substring(coalesce(text, ''), 1, 40)) OVER w AS subject,
  coalesce(text, '') || coalesce(chr(10) || '> ' || replace(lag(coalesce(text, '')) OVER w, chr(10), chr(10) || '> '), '')
  || coalesce(chr(10) || '> > ' || replace(lag(coalesce(text, ''), 2) OVER w, chr(10), chr(10) || '> > '), '') AS body
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""
VOTES_SQL = RUN_SQL.rstrip() + ", v AS (SELECT id, count_if(pred)::bigint AS n_pos, max(CASE WHEN run = 0 THEN p END) AS p0 FROM runs GROUP BY id HAVING count(DISTINCT run) = 3)\n"
CELLS = "count_if(label = 'positive' AND pred)::bigint AS tp, count_if(label = 'negative' AND pred)::bigint AS fp, count_if(label = 'positive' AND NOT pred)::bigint AS fn, count_if(label = 'negative' AND NOT pred)::bigint AS tn"

Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[f.__name__] = (f, sql)
        return f

    return add


SCORE_COLUMNS = ["run", "predictions_total", "labels_total", "model_positive", "model_negative", "tp", "fp", "pool_fn", "sample_n", "sample_k", "n_unsampled", "pool_unlabeled", "brier_n"]
SCORE_RATES = ["precision", "fn_rate", "fn_lo", "fn_hi", "est_fn", "recall", "recall_lo", "recall_hi", "f1", "brier"]


@query(
    RUN_SQL
    + """, j AS (SELECT runs.*, label, sample_role FROM runs LEFT JOIN lab USING (id)),
c AS (SELECT run, count(*) AS predictions_total, count(label) AS labels_total, count_if(pred)::bigint AS model_positive, count_if(NOT pred)::bigint AS model_negative,
 count_if(pred AND label = 'positive')::bigint AS tp, count_if(pred AND label = 'negative')::bigint AS fp, count_if(NOT pred AND label = 'positive' AND sample_role = 'pool')::bigint AS pool_fn,
 count_if(NOT pred AND label IN ('positive', 'negative') AND sample_role = 'random_sample')::bigint AS sample_n, count_if(NOT pred AND label = 'positive' AND sample_role = 'random_sample')::bigint AS sample_k,
 count_if(NOT pred AND label IS NULL)::bigint AS n_unsampled, count_if(label IN ('positive', 'negative'))::bigint AS brier_n,
 avg(CASE WHEN label IN ('positive', 'negative') THEN pow(p - (label = 'positive')::int, 2) END) AS brier FROM j GROUP BY run),
e AS (SELECT *, model_positive - tp - fp AS pool_unlabeled, tp / nullif(tp + fp, 0) AS precision, coalesce(sample_k / nullif(sample_n, 0), 0) AS fn_rate,
 (fn_rate + 3.8416 / (2 * sample_n)) / (1 + 3.8416 / sample_n) AS mid, 1.96 * sqrt(fn_rate * (1 - fn_rate) / sample_n + 3.8416 / (4.0 * sample_n * sample_n)) / (1 + 3.8416 / sample_n) AS half,
 greatest(0, mid - half) AS fn_lo, least(1, mid + half) AS fn_hi, pool_fn + fn_rate * n_unsampled AS est_fn, tp / (tp + est_fn) AS recall,
 tp / (tp + pool_fn + fn_hi * n_unsampled) AS recall_lo, tp / (tp + pool_fn + fn_lo * n_unsampled) AS recall_hi, 2 * precision * recall / (precision + recall) AS f1 FROM c)
SELECT """
    + ", ".join(SCORE_COLUMNS)
    + ", "
    + ", ".join(f"floor({c} * 10000 + 0.5) / 10000.0 AS {c}" for c in SCORE_RATES)
    + " FROM e"
)
def scorecard_by_run(spark, d):
    out = evaluate.scorecard(runs(spark, d), labels(spark, d), ["run"])
    return out.select(*SCORE_COLUMNS, *[M.rounded(F.col(c)).alias(c) for c in SCORE_RATES])


@query(RUN_SQL + f"SELECT run, {CELLS} FROM runs JOIN lab USING (id) WHERE label <> 'unsure' GROUP BY run")
def confusion_counts(spark, d):
    return evaluate.confusion(runs(spark, d), labels(spark, d), ["run"])


@query(RUN_SQL + f", c AS (SELECT run, {CELLS} FROM runs JOIN lab USING (id) WHERE label <> 'unsure' GROUP BY run) SELECT run, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, floor(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END * 10000 + 0.5) / 10000.0 AS f1 FROM c")
def prf_zero(spark, d):
    return evaluate.precision_recall(confusion_counts(spark, d)).withColumn("f1", M.rounded(F.col("f1")))


@query(
    RUN_SQL
    + """, b AS (SELECT least(floor(p * 10)::int, 9) AS bin, count(*) AS n, avg(p) AS mean_p, count_if(label = 'positive')::bigint AS k
 FROM runs JOIN lab USING (id) WHERE run = 1 AND label <> 'unsure' GROUP BY 1)
SELECT r.range::int AS bin, r.range / 10.0 AS lower, (r.range + 1) / 10.0 AS upper, coalesce(n, 0) AS n,
 floor(mean_p * 10000 + 0.5) / 10000.0 AS mean_p, floor(k * 10000 / n + 0.5) / 10000.0 AS frac_positive FROM range(10) r LEFT JOIN b ON r.range = b.bin"""
)
def reliability_bins(spark, d):
    out = evaluate.reliability(run(spark, d, 1), labels(spark, d))
    return out.select("bin", "lower", "upper", "n", M.rounded(F.col("mean_p")).alias("mean_p"), M.rounded(F.col("frac_positive")).alias("frac_positive"))


@query("SELECT doc_id + 1000000000 AS id FROM labels WHERE doc_id % 11 = 0")
def orphan_labels(spark, d):
    """Every eleventh label is also given to an id that no prediction has."""
    own = labels(spark, d)
    foreign = own.where("id % 11 = 0").withColumn("id", F.col("id") + 1_000_000_000)
    return evaluate.orphan_labels(run(spark, d, 0), own.unionByName(foreign).unionByName(foreign))


@query(RUN_SQL + "SELECT id, label FROM lab WHERE id IN (SELECT id FROM runs WHERE run = 0 AND NOT pred)")
def labeled_negatives_semi(spark, d):
    return labels(spark, d).join(run(spark, d, 0).where("not prediction"), "id", "left_semi").select("id", "label")


@query("""WITH s AS (SELECT strftime(unnest(generate_series(date '1991-11-01', date '1998-12-01', interval 1 month)), '%Y-%m') AS ym),
o AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, o_orderpriority IN ('1-URGENT', '2-HIGH') AS bot FROM orders)
SELECT coalesce(ym, 'total') AS ym, count(bot) AS n_in, coalesce(count_if(NOT bot), 0)::bigint AS kept, coalesce(count_if(bot), 0)::bigint AS dropped FROM s LEFT JOIN o USING (ym) GROUP BY ROLLUP (ym)""")
def bot_filter_monthly(spark, d):
    """Orders as mails of a month; two priorities stand for bots, one by address and one by domain."""
    kind = F.col("o_orderpriority")
    sender = F.when(kind == "1-URGENT", S.BOT_SENDER.upper()).when(kind == "2-HIGH", "ci" + S.BOT_DOMAIN).otherwise("jira@apache.org.example")
    mails = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("ym"), sender.alias("sender"))
    return files.filter_months(mails, month_spine(spark, "1991-11", "1998-12"), S.is_bot(F.col("sender")))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedupe_last_wins(spark, d):
    return evaluate.last_wins(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query(RUN_SQL + "SELECT a.run AS run_i, b.run AS run_j, count(*) AS n_compared, count_if(a.pred <> b.pred)::bigint AS disagree, count_if(a.pred AND NOT b.pred)::bigint AS pos_to_neg, count_if(NOT a.pred AND b.pred)::bigint AS neg_to_pos FROM runs a JOIN runs b ON a.id = b.id AND a.run < b.run GROUP BY 1, 2")
def run_pairwise_agreement(spark, d):
    return compare.pairwise(runs(spark, d), list(range(len(RUNS))))


@query(RUN_SQL + "SELECT count_if(a.pred AND NOT b.pred)::bigint AS pos_to_neg, count_if(NOT a.pred AND b.pred)::bigint AS neg_to_pos, floor(coalesce(100.0 * pos_to_neg / nullif(pos_to_neg + neg_to_pos, 0), 0) * 10000 + 0.5) / 10000.0 AS pct_pos_to_neg FROM runs a JOIN runs b ON a.id = b.id AND a.run < b.run")
def flip_asymmetry(spark, d):
    return compare.flip_asymmetry(run_pairwise_agreement(spark, d)).withColumn("pct_pos_to_neg", M.rounded(F.col("pct_pos_to_neg")))


@query(VOTES_SQL + "SELECT n_pos, count(*) AS n FROM v GROUP BY n_pos")
def vote_histogram(spark, d):
    return compare.vote_histogram(runs(spark, d), len(RUNS))


@query(VOTES_SQL + "SELECT id, n_pos, p0, row_number() OVER (ORDER BY p0 DESC, id) AS place FROM v WHERE n_pos BETWEEN 1 AND 2")
def unstable_items(spark, d):
    """By falling probability in the first run."""
    p0 = run(spark, d, 0).select("id", F.col("p_positive").alias("p0"))
    out = compare.unstable(runs(spark, d), len(RUNS)).join(p0, "id")
    return M.ranked(out, [F.desc("p0"), F.col("id")], "place")


@query(VOTES_SQL + "SELECT least(floor(p0 * 10)::int, 9) AS bin, count(*) AS total, count_if(n_pos = 0)::bigint AS stable_neg, count_if(n_pos = 3)::bigint AS stable_pos, count_if(n_pos BETWEEN 1 AND 2)::bigint AS unstable FROM v GROUP BY 1")
def stability_by_bin(spark, d):
    return compare.stability_by_bin(runs(spark, d), len(RUNS), 0)


@query(RUN_SQL + "SELECT CASE WHEN l.label = 'unsure' THEN 'unsure' WHEN r.pred THEN 'positive' ELSE 'negative' END AS v1, l.label AS v2, count(*) AS n FROM lab l JOIN runs r ON r.id = l.id AND r.run = 1 GROUP BY 1, 2")
def label_confusion_matrix(spark, d):
    v2 = labels(spark, d)
    v1 = v2.join(run(spark, d, 1).select("id", "prediction"), "id").select("id", F.when(F.col("label") == "unsure", "unsure").when(F.col("prediction"), "positive").otherwise("negative").alias("label"))
    return compare.label_confusion(v1, v2)


@query(RUN_SQL + "SELECT count_if(a.pred AND b.pred)::bigint AS agree_pos, count_if(NOT a.pred AND NOT b.pred)::bigint AS agree_neg, count_if(a.pred AND NOT b.pred)::bigint AS pos_to_neg, count_if(NOT a.pred AND b.pred)::bigint AS neg_to_pos FROM runs a JOIN runs b ON a.id = b.id AND a.run = 0 AND b.run = 1")
def flip_counts(spark, d):
    return compare.flips(run(spark, d, 0), run(spark, d, 1))


@query(RUN_SQL + "SELECT id FROM runs WHERE run = 0 AND pred EXCEPT SELECT id FROM runs WHERE run = 1 AND pred")
def only_in_first_run(spark, d):
    return run(spark, d, 0).where("prediction").select("id").exceptAll(run(spark, d, 1).where("prediction").select("id"))


@query(RUN_SQL + "SELECT DISTINCT id FROM runs WHERE pred")
def union_positives(spark, d):
    return runs(spark, d).where("prediction").select("id").distinct()


@query(RUN_SQL + "SELECT l.id, a.pred AS first, b.pred AS second FROM lab l LEFT JOIN runs a ON a.id = l.id AND a.run = 0 LEFT JOIN runs b ON b.id = l.id AND b.run = 1 AND b.pred")
def coverage_matrix(spark, d):
    a = run(spark, d, 0).select("id", F.col("prediction").alias("first"))
    b = run(spark, d, 1).where("prediction").select("id", F.col("prediction").alias("second"))
    return labels(spark, d).select("id").join(a, "id", "left").join(b, "id", "left")


@query(RUN_SQL + "SELECT CASE WHEN p < .01 THEN '<.01' WHEN p < .1 THEN '.01-.1' WHEN p < .5 THEN '.1-.5' WHEN p < .9 THEN '.5-.9' ELSE '>=.9' END AS bucket, count(*) AS n FROM runs WHERE run = 0 GROUP BY 1")
def p_distribution_buckets(spark, d):
    p = F.col("p_positive")
    b = F.when(p < 0.01, "<.01").when(p < 0.1, ".01-.1").when(p < 0.5, ".1-.5").when(p < 0.9, ".5-.9").otherwise(">=.9")
    return run(spark, d, 0).groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


SUBJECTS = ["[VOTE] Release {v}", "Re: [VOTE] Release {v}", "Proposal: {v}", "Re: proposal {v}", "[VOTE PASSED] Release {v}", "[DISCUSS] plans", "fwd: Proposal again", "notes of the week"]
CORPUS_SQL = (
    RUN_SQL.rstrip()
    + """, corpus AS (SELECT doc_id AS id, replace(list_extract(["""
    + ", ".join(f"'{s}'" for s in SUBJECTS)
    + """], doc_id % 8 + 1), '{v}', '2.' || doc_id % 4) AS subject,
 coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN ' We postpone 2.1.' || doc_id % 9 || ' now' WHEN 1 THEN ' a re-roll of 3.0' WHEN 2 THEN ' 1.2.3 only' ELSE '' END AS body FROM documents)
"""
)
SWEEP_SQL = (
    CORPUS_SQL
    + r""", neg AS (SELECT id, subject, body, contains(replace(replace(replace(upper(subject), '[VOTE PASSED]', ''), '[VOTE CLOSED]', ''), '[VOTE FAILED]', ''), '[VOTE]') AS literal,
 regexp_matches(subject, '(?i)\[VOTE\b') OR regexp_matches(subject, '(?i)^proposal') AS marked, NOT regexp_matches(lower(subject), '^(re:|fwd:)') AS root
 FROM runs JOIN corpus USING (id) WHERE run = 0 AND NOT pred),
m AS (SELECT id, pool, CASE pool WHEN 'P0' THEN false
 WHEN 'P1' THEN regexp_matches(body, '\b\d+\.\d+\.\d+\b') AND NOT literal AND regexp_matches(body,
  '(?i)\b(re-?roll|take it down|takedown|postpone|shorten|cadence|LTS|cycle|i propose|proposal:|let''s do a|move(d)? to)\b')
 WHEN 'P2' THEN marked AND (root OR length(body) > 800) WHEN 'P3' THEN marked ELSE true END AS inside
 FROM neg, (VALUES ('P0'), ('P1'), ('P2'), ('P3'), ('P_full')) p(pool)),
s AS (SELECT pool, count_if(inside)::bigint AS pool_size FROM m GROUP BY pool),
f AS (SELECT c.id, s.pool, CASE WHEN NOT c.pred AND coalesce(m.inside, false) THEN b.pred ELSE c.pred END AS pred
 FROM runs c JOIN runs b ON b.id = c.id AND b.run = 1 AND c.run = 0 CROSS JOIN s LEFT JOIN m ON m.id = c.id AND m.pool = s.pool),
c AS (SELECT pool, """
    + CELLS
    + """ FROM f JOIN lab USING (id) WHERE label <> 'unsure' GROUP BY pool),
sweep AS (SELECT pool, pool_size, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
 CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
 pool_size * 100.0 / (SELECT count(*) FROM documents) AS pct_calls FROM c JOIN s USING (pool))
"""
)


def rates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: M.rounded(F.col(c)) for c in names})


def four(*names: str) -> str:
    return ", ".join(f"floor({c} * 10000 + 0.5) / 10000.0 AS {c}" for c in names)


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """A mail for each document, with a subject of eight kinds and in part a release sentence behind its text."""
    i = F.col("doc_id")
    subject = F.replace(F.get(F.array(*[F.lit(s) for s in SUBJECTS]), (i % 8).cast("int")), F.lit("{v}"), F.concat(F.lit("2."), i % 4))
    more = F.when(i % 5 == 0, F.concat(F.lit(" We postpone 2.1."), i % 9, F.lit(" now"))).when(i % 5 == 1, " a re-roll of 3.0").when(i % 5 == 2, " 1.2.3 only").otherwise("")
    return table(spark, d, "documents").select(i.alias("id"), subject.alias("subject"), F.concat(F.coalesce("text", F.lit("")), more).alias("body"))


@query(SWEEP_SQL + f"SELECT pool, pool_size, tp, fp, fn, tn, {four('precision', 'recall', 'f1', 'pct_calls')} FROM sweep")
def escalation_pool_sweep(spark, d):
    out = escalate.pool_sweep(run(spark, d, 0), run(spark, d, 1), corpus(spark, d), labels(spark, d))
    return rates(out.select("pool", "pool_size", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "pct_calls"), "precision", "recall", "f1", "pct_calls")


@query(RUN_SQL + "SELECT CASE WHEN b.pred THEN 'new' ELSE 'lost' END AS kind, count(*) AS total, count(label) AS labeled, count_if(label IS NULL)::bigint AS unlabeled FROM runs a JOIN runs b ON a.id = b.id AND a.run = 0 AND b.run = 1 AND a.pred <> b.pred LEFT JOIN lab ON lab.id = a.id GROUP BY 1")
def movement(spark, d):
    return escalate.movement(run(spark, d, 0), run(spark, d, 1), labels(spark, d))


@query(
    CORPUS_SQL
    + r""", x AS (SELECT id, regexp_extract_all(subject || chr(10) || body, '\b(\d\.\d(?:\.\d{1,2})?(?:-[A-Za-z0-9]+)?)\b', 1) AS l FROM corpus),
u AS (SELECT id, unnest(l) AS v, generate_subscripts(l, 1) AS p FROM x), f AS (SELECT id, v, min(p) AS p FROM u GROUP BY 1, 2)
SELECT id, coalesce(string_agg(v, ' ' ORDER BY p), '') AS versions FROM corpus LEFT JOIN f USING (id) GROUP BY id"""
)
def version_extract(spark, d):
    """Versions of subject and body in the order in which they are first seen."""
    return corpus(spark, d).select("id", F.array_join(X.versions(F.concat_ws("\n", "subject", "body")), " ").alias("versions"))


@query("SELECT user_id, min(ts) AS first_mention_at, min(CASE WHEN event_type = 'signup' THEN ts END) AS announced_at, min(CASE WHEN event_type = 'purchase' THEN ts END) AS passed_at, min(CASE WHEN event_type = 'error' THEN ts END) AS closed_at FROM events GROUP BY user_id")
def version_event_log(spark, d):
    log = versions.event_log(vote_mails(spark, d))
    return log.select(F.substring_index("version", "-", -1).cast("long").alias("user_id"), "first_mention_at", "announced_at", "passed_at", "closed_at")


@query("WITH l AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS a, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p, min(CASE WHEN event_type = 'error' THEN ts END) AS c FROM events GROUP BY user_id) SELECT CASE WHEN p <= ts THEN 'vote_passed' WHEN c <= ts THEN 'vote_failed' WHEN a <= ts THEN 'vote_active' ELSE 'pre_announcement' END AS state, count(*) AS n FROM events JOIN l USING (user_id) GROUP BY 1")
def version_state_asof(spark, d):
    log = version_event_log(spark, d).withColumnRenamed("user_id", "version")
    q = table(spark, d, "events").select(F.col("user_id").alias("version"), "ts")
    return versions.states(q, log).groupBy("state").agg(F.count("*").alias("n"))


@query(RUN_SQL + ", l AS (SELECT id, unnest(string_split(body, chr(10))) AS line FROM msg) SELECT length(regexp_replace(regexp_extract(line, '^(?:\\s*>)*'), '[^>]', '', 'g')) AS depth, count(*) AS n FROM l WHERE line <> '' GROUP BY 1")
def quote_depth_lines(spark, d):
    rows = messages(spark, d).select(F.explode(X.lines(F.col("body"))).alias("line")).where("line <> ''")
    return rows.groupBy(X.quote_depth(F.col("line")).cast("long").alias("depth")).agg(F.count("*").alias("n"))


def _extract_sql(keep: str, shown: str) -> str:
    return RUN_SQL + f", l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM msg), q AS (SELECT *, length(regexp_replace(regexp_extract(line, '^(?:\\s*>)*'), '[^>]', '', 'g')) AS depth FROM l), k AS (SELECT id, pos, {shown} AS line FROM q WHERE {keep}), b AS (SELECT *, trim(line) = '' AS blank, lag(trim(line) = '') OVER (PARTITION BY id ORDER BY pos) AS before FROM k), t AS (SELECT id, rtrim(string_agg(CASE WHEN blank THEN '' ELSE line END, chr(10) ORDER BY pos), chr(10) || ' ') AS text FROM b WHERE NOT blank OR NOT coalesce(before, true) GROUP BY id) SELECT msg.id, md5(CASE WHEN coalesce(text, '') = '' THEN '' ELSE text || chr(10) END) AS digest FROM msg LEFT JOIN t USING (id)"


@query(_extract_sql("depth <= 1", "line"))
def extract_depth1(spark, d):
    return messages(spark, d).select("id", F.md5(X.extract_at_depth(F.col("body"), 1)).alias("digest"))


@query(_extract_sql("depth <= 2", "CASE WHEN depth > 0 THEN repeat('> ', depth::int) || '[QUOTED]' ELSE line END"))
def elide_depth2(spark, d):
    return messages(spark, d).select("id", F.md5(X.elide_quoted(F.col("body"), 2)).alias("digest"))


@query(RUN_SQL + ", s AS (SELECT '42:' || id AS k, id FROM runs WHERE run = 0 AND NOT pred ORDER BY md5('42:' || id) LIMIT 100) SELECT id, 'pool' AS sample_role FROM runs WHERE run = 0 AND pred UNION ALL SELECT id, 'random_sample' FROM s")
def labeling_sheet_sample(spark, d):
    return sampling.labeling_sheet(run(spark, d, 0))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, sum(length(text))::bigint AS chars FROM documents GROUP BY source")
def corpus_profile(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.sum(F.length("text")).alias("chars"))


@query("SELECT strftime(m, '%Y-%m') AS ym, count(o_orderkey) AS orders FROM (SELECT unnest(generate_series(date '1992-01-01', date '1998-12-01', interval 1 month)) AS m) LEFT JOIN orders ON strftime(o_orderdate, '%Y-%m') = strftime(m, '%Y-%m') GROUP BY 1")
def month_volumes(spark, d):
    by = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("ym")).agg(F.count("*").alias("orders"))
    return month_spine(spark, "1992-01", "1998-12").join(by, "ym", "left").select("ym", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query("""SELECT event_type, count(value) AS n, max(value) AS longest, floor(avg(value) * 10000 + 0.5) / 10000.0 AS mean, median(value) AS median,
 list_sort(list(value))[1 + round_even(0.95 * (count(value) - 1), 0)::int] AS p95 FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY event_type""")
def latency_percentiles(spark, d):
    """Events as calls, of which errors failed."""
    calls = table(spark, d, "events").select("event_type", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed_s")).where("elapsed_s is not null")
    return rates(scoring.latency_report(calls, ["event_type"]), "mean").select("event_type", "n", "longest", "mean", "median", "p95")


@query("SELECT event_type, count(value) AS n, floor(count(value) / 3600.0 * 10000 + 0.5) / 10000.0 AS per_second, " + ", ".join(f"list_sort(list(value))[1 + round_even({p} * (count(value) - 1), 0)::int] AS p{int(100 * p)}" for p in (0.5, 0.9, 0.99)) + " FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY event_type")
def latency_table(spark, d):
    """Events of an hour as calls."""
    calls = table(spark, d, "events").select("event_type", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("elapsed_s")).where("elapsed_s is not null")
    return rates(scoring.latency_report(calls, ["event_type"], 3600.0), "per_second").select("event_type", "n", "per_second", "p50", "p90", "p99")


@query("SELECT doc_id AS id, 'synth-' || substring(sha256(coalesce(source, '') || chr(0) || coalesce(lang, '') || chr(0) || '' || chr(0) || substring(coalesce(text, ''), 1, 4096)), 1, 16) AS synth FROM documents")
def synthetic_ids(spark, d):
    part = {c: F.coalesce(F.col(c), F.lit("")) for c in ("source", "lang", "text")}
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), X.synthetic_id(part["source"], part["lang"], F.lit(""), part["text"]).alias("synth"))


@query("""WITH l AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts END) AS a, min(CASE WHEN event_type = 'purchase' THEN ts END) AS p, min(CASE WHEN event_type = 'error' THEN ts END) AS c FROM events GROUP BY user_id)
SELECT event_id AS id, 'VERSION CONTEXT (state at this message''s timestamp):' || chr(10) || '- 1.' || user_id % 10 || '.' || user_id // 10 % 100 || '-' || user_id || ': ' ||
 CASE WHEN p <= ts THEN 'vote_passed (passed ' || strftime(p, '%Y-%m-%d') || ')' WHEN c <= ts THEN 'vote_failed (closed ' || strftime(c, '%Y-%m-%d') || ')'
 WHEN a <= ts THEN 'vote_active (announced ' || strftime(a, '%Y-%m-%d') || ')' ELSE 'pre_announcement (no [VOTE] yet)' END AS block FROM events JOIN l USING (user_id)""")
def version_block(spark, d):
    mails = vote_mails(spark, d)
    return versions.context_blocks(mails, versions.event_log(mails))


ATTRIBUTED = "On Mon, Mar 3, 2014 at 9:00 AM, A. Writer <\nwriter@example.org> wrote:"
# A line that starts with "On " above the attribution is taken for its beginning.
_OWN = _extract_sql("true QUALIFY depth = 0 AND NOT (starts_with(trim(line), 'On ') AND coalesce(lead(depth) OVER (PARTITION BY id ORDER BY pos), 0) > 0)", "line")
CONTEXT_WITH = _OWN.rpartition(" SELECT msg.id")[0] + """, z AS (SELECT *, depth IS DISTINCT FROM lag(depth) OVER (PARTITION BY id ORDER BY pos) AS fresh FROM q),
z2 AS (SELECT *, sum(fresh::int) OVER (PARTITION BY id ORDER BY pos) AS run FROM z),
seg AS (SELECT id, run, depth, rtrim(string_agg(line, chr(10) ORDER BY pos), chr(10) || chr(9) || ' ') AS text FROM z2 WHERE depth > 0 GROUP BY id, run, depth),
ctx AS (SELECT msg.id, coalesce(any_value(t.text), '') AS own, string_agg('[depth ' || depth || ']' || chr(10) || seg.text, chr(10) || chr(10) ORDER BY run) AS quoted,
 contains(any_value(body), chr(10) || '> ') AS attributed FROM msg LEFT JOIN t USING (id) LEFT JOIN seg USING (id) GROUP BY msg.id)
"""


def attributed(spark: SparkSession, d: str) -> DataFrame:
    """The messages with a wrapped attribution above their quotes."""
    return messages(spark, d).withColumn("body", F.regexp_replace("body", r"(?s)^(.*?)\n> ", "$1\n" + ATTRIBUTED + "\n> "))


@query(CONTEXT_WITH + "SELECT id, md5(own) AS own, md5(coalesce(quoted, '')) AS quoted, CASE WHEN attributed THEN 'On Mon, Mar 3, 2014 at 9:00 AM, A. Writer < writer@example.org> wrote:' ELSE '' END AS attributions FROM ctx")
def message_context(spark, d):
    c = attributed(spark, d).select("id", X.message_context("body").alias("c"))
    segments = F.transform("c.quoted_segments", lambda s: F.concat(F.lit("[depth "), s["depth"].cast("string"), F.lit("]\n"), s["text"]))
    return c.select("id", F.md5("c.new_content").alias("own"), F.md5(F.array_join(segments, "\n\n")).alias("quoted"), F.regexp_extract(F.array_join("c.attribution_lines", "|"), "On Mon, Mar.*$", 0).alias("attributions"))


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 15 HOUR, '%Y-%m-%d %H:%M:%S') AS utc FROM orders")
def mail_dates(spark, d):
    stamp = F.concat(F.date_format("o_orderdate", "E, d MMM yyyy"), F.lit(" 10:00:00 "), F.when(F.col("o_orderkey") % 2 == 0, "-0500").otherwise("EST"), F.lit(" (zone)"))
    return table(spark, d, "orders").select("o_orderkey", F.date_format(X.mail_date(stamp), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT doc_id AS id, doc_id % 2 = 0 AS prediction, source AS evidence_quote, md5(coalesce(text, '')) AS rationale FROM documents")
def answers_parsed(spark, d):
    """Answers that hold whole texts: plain, fenced, without their brace, without quote and brace."""
    docs = table(spark, d, "documents")
    said = F.struct((F.col("doc_id") % 2 == 0).alias("is_schedule_change_announcement"), F.col("source").alias("evidence_quote"), F.coalesce("text", F.lit("")).alias("rationale"))
    answer, kind = F.to_json(said), F.col("doc_id") % 4
    short = lambda n: F.substring(answer, F.lit(1), F.length(answer) - n)
    shown = F.when(kind == 1, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).when(kind == 2, short(1)).when(kind == 3, short(2)).otherwise(answer)
    read = docs.select(F.col("doc_id").alias("id"), scoring.parse_answer(shown).alias("a"))
    return read.select("id", F.col("a.is_schedule_change_announcement").alias("prediction"), "a.evidence_quote", F.md5("a.rationale").alias("rationale"))


@query(RUN_SQL + "SELECT run, id, floor((CASE WHEN p = 0 THEN CASE WHEN pred THEN .999 ELSE .001 END ELSE p END) * 10000 + 0.5) / 10000.0 AS p FROM runs")
def logprob_reading(spark, d):
    p = F.col("p_positive")
    alt = F.array(F.struct(F.lit(" true").alias("token"), F.log(p).alias("logprob")), F.struct(F.lit("false").alias("token"), F.log(1 - p).alias("logprob")))
    token = F.struct(F.when(p >= 0.5, "true").otherwise("false").alias("token"), F.log(F.greatest(p, 1 - p)).alias("logprob"), alt.alias("top_logprobs"))
    tokens = F.when(p > 0, F.array(token)).otherwise(F.array().cast("array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>"))
    return runs(spark, d).select("run", "id", M.rounded(scoring.p_positive(tokens, F.col("prediction"))).alias("p"))
