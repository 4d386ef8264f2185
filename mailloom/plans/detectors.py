"""Structural detectors over orders, lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailloom.functions import subjects as S
from mailloom.operators import detectors as D
from mailloom.plans.queries import CORPUS_SQL, corpus, four, labels, query, rates, run, table


@query("""WITH i AS (SELECT l_suppkey, row_number() OVER () AS k, l_shipdate AS s, l_shipdate + to_days(l_linenumber::int) AS e FROM lineitem),
n AS (SELECT a.l_suppkey, a.k, count(b.k) AS n FROM i a LEFT JOIN i b ON a.l_suppkey = b.l_suppkey AND a.k <> b.k AND a.s < b.e AND b.s < a.e GROUP BY 1, 2)
SELECT l_suppkey, count(*) AS intervals, count_if(n > 0)::bigint AS overlapping, sum(n)::bigint AS met, max(n)::bigint AS most FROM n GROUP BY l_suppkey""")
def double_booking_overlap(spark, d):
    """Lines bind their supplier from shipping on, for as many days as their number."""
    line = table(spark, d, "lineitem").select("l_suppkey", F.monotonically_increasing_id().alias("k"), F.col("l_shipdate").cast("timestamp").alias("s"), "l_linenumber")
    line = line.withColumn("e", F.timestamp_add("DAY", F.col("l_linenumber").cast("int"), F.col("s")))
    n = F.col("n_overlaps")
    out = D.overlaps(line, "l_suppkey", "s", "e", "k").groupBy("l_suppkey")
    return out.agg(F.count("*").alias("intervals"), F.count_if(n > 0).alias("overlapping"), F.sum(n).alias("met"), F.max(n).alias("most"))


@query("""SELECT l_linenumber, count(*) AS n FROM (SELECT l_linenumber, l_shipdate, lag(l_shipdate + INTERVAL 2 DAY) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before FROM lineitem)
WHERE l_shipdate < before GROUP BY 1""")
def dependency_violation(spark, d):
    """Lines of an order follow each other; each takes two days."""
    line = table(spark, d, "lineitem").withColumn("ship", F.col("l_shipdate").cast("timestamp"))
    late = D.early_successors(line, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "ship", F.timestamp_add("DAY", F.lit(2), F.col("ship")))
    return late.groupBy("l_linenumber").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT l_suppkey, date_diff('day', o_orderdate::date, l_shipdate::date) AS lead FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
h AS (SELECT l_suppkey, sum(lead)::bigint AS total, count(*) AS n FROM j GROUP BY 1) SELECT l_suppkey, count_if(lead * n < total)::bigint AS squeezed, any_value(n) AS n FROM j JOIN h USING (l_suppkey) GROUP BY 1""")
def lead_time_squeeze(spark, d):
    """Lines that leave their supplier less time than it takes on average."""
    line = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.select("l_suppkey", F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("lead"))
    past = line.groupBy("l_suppkey").agg(F.sum("lead").alias("total"), F.count("*").alias("n"))
    out = line.join(past, "l_suppkey").groupBy("l_suppkey")
    return out.agg(F.count_if(F.col("lead") * F.col("n") < F.col("total")).alias("squeezed"), F.max("n").alias("n"))


@query("""SELECT user_id, min(slack)::bigint AS least, count_if(slack < 0)::bigint AS below FROM (SELECT user_id,
 sum(CASE WHEN event_type = 'error' THEN -floor(value * 100)::bigint ELSE floor(value * 20)::bigint END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS slack FROM events) GROUP BY user_id""")
def slack_consumption_drift(spark, d):
    """Errors use up slack, other events give some back; the running sum of each user's chain."""
    change = F.when(F.col("event_type") == "error", -F.floor(F.col("value") * 100)).otherwise(F.floor(F.col("value") * 20))
    rows = D.against_own_past(table(spark, d, "events").withColumn("change", change), "user_id", ["ts", "event_id"], "change")
    slack = F.col("past_sum") + F.col("change")
    return rows.groupBy("user_id").agg(F.min(slack).alias("least"), F.count_if(slack < 0).alias("below"))


@query("""WITH g AS (SELECT user_id, event_id, ts, date_diff('second', lag(ts) OVER w, ts) AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT *, count(gap) OVER w AS n, coalesce(sum(gap) OVER w, 0) AS total FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, gap FROM p WHERE n >= 3 AND gap * n > 3 * total""")
def vendor_silence_gap(spark, d):
    return D.silences(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "gap")


@query("""SELECT event_type, count_if(v < before - 50)::bigint AS drops, count_if(v > before + 50)::bigint AS jumps FROM
(SELECT event_type, floor(value)::bigint AS v, lag(floor(value)::bigint) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) GROUP BY 1""")
def confidence_interval_drift(spark, d):
    """Values that move by more than 50 since the last of their user and kind."""
    own = table(spark, d, "events").withColumn("who", F.concat_ws(":", "user_id", "event_type")).withColumn("v", F.floor("value"))
    out = D.against_own_past(own, "who", ["ts", "event_id"], "v").groupBy("event_type")
    return out.agg(F.count_if(F.col("v") < F.col("previous") - 50).alias("drops"), F.count_if(F.col("v") > F.col("previous") + 50).alias("jumps"))


@query("""WITH t AS (SELECT source, doc_id, length(text) - length(replace(text, '!', '')) AS marks FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
p AS (SELECT *, count(*) OVER w AS n, coalesce(sum(marks) OVER w, 0) AS total FROM t WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, count_if(n > 0 AND marks * n > 2 * total)::bigint AS raised, sum(marks)::bigint AS marks FROM p GROUP BY source""")
def risk_escalation_language(spark, d):
    """Texts with more than twice the exclamation marks that their source had on average before."""
    docs = table(spark, d, "documents").where("text is not null and source is not null").withColumn("marks", F.regexp_count("text", F.lit("!")))
    rows = D.against_own_past(docs, "source", ["doc_id"], "marks")
    raised = (F.col("past_n") > 0) & (F.col("marks") * F.col("past_n") > 2 * F.col("past_sum"))
    return rows.groupBy("source").agg(F.count_if(raised).alias("raised"), F.sum("marks").alias("marks"))


DETECTORS = {"discuss": S.DISCUSS, "proposal": S.PROPOSAL_ANYWHERE, "vote": S.VOTE}


@query(
    CORPUS_SQL
    + r""", m AS (SELECT id, regexp_matches(subject, '(?i)\[DISCUSS\b') AS a, regexp_matches(subject, '(?i)\bproposal\b') AS b, regexp_matches(subject, '(?i)\[VOTE\b') AS c, regexp_matches(body, '\b\d+\.\d+\.\d+\b') AS v FROM corpus)
SELECT (a::int + b::int + c::int + v::int)::bigint AS n_matched, CASE WHEN a THEN 'discuss' WHEN b THEN 'proposal' WHEN v THEN 'version' WHEN c THEN 'vote' END AS first, count(*) AS n FROM m GROUP BY 1, 2"""
)
def matched_nothing_or_many(spark, d):
    hits = {n: S.matches(F.col("subject"), p) for n, p in DETECTORS.items()} | {"version": F.col("body").rlike(S.VERSION_XYZ)}
    found = D.matched(corpus(spark, d), "id", hits)
    return found.groupBy(F.col("n_matched").cast("long").alias("n_matched"), "first").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT coalesce(source, 'none') AS signal, toxic = 1 AS bad FROM documents JOIN labels USING (doc_id)), s AS (SELECT count(*) AS n, count_if(bad)::bigint AS yes FROM t),
c AS (SELECT signal, count_if(bad)::bigint AS n11, count_if(NOT bad)::bigint AS n10 FROM t GROUP BY 1), f AS (SELECT signal, n11, n10, (yes - n11)::bigint AS n01, (n - yes - n10)::bigint AS n00 FROM c, s),
x AS (SELECT *, (n11 + n10 + n01 + n00)::double * (n11 * n00 - n10 * n01)::double * (n11 * n00 - n10 * n01)::double / nullif((n11 + n10)::double * (n01 + n00) * (n11 + n01) * (n10 + n00), 0) AS chi2 FROM f)
SELECT signal, n11, n10, n01, n00, """
    + four("chi2")
    + " FROM x"
)
def consequence_correlation(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.coalesce("source", F.lit("none")).alias("signal"), (F.col("toxic") == 1).alias("bad"))
    return rates(D.association(rows, "signal", "bad"), "chi2")


@query("SELECT ts < TIMESTAMP '2024-01-20' AS training, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def time_bounded_split(spark, d):
    """No random split: what lies before a day is for training."""
    early = F.col("ts").cast("timestamp") < F.lit("2024-01-20").cast("timestamp")
    return table(spark, d, "events").groupBy(early.alias("training"), "event_type").agg(F.count("*").alias("n"))


@query(None)
def isotonic_calibration(spark, d):
    """Calibrated probabilities of a run; iterative, so without SQL."""
    return rates(D.calibrated(run(spark, d, 1), labels(spark, d)).select("id", "p_positive", "p_calibrated"), "p_calibrated")


@query("""SELECT user_id, event_id, stated AS stated_at FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN ts END IGNORE NULLS) OVER
 (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stated FROM events) WHERE event_type = 'purchase' AND stated < ts - INTERVAL 5 DAY""")
def stale_assumption(spark, d):
    """Purchases whose last signup of the user is over five days back."""
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    out = D.stale(events, "user_id", ["ts", "event_id"], "ts", kind == "signup", kind == "purchase", 5)
    return out.select("user_id", "event_id", F.col("stated_at").cast("timestamp_ntz").alias("stated_at"))


@query("""SELECT conv_id, turn, impact FROM (SELECT conv_id, turn, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::bigint AS impact FROM conversations)
ORDER BY impact DESC, conv_id, turn LIMIT 20""")
def linchpin_identification(spark, d):
    """The twenty turns that most text follows."""
    turns = D.downstream(table(spark, d, "conversations"), "conv_id", "turn", F.length(F.coalesce("text", F.lit(""))))
    return turns.orderBy(F.desc("impact"), "conv_id", "turn").limit(20).select("conv_id", "turn", "impact")
