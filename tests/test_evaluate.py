from pyspark.sql import functions as F

from mailloom.functions import text as X
from mailloom.operators import compare, escalate
from mailloom.operators.evaluate import scorecard

P = "id string, prediction boolean, p_positive double, ordinal long"
L = "id string, label string, sample_role string, ordinal long"


def test_stratified_scorecard(spark):
    preds = [(f"p{i}", True, 0.9, i) for i in range(10)] + [(f"n{i}", False, 0.1, i) for i in range(990)]
    labels = [(f"p{i}", "positive" if i < 8 else "negative", "pool", i) for i in range(10)]
    labels += [(f"n{i}", "positive", "pool", i) for i in range(3)] + [(f"n{i}", "positive" if i == 3 else "negative", "random_sample", i) for i in range(3, 103)]
    r = scorecard(spark.createDataFrame(preds, P), spark.createDataFrame(labels, L)).first()
    assert (r.pool_fn, r.sample_n, r.sample_k, r.n_unsampled) == (3, 100, 1, 887)
    assert abs(r.est_fn - 11.87) < 1e-6 and abs(r.recall - 0.4026) < 1e-4 and abs(r.precision - 0.8) < 1e-9 and abs(r.f1 - 0.5358) < 5e-4


def test_no_positives_is_undefined(spark):
    preds = [(f"n{i}", False, 0.1, i) for i in range(10)]
    r = scorecard(spark.createDataFrame(preds, P), spark.createDataFrame([("n1", "positive", None, 1), ("n2", "negative", None, 2)], L)).first()
    assert r.precision is None and r.f1 is None and r.sample_k == 1


def test_quote_depth_and_extraction(spark):
    lines = {"hello": 0, "": 0, "> hello": 1, ">hello": 1, "> > hello": 2, ">> hello": 2, "> >> hello": 3, "  > hello": 1}
    df = spark.createDataFrame([(k,) for k in lines], "l string")
    assert {r.l: r.d for r in df.select("l", X.quote_depth(F.col("l")).alias("d")).collect()} == lines
    body = spark.createDataFrame([("new\n\n\nOn Monday, Ann wrote:\n> one\n> > two\n",)], "b string")
    r = body.select(X.extract_at_depth(F.col("b"), 0).alias("a"), X.elide_quoted(F.col("b"), 1).alias("e")).first()
    assert r.a == "new\n" and r.e == "new\n\nOn Monday, Ann wrote:\n> [QUOTED]\n"


def test_pool_sweep(spark):
    """Against the same sweep id by id in Python; unlabelled ids, ids the frontier lacks, null subjects and repeated labels included."""
    subjects = ["[VOTE] a", "Re: [VOTE] a", "Proposal: b", "notes", None]
    bodies = ["we postpone 2.1.3 now", "nothing", None, "x" * 900]
    cheap = [(i, i % 3 == 0) for i in range(60)]
    front = {i: i % 4 == 0 for i in range(60) if i % 7}
    label = [(i, ("positive", "negative", "unsure")[i % 5 % 3]) for i in range(0, 60, 2)] + [(4, "negative")]
    mails = {i: (subjects[i % 5], bodies[i % 4]) for i in range(55)}
    sweep = escalate.pool_sweep(
        spark.createDataFrame(cheap, "id long, prediction boolean"), spark.createDataFrame(list(front.items()), "id long, prediction boolean"),
        spark.createDataFrame([(i, *m) for i, m in mails.items()], "id long, subject string, body string"), spark.createDataFrame(label, "id long, label string"),
    )

    def inside(pool, i):
        subject, body = (x or "" for x in mails.get(i, ("", "")))
        marked = "[VOTE]" in subject or subject.startswith("Proposal")
        kinds = {"P0": False, "P1": "postpone" in body and "[VOTE]" not in subject, "P2": marked and (not subject.startswith("Re:") or len(body) > 800), "P3": marked, "P_full": True}
        return kinds[pool]

    rows = {r.pool: r for r in sweep.collect()}
    assert set(rows) == {"P0", "P1", "P2", "P3", "P_full"}
    for pool, r in rows.items():
        up = {i for i, said in cheap if not said and inside(pool, i)}
        final = {i: front[i] if i in up and i in front else said for i, said in cheap}
        want = [sum(final[i] == said and which == kind for i, which in label) for said, kind in ((True, "positive"), (True, "negative"), (False, "positive"), (False, "negative"))]
        assert (r.pool_size, [r.tp, r.fp, r.fn, r.tn]) == (len(up), want) and abs(r.pct_calls - len(up) / 0.6) < 1e-9
    none = spark.createDataFrame([], "id long, prediction boolean")
    empty = escalate.pool_sweep(none, none, spark.createDataFrame([], "id long, subject string, body string"), spark.createDataFrame([], "id long, label string")).collect()
    assert all((r.pool_size, r.tp, r.f1, r.pct_calls) == (0, 0, 0.0, None) for r in empty) and len(empty) == 5


def test_rules_at_their_bounds(spark):
    scores = spark.createDataFrame([("a", 0.7, 0.65), ("b", 0.69, 0.65), ("c", 0.1, 0.5), ("d", 0.9, 0.49), ("e", None, None), ("f", float("nan"), float("nan"))], "k string, precision double, f1 double")
    verdicts = {r.k: r.verdict for r in compare.promotion(scores).collect()}
    assert verdicts == {"a": "promote", "b": "imprecise", "c": "marginal", "d": "reject", "e": "reject", "f": "reject"}
    other = compare.across_corpora(scores, spark.createDataFrame([(0.56,)], "f1 double"), band=0.08)
    assert {r.k: r.transfer for r in other.collect()} == {"a": "above", "b": "above", "c": "within", "d": "within", "e": None, "f": None}
    cards = spark.createDataFrame([(0.18,), (0.19,), (None,)], "brier double")
    assert [r.usable for r in compare.usable_probabilities(cards).collect()] == [True, False, False]
    sweep = spark.createDataFrame([("P0", 0, 0.91), ("P1", 10, 0.93), ("P2", 20, 0.95), ("P_full", 99, 0.97)], "pool string, pool_size long, f1 double")
    assert [(r.pool, r.good, r.close) for r in escalate.judged_pools(sweep).orderBy("pool").collect()] == [("P0", True, False), ("P1", True, True), ("P2", True, True), ("P_full", True, True)]
    assert escalate.smallest_good_pool(sweep).first().pool == "P1" and not escalate.smallest_good_pool(sweep, least_f1=0.98).collect()
