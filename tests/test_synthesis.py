"""Composed detectors, joins in time, calibration and ranks against plain Python."""

import itertools
import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from mailloom.functions import metrics as M
from mailloom.operators import calibrate, concerns, evaluate, graph, mining, nearby, registry, scoring
from mailloom.plans import synthesis  # noqa: F401  it registers its queries
from mailloom.plans.queries import Q


def test_longest_paths(spark):
    rng = random.Random(3)
    edges = sorted({(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a < b})
    table = spark.createDataFrame([*edges, edges[0], (None, 3), (4, None)], "src long, dst long").repartition(3)
    longest = {}
    for n in range(39, -1, -1):
        longest[n] = 1 + max((longest[b] for a, b in edges if a == n), default=0)
    assert {r.node: r.length for r in graph.longest_paths(table).collect()} == {n: longest[n] for e in edges for n in e}
    with pytest.raises(ValueError, match="cycle"):
        graph.longest_paths(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long"), most=4)
    assert graph.longest_paths(table.where("false")).count() == 0


def test_concern_trails(spark):
    """A branch is followed until it is answered; what lies behind an answer does not count again."""
    rows = [
        (1, None, "raise"), (2, 1, ""), (3, 2, "ack"), (4, 3, "ack turn"), (5, 2, "turn flag"), (6, 5, "turn"), (7, 1, "formal ack"), (8, None, "raise"), (9, 8, "decider formal"), (10, 4, "raise"), (11, None, None),
    ]
    has = lambda w: F.contains(F.col("say"), F.lit(w))
    out = concerns.concern_trails(spark.createDataFrame(rows, "id long, parent long, say string").repartition(2), *map(has, ("raise", "ack", "formal", "turn", "flag", "decider")))
    assert sorted(map(tuple, out.collect())) == [(1, 1, True, 2, 1, False), (8, None, False, 0, 0, True), (10, None, False, 0, 0, False)]


def test_concern_trails_equal_their_sql(spark, tmp_path):
    """Words end at accented letters, repeated rows count each, and rows without an id are left out."""
    rows = [
        (1, 0, "user", "of"), (1, 1, "user", "voilà la"), (1, 2, "assistant", "éla, from"), (1, 3, "user", "zuñ zuñ"), (1, 4, "user", "duè"), (1, 5, None, "zu_ zu9"),
        (2, 0, "user", "de"), (2, 0, "user", "de"), (2, 0, "system", None), (2, 1, "user", "from"), (2, 1, "user", "from, that"), (2, 3, "assistant", "that"), (2, 3, "assistant", "that"),
        (None, 0, "user", "of"), (3, None, "user", "of"), (4, 0, "user", "undé"), (4, 1, "user", "that"), (5, 0, "user", "ofen"), (5, 1, "user", "that"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    run, sql = Q["concern_trails"]
    with duckdb.connect() as con:
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
        want = con.sql(sql).fetchall()
    assert Counter(map(tuple, run(spark, str(tmp_path)).collect())) == Counter(want) and {r[0] for r in want} == {1000, 2000, 4000}


@pytest.mark.parametrize(("seconds", "inclusive"), [(10, True), (10, False), (100_000, True)])
def test_as_of_and_near_joins(spark, seconds, inclusive):
    rng = random.Random(seconds)
    left = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(0, 200, 3)])) for i in range(80)]
    right = sorted({(rng.choice(["a", "b", "c"]), rng.choice(range(0, 200, 3))) for _ in range(30)}) + [(None, 5), ("a", None)]
    when = lambda c: F.timestamp_seconds(c).alias("at")
    a = spark.createDataFrame(left, "id long, who string, s long").select("id", "who", when(F.col("s")), F.lit(1).alias("l"), F.lit(2).alias("b")).repartition(3)
    b = spark.createDataFrame(right, "who string, s long").select("who", when(F.col("s")), F.col("s").alias("t")).repartition(2)
    got = {r.id: r.last and r.last.t for r in nearby.asof(a, b, "who", "at", "at", seconds, inclusive).collect()}
    fits = lambda x, y: y < x or (inclusive and y == x)
    assert got == {i: max((t for w, t in right if w and w == who and t is not None and s is not None and fits(s, t)), default=None) for i, who, s in left}
    pairs = sorted((r.l.id, r.r.t) for r in nearby.near(a, b, "who", "at", "at", 10).collect())
    assert pairs == sorted((i, t) for i, who, s in left for w, t in right if who and who == w and s is not None and t is not None and abs(s - t) <= 10)


def test_signal_combinations(spark):
    rng = random.Random(1)
    rows = [([rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(9))], rng.choice([True, False, None])) for _ in range(120)] + [(None, True)]
    out = mining.signal_combinations(spark.createDataFrame(rows, "signals array<string>, bad boolean"), F.col("signals"), F.col("bad"), 12)
    want = {}
    for k in (1, 2, 3):
        for c in itertools.combinations("abcd", k):
            own = [bool(bad) for s, bad in rows if set(c) <= set(s or [])]
            if len(own) >= 12:
                yes = sum(bool(bad) for _, bad in rows)
                want[" & ".join(c)] = (sum(own), len(own) - sum(own), yes - sum(own), len(rows) - yes - len(own) + sum(own))
    assert {r.signals: (r.n11, r.n10, r.n01, r.n00) for r in out.collect()} == want and any(k.count("&") == 2 for k in want)


def test_clusters(spark):
    rows = [(i, x + i % 3, y) for i, (x, y) in enumerate([(0, 0), (100, 0), (0, 100)] * 20)] + [(99, None, 0)]
    table = spark.createDataFrame(rows, "key long, x int, y int").repartition(4)
    out = {r.id: r.cluster for r in mining.clusters(table, "key", ["x", "y"], 4, 6).collect()}
    assert len(out) == 61 and out == {r.id: r.cluster for r in mining.clusters(table.repartition(2), "key", ["x", "y"], 4, 6).collect()}
    assert all(len({out[i] for i in range(60) if i % 3 == k} & {out[i] for i in range(60) if i % 3 != k}) == 0 for k in range(3))
    assert mining.clusters(table.where("false"), "key", ["x"], 2, 2).count() == 0


BODIES = [
    "Urgent: on track.\nOn Mon, A wrote:\n> shipped and URGENT 1.2.3\nnot our fault", "> only quoted work stopped", None, "", "stopped work, stopped work; suspended", "urgent critical severe alarming grave",
    " > > on hold\n\nfine\r\nFrom: a on track", "waiting on\nthem", "[VOTE] on hold 1.2.3",
]


def test_registry_columns_and_sql_agree(spark):
    own = registry.Registry(*registry.BUILT_IN.detectors.values(), registry.Detector("any_hold", r"\bon hold\b", "body", 1))
    mails = spark.createDataFrame([(i, ("[vote] x", None, "Re: [VOTE]")[i % 3], b) for i, b in enumerate(BODIES)], "id long, subject string, body string")
    own.install(spark, "detect_all")
    a = sorted(map(tuple, own.detect(mails).collect()))
    b = sorted(map(tuple, spark.sql("SELECT m.id, f.* FROM {m} m, LATERAL detect_all(m.subject, m.body) f", m=mails).collect()))
    assert a == b and len(a) == len(BODIES) * 7
    said = {(r[0], r[1]): (r[2], r[3], r[4]) for r in a}
    assert said[0, "vendor_status_update"] == (True, 0.5, "on track") and said[0, "blame_displacement"][0] and said[0, "quoted_version"][0]
    assert said[4, "stop_work_implication"][1] == 1.0 and said[5, "risk_escalation_language"][1] == 1.0 and not said[1, "stop_work_implication"][0] and said[8, "any_hold"][0]
    with pytest.raises(ValueError):
        own.add(registry.Detector("vote", "x"))
    with pytest.raises(ValueError):
        registry.Detector("x", "y", "z")


def test_calibration(spark):
    rng = random.Random(7)
    items = [(i, p := rng.randrange(60) / 60, rng.random() < 0.2 + 0.6 * p * p) for i in range(900)]
    preds = spark.createDataFrame([(i, p) for i, p, _ in items] + [(-1, None), (-2, 0.0), (-3, 2.0)], "id long, p_positive double")
    labels = spark.createDataFrame([(i, "positive" if y else "negative") for i, _, y in items] + [(-1, "positive"), (5000, "unsure")], "id long, label string")
    at = calibrate.points(preds, labels)
    a, b = calibrate.platt(at)
    pos, neg = sum(y for *_, y in items), sum(not y for *_, y in items)
    target = lambda y: (pos + 1) / (pos + 2) if y else 1 / (neg + 2)
    mu = [1 / (1 + math.exp(-(a * p + b))) for _, p, _ in items]
    assert abs(sum(target(y) - m for (_, _, y), m in zip(items, mu, strict=True))) < 1e-6 and abs(sum((target(y) - m) * p for (_, p, y), m in zip(items, mu, strict=True))) < 1e-6
    assert calibrate.platt(at.where("false")) == (0.0, 0.0)

    sums = {p: [sum(y for _, q, y in items if q == p), sum(q == p for _, q, _ in items)] for p in sorted({p for _, p, _ in items})}
    ps = list(sums)
    mean = lambda i, j: sum(sums[p][0] for p in ps[i : j + 1]) / sum(sums[p][1] for p in ps[i : j + 1])
    fitted = {p: max(min(mean(i, j) for j in range(k, len(ps))) for i in range(k + 1)) for k, p in enumerate(ps)}
    for parts in (64, 1):
        blocks = calibrate.isotonic_blocks(at, parts).orderBy("low").collect()
        assert {p: next(r.value for r in blocks if r.low <= p <= r.high) for p in ps} == pytest.approx(fitted)
    out = {r.id: r.p_calibrated for r in calibrate.isotonic_probability(preds, calibrate.isotonic_blocks(at)).collect()}
    assert {i: out[i] for i, *_ in items} == pytest.approx({i: fitted[p] for i, p, _ in items}) and out[-1] is None and out[-3] == fitted[ps[-1]] and len(out) == 903


def test_places_without_one_task(spark):
    rows = [(i * 37 % 101, i % 7) for i in range(101)]
    out = M.ranked(spark.createDataFrame(rows, "id long, v long").repartition(5), [F.desc("v"), F.col("id")], "place")
    assert [tuple(r) for r in out.orderBy("place").collect()] == [(i, v, k + 1) for k, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))]


def test_answers_with_nested_values(spark):
    texts = ['{"is_schedule_change_announcement": true, "extra": {"a": [1, {"b": "}"}]}, "rationale": "r"}', '{"is_schedule_change_announcement": false, "evidence_quote": ["x"]', '{"is_schedule_change_announcement": true} tail', '{"a": [1}']
    got = [r[0] and r[0].is_schedule_change_announcement for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(scoring.parse_answer(F.col("t"))).collect()]
    assert got == [True, False, None, None]


def test_the_last_prompt_of_an_id_is_scored(spark):
    prompts = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only")], "id string, ordinal long, user string")
    out = scoring.run_scorer(prompts, None, lambda system, user: {"content": f"{system}:{user}"}, concurrency=2, system="S")
    assert sorted((r.id, r.content) for r in out.collect()) == [("a", "S:new"), ("b", "S:only")]


def test_fallback_probabilities_do_not_calibrate(spark):
    preds = spark.createDataFrame([(1, True, 0.9, "logprob", 1, "m1"), (2, True, 0.999, "fallback", 2, "m2"), (3, False, 0.001, "fallback", 3, "m3")], "id long, prediction boolean, p_positive double, p_source string, ordinal long, model_id string")
    labels = spark.createDataFrame([(i, "positive", "pool", i) for i in (1, 2, 3)], "id long, label string, sample_role string, ordinal long")
    card, parity = (evaluate.scorecard(preds, labels, sources=s, corpus_size=9).first() for s in (("logprob",), None))
    assert card.brier_n == 1 and card.brier == pytest.approx(0.01) and parity.brier_n == 3 and card.tp == parity.tp == 2
    assert (card.corpus_size, card.model_id) == (9, "m1")
    assert sum(r.n for r in evaluate.reliability(preds, labels).collect()) == 1 and sum(r.n for r in evaluate.reliability(preds, labels, sources=None).collect()) == 3
