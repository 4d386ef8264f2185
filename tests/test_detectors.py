"""Detectors, ranks and rules against plain versions on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from mailloom.functions import metrics as M
from mailloom.operators import compare, detectors, escalate, evaluate, sampling


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), k, s := rng.randrange(60), s + rng.randrange(1, 9)) for k in range(150)]
    got = {r.k: r.n_overlaps for r in detectors.overlaps(spark.createDataFrame(rows, "who long, k long, s long, e long"), "who", "s", "e", "k").collect()}
    assert got == {k: sum(w == v and k != j and s < f and t < e for v, j, t, f in rows) for w, k, s, e in rows}


def test_nearest_ranks(spark):
    rng = random.Random(4)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3001)], "b": [5.0] * 40, "c": [rng.randrange(7) + 0.0 for _ in range(500)], "d": [1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: (r.p95, r.p50) for r in M.nearest_ranks(df, ["g"], "v", {"p95": 0.95, "p50": 0.5}).collect()}
    pick = lambda v, p: sorted(v)[round(p * (len(v) - 1))]
    assert got == {g: (pick(v, 0.95), pick(v, 0.5)) for g, v in groups.items()}
    alone = M.nearest_ranks(df.where("g = 'a'"), [], "v", {"p": 0.25}).first()
    assert alone.p == pick(groups["a"], 0.25)


def test_silences_and_past(spark):
    rows = [("u", i, t) for i, t in enumerate([0, 10, 20, 30, 100, 110])] + [("v", 9, 5)]
    df = spark.createDataFrame(rows, "who string, i long, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.i, r.gap) for r in detectors.silences(df, "who", "ts", "i").collect()] == [(4, 70)]
    past = {r.i: (r.past_n, r.past_sum, r.previous) for r in detectors.against_own_past(df, "who", ["i"], "t").collect()}
    assert past[0] == past[9] == (0, 0, None) and past[3] == (3, 30, 20)
    old = detectors.stale(df.withColumn("ts", F.timestamp_seconds(F.col("t") * 86400)), "who", ["i"], "ts", F.col("i") == 1, F.col("i") >= 3, 15)
    assert sorted(r.i for r in old.collect()) == [3, 4, 5]


def test_rules_on_undefined_scores(spark):
    rows = [("a", 0.9, 0.9), ("b", 0.5, 0.9), ("c", 0.5, 0.1), ("d", 0.1, 0.9), ("e", float("nan"), 0.9), ("f", None, None)]
    out = compare.decision(spark.createDataFrame(rows, "k string, f1 double, precision double"), 0.8, 0.4, 0.5).collect()
    assert {r.k: r.branch for r in out} == {"a": "adopt", "b": "refine", "c": "imprecise", "d": "reject", "e": "reject", "f": "reject"}


def test_combination_modes(spark):
    pred = lambda rows: spark.createDataFrame(rows, "id string, prediction boolean")
    cheap, front = pred([("a", False), ("b", True), ("c", False), ("d", False)]), pred([("a", True), ("b", False), ("c", True)])
    members = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "d")], "pool string, id string")
    shown = lambda only: {(r.pool, r.id): (r.prediction, r.escalated) for r in escalate.combine(cheap, front, members, ["p", "none"], only).collect()}
    assert shown(True)["p", "a"] == (True, True) and shown(True)["p", "b"] == (True, False)
    assert shown(False)["p", "b"] == (False, True) and shown(False)["p", "d"] == (False, False) and shown(False)["none", "a"] == (False, False)
    labels = spark.createDataFrame([("a", "positive"), ("b", "unsure")], "id string, label string")
    r = escalate.pool_overlap(members, labels).first()
    assert (r.pool_size, r.labeled, r.positive, r.negative) == (3, 2, 1, 0)
    assert {(r.id, r.kind, r.label) for r in escalate.moved(cheap, front, labels).collect()} == {("a", "new", "positive"), ("b", "lost", "unsure"), ("c", "new", None)}
    assert {(r.id, r.cell) for r in evaluate.cell_items(cheap, labels).collect()} == {("a", "fn")}


def test_calibration_is_monotone(spark):
    rng = random.Random(5)
    p = [rng.random() for _ in range(400)]
    preds = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "id long, p_positive double")
    labels = spark.createDataFrame([(i, "positive" if rng.random() < x * x else "negative") for i, x in enumerate(p) if i % 2], "id long, label string")
    out = sorted((r.p_positive, r.p_calibrated) for r in detectors.calibrated(preds, labels).collect())
    assert len(out) == 400 and [c for _, c in out] == sorted(c for _, c in out)
    assert sum((c - x * x) ** 2 for x, c in out) / 400 < 0.02


def test_association_and_matches(spark):
    rows = [("x", True)] * 8 + [("x", False)] * 2 + [("y", True)] * 2 + [("y", False)] * 8
    got = {r.s: (r.n11, r.n10, r.n01, r.n00, r.chi2) for r in detectors.association(spark.createDataFrame(rows, "s string, o boolean"), "s", "o").collect()}
    assert got["x"] == (8, 2, 2, 8, pytest.approx(7.2)) and got["y"][:4] == (2, 8, 8, 2)
    df = spark.createDataFrame([(1, "a b"), (2, "b"), (3, None), (4, "")], "id int, t string")
    hits = detectors.matched(df, "id", {"b": F.contains("t", F.lit("b")), "a": F.contains("t", F.lit("a"))})
    assert {(r.id, r.n_matched, r.first) for r in hits.collect()} == {(1, 2, "a"), (2, 1, "b"), (3, 0, None), (4, 0, None)}


def test_sheet_rows(spark):
    preds = spark.createDataFrame([(i, i < 2, 0.5, "q" if i else None, None) for i in range(6)], "id long, prediction boolean, p_positive double, evidence_quote string, rationale string")
    mails = spark.createDataFrame([(0, "f", "s", None, "b")], "id long, from_raw string, subject string, date string, body_text string")
    out = {r.id: r for r in sampling.sheet_rows(preds, mails, k=2).collect()}
    assert len(out) == 4 and len(out[0]) == 10 and tuple(out[0])[4:] == ("", "", "f", "s", "", "b") and tuple(out[1])[4:] == ("q", "", "", "", "", "")
    assert sorted(r.sample_role for r in out.values()) == ["pool", "pool", "random_sample", "random_sample"]
