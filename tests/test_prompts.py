"""Prompt variants, hashes, requests, scoring runs and the reading of answers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mailloom.operators import prompts as P
from mailloom.operators import scoring
from mailloom.sources import files, mail

BODY = "New words.\n\nOn Mon, May 5, Jon wrote:\n> first\n> > second\n> back\n-- \nMe"


@pytest.fixture(scope="module")
def mails(spark):
    rows = [("a", "A <a@x.org>", "2014-01-01", "[VOTE] x", BODY), ("b", None, None, None, None), ("c", "c", "d", "s", "> only quoted"), ("d", "d", "", "long", "w" * 70_000 + "\n> q")]
    return spark.createDataFrame(rows, "id string, from_raw string, date string, subject string, body string")


def users(mails, variant, **options):
    return {r.id: r.user for r in P.build_prompts(mails, variant, **options).collect()}


def test_shapes(mails):
    head = "Message:\nFrom: A <a@x.org>\nSubject: [VOTE] x\nDate: 2014-01-01\n\n"
    assert users(mails, "current_baseline")["a"] == head + BODY
    assert users(mails, "v2_strict", depth=1)["a"] == head + "New words.\n\nOn Mon, May 5, Jon wrote:\n> first\n> back\n--\nMe\n".replace("--\n", "-- \n")
    assert users(mails, "v2_elided", depth=1)["a"].count("[QUOTED]") == 2
    assert users(mails, "v3_elided")["a"].count("> > [QUOTED]") == 1
    assert users(mails, "new_only")["a"] == head + "New words."
    assert users(mails, "new_only")["c"].endswith(P.NO_NEW_CONTENT) and users(mails, "new_only")["b"].endswith(P.NO_NEW_CONTENT)
    marked = users(mails, "new_with_marked_quoted")
    assert "[depth 1]\n> first\n\n[depth 2]\n> > second\n\n[depth 1]\n> back" in marked["a"] and P.NO_QUOTED in marked["b"]
    assert "w" * 30_000 + "\n\nQUOTED" in marked["d"] and "w" * 30_001 not in marked["d"]
    assert len(users(mails, "current_baseline")["d"]) == 60_000 + len("Message:\nFrom: d\nSubject: long\nDate: \n\n")


def test_tagged_blocks(spark, mails):
    blocks = spark.createDataFrame([("a", "BLOCK"), ("c", "")], "id string, block string")
    got = users(mails, "v2_elided_tagged", blocks=blocks)
    assert "\n\nBLOCK\n\nNew words." in got["a"] and P.NO_VERSIONS in got["c"] and P.NO_VERSIONS in got["b"]
    assert P.NO_VERSIONS in users(mails, "v2_elided_tagged")["a"]


def test_hashes_and_refusals(mails):
    assert len({P.prompt_hash(v, "examples") for v in P.VARIANTS}) == 8
    parts = [P.SYSTEM_V1, P.TEMPLATE, json.dumps(P.SCHEMA, sort_keys=True), "new_only"]
    assert P.prompt_hash("new_only") == hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]
    assert P.prompt_hash("v2_elided_fewshot", "a") != P.prompt_hash("v2_elided_fewshot", "b")
    for variant, options in (("nothing", {}), ("v2_elided_fewshot", {})):
        with pytest.raises(ValueError):
            P.build_prompts(mails, variant, **options)
    assert P.SYSTEM_V3.count("\n") == P.SYSTEM_V2.count("\n") + 2


def test_payload(mails):
    row = P.build_prompts(mails, "v3_elided").withColumn("p", P.payload("m")).where("id = 'a'").first()
    got = json.loads(row.p)
    assert got["messages"] == [{"role": "system", "content": row.system}, {"role": "user", "content": row.user}]
    assert (got["model"], got["temperature"], got["max_tokens"], got["guided_json"], got["logprobs"], got["top_logprobs"]) == ("m", 0, 400, P.SCHEMA, True, 10)
    bare = json.loads(P.build_prompts(mails, "v3_elided").select(P.payload("m", None).alias("p")).first().p)
    assert "logprobs" not in bare and "top_logprobs" not in bare


def test_answers(spark):
    good = '{"is_schedule_change_announcement": true, "evidence_quote": "a \\"b\\" {", "rationale": "r"}'
    cases = {
        good: (True, 'a "b" {', "r"), "```json\n" + good + "\n```": (True, 'a "b" {', "r"), good[:-1]: (True, 'a "b" {', "r"), good[:-2]: (True, 'a "b" {', "r"),
        good + " and more": None, "no json": None, "": None, '{"is_schedule_change_announcement": false, "evidence_quote": null}': (False, None, None),
        '{"is_schedule_change_announcement": true, "rationale": "' + "\\\\n" * 100_000 + '"}': (True, None, "\\n" * 100_000),
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "n int, s string")
    got = rows.select("n", scoring.parse_answer(F.col("s")).alias("a")).orderBy("n").collect()
    assert [tuple(r.a) if r.a and r.a[0] is not None else None for r in got] == list(cases.values())


def test_probability(spark):
    tok = lambda t, p, *tops: (t, p, [(a, b) for a, b in tops])
    rows = [
        ([tok("{", -0.1), tok(" true", -0.5, ("true", -0.5), ("false", -1.5))], True), ([tok("false", -0.2, ("false", -0.2), ("x", -3.0))], False),
        ([tok("true", -0.3)], True), ([tok("yes", -0.1)], True), (None, False),
    ]
    got = [r.p for r in spark.createDataFrame(rows, f"t {scoring.TOKENS}, said boolean").select(scoring.p_positive(F.col("t"), F.col("said")).alias("p")).collect()]
    from math import exp

    share = lambda a, b: exp(a) / (exp(a) + exp(b))
    assert got == pytest.approx([share(-0.5, -1.5), 1 - share(-0.2, -4.0), share(-0.3, -10.0), 0.999, 0.001])


def test_runs_resume(spark, mails, tmp_path):
    """Errors and unreadable answers make no row, are counted, and come again."""
    log, calls = f"{tmp_path}/log", []

    def flaky(system, user):
        if "Subject: long" in user:
            raise OSError("refused")
        return {"content": "?" if "From: c" in user else '{"is_schedule_change_announcement": false}'}

    def steady(system, user):
        return {"content": '{"is_schedule_change_announcement": true, "evidence_quote": "q"}', "tokens": [{"token": "true", "logprob": -0.1, "top_logprobs": []}]}

    prompts = P.build_prompts(mails.union(mails), "v3_elided", depth=2)
    for scorer, want in ((flaky, {"ok": 2, "error": 1, "unreadable": 1}), (steady, {"ok": 2}), (steady, {})):
        done = files_done(spark, log, calls)
        out, counts = scoring.classify(prompts, done, scorer, "m", lambda df: store(df, f"{tmp_path}/r{len(calls)}"), depth=2, concurrency=3)
        files.append_predictions(out, log)
        calls.append(1)
        assert {r.outcome: r.n for r in counts.collect()} == want
    rows = {r.id: r for r in spark.read.schema(mail.PREDICTION + ", p_source string").json(log).collect()}
    assert set(rows) == {"a", "b", "c", "d"} and not rows["a"].prediction and rows["c"].prediction
    assert (rows["c"].p_source, rows["a"].p_source, rows["a"].p_positive, rows["c"].quote_depth, rows["c"].model_id) == ("logprob", "fallback", 0.001, 2, "m")
    assert rows["c"].prompt_hash == P.prompt_hash("v3_elided") and rows["c"].evidence_quote == "q" and rows["c"].rationale == ""


def files_done(spark, log, calls):
    return mail.done_ids(spark, log) if calls else None


def store(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def test_latency_and_errors(spark):
    rows = [(True, float(x), None) for x in range(1, 101)] + [(False, 500.0, e) for e in "aabbbcdefg"] + [(True, None, None)]
    calls = spark.createDataFrame(rows, "ok boolean, elapsed_s double, error string")
    r = scoring.latency_report(calls.where("elapsed_s is not null")).first()
    assert (r.n, r.longest, r.p95, r.median, r["mean"]) == (100, 100.0, 95.0, 50.5, 50.5)
    assert [(r.error, r.n) for r in scoring.errors_by_message(calls).collect()] == [("b", 3), ("a", 2), ("c", 1), ("d", 1), ("e", 1)]


def test_replay(spark):
    def call(payload):
        if payload == "lost":
            raise ConnectionError("reset")
        return (503, b"busy") if payload == "busy" else (200, b'{"usage": {"prompt_tokens": 7, "completion_tokens": 2}}')

    rows = spark.createDataFrame([("a", "fine"), ("b", "busy"), ("c", "lost")], "id string, payload string")
    got = {r.id: r for r in scoring.replay(rows, call, 2).collect()}
    assert [(got[i].ok, got[i].status, got[i].prompt_tokens, got[i].error) for i in "abc"] == [(True, 200, 7, None), (False, 503, None, "HTTP 503"), (False, None, None, "reset")]
    assert all(r.elapsed_s >= 0 for r in got.values()) and got["b"].response_bytes == 4
