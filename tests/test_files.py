"""Mail archives and the files around the corpus, written and read back."""

import json

import pytest
from pyspark.sql import functions as F

from mailloom.functions import subjects as S
from mailloom.operators import prompts as P
from mailloom.sources import files, mail
from mailloom.streaming import incremental

MBOX = """From a@x.org Thu Jan  2 10:00:00 2014
Message-ID: <one@x.org>
From: Ann Writer <ann@x.org>
Date: Thu, 2 Jan 2014 10:00:00 -0500
Subject: [VOTE] Release 1.2.3
References: <r1@x> <r2@x>
In-Reply-To: <r2@x>
X-Twice: 1
X-Twice: 2

Body one.
 From here it goes on.

From b@x.org Thu Jan  2 11:00:00 2014
From: jira@apache.org
Date: Sat, 1 Feb 2014 10:00:00 GMT
Subject: (JIRA)
Content-Type: multipart/mixed; boundary=B

--B
Content-Type: text/html

<b>html</b>
--B
Content-Type: text/plain; charset=latin-1
Content-Transfer-Encoding: quoted-printable

caf=E9
--B--

From c@x.org Thu Jan  2 11:00:00 2014
From: c@builds.apache.org
Date: some day
Subject: no date

last
"""


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("mail") / "2014-01.mbox"
    path.write_text(MBOX)
    return mail.read_mbox(spark, str(path), "dev@x.org")


def test_mbox(messages):
    by = {r.subject: r for r in messages.collect()}
    one, two, three = by["[VOTE] Release 1.2.3"], by["(JIRA)"], by["no date"]
    assert (one.id, one.date, one.from_name, one.from_email) == ("one@x.org", "2014-01-02T15:00:00Z", "Ann Writer", "ann@x.org")
    assert (one.references, one.in_reply_to, one.headers["X-Twice"]) == (["r1@x", "r2@x"], "r2@x", "2")
    assert one.body_text.startswith("Body one.\n From here") and two.body_text.strip() == "café"
    assert two.id.startswith("synth-") and len(two.id) == 22 and two.date == "2014-02-01T10:00:00Z" and three.date is None
    assert two.in_reply_to is None and one["list"] == "dev@x.org" and one.provenance.source_url.endswith("2014-01.mbox")


def test_months_of_a_corpus(spark, messages, tmp_path):
    out = f"{tmp_path}/corpus"
    mail.write_messages(messages, out)
    mail.write_messages(messages.where("id = 'one@x.org'"), out)  # other partitions stay
    again = files.read_months(spark, out, mail.MESSAGE, "2014-01", "2014-01")
    assert [r.id for r in again.collect()] == ["one@x.org"]
    assert "PartitionFilters: [isnotnull(ym" in again._jdf.queryExecution().toString()
    everything = files.read_months(spark, out, mail.MESSAGE, "0", "z")
    assert everything.count() == 3 and everything.where("ym = 'unknown'").count() == 1
    kept = files.filter_months(everything, spark.createDataFrame([("2014-01",), ("2014-02",), ("2014-03",)], "ym string"), S.is_bot(F.col("from_email")))
    assert {tuple(r) for r in kept.collect()} == {("2014-01", 1, 1, 0), ("2014-02", 1, 0, 1), ("2014-03", 0, 0, 0), ("total", 2, 1, 1)}
    summary = files.harvest_summary(everything, spark.createDataFrame([("2014-01",), ("2014-03",)], "ym string"), F.octet_length("body_text"))
    assert {(r.ym, r.messages, r.status) for r in summary.collect()} == {("2014-01", 1, "ok"), ("2014-03", 0, "missing"), ("total", 1, "ok")}
    assert files.read_subjects(spark, out + "/*/*").where("id = 'one@x.org'").first().subject == "[VOTE] Release 1.2.3"


def test_bad_lines_fail_or_are_passed_over(spark, tmp_path):
    (tmp_path / "2014-05.jsonl").write_text('{"id": "a"}\n\n{"id": "b"}\n')
    assert {(r.id, r.ym) for r in mail.read_jsonl(spark, str(tmp_path / "*.jsonl"), "id string").collect()} == {("a", "2014-05"), ("b", "2014-05")}
    (tmp_path / "log.jsonl").write_text('{"id": "a"}\n{"id": \n{"x": 1}\n{"id": "a"}\n')
    assert [r.id for r in mail.done_ids(spark, str(tmp_path / "log.jsonl")).collect()] == ["a"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        mail.read_jsonl(spark, str(tmp_path / "log.jsonl"), "id string").collect()


def test_runs_and_lists(spark, tmp_path):
    for name, i in (("preds-depth-2.jsonl", "a"), ("preds-run-3.jsonl", "b"), ("baseline.jsonl", "c")):
        (tmp_path / name).write_text(json.dumps({"id": i, "prediction": True, "p_positive": 0.5}) + "\n")
    got = {(r.id, r.file_depth, r.run) for r in files.read_runs(spark, str(tmp_path / "*.jsonl")).collect()}
    assert got == {("a", 2, "preds-depth-2"), ("b", -1, "run3"), ("c", -1, "baseline")}
    (tmp_path / "pool.json").write_text('["x", "y",\n "x"]')
    assert sorted(r.id for r in files.read_id_list(spark, str(tmp_path / "pool.json")).collect()) == ["x", "y"]
    report = {"c_to_ab_flip_diagnostics": [{"id": "a", "interpretation": "anchoring fix: x"}, {"id": "b", "interpretation": "other"}, {"id": "c", "interpretation": None}]}
    (tmp_path / "report.json").write_text(json.dumps(report, indent=1))
    assert [r.id for r in files.read_flips(spark, str(tmp_path / "report.json"), prefix="anchoring fix").collect()] == ["a"]
    assert files.read_flips(spark, str(tmp_path / "report.json")).count() == 3
    (tmp_path / "examples.txt").write_text("one\ntwo\n")
    assert files.read_asset(spark, str(tmp_path / "examples.txt")) == "one\ntwo\n"


def test_dump_and_report(spark, messages, tmp_path):
    prompts = P.build_prompts(messages.select("id", "from_raw", "date", "subject", F.col("body_text").alias("body")), "v2_strict")
    files.dump_prompts(prompts, P.payload("m"), f"{tmp_path}/dump")
    back = files.read_workload(spark, f"{tmp_path}/dump", 2).collect()
    assert [r.id for r in back] == sorted(r.id for r in messages.collect())[:2] and files.read_workload(spark, f"{tmp_path}/dump").count() == 3
    assert all(r.char_count_system == len(P.SYSTEM_V2) and json.loads(r.payload)["messages"][1]["content"][: r.char_count_user] for r in back)
    files.write_report(spark.createDataFrame([(1, float("nan"), 0.5)], "n int, f1 double, p double"), f"{tmp_path}/report")
    assert [json.loads(f.read_text()) for f in (tmp_path / "report").glob("*.json")] == [{"n": 1, "f1": None, "p": 0.5}]


def test_stream_of_messages(spark, tmp_path):
    """Files that arrive are scored once, also over a restart."""
    (tmp_path / "in").mkdir()
    score = lambda df: df.select("id", (F.length("subject") > 3).alias("prediction"))
    for k, ids in enumerate((["a", "b", "a"], ["c"])):
        (tmp_path / "in" / f"{k}.json").write_text("".join(json.dumps({"id": i, "date": "2014-01-02T10:00:00Z", "subject": "some"}) + "\n" for i in ids))
        stream = incremental.new_messages(spark, f"{tmp_path}/in", "id string, date string, subject string")
        incremental.append_scores(stream, score, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(r.id for r in spark.read.json(f"{tmp_path}/out").collect()) == ["a", "b", "c"]


def test_filtered_files(spark, tmp_path):
    """Kept messages by month; a month of which nothing is left keeps its counts only, also over what an earlier run wrote."""
    rows = [("a", "2014-01", "x"), ("b", "2014-01", "bot"), ("c", "2014-02", "bot"), ("d", "2014-03", None)]
    mails = spark.createDataFrame(rows, "id string, ym string, sender string")
    path = str(tmp_path / "kept")
    files.write_filtered(mails, F.lit(False), path).collect()
    got = {r.ym: (r.n_in, r.kept, r.dropped) for r in files.write_filtered(mails, F.col("sender") == "bot", path).collect()}
    assert got == {"2014-01": (2, 1, 1), "2014-02": (1, 0, 1), "2014-03": (1, 1, 0), "total": (4, 2, 2)}
    back = files.read_months(spark, path, "id string, sender string", "2014-01", "2014-03")
    assert {(r.id, r.ym) for r in back.collect()} == {("a", "2014-01"), ("d", "2014-03")}
