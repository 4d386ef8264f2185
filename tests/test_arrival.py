"""Mbox files against Python's own reader; logs and states of streams over orders, retries and restarts."""

import json
import mailbox
import os
import shutil

import pytest
from pyspark.sql import functions as F

from mailloom.operators import versions
from mailloom.sources import mail, mbox
from mailloom.sources.mail import month_spine
from mailloom.streaming import incremental as I

HEAD = b"From a@x Thu Jan  2 10:00:00 2014\n"
NESTED = (
    b"Subject: parts\nContent-Type: multipart/mixed; boundary=A\n\n--A\nContent-Type: multipart/alternative; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>\n--B\nContent-Type: text/plain\n\n\n--B\n"
    b"Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n\xc3\xbcber\n--B--\n--A\nContent-Type: text/plain\nContent-Disposition: ATTACHMENT\n\nno\n--A--\n"
)
MAILS = [
    "Subject: utf\nMessage-ID: <1@x>\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\nCafé – naïve\n".encode(),
    b"Subject: latin\nContent-Type: text/plain; charset=iso-8859-1\n\nCaf\xe9\n>From the top\n\n\n",
    b"Subject: none\n\nplain \xe4 bytes\n", b"Subject: odd\nContent-Type: text/plain; charset=no-such\n\nx\n", NESTED, b"Subject: html\nContent-Type: text/html\n\n<b>\n", b"Subject: empty\n\n", b"Subject: cut\nFrom: c@x\n\nends here",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("boxes")
    (path / "2014-01.mbox").write_bytes(b"ahead of all\n" + b"\n".join(HEAD + m for m in MAILS))
    (path / "2014-02.mbox").write_bytes(b"\n".join(HEAD + f"Subject: n{i}\n\n{'line\n' * (i % 7)}".encode() for i in range(60)))
    (path / "2014-03.mbox").write_bytes(b"")
    return path


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_same_messages_as_the_mailbox_module(spark, folder, split):
    """A border inside a message, at a line's start or inside a ``From `` line loses and repeats nothing."""
    mbox.register(spark)
    rows = spark.read.format("mbox").option("splitBytes", split).load(str(folder)).orderBy("file", "start").collect()
    want = [(str(f), own.get_bytes(k)) for f in sorted(folder.iterdir()) for own in [mailbox.mbox(f)] for k in own.keys()]
    assert [(r.file, bytes(r.raw)) for r in rows] == want


def test_bodies_of_eight_bit_mails(spark, folder):
    by = {r.subject: r.body_text for r in mail.read_mbox(spark, str(folder / "2014-01.mbox"), "dev", splitBytes="90").collect()}
    assert by == {"utf": "Café – naïve\n", "latin": "Café\n>From the top\n\n\n", "none": "plain � bytes\n", "odd": "x\n", "parts": "über", "html": "", "empty": "", "cut": "ends here"}


def test_written_mails_come_back(spark, tmp_path):
    mbox.register(spark)
    raws = [b"A: 1\n\nFrom here\nFrom there\n", b"B: 2\n\n", b"C: 3\n\nno end"]
    spark.createDataFrame([(r,) for r in raws], "raw binary").repartition(2).write.format("mbox").mode("append").save(str(tmp_path / "out"))
    back = spark.read.format("mbox").load(str(tmp_path / "out")).collect()
    assert sorted(bytes(r.raw) for r in back) == [b"A: 1\n\n>From here\n>From there\n", b"B: 2\n\n", b"C: 3\n\nno end\n"]
    assert all(name.startswith("part-") for name in os.listdir(tmp_path / "out"))


def test_files_that_fail_are_rows(spark, folder, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("mbox").load(str(folder / "nowhere")).count()
    (status,) = mail.mbox_status(spark, str(folder / "nowhere")).collect()
    assert status.messages == 0 and status.error
    assert {os.path.basename(r.file): r.messages for r in mail.mbox_status(spark, str(folder)).collect()} == {"2014-01.mbox": 8, "2014-02.mbox": 60}


def test_harvest_of_fetched_months(spark, folder, tmp_path):
    """One month is missing, one is fetched already and kept."""
    own = tmp_path / "raw"
    own.mkdir()
    shutil.copy(folder / "2014-02.mbox", own / "2014-01.mbox")
    got = mail.fetch_months(month_spine(spark, "2014-01", "2014-04"), str(own), lambda ym: f"file://{folder}/{ym}.mbox", pause=0)
    status = {r.ym: r for r in got.collect()}
    assert status["2014-04"].error and status["2014-01"].bytes == (folder / "2014-02.mbox").stat().st_size
    rows = {r.ym: (r.messages, r.error is None) for r in mail.harvest(got, mail.read_mbox(spark, str(own), "dev")).collect()}
    assert rows == {"2014-01": (60, True), "2014-02": (60, True), "2014-03": (0, True), "2014-04": (None, False), "total": (120, True)}


VOTES = [
    ("2014-06-20 12:00:00", "[VOTE] Release 1.2.17", "on 1.2.18 later"), ("2014-06-15 10:00:00", "Re: thoughts on 1.2.18", ""), ("2014-06-21 08:00:00", "Re: [VOTE] Release 1.2.17", ""),
    ("2014-06-30 15:00:00", "[VOTE PASSED] Release 1.2.17 and 2.0.9", ""), ("2014-07-05 09:00:00", "[VOTE CLOSED] Release 2.0.9", ""), (None, "[VOTE] 3.0.1", ""), ("2014-01-01 00:00:00", "late news of 2.0.9", ""),
]


@pytest.mark.parametrize("order", [[0, 1, 2], [2, 0, 1]])
def test_version_states_follow_a_stream(spark, tmp_path, order):
    """Three files in any order end in the batch's log; a restart adds nothing, a later file its rows only."""
    schema = "date string, subject string, body string"
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")
    source.mkdir()

    def run():
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source)).withColumn("ts", F.to_timestamp("date"))
        I.track_versions(rows, out, checkpoint).awaitTermination()
        return sorted(tuple(map(str, r)) for r in I.version_states(spark, out).collect())

    parts = [VOTES[0:3], VOTES[3:5], VOTES[5:]]
    for n, k in enumerate(order):
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("date", "subject", "body"), v, strict=True))) for v in parts[k]))
        got = run()
    batch = versions.event_log(spark.createDataFrame(VOTES, schema).withColumn("ts", F.to_timestamp("date")))
    assert got == sorted(tuple(map(str, r)) for r in batch.collect())
    before = I.read_log(spark, out, I.STATE).count()
    assert run() == got and I.read_log(spark, out, I.STATE).count() == before


def test_a_retried_batch_leaves_each_id_once(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "log"), str(tmp_path / "state")
    source.mkdir()
    calls = []

    def score(df):
        calls.append(1)
        return df.select("id", F.lit(True).alias("prediction"))

    def run(fail=False):
        rows = spark.readStream.schema("id string").json(str(source))
        name = I.run_name(checkpoint)

        def each(df, n):
            I.score_batch(df, n, score, out, name)
            if fail:
                raise RuntimeError("lost after the write")

        q = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()

    (source / "a.json").write_text('{"id": "a"}\n{"id": "b"}\n{"id": "a"}')
    with pytest.raises(Exception, match="lost after"):
        run(fail=True)
    run()
    (source / "b.json").write_text('{"id": "b"}\n{"id": "c"}')
    run()
    I.append_scores(spark.readStream.schema("id string").json(str(source)), score, out, str(tmp_path / "other")).awaitTermination()
    assert sorted(r.id for r in I.read_log(spark, out, "id string").collect()) == ["a", "b", "c"] and len(calls) == 4
