"""Sources and streams as queries: mails written as mbox and read back, logs and states that follow a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailloom.operators.rounds import new_path
from mailloom.plans.queries import query, table
from mailloom.sources import mail, mbox
from mailloom.streaming import incremental as I

MAIL_SQL = """WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') || chr(10) AS body FROM conversations)
SELECT conv_id || '-' || turn || '@example.org' AS id, role || '@example.org' AS from_email, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) || '@example.org' END AS in_reply_to,
 md5(substr(replace(chr(10) || body, chr(10) || 'From ', chr(10) || '>From '), 2)) AS digest FROM m"""


@query(MAIL_SQL)
def mbox_round_trip(spark, d):
    """Turns as mails of 8-bit bodies, written as mbox files and read back in ranges of 100 kB."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    name = lambda turn: F.concat(F.lit("<"), "conv_id", F.lit("-"), turn, F.lit("@example.org>\n"))
    reply = F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: "), name(F.col("turn") - 1))).otherwise("")
    head = [F.lit("Message-ID: "), name(F.col("turn")), F.lit("From: "), "role", F.lit("@example.org\n"), reply, F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: 8bit\n\n")]
    mbox.register(spark)
    path = new_path(spark, "mails")
    c.select(F.concat(*head, "text", F.lit("\n")).cast("binary").alias("raw")).write.format("mbox").mode("append").save(path)
    return mail.read_mbox(spark, path, "dev@example.org", splitBytes="100000").select("id", "from_email", "in_reply_to", F.md5("body_text").alias("digest"))


@query("SELECT user_id, min(ts) AS first_mention_at, min(CASE WHEN event_type = 'signup' THEN ts END) AS announced_at, min(CASE WHEN event_type = 'purchase' THEN ts END) AS passed_at, min(CASE WHEN event_type = 'error' THEN ts END) AS closed_at FROM events GROUP BY user_id")
def version_state_stream(spark, d):
    """Vote mails as a stream, with keyed state for each version."""
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern reads a file as well as a folder
    tag = F.when(F.col("event_type") == "signup", "[VOTE] ").when(F.col("event_type") == "purchase", "[VOTE PASSED] ").when(F.col("event_type") == "error", "[VOTE CLOSED] ").otherwise("")
    mails = e.select("ts", F.concat(tag, F.lit("release 1.0-"), "user_id").alias("subject"), F.lit("").alias("body"))
    out = new_path(spark, "version-log")
    I.track_versions(mails, out, new_path(spark, "version-checkpoint")).awaitTermination()
    states = I.version_states(spark, out)
    return states.select(F.substring_index("version", "-", -1).cast("long").alias("user_id"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in I.EVENTS])


@query("SELECT doc_id::varchar AS id, coalesce(contains(text, '!'), false) AS prediction, 1::bigint AS n FROM documents")
def stream_scores_once(spark, d):
    """Documents scored as a stream; the last batch is then run again, as after a crash behind its write."""
    docs = spark.readStream.schema(table(spark, d, "documents").schema).parquet(f"{d}/documents.parque[t]").select(F.col("doc_id").cast("string").alias("id"), "text")
    score = lambda df: df.select("id", F.coalesce(F.contains("text", F.lit("!")), F.lit(False)).alias("prediction"))
    out, checkpoint = new_path(spark, "score-log"), new_path(spark, "score-checkpoint")
    I.append_scores(docs, score, out, checkpoint).awaitTermination()
    again = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    I.score_batch(again, 0, score, out, I.run_name(checkpoint))
    return I.read_log(spark, out, "id string, prediction boolean").groupBy("id").agg(F.max("prediction").alias("prediction"), F.count("*").alias("n"))
