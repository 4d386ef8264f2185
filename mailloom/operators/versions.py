"""Point-in-time release state of versions, from vote mails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import subjects as S
from mailloom.functions.text import versions

# The block that prompts show.
HEADER = "VERSION CONTEXT (state at this message's timestamp):"
SHOWN = {"vote_passed": "passed", "vote_failed": "closed", "vote_active": "announced"}
UNANNOUNCED = "pre_announcement (no [VOTE] yet)"


def event_log(messages: DataFrame) -> DataFrame:
    """(version, first_mention_at, announced_at, passed_at, closed_at): the earliest of each. ``messages``: ts, subject, body.

    A fold over messages in time order is a minimum, so no sort is needed.
    """
    dated = messages.where("ts is not null")
    mentions = dated.select("ts", F.explode(versions(F.concat_ws("\n", "subject", "body"))).alias("version"), F.lit(None).cast("string").alias("event"))
    votes = dated.withColumn("event", S.vote_event(F.col("subject"))).where("event is not null").select("ts", F.explode(versions(F.col("subject"))).alias("version"), "event")
    at = lambda e: F.min(F.when(F.col("event") == e, F.col("ts")))
    return mentions.unionByName(votes).groupBy("version").agg(F.min("ts").alias("first_mention_at"), at("announced").alias("announced_at"), at("passed").alias("passed_at"), at("closed").alias("closed_at"))


def state_at(ts: Column) -> Column:
    """State at a time, of joined event columns; an unknown version is pre_announcement."""
    return F.when(F.col("passed_at") <= ts, "vote_passed").when(F.col("closed_at") <= ts, "vote_failed").when(F.col("announced_at") <= ts, "vote_active").otherwise("pre_announcement")


def state_date(ts: Column) -> Column:
    """Date of the event that decides the state."""
    pick = F.when(F.col("passed_at") <= ts, F.col("passed_at")).when(F.col("closed_at") <= ts, F.col("closed_at")).when(F.col("announced_at") <= ts, F.col("announced_at"))
    return F.date_format(pick, "yyyy-MM-dd")


def state_tag(ts: Column) -> Column:
    """State with the date of its event, as prompts show it."""
    state, out = state_at(ts), F.lit(UNANNOUNCED)
    for name, verb in SHOWN.items():
        out = F.when(state == name, F.concat(F.lit(f"{name} ({verb} "), state_date(ts), F.lit(")"))).otherwise(out)
    return out


def states(queries: DataFrame, log: DataFrame) -> DataFrame:
    """``queries`` (version, ts, ...) with state and date: an equi-join and a CASE, no range join."""
    return queries.join(log, "version", "left").withColumn("state", state_at(F.col("ts"))).withColumn("state_date", state_date(F.col("ts"))).drop("first_mention_at", "announced_at", "passed_at", "closed_at")


def context_blocks(messages: DataFrame, log: DataFrame) -> DataFrame:
    """(id, block): the known versions of each message with their state, in first-seen order; empty if none."""
    found = messages.select("id", "ts", F.posexplode(versions(F.concat_ws("\n", "subject", "body"))).alias("pos", "version")).where("ts is not null")
    lines = found.join(log, "version").withColumn("tag", state_tag(F.col("ts")))
    blocks = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(F.lit("- "), "version", F.lit(": "), "tag").alias("line")))).alias("rows"))
    text = F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return messages.select("id").join(blocks, "id", "left").select("id", F.coalesce(F.when(F.col("rows").isNotNull(), text), F.lit("")).alias("block"))
