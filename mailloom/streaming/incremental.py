"""Beyond batch: messages that arrive as files are scored once, and version states follow them.

Results go to a log with a folder for each batch of each query. A batch that is run again
writes the same folder again, so each row is there once however often a batch fails after its write.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from mailloom.functions import subjects as S
from mailloom.functions.text import versions

STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def new_messages(spark: SparkSession, path: str, schema: str, delay: str = "1 day") -> DataFrame:
    """A stream of messages, repeats of an id within ``delay`` dropped."""
    rows = spark.readStream.schema(schema).json(path).withColumn("ts", F.to_timestamp("date"))
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["id"])


def run_name(checkpoint: str) -> str:
    """What a query's folders in a log are named by: its checkpoint is what makes it the same query."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def write_batch(rows: DataFrame, out: str, run: str, batch: int) -> None:
    """One batch's folder of the log at ``out``, replaced as a whole."""
    rows.write.mode("overwrite").option("timestampFormat", STAMP).json(f"{out}/run={run}/batch={batch}")


def read_log(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of a log, with ``run`` and ``batch``; none before the first batch."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, run string, batch long")
    return spark.read.schema(f"{schema}, run string, batch long").option("timestampFormat", STAMP).json(out)


def score_batch(batch: DataFrame, number: int, score: Callable[[DataFrame], DataFrame], out: str, run: str) -> None:
    """Score the messages of a batch that no other batch has in the log, one row for each id, and write its folder."""
    logged = read_log(batch.sparkSession, out, "id string").where(~((F.col("run") == run) & (F.col("batch") == number)))
    fresh = batch.dropDuplicates(["id"]).join(logged.select("id"), "id", "left_anti")
    write_batch(score(fresh), out, run, number)


def append_scores(messages: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each id of the stream is scored and logged once: over batches, restarts, retried batches, and queries that share the log.

    A batch that fails after its write is scored again when it is retried, and its folder replaced.
    """
    run = run_name(checkpoint)
    each = lambda df, number: score_batch(df, number, score, out, run)
    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EVENTS = ("first_mention_at", "announced_at", "passed_at", "closed_at")
STATE = "version string, " + ", ".join(f"{e} timestamp" for e in EVENTS)


def mentions(messages: DataFrame) -> DataFrame:
    """(version, ts, event) of messages (ts, subject, body): a row for each version, of ``mention`` or of the vote that its subject tells."""
    named = versions(F.col("subject"))
    told = F.transform(versions(F.concat_ws("\n", "subject", "body")), lambda v: F.struct(v.alias("version"), F.lit("mention").alias("event")))
    votes = F.when(F.col("vote").isNotNull(), F.transform(named, lambda v: F.struct(v.alias("version"), F.col("vote").alias("event"))))
    both = F.concat(told, F.coalesce(votes, F.array().cast("array<struct<version:string,event:string>>")))
    return messages.where("ts is not null").withColumn("vote", S.vote_event(F.col("subject"))).select("ts", F.inline(both))


class VersionState(StatefulProcessor):
    """The earliest time of each event of a version. Emits a version whenever one of them moves.

    Times only ever move back, so the order of arrival does not matter and a late row counts like any other.
    """

    KINDS = {"mention": 0, "announced": 1, "passed": 2, "closed": 3}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getValueState("times", StructType([StructField(e, LongType()) for e in EVENTS]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = list(self.times.get()) if self.times.exists() else [None] * len(EVENTS)
        before = list(known)
        for frame in rows:
            for event, least in frame.groupby("event")["micros"].min().items():
                for i in {0, self.KINDS[event]}:
                    known[i] = int(least) if known[i] is None else min(known[i], int(least))
        if known != before:
            self.times.update(tuple(known))
            yield pd.DataFrame([(key[0], *known)], columns=["version", *EVENTS]).astype(dict.fromkeys(EVENTS, "Int64"))

    def close(self) -> None:
        pass


def version_changes(messages: DataFrame) -> DataFrame:
    """STATE of versions that moved, for a stream of messages (ts, subject, body). Needs the RocksDB state store."""
    rows = mentions(messages).select("version", "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    changed = rows.groupBy("version").transformWithStateInPandas(VersionState(), "version string, " + ", ".join(f"{e} long" for e in EVENTS), "Update", "None")
    return changed.select("version", *[F.timestamp_micros(e).alias(e) for e in EVENTS])


def track_versions(messages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Keeps the log of version changes at ``out`` up to the stream; see ``version_states``."""
    spark, run = messages.sparkSession, run_name(checkpoint)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    each = lambda df, number: write_batch(df, out, run, number)
    return version_changes(messages).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_states(spark: SparkSession, out: str) -> DataFrame:
    """STATE as of the last batch. A version's times only move back, so the least of each is the last, over several queries too."""
    return read_log(spark, out, STATE).groupBy("version").agg(*[F.min(e).alias(e) for e in EVENTS])
