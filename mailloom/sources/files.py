"""Files around the corpus: id lists, runs named by their files, workloads, assets, reports, and the log of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.text import strip
from mailloom.sources.mail import PREDICTION, read_jsonl

# The ways in which file names give a run's depth and label.
DEPTH = r"depth-(\d+)"
RUN = r"run-?(\d+)"


def depth_of(name: Column) -> Column:
    """Quote depth in a file name; -1 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, DEPTH, 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(-1))


def label_of(name: Column) -> Column:
    """``run`` and its number in a file name, else the name without its ending."""
    number = F.regexp_extract(name, RUN, 1)
    return F.when(number != "", F.concat(F.lit("run"), number)).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a file that holds one JSON array of strings."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.explode(F.from_json("value", "array<string>")).alias("id")).distinct()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files of several runs, with the depth and the label that their names give."""
    rows = spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)
    name = F.col("_metadata.file_name")
    return rows.withColumns({"file_depth": depth_of(name), "run": label_of(name)})


def read_months(spark: SparkSession, path: str, schema: str, first: str, last: str) -> DataFrame:
    """Messages of the months yyyy-MM from first to last of ``write_messages``; other partitions are not read."""
    rows = spark.read.schema(f"{schema}, ym string").json(path)
    return rows.where(F.col("ym").between(first, last))


def read_subjects(spark: SparkSession, path: str) -> DataFrame:
    """(id, subject) of messages, the only columns parsed."""
    return read_jsonl(spark, path, "id string, subject string").select("id", strip(F.col("subject")).alias("subject"))


def read_workload(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Dumped prompts, the first ``limit`` by id; 0 is all."""
    rows = spark.read.schema("id string, prompt_variant string, prompt_hash string, char_count_user int, char_count_system int, payload string").json(path)
    return rows.orderBy("id").limit(limit) if limit else rows


def read_flips(spark: SparkSession, path: str, field: str = "c_to_ab_flip_diagnostics", prefix: str = "") -> DataFrame:
    """The items of a list of structs inside a report, those whose interpretation starts with ``prefix``."""
    report = spark.read.option("multiLine", True).json(path)
    return report.select(F.inline(field)).where(F.coalesce(F.col("interpretation"), F.lit("")).startswith(prefix))


def read_asset(spark: SparkSession, path: str) -> str:
    """A small text file, such as worked examples of a prompt."""
    return spark.read.text(path, wholetext=True).first()["value"]


def append_predictions(rows: DataFrame, path: str) -> None:
    """Adds prediction rows to the log; a task's rows appear when its job commits, so a lost executor leaves none twice."""
    rows.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file, undefined numbers as null."""
    clean = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if t == "double" else F.col(c) for c, t in report.dtypes]
    report.select(*clean).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def dump_prompts(prompts: DataFrame, payload: Column, path: str) -> None:
    """Prompts with their request and sizes, as JSON lines."""
    prompts.select(
        "id", "prompt_variant", "prompt_hash", F.length("user").alias("char_count_user"), F.length("system").alias("char_count_system"), payload.alias("payload")
    ).write.mode("overwrite").json(path)


def filter_months(messages: DataFrame, months: DataFrame, dropped: Column) -> DataFrame:
    """(ym, n_in, kept, dropped): each month of ``months`` (ym), empty ones too, and a row ``total``."""
    flagged = messages.select("ym", dropped.alias("__out"))
    counts = flagged.groupBy("ym").agg(F.count("*").alias("n_in"), F.count_if(~F.col("__out")).alias("kept"), F.count_if("__out").alias("dropped"))
    full = months.select("ym").join(counts, "ym", "left").na.fill(0)
    return full.unionByName(full.agg(F.lit("total").alias("ym"), *[F.sum(c).alias(c) for c in ("n_in", "kept", "dropped")]))


def write_filtered(messages: DataFrame, dropped: Column, path: str) -> DataFrame:
    """Writes the messages that are not ``dropped`` (null: kept) as JSON lines, a folder for each ``ym``; returns ``filter_months`` of them.

    What was at ``path`` is replaced, so a month of which nothing is left has no folder. The counts read the months and
    the condition's columns once more.
    """
    out = F.coalesce(dropped, F.lit(False))
    messages.where(~out).write.partitionBy("ym").mode("overwrite").json(path)
    return filter_months(messages, messages.select("ym").distinct(), out)


def harvest_summary(messages: DataFrame, months: DataFrame, size: Column) -> DataFrame:
    """(ym, messages, bytes, status): each month, ``missing`` where nothing was harvested, and a row ``total``."""
    counts = messages.groupBy("ym").agg(F.count("*").alias("messages"), F.sum(size.cast("long")).alias("bytes"))
    full = months.select("ym").join(counts, "ym", "left").na.fill(0)
    rows = full.withColumn("status", F.when(F.col("messages") == 0, "missing").otherwise("ok"))
    return rows.unionByName(full.agg(F.lit("total").alias("ym"), F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes")).withColumn("status", F.lit("ok")))
