"""Reading mail archives and JSON-lines records; writing and resuming prediction logs."""

from __future__ import annotations

import email
import email.utils
import os
import shutil
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from email import policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.text import clean_id, mail_date, references, synthetic_id
from mailloom.sources.mbox import register

MESSAGE = "id string, list string, date string, from_name string, from_email string, from_raw string, subject string, in_reply_to string, references array<string>, body_text string, headers map<string,string>, provenance struct<source_url:string,fetched_at:string,harvester_version:string>"
PREDICTION = "id string, prediction boolean, p_positive double, evidence_quote string, rationale string, model_id string, prompt_hash string, prompt_variant string, quote_depth int, predicted_at string"
LABEL = "id string, label string, sample_role string, notes string"


def month_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Months yyyy-MM from start to end inclusive; none when start is later."""
    bounds = spark.range(1).select(F.to_date(F.lit(start), "yyyy-MM").alias("s"), F.to_date(F.lit(end), "yyyy-MM").alias("e")).where("s <= e")
    return bounds.select(F.explode(F.expr("sequence(s, e, interval 1 month)")).alias("m")).select(F.date_format("m", "yyyy-MM").alias("ym"))


def _text(part: email.message.Message) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _body(message: email.message.Message) -> str:
    """The first text part that is not empty and no attachment."""
    plain = (p for p in message.walk() if not p.is_multipart() and p.get_content_type() == "text/plain")
    shown = (p for p in plain if p is message or "attachment" not in str(p.get("Content-Disposition", "")).lower())
    return next((t for t in map(_text, shown) if t), "")


FIELDS = "mid string, rfc_date string, from_name string, from_email string, from_raw string, subject string, reply string, refs string, body_text string, headers map<string,string>"


def _fields(raw: bytes) -> tuple:
    m = email.message_from_bytes(raw, policy=policy.compat32)
    told = lambda name: str(m.get(name) or "")
    name, address = email.utils.parseaddr(told("From"))
    return told("Message-ID"), told("Date"), name, address, told("From"), told("Subject"), told("In-Reply-To"), told("References"), _body(m), {k: str(v) for k, v in m.items()}


def read_mbox(spark: SparkSession, path: str, list_name: str, **options: str) -> DataFrame:
    """Messages of mbox files (see ``sources.mbox``): MIME parts are parsed from bytes in Python, fields in columns.

    With ``onError="row"`` a file that cannot be read adds no message; ``mbox_status`` tells of it.
    """
    register(spark)
    raw = spark.read.format("mbox").options(**options).load(path).where("raw is not null").select("raw", "file")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame([_fields(bytes(r)) for r in frame["raw"]], columns=[f.split()[0] for f in FIELDS.split(", ")])
            yield out.assign(file=frame["file"].to_numpy())

    parsed = raw.mapInPandas(parse, f"{FIELDS}, file string")
    made = synthetic_id(F.col("from_raw"), F.col("rfc_date"), F.col("subject"), F.col("body_text"))
    return parsed.select(
        F.coalesce(F.nullif(clean_id(F.col("mid")), F.lit("")), made).alias("id"), F.lit(list_name).alias("list"), F.date_format(mail_date(F.col("rfc_date")), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        "from_name", "from_email", "from_raw", "subject", F.nullif(clean_id(F.coalesce("reply", F.lit(""))), F.lit("")).alias("in_reply_to"), references(F.col("refs")).alias("references"), "body_text", "headers",
        F.struct(F.col("file").alias("source_url"), F.lit(None).cast("string").alias("fetched_at"), F.lit("1").alias("harvester_version")).alias("provenance"),
    )


def mbox_status(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, messages, bytes, error) of each file that holds a message or cannot be read."""
    register(spark)
    rows = spark.read.format("mbox").options(**{"onError": "row", **options}).load(path)
    return rows.groupBy("file").agg(F.count("raw").alias("messages"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).cast("long").alias("bytes"), F.max("error").alias("error"))


def fetch_months(months: DataFrame, folder: str, url: Callable[[str], str], force: bool = False, timeout: float = 30.0, pause: float = 1.0) -> DataFrame:
    """(ym, url, path, bytes, error): the archive of each month (ym) fetched into ``folder``, a shared path.

    A file that is there is not fetched again unless ``force``; it appears when it is whole, so a task that runs
    again goes on where it stopped. A failed month is a row with its error. One task fetches, with a ``pause`` after each request.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for frame in frames:
            rows = []
            for ym in frame["ym"]:
                path, error = f"{folder}/{ym}.mbox", None
                try:
                    if force or not os.path.exists(path):
                        with urllib.request.urlopen(url(ym), timeout=timeout) as got, open(f"{path}.part", "wb") as out:
                            shutil.copyfileobj(got, out)
                        os.replace(f"{path}.part", path)
                        time.sleep(pause)
                except urllib.error.HTTPError as e:
                    error = f"HTTP {e.code}"
                except Exception as e:  # noqa: BLE001  a month that fails is data here
                    error = str(e)[:200]
                rows.append((ym, url(ym), path, os.path.getsize(path) if error is None else None, error))
            yield pd.DataFrame(rows, columns=["ym", "url", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    return months.select("ym").coalesce(1).mapInPandas(run, "ym string, url string, path string, bytes long, error string")


def harvest(fetched: DataFrame, messages: DataFrame) -> DataFrame:
    """(ym, messages, bytes, error) of each fetched month, and a row ``total``: ``messages`` as of ``read_mbox``, months by file name."""
    month = F.regexp_extract("provenance.source_url", r"(\d{4}-\d{2})\.mbox$", 1)
    counts = messages.groupBy(month.alias("ym")).agg(F.count("*").alias("messages"))
    rows = fetched.join(counts, "ym", "left").select("ym", F.when(F.col("error").isNull(), F.coalesce("messages", F.lit(0))).alias("messages"), "bytes", "error")
    return rows.unionByName(rows.agg(F.lit("total").alias("ym"), F.sum("messages").alias("messages"), F.sum("bytes").alias("bytes"), F.lit(None).cast("string").alias("error")))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; a bad line fails the read. Month from the file name as ``ym``."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("ym", F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2})", 1))


def write_messages(messages: DataFrame, path: str) -> None:
    """Partitioned by list and month; only the partitions present are replaced."""
    ym = F.coalesce(F.substring("date", 1, 7), F.lit("unknown"))
    messages.withColumn("ym", ym).write.partitionBy("list", "ym").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids in a prediction log; unreadable lines and lines without id are ignored."""
    schema = "id string, _corrupt_record string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).where("id is not null").select("id").distinct()
