"""Pluggable scorers, the reading of their answers, prediction rows and reports on calls."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.metrics import nearest_ranks
from mailloom.functions.text import strip
from mailloom.operators.evaluate import last_wins

ANSWER = "is_schedule_change_announcement boolean, evidence_quote string, rationale string"
TOKENS = "array<struct<token:string,logprob:double,top_logprobs:array<struct<token:string,logprob:double>>>>"
RESPONSE = f"content string, tokens {TOKENS}, prompt_tokens long, completion_tokens long, error string"


def parse_answer(content: Column) -> Column:
    """Struct of an answer's JSON: code fences are stripped, a missing brace or quote is repaired; null if it is no object."""
    s = strip(content)
    s = F.when(s.startswith("```"), F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*\n", ""), r"\s*```$", "")).otherwise(s)
    inside = r'[^\[\]{}"]|"[^"]*"'
    for _ in range(4):  # lists and objects as values, nested up to four deep; from_json refuses malformed ones
        inside = r'[^\[\]{}"]|"[^"]*"|[\[{](?:' + inside + r')*[\]}]'
    value = r'("[^"]*"|true|false|null|-?[0-9.eE+-]+|[\[{](?:' + inside + r')*[\]}])'
    whole = r'^\{\s*("[^"]*"\s*:\s*' + value + r'\s*(,\s*(?=")|(?=\})))*\}\s*$'
    bare = lambda t: F.regexp_replace(t, r"(?s)\\.", "")  # noqa: E731  without escapes a string ends at its next quote
    read = lambda t: F.when(bare(t).rlike(whole), F.from_json(t, ANSWER))
    return F.coalesce(read(s), read(F.concat(s, F.lit("}"))), read(F.concat(s, F.lit('"}'))))


def p_positive(tokens: Column, prediction: Column) -> Column:
    """Probability of true at the first boolean token; .999 or .001 without one.

    ``tokens``: array of (token, logprob, top_logprobs: array of (token, logprob)).
    """
    said = lambda t: strip(t["token"]).isin("true", "false")
    first = F.get(F.filter(tokens, said), 0)
    other = F.get(F.filter(first["top_logprobs"], lambda a: said(a) & (strip(a["token"]) != strip(first["token"]))), 0)["logprob"]
    least = F.array_min(F.transform(first["top_logprobs"], lambda a: a["logprob"]))
    other = F.coalesce(other, least - 1.0, F.lit(-10.0))
    a, b = F.exp(first["logprob"]), F.exp(other)
    p = F.when(strip(first["token"]) == "true", a).otherwise(b) / F.nullif(a + b, F.lit(0.0))
    return F.coalesce(p, F.when(prediction, 0.999).otherwise(0.001))


def run_scorer(prompts: DataFrame, done: DataFrame | None, scorer: Callable[[str, str], dict], concurrency: int = 32, limit: int = 0, system: str | None = None) -> DataFrame:
    """(id, RESPONSE) of prompts that are not done, one call per id; an error is a row.

    ``scorer`` takes system and user text and returns the fields of RESPONSE that it knows. Of several prompts
    of an id the last by ``ordinal`` is scored, any if there is no such column. A ``system`` text that all prompts
    share goes to the tasks once instead of with each row.
    """
    todo = prompts.select("id", "user", *([] if system is not None else ["system"]), *[c for c in ("ordinal",) if c in prompts.columns])
    todo = last_wins(todo, ["id"]) if "ordinal" in todo.columns else todo.dropDuplicates(["id"])
    todo = todo if done is None else todo.join(done, "id", "left_anti")
    todo = todo.orderBy("id").limit(limit) if limit else todo
    names = [f.split()[0] for f in ("content", "tokens", "prompt_tokens", "completion_tokens", "error")]

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, told, user in zip(frame["id"], [system] * len(frame) if system is not None else frame["system"], frame["user"], strict=True):
                try:
                    said = scorer(told, user)
                except Exception as e:  # noqa: BLE001  an endpoint's failure is data here
                    said = {"error": str(e)[:200]}
                rows.append((i, *(said.get(n) for n in names)))
            yield pd.DataFrame(rows, columns=["id", *names]).astype({"prompt_tokens": "Int64", "completion_tokens": "Int64"})

    return todo.drop("ordinal").repartition(concurrency).mapInPandas(call, f"id string, {RESPONSE}")


def predictions(responses: DataFrame, prompts: DataFrame, model: str, depth: int | None = None) -> DataFrame:
    """Prediction rows of readable responses, with ``p_source``: logprob, or fallback where no boolean token was seen."""
    read = responses.withColumn("__a", parse_answer(F.col("content"))).where("__a.is_schedule_change_announcement is not null")
    said = F.col("__a.is_schedule_change_announcement")
    seen = F.coalesce(F.exists("tokens", lambda t: strip(t["token"]).isin("true", "false")), F.lit(False))
    out = read.join(prompts.select("id", "prompt_hash", "prompt_variant"), "id")
    return out.select(
        "id", said.alias("prediction"), p_positive(F.col("tokens"), said).alias("p_positive"), "__a.evidence_quote", F.coalesce("__a.rationale", F.lit("")).alias("rationale"),
        F.lit(model).alias("model_id"), "prompt_hash", "prompt_variant", F.lit(depth).cast("int").alias("quote_depth"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("predicted_at"), F.when(seen, "logprob").otherwise("fallback").alias("p_source"),
    )


def classify(prompts: DataFrame, done: DataFrame | None, scorer: Callable[[str, str], dict], model: str, write: Callable[[DataFrame], DataFrame], depth: int | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(prediction rows, counts by outcome: ok, error, unreadable); only prediction rows belong into the log.

    The scorer is paid for, so ``write`` stores its responses once (and returns the stored rows) before they are read.
    """
    stored = write(run_scorer(prompts, done, scorer, **options))
    kind = F.when(F.col("error").isNotNull(), "error").when(parse_answer(F.col("content"))["is_schedule_change_announcement"].isNull(), "unreadable").otherwise("ok")
    return predictions(stored, prompts, model, depth), stored.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def latency_report(results: DataFrame, by: list[str] | None = None, wall_s: float | None = None) -> DataFrame:
    """Calls, mean, median, nearest-rank p50 to p99 and maximum of ``elapsed_s`` of the ok rows (``ok``, ``elapsed_s``), and ok calls a second of ``wall_s``."""
    by = by or []
    ok = results.where("ok")
    ranks = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "low": (0.5, F.floor), "high": (0.5, F.ceil)}
    stats = ok.groupBy(*by).agg(F.count("*").alias("n"), F.avg("elapsed_s").alias("mean"), F.max("elapsed_s").alias("longest"))
    other = nearest_ranks(ok, by, "elapsed_s", ranks)
    stats = stats.join(other, by) if by else stats.crossJoin(other)  # one row each
    return stats.withColumns({"median": (F.col("low") + F.col("high")) / 2, "per_second": F.col("n") / F.lit(wall_s)}).drop("low", "high")


def errors_by_message(results: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent errors; of equally frequent ones the first by text."""
    return results.where("not ok").groupBy("error").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error").limit(top)


def replay(workload: DataFrame, call: Callable[[str], tuple[int, bytes]], concurrency: int = 32) -> DataFrame:
    """A row for each request of a dumped workload (id, payload): how it went and how long it took.

    ``call`` posts a payload and returns status and body; a status of 400 or more, or an exception, is a failed row.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, payload in zip(frame["id"], frame["payload"], strict=True):
                began, status, body, error = time.monotonic(), None, b"", None
                try:
                    status, body = call(payload)
                    error = None if status < 400 else f"HTTP {status}"
                except Exception as e:  # noqa: BLE001  an endpoint's failure is data here
                    error = str(e)[:200]
                rows.append((i, error is None, status, time.monotonic() - began, len(body), body.decode("utf-8", "replace"), error))
            out = pd.DataFrame(rows, columns=["id", "ok", "status", "elapsed_s", "response_bytes", "body", "error"])
            yield out.astype({"status": "Int32"})

    calls = workload.repartition(concurrency).select("id", "payload").mapInPandas(each, "id string, ok boolean, status int, elapsed_s double, response_bytes long, body string, error string")
    used = F.from_json("body", "usage struct<prompt_tokens:long,completion_tokens:long>")["usage"]
    return calls.select("id", "ok", "status", "elapsed_s", "response_bytes", used["prompt_tokens"].alias("prompt_tokens"), used["completion_tokens"].alias("completion_tokens"), "error")


def replayed(workload: DataFrame, call: Callable[[str], tuple[int, bytes]], path: str, concurrency: int = 32) -> tuple[DataFrame, DataFrame]:
    """(calls, report): the workload is replayed once into JSON lines at ``path``; its latencies, and ok calls a second of the whole run.

    A task that is lost posts its requests again; each request has one row all the same.
    """
    rows, began = replay(workload, call, concurrency), time.monotonic()
    rows.write.mode("overwrite").json(path)
    took = time.monotonic() - began
    calls = workload.sparkSession.read.schema(rows.schema).json(path)
    return calls, latency_report(calls, wall_s=took)
