"""Prompts of all variants, their answers and reports, over mails made of ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions import subjects as S
from mailloom.functions import text as X
from mailloom.operators import prompts as P
from mailloom.operators import scoring, versions
from mailloom.plans.queries import CONTEXT_WITH, CORPUS_SQL, _extract_sql, attributed, corpus, messages, query, rates, table
from mailloom.sources import files
from mailloom.sources.mail import month_spine

EXAMPLES = "\n\nWORKED EXAMPLES\n(none given here)"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


HEAD = "'Message:' || chr(10) || 'From: ' || role || chr(10) || 'Subject: ' || subject || chr(10) || 'Date: ' || chr(10) || chr(10)"


def _prompt_sql(variant: str, ctes: str, user: str, source: str) -> str:
    """Rows of one variant: the hash over fixed texts is a constant, the user text is built in SQL."""
    system = _text(P.system_prompt(variant, EXAMPLES))
    parts = [P.system_prompt(variant, EXAMPLES), P.template(variant), P.json.dumps(P.SCHEMA, sort_keys=True), variant]
    digest = "substring(sha256(" + " || chr(0) || ".join(map(_text, parts)) + "), 1, 16)"
    return ctes + f"SELECT id, '{variant}' AS prompt_variant, {digest} AS prompt_hash, md5({system}) AS system, md5({user}) AS \"user\" FROM {source}"


def prompts_of(spark, d, variant: str, mails: DataFrame, **options) -> DataFrame:
    rows = mails.select("id", F.col("role").alias("from_raw"), F.lit(None).cast("string").alias("date"), "subject", "body")
    out = P.build_prompts(rows, variant, examples=EXAMPLES, **options)
    return out.withColumns({"system": F.md5("system"), "user": F.md5("user")})


_ELIDED = _extract_sql("true", "CASE WHEN depth > 0 THEN repeat('> ', depth::int) || '[QUOTED]' ELSE line END").rpartition(" SELECT msg.id")[0] + " "
_ELIDED_BODY = "substring(CASE WHEN coalesce(t.text, '') = '' THEN '' ELSE t.text || chr(10) END, 1, 60000)"
_SHALLOW = _extract_sql("depth <= 1", "line").rpartition(" SELECT msg.id")[0] + " "
_MSG = _SHALLOW.partition(", l AS (")[0] + " "
_WITH_TEXT = "msg LEFT JOIN t USING (id)"


@query(_prompt_sql("current_baseline", _MSG, HEAD + " || substring(body, 1, 60000)", "msg"))
def prompt_current_baseline(spark, d):
    return prompts_of(spark, d, "current_baseline", messages(spark, d))


@query(_prompt_sql("v2_strict", _SHALLOW, HEAD + " || " + _ELIDED_BODY, _WITH_TEXT))
def prompt_v2_strict(spark, d):
    """At depth 1."""
    return prompts_of(spark, d, "v2_strict", messages(spark, d), depth=1)


@query(_prompt_sql("v2_elided", _ELIDED, HEAD + " || " + _ELIDED_BODY, _WITH_TEXT))
def prompt_v2_elided(spark, d):
    return prompts_of(spark, d, "v2_elided", messages(spark, d))


@query(_prompt_sql("v2_elided_fewshot", _ELIDED, HEAD + " || " + _ELIDED_BODY, _WITH_TEXT))
def prompt_v2_elided_fewshot(spark, d):
    return prompts_of(spark, d, "v2_elided_fewshot", messages(spark, d))


@query(_prompt_sql("v3_elided", _ELIDED, HEAD + " || " + _ELIDED_BODY, _WITH_TEXT))
def prompt_v3_elided(spark, d):
    return prompts_of(spark, d, "v3_elided", messages(spark, d))


_TAGS = (
    _ELIDED.rstrip()
    + """, tags AS (SELECT conv_id || '-' || turn AS id, 'VERSION CONTEXT (state at this message''s timestamp):' || chr(10) || '- 9.' || conv_id % 10 || ': '
 || CASE WHEN turn >= 3 THEN 'vote_passed (passed 2014-06-03)' WHEN turn >= 1 THEN 'vote_active (announced 2014-06-01)' ELSE 'pre_announcement (no [VOTE] yet)' END AS block FROM conversations)
"""
)


@query(
    _prompt_sql(
        "v2_elided_tagged", _TAGS, HEAD.replace("subject", "subject || ' 9.' || split_part(id, '-', 1)::bigint % 10") + f" || CASE WHEN role = 'system' THEN {_text(P.NO_VERSIONS)} ELSE block END || chr(10) || chr(10) || " + _ELIDED_BODY,
        _WITH_TEXT + " LEFT JOIN tags USING (id)",
    )
)
def prompt_v2_elided_tagged(spark, d):
    """Each mail names a version that is put to the vote on the second day and passes on the fourth; blocks are kept from system mails."""
    turn = F.substring_index("id", "-", -1).cast("int")
    version = F.concat(F.lit(" 9."), F.substring_index("id", "-", 1).cast("long") % 10)
    mails = messages(spark, d).withColumn("subject", F.concat("subject", version)).withColumn("ts", F.timestamp_seconds(F.lit(1401494400) + turn * 86400))
    votes = spark.range(20).select((F.col("id") % 10).alias("v"), (F.col("id") < 10).alias("first"))
    tag = F.when(F.col("first"), "[VOTE] 9.").otherwise("[VOTE PASSED] 9.")
    votes = votes.select(F.when(F.col("first"), F.lit("2014-06-01")).otherwise("2014-06-03").cast("timestamp").alias("ts"), F.concat(tag, "v").alias("subject"), F.lit("").alias("body"))
    blocks = versions.context_blocks(mails.where("role <> 'system'"), versions.event_log(votes))
    return prompts_of(spark, d, "v2_elided_tagged", mails, blocks=blocks)


@query(_prompt_sql("new_only", CONTEXT_WITH, HEAD + f" || CASE WHEN own = '' THEN {_text(P.NO_NEW_CONTENT)} ELSE substring(own, 1, 60000) END", "ctx JOIN msg USING (id)"))
def prompt_new_only(spark, d):
    return prompts_of(spark, d, "new_only", attributed(spark, d))


_MARKED = CONTEXT_WITH.rstrip() + f", cut AS (SELECT id, substring(CASE WHEN own = '' THEN {_text(P.NO_NEW_CONTENT)} ELSE own END, 1, 30000) AS own, coalesce(quoted, {_text(P.NO_QUOTED)}) AS quoted FROM ctx) "
_MARKED_USER = HEAD + " || " + _text("NEW REPLY (this author's statement):\n") + " || own || " + _text("\n\nQUOTED CONTEXT (from earlier messages, for reference only — NOT this author's statement):\n") + " || substring(quoted, 1, greatest(200, 60000 - length(own) - 200)::bigint)"


@query(_prompt_sql("new_with_marked_quoted", _MARKED, _MARKED_USER, "cut JOIN msg USING (id)"))
def prompt_new_with_marked_quoted(spark, d):
    return prompts_of(spark, d, "new_with_marked_quoted", attributed(spark, d))


@query(
    _MSG
    + f"""SELECT count(*) AS n, sum(c)::bigint AS chars, max(c)::bigint AS longest, arg_min(id, (-c, id)) AS longest_id, sum(c)::bigint // count(*) AS mean, sum(c)::bigint // 4 AS tokens
FROM (SELECT id, length({_text(P.SYSTEM_V1)}) + length({HEAD} || substring(body, 1, 60000)) AS c FROM msg)"""
)
def prompt_char_stats(spark, d):
    mails = messages(spark, d).select("id", F.col("role").alias("from_raw"), F.lit("").alias("date"), "subject", "body")
    return P.char_stats(P.build_prompts(mails, "current_baseline"))


def rule_scorer(system: str, user: str) -> dict:
    """Stands for an endpoint: says yes to votes, is unsure about proposals, fails on discussions, and once cuts its answer short."""
    head = user.partition("\nSubject: ")[2].partition("\n")[0]
    if head.startswith("[DISCUSS]"):
        raise TimeoutError("no answer")
    said = "[VOTE]" in head
    answer = '{"is_schedule_change_announcement": %s, "evidence_quote": %s, "rationale": "by subject"}' % (str(said).lower(), '"%s"' % head if said else "null")
    logprob = -0.5 if "roposal" in head else -0.125
    other = {"token": "false" if said else "true", "logprob": -1.0 if "roposal" in head else -2.125}
    tokens = [{"token": str(said).lower(), "logprob": logprob, "top_logprobs": [{"token": str(said).lower(), "logprob": logprob}, other]}]
    if "PASSED" in head:
        answer = "I cannot tell"
    return {"content": answer[:-1] if "Re:" in head else answer, "tokens": None if head.startswith("fwd") else tokens, "prompt_tokens": len(user) // 4}


@query(
    CORPUS_SQL
    + """SELECT id::varchar AS id, contains(subject, '[VOTE]') AS prediction, CASE WHEN contains(subject, '[VOTE]') THEN subject END AS evidence_quote,
 CASE WHEN id % 8 = 6 THEN 'fallback' ELSE 'logprob' END AS p_source,
 floor(CASE WHEN id % 8 = 6 THEN .001 WHEN contains(subject, '[VOTE]') THEN 1 / (1 + exp(-2)) WHEN contains(subject, 'roposal') THEN 1 / (1 + exp(0.5)) ELSE 1 / (1 + exp(2)) END * 10000 + 0.5) / 10000.0 AS p_positive
FROM corpus WHERE id % 8 NOT IN (4, 5) AND id % 3 <> 0"""
)
def classify_run(spark, d):
    """Prompts that are not done are scored; failed and unreadable answers make no row and come again."""
    mails = corpus(spark, d).select(F.col("id").cast("string").alias("id"), F.lit("a@example.org").alias("from_raw"), F.lit("").alias("date"), "subject", "body")
    prompts = P.build_prompts(mails, "v3_elided", depth=2)
    done = prompts.where("id % 3 = 0").select("id")
    out = scoring.predictions(scoring.run_scorer(prompts, done, rule_scorer, concurrency=8, system=P.system_prompt("v3_elided")), prompts, "rules", depth=2)
    return rates(out.select("id", "prediction", "evidence_quote", "p_source", "p_positive"), "p_positive")


@query("SELECT l_shipmode AS error, n FROM (SELECT 'HTTP ' || (500 + l_linenumber) AS l_shipmode, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ORDER BY n DESC, error LIMIT 5")
def error_top5(spark, d):
    """Returned lines as failed calls."""
    calls = table(spark, d, "lineitem").select((F.col("l_returnflag") != "R").alias("ok"), F.concat(F.lit("HTTP "), F.lit(500) + F.col("l_linenumber")).alias("error"))
    return scoring.errors_by_message(calls)


@query(
    CORPUS_SQL
    + r"""SELECT lower(regexp_extract(subject || ' ' || body, '(?i)\b(re-?roll|re-?start|reroll|postpone|delay|reschedule|push back|shorten|extend the vote|release cycle|after 3\.0|too late|moved to|slip|push out|next week|until)\b')) AS word,
 count(*) AS n FROM corpus GROUP BY 1 HAVING word <> ''"""
)
def schedule_keyword_hits(spark, d):
    """How many mails have each schedule word first."""
    word = F.lower(F.regexp_extract(F.concat_ws(" ", "subject", "body"), "(?i)" + S.SCHEDULE_WORDS, 0))
    return corpus(spark, d).groupBy(word.alias("word")).agg(F.count("*").alias("n")).where("word <> ''")


@query("SELECT split_part(lower(source || '@Lists' || doc_id % 13 || '.example.org'), '@', -1) AS domain, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def sender_domain_topk(spark, d):
    sender = F.concat("source", F.lit("@Lists"), F.col("doc_id") % 13, F.lit(".example.org"))
    by = table(spark, d, "documents").where("source is not null").groupBy(X.email_domain(sender).alias("domain")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "domain").limit(10)


@query("""WITH s AS (SELECT strftime(unnest(generate_series(date '1991-12-01', date '1998-12-01', interval 1 month)), '%Y-%m') AS ym), o AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym, length(o_orderpriority) AS b FROM orders),
r AS (SELECT ym, count(b) AS messages, coalesce(sum(b), 0)::bigint AS bytes FROM s LEFT JOIN o USING (ym) GROUP BY ym)
SELECT ym, messages, bytes, CASE WHEN messages = 0 THEN 'missing' ELSE 'ok' END AS status FROM r UNION ALL SELECT 'total', sum(messages)::bigint, sum(bytes)::bigint, 'ok' FROM r""")
def harvest_summary(spark, d):
    mails = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("ym"), "o_orderpriority")
    return files.harvest_summary(mails, month_spine(spark, "1991-12", "1998-12"), F.octet_length("o_orderpriority"))


@query(
    """SELECT doc_id AS id, CASE doc_id % 6 WHEN 4 THEN false WHEN 5 THEN false ELSE true END AS attribution,
 coalesce(nullif(regexp_extract('preds-depth-' || doc_id % 7 || '.jsonl', 'depth-(\\d+)', 1), '')::int, -1) AS depth FROM documents""".replace("\\\\", "\\")
)
def attribution_lines(spark, d):
    """Six shapes of a line above a quote, and the depth in a file name."""
    i = F.col("doc_id")
    who = F.coalesce("source", F.lit("nobody"))
    shapes = F.array(
        F.concat(F.lit("  On Monday "), who, F.lit(" wrote:  ")), F.concat(F.lit("On 3 May, "), who, F.lit("wrote:")), F.concat(who, F.lit(" wrote on Monday, 3 May:")),
        F.lit("---- Original Message ----"), F.concat(who, F.lit(" wrote that:")), F.concat(F.lit("> On Monday "), who, F.lit(" wrote:")),
    )
    line = F.get(shapes, (i % 6).cast("int"))
    return table(spark, d, "documents").select(i.alias("id"), X.is_attribution(line).alias("attribution"), files.depth_of(F.concat(F.lit("preds-depth-"), i % 7, F.lit(".jsonl"))).alias("depth"))
