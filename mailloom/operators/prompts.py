"""Prompts: the texts of the detector's variants, its requests, and their hashes.

Worked examples of the few-shot variant are an asset of the user's: a text passed in.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.text import elide_quoted, extract_at_depth, message_context

# Prompt texts, templates, placeholders, schema and limits. Their hash names a prompt.
SYSTEM_V1 = """You are reviewing a single message from the Apache Cassandra developer mailing list (dev@cassandra.apache.org). Determine whether the message announces or implies a change to a previously-stated or expected schedule for software work (releases, milestones, target dates, version cadence).

POSITIVE:
- Announcements that a release/version is delayed, advanced, or rescheduled
- Proposals to change a previously-stated target date ("should we move X to next week?")
- Acknowledgments that a previously-implied timeline will not be met
- Setting a new target date when a previous expectation existed

NEGATIVE:
- Discussion of current schedules without proposing changes ("X is on track")
- Status updates that don't affect a future date
- Setting an initial target with no prior expectation
- Pure technical discussion with no schedule reference

Output strict JSON:
{
  "is_schedule_change_announcement": true | false,
  "evidence_quote": "<verbatim span from message that justifies the answer, or null if false>",
  "rationale": "<one-sentence explanation>"
}"""
SYSTEM_V2 = """You are reviewing a single message from the Apache Cassandra developer mailing list (dev@cassandra.apache.org). Determine whether the message announces, proposes, or implies a change to a previously-stated date or version target for a release, milestone, or planned work.

The change must affect a substantive deliverable (a release date, a feature target version, a release cadence). Procedural mechanics around an in-flight release process — vote retries, vote-period adjustments, +1/-1 votes — are NOT schedule changes; they are the standard release process executing normally.

POSITIVE — the author IS announcing/proposing/implying a substantive schedule change:
- Explicit date changes ("I propose postponing release of 1.2.17 until next week")
- Version target shifts ("we're planning to move to file-based hint storage in 3.0", "it's too late for a schema change in 2.1")
- Release cadence proposals ("I'd love it if we could modify the C* release cycle to 4 months")
- Acknowledgments that a previously-stated timeline will not be met ("we still have a lot to do before X")
- Setting a new target date when a previous expectation existed
- Re-rolls that introduce a NEW version not previously planned (e.g., "let's do a 1.2.18" when 1.2.17 was the last announced)

NEGATIVE — these are NOT schedule changes:
- Vote-failure rerolls of an already-planned release ("vote closed; we'll re-roll once X is fixed") — the release was always planned to happen when the vote passed; one failed vote attempt is procedural, not a schedule change. The release is still in-flight on the same broad schedule.
- Vote-period adjustments ("I'll shorten the vote period to 48h", "extending the vote 24 more hours") — mechanic, not date.
- +1 / -1 votes by themselves, even when the parent vote announcement is in the thread — the vote reply is procedural.
- Discussion of current schedules without proposing changes ("X is on track")
- Initial schedule announcements when no prior expectation existed
- Pure technical discussion with no schedule reference

CRITICAL — quoted text rule:
If your evidence for a positive judgment would be a phrase that appears in the QUOTED part of the message (lines starting with > or otherwise marked as from an earlier message in the thread), the answer is NEGATIVE. Judge based on what THIS author wrote in THIS message, not what they are quoting from someone else. The author is referencing the quoted material, not asserting it.

Output strict JSON:
{
  "is_schedule_change_announcement": true | false,
  "evidence_quote": "<verbatim span from THIS author's new content (NOT quoted lines), or null if false>",
  "rationale": "<one-sentence explanation, including whether the evidence is in new content or quoted material if relevant>"
}"""
V3_POSITIVE = """- Question-form or conditional-form proposals — "How about X by late Jan?", "Should we move to monthly cadence?", "Would it be better to abandon the rc and re-release as X?" — are still proposals when the question is the author's substantive suggestion (not just clarifying what someone else said). Tentative phrasing ("thoughts?", "would that be better?") does not downgrade a substantive proposal to discussion."""
V3_NEGATIVE = """- JIRA bookkeeping notices — "I've created version X in JIRA", "target version set to X (rNNNN)", "merged to branch-N and target version set to X" — are administrative metadata changes, not schedule changes. They describe work already done or make a version selectable in the issue tracker; the schedule decision happens elsewhere in the thread."""
MARKED_SUFFIX = """

The user message below contains a NEW REPLY (this author's actual statement in this message) followed by QUOTED CONTEXT (text quoted from earlier messages, NOT this author's statement). Base your schedule-change judgment on the NEW REPLY only; the QUOTED CONTEXT is reference, not the author's claim."""
TEMPLATE = "Message:\nFrom: {from_raw}\nSubject: {subject}\nDate: {date}\n\n{body_text}"
TEMPLATE_TAGGED = "Message:\nFrom: {from_raw}\nSubject: {subject}\nDate: {date}\n\n{version_context_block}\n\n{body_text}"
TEMPLATE_MARKED = (
    "Message:\nFrom: {from_raw}\nSubject: {subject}\nDate: {date}\n\nNEW REPLY (this author's statement):\n{new_content}\n\n"
    "QUOTED CONTEXT (from earlier messages, for reference only — NOT this author's statement):\n{quoted_block}"
)
NO_NEW_CONTENT = "(no new content from this author in this message)"
NO_QUOTED = "(no quoted context in this message)"
NO_VERSIONS = "VERSION CONTEXT: (no Cassandra versions mentioned in this message)"
SCHEMA = {
    "type": "object",
    "properties": {"is_schedule_change_announcement": {"type": "boolean"}, "evidence_quote": {"type": ["string", "null"]}, "rationale": {"type": "string"}},
    "required": ["is_schedule_change_announcement", "evidence_quote", "rationale"],
    "additionalProperties": False,
}
VARIANTS = ["current_baseline", "new_only", "new_with_marked_quoted", "v2_strict", "v2_elided", "v2_elided_tagged", "v2_elided_fewshot", "v3_elided"]
BODY_CAP = 60_000
REQUEST = {"temperature": 0, "max_tokens": 400}


def _after(text: str, line: str, new: str) -> str:
    """``text`` with a line put behind the one that starts with ``line``."""
    rows = text.split("\n")
    at = next(i for i, row in enumerate(rows) if row.startswith(line))
    return "\n".join([*rows[: at + 1], new, *rows[at + 1 :]])


SYSTEM_V3 = _after(_after(SYSTEM_V2, "- Re-rolls that introduce", V3_POSITIVE), "- Pure technical discussion", V3_NEGATIVE)


def system_prompt(variant: str, examples: str | None = None) -> str:
    """System text of a variant; ``examples`` are the few-shot variant's, which is refused without them."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown prompt variant: {variant}")
    if variant == "v2_elided_fewshot":
        if not examples:
            raise ValueError("the few-shot variant needs its worked examples")
        return SYSTEM_V2 + examples
    if variant == "v3_elided":
        return SYSTEM_V3
    if variant == "new_with_marked_quoted":
        return SYSTEM_V1 + MARKED_SUFFIX
    return SYSTEM_V2 if variant.startswith("v2_") else SYSTEM_V1


def template(variant: str) -> str:
    return {"new_with_marked_quoted": TEMPLATE_MARKED, "v2_elided_tagged": TEMPLATE_TAGGED}.get(variant, TEMPLATE)


def prompt_hash(variant: str, examples: str | None = None) -> str:
    """16 hex digits over system text, template, schema and name."""
    parts = [system_prompt(variant, examples), template(variant), json.dumps(SCHEMA, sort_keys=True), variant]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def _filled(form: str, **values: Column) -> Column:
    """A template with its {names} replaced by columns."""
    out, rest = [], form
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(text), values[name]]
    return F.concat(*out, F.lit(rest))


def fields(variant: str, body: Column, depth: int | None = None, block: Column | None = None) -> dict[str, Column]:
    """What a variant puts into its template for a message body."""
    if variant in ("current_baseline", "v2_strict"):
        shown = body if depth is None else extract_at_depth(body, depth)
        return {"body_text": F.substring(shown, 1, BODY_CAP)}
    if variant in ("v2_elided", "v2_elided_fewshot", "v3_elided", "v2_elided_tagged"):
        shown = {"body_text": F.substring(elide_quoted(body, 999 if depth is None else depth), 1, BODY_CAP)}
        if variant != "v2_elided_tagged":
            return shown
        return shown | {"version_context_block": F.coalesce(F.nullif(block, F.lit("")), F.lit(NO_VERSIONS)) if block is not None else F.lit(NO_VERSIONS)}
    context = message_context(body)
    own = F.coalesce(F.nullif(context["new_content"], F.lit("")), F.lit(NO_NEW_CONTENT))
    if variant == "new_only":
        return {"body_text": F.substring(own, 1, BODY_CAP)}
    own = F.substring(own, 1, BODY_CAP // 2)
    segments = F.transform(context["quoted_segments"], lambda s: F.concat(F.lit("[depth "), s["depth"].cast("string"), F.lit("]\n"), s["text"]))
    quoted = F.coalesce(F.nullif(F.array_join(segments, "\n\n"), F.lit("")), F.lit(NO_QUOTED))
    room = F.greatest(F.lit(200), BODY_CAP - F.length(own) - 200)
    return {"new_content": own, "quoted_block": F.substring(quoted, F.lit(1), room)}


def build_prompts(messages: DataFrame, variant: str, depth: int | None = None, blocks: DataFrame | None = None, examples: str | None = None) -> DataFrame:
    """(id, prompt_variant, prompt_hash, system, user) of ``messages`` (id, from_raw, date, subject, body).

    ``blocks`` (id, block) are the version blocks of the tagged variant; an unknown variant is refused.
    """
    system = system_prompt(variant, examples)
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("from_raw", "date", "subject", "body")}
    rows = messages if blocks is None else messages.join(blocks.select("id", F.col("block").alias("__block")), "id", "left")
    own = fields(variant, text["body"], depth, None if blocks is None else F.col("__block"))
    user = _filled(template(variant), **{k: v for k, v in text.items() if k != "body"}, **own)
    return rows.select("id", F.lit(variant).alias("prompt_variant"), F.lit(prompt_hash(variant, examples)).alias("prompt_hash"), F.lit(system).alias("system"), user.alias("user"))


def payload(model: str, top_logprobs: int | None = 10) -> Column:
    """The request of a prompt (``system``, ``user``) as JSON; without log-probabilities if ``top_logprobs`` is None."""
    said = lambda role: F.struct(F.lit(role).alias("role"), F.col(role).alias("content"))
    messages = F.array(said("system"), said("user"))
    parts = [F.lit(model).alias("model"), messages.alias("messages"), *[F.lit(v).alias(k) for k, v in REQUEST.items()]]
    parts += [] if top_logprobs is None else [F.lit(True).alias("logprobs"), F.lit(top_logprobs).alias("top_logprobs")]
    guided = F.lit(', "guided_json": ' + json.dumps(SCHEMA) + "}")
    return F.concat(F.regexp_replace(F.to_json(F.struct(*parts)), r"\}$", ""), guided)


def char_stats(prompts: DataFrame) -> DataFrame:
    """Number of prompts, characters in all, mean (whole), longest and its id (the least of several), tokens at four characters each."""
    size = prompts.select("id", (F.length("system") + F.length("user")).cast("long").alias("chars"))
    out = size.agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("chars").alias("longest"), F.min_by("id", F.struct(-F.col("chars"), F.col("id"))).alias("longest_id"))
    return out.withColumn("mean", F.floor(F.try_divide("chars", "n"))).withColumn("tokens", F.floor(F.col("chars") / 4))
