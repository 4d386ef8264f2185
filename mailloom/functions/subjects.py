"""Subject and body predicates of the escalation pools and detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define markers and keyword lists.
VOTE = r"\[VOTE\b"
DISCUSS = r"\[DISCUSS\b"
PROPOSAL_START = r"^proposal"
PROPOSAL_ANYWHERE = r"\bproposal\b"
THINKING_AHEAD = r"\bthinking ahead\b"
LOGISTICS = r"\blogistics for releasing\b"
RELEASE_WORDS = r"\b(re-?roll|take it down|takedown|postpone|shorten|cadence|LTS|cycle|i propose|proposal:|let's do a|move(d)? to)\b"
SCHEDULE_WORDS = r"\b(re-?roll|re-?start|reroll|postpone|delay|reschedule|push back|shorten|extend the vote|release cycle|after 3\.0|too late|moved to|slip|push out|next week|until)\b"
VERSION_XYZ = r"\b\d+\.\d+\.\d+\b"
VOTE_PASSED = r"\[VOTE\s*PASSED\]|\[PASSED\s*VOTE\]|\[RESULT\][^a-z]*pass"
VOTE_CLOSED = r"\[VOTE\s*CLOSED\]|\[CLOSED\]"
VOTE_OPEN = r"\[VOTE\]"
BOT_SENDER = "jira@apache.org"
BOT_DOMAIN = "@builds.apache.org"


def is_bot(email: Column) -> Column:
    e = F.lower(F.coalesce(email, F.lit("")))
    return (e == BOT_SENDER) | e.endswith(BOT_DOMAIN)


def is_root(subject: Column) -> Column:
    return ~F.lower(subject).rlike("^(re:|fwd:)")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern)


def is_literal_vote(subject: Column) -> Column:
    """[VOTE] is left after the markers of ended votes are taken out."""
    s = F.upper(subject)
    for marker in ("[VOTE PASSED]", "[VOTE CLOSED]", "[VOTE FAILED]"):
        s = F.replace(s, F.lit(marker), F.lit(""))
    return F.contains(s, F.lit("[VOTE]"))


def vote_event(subject: Column) -> Column:
    """passed, closed, announced or null."""
    return F.when(matches(subject, VOTE_PASSED), "passed").when(matches(subject, VOTE_CLOSED), "closed").when(matches(subject, VOTE_OPEN), "announced")
