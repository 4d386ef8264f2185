"""Text functions of message bodies, as column expressions.

Lines split where Python's ``splitlines`` splits; blanks and digits are Unicode.
"""

from __future__ import annotations

import re
from itertools import accumulate, groupby, takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that define attribution lines, versions, vote events and subjects.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
ATTRIBUTION = [
    r"^On\b.+\bwrote:\s*$",
    r"^On\b.+,.+wrote:\s*$",
    r"^.+\bwrote\s+on\b.+:\s*$",
    r"^-{3,}\s*Original\s+[Mm]essage\s*-{3,}\s*$",
    r"^From:\s+.+$",
]
VERSION = r"\b(\d\.\d(?:\.\d{1,2})?(?:-[A-Za-z0-9]+)?)\b"
SIGNATURE = r"^--\s*$"
MARKER = "[QUOTED]"
_EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def ascii_edges(pattern: str) -> str:
    """``pattern`` with words of ASCII letters at each ``\\b``, as SQL has them; Java's are of all letters before version 19."""
    return pattern.replace(r"\b", _EDGE)


def strip(c: Column) -> Column:
    """Without blanks at both ends, all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+$", "")


def lines(c: Column) -> Column:
    """Lines of a text; a line end at the end makes no empty line, an empty text has none."""
    parts = F.split(c, LINE_END)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(trimmed)


def quote_depth(line: Column) -> Column:
    """Number of leading ``>``, blanks between them ignored."""
    prefix = F.regexp_extract(line, r"(?U)^(?:\s*>)*", 0)
    return F.length(prefix) - F.length(F.replace(prefix, F.lit(">"), F.lit("")))


def is_attribution(line: Column) -> Column:
    bare, out = strip(line), F.lit(False)
    for pattern in ATTRIBUTION:
        out = out | bare.rlike("(?U)" + pattern)
    return out


def is_blank(line: Column) -> Column:
    return strip(line) == ""


def _body(rows: Column) -> Column:
    """Lines as a text: no blank lines ahead or behind, each run of them in between one empty line, a line end if there is any text."""
    text = rstrip(F.array_join(rows, "\n"))
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\A\s*\n", ""), r"(?U)\n\s*\n", "\n\n")
    return F.when(text == "", "").otherwise(F.concat(text, F.lit("\n")))


def extract_at_depth(body: Column, depth: int) -> Column:
    """The lines quoted at most ``depth`` deep; at depth 0 attribution lines go too."""
    rows = F.filter(lines(body), lambda x: (quote_depth(x) <= depth) & (~is_attribution(x) if depth == 0 else F.lit(True)))
    return _body(rows)


def elide_quoted(body: Column, depth: int = 999, marker: str = MARKER) -> Column:
    """Quoted lines up to ``depth`` replaced by a marker behind their prefix, deeper ones dropped."""
    told = F.transform(lines(body), lambda x: F.struct(quote_depth(x).alias("depth"), x.alias("line")))
    shown = lambda x: F.when(x["depth"] > 0, F.concat(F.repeat(F.lit("> "), x["depth"]), F.lit(marker))).otherwise(x["line"])
    return _body(F.transform(F.filter(told, lambda x: x["depth"] <= depth), shown))


def versions(text: Column) -> Column:
    """Distinct versions in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?U)" + VERSION), F.lit(1)))


def signature(body: Column) -> Column:
    """What follows the first line of two dashes; null without one."""
    rows = lines(body)
    at = F.array_position(F.transform(rows, lambda x: x.rlike("(?U)" + SIGNATURE)), True)
    return F.when(at > 0, strip(F.array_join(F.slice(rows, (at + 1).cast("int"), F.greatest(F.lit(0), F.size(rows) - at.cast("int"))), "\n")))


def clean_id(c: Column) -> Column:
    return F.regexp_replace(strip(c), "^[<>]+|[<>]+$", "")


def references(c: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, "^[<>]+|[<>]+$", ""))


def synthetic_id(sender: Column, date: Column, subject: Column, body: Column) -> Column:
    nul = F.lit("\0")
    raw = F.concat(sender, nul, date, nul, subject, nul, F.substring(body, 1, 4096))
    return F.concat(F.lit("synth-"), F.substring(F.sha2(raw, 256), 1, 16))


def mail_date(c: Column) -> Column:
    """UTC timestamp of an RFC 2822 date; without a zone it is UTC, unreadable is null."""
    bare = strip(F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r"^\s*[A-Za-z]{3},\s*", ""))
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    for name, hours in (("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"), ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700")):
        zoned = F.regexp_replace(zoned, rf"\s{name}$", f" {hours}")
    formats = ["d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx", "d MMM yyyy HH:mm:ss", "d MMM yyyy HH:mm"]
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in formats])


def email_domain(c: Column) -> Column:
    return F.substring_index(F.lower(c), "@", -1)


_RUN = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("text", T.StringType())])
CONTEXT = T.StructType([T.StructField("new_content", T.StringType()), T.StructField("quoted_segments", T.ArrayType(_RUN)), T.StructField("attribution_lines", T.ArrayType(T.StringType())), T.StructField("signature", T.StringType())])


def _depth(line: str) -> int:
    return re.match(r"(?:\s*>)*", line)[0].count(">")


def _attribution(rows: list[str], i: int, end: int) -> tuple[int, str]:
    """(lines taken, text) of the attribution at a line of no depth, which mailers wrap over up to three; 0 if none."""
    first = rows[i].strip()
    known = lambda t: any(re.search(p, t) for p in ATTRIBUTION)
    if first.startswith("On ") and not first.endswith("wrote:"):
        behind = takewhile(lambda x: x.strip() and not _depth(x), rows[i + 1 : min(end, i + 3)])
        joined = enumerate(accumulate([first, *map(str.strip, behind)], "{} {}".format), 1)
        taken, text = next(((n, t) for n, t in joined if t.endswith("wrote:")), (0, ""))
        if taken and known(text):
            return taken, text
    return (1, first) if known(first) else (0, "")


def _context(body: str | None) -> tuple[str, list[dict], list[str], str | None]:
    rows = (body or "").splitlines()
    end = next((i for i, x in enumerate(rows) if re.match(SIGNATURE, x)), len(rows))
    marked, i = [], 0  # (-1 for an attribution, else the depth; text)
    while i < end:
        taken, text = (0, "") if _depth(rows[i]) else _attribution(rows, i, end)
        marked.append((-1, text) if taken else (_depth(rows[i]), rows[i]))
        i += taken or 1
    runs = [(k, [t for _, t in g]) for k, g in groupby(marked, key=lambda m: m[0])]
    own = [t if t.strip() else "" for k, t in marked if k == 0]
    kept = [t for t, before in zip(own, ["", *own], strict=False) if t or before]
    return "\n".join(kept).rstrip(), [{"depth": k, "text": "\n".join(t).strip()} for k, t in runs if k > 0], [t for k, t in marked if k < 0], "\n".join(rows[end + 1 :]).strip() or None


@F.pandas_udf(CONTEXT)
def message_context(bodies: pd.Series) -> pd.DataFrame:
    """Own text, quoted runs with their depth, attributions and signature of a body; a null body is empty.

    A wrapped attribution takes the lines behind it, so lines are read in order.
    """
    return pd.DataFrame([_context(b) for b in bodies], columns=["new_content", "quoted_segments", "attribution_lines", "signature"])
