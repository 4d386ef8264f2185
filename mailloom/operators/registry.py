"""Detectors by name: a pattern, the shape of the body that it reads, and a score. One registry serves columns and SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from mailloom.functions import subjects as S
from mailloom.functions import text as X

SHAPES = ("subject", "body", "new", "quoted")
ROW = "detector string, matched boolean, score double, evidence string"


@dataclass(frozen=True)
class Detector:
    """Matches where ``pattern`` (no case) occurs in the ``shape``: the subject, the whole body, its own lines or its quoted lines.

    The score is the number of occurrences, ``full`` or more of them being 1.
    """

    name: str
    pattern: str
    shape: str = "new"
    full: int = 2

    def __post_init__(self):
        if self.shape not in SHAPES:
            raise ValueError(f"shape is one of {SHAPES}")
        re.compile(self.pattern)


def shaped(subject: Column, body: Column, shape: str) -> Column:
    if shape == "subject":
        return F.coalesce(subject, F.lit(""))
    body = F.coalesce(body, F.lit(""))
    if shape == "body":
        return body
    own = (lambda x: (X.quote_depth(x) == 0) & ~X.is_attribution(x)) if shape == "new" else (lambda x: X.quote_depth(x) > 0)
    return F.array_join(F.filter(X.lines(body), own), "\n")


def _shaped(subject: str | None, body: str | None, shape: str) -> str:
    """``shaped`` of one row, for the SQL function."""
    if shape in ("subject", "body"):
        return (subject if shape == "subject" else body) or ""
    lines, deep = (body or "").splitlines(), lambda x: X._depth(x) > 0
    return "\n".join(x for x in lines if (deep(x) if shape == "quoted" else not deep(x) and not any(re.search(p, x.strip()) for p in X.ATTRIBUTION)))


class Registry:
    def __init__(self, *detectors: Detector):
        self.detectors: dict[str, Detector] = {}
        for d in detectors:
            self.add(d)

    def add(self, detector: Detector) -> None:
        if detector.name in self.detectors:
            raise ValueError(f"{detector.name} is there already")
        self.detectors[detector.name] = detector

    def matches(self, subject: Column, body: Column) -> dict[str, Column]:
        """Conditions by name, for ``detectors.matched``."""
        return {d.name: S.matches(shaped(subject, body, d.shape), d.pattern) for d in self.detectors.values()}

    def detect(self, messages: DataFrame) -> DataFrame:
        """(id, ROW): each detector's answer for each message (id, subject, body); shapes are made once a message, all in the JVM."""
        used = sorted({d.shape for d in self.detectors.values()})
        rows = messages.select("id", *[shaped(F.col("subject"), F.col("body"), s).alias(f"as_{s}") for s in used])
        answers = []
        for d in self.detectors.values():
            text, pattern = F.col(f"as_{d.shape}"), "(?i)" + d.pattern
            n = F.regexp_count(text, F.lit(pattern))
            answers.append(F.struct(F.lit(d.name).alias("detector"), (n > 0).alias("matched"), F.least(n / F.lit(float(d.full)), F.lit(1.0)).alias("score"), F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")).alias("evidence")))
        return rows.select("id", F.inline(F.array(*answers)))

    def install(self, spark: SparkSession, name: str = "detect") -> None:
        """A table function ``name(subject, body)`` of this registry's detectors as they are now."""
        known = tuple((d.name, re.compile(d.pattern, re.I), d.shape, d.full) for d in self.detectors.values())

        @udtf(returnType=ROW)
        class Detect:
            def eval(self, subject: str, body: str) -> Iterator[tuple]:
                shapes = {s: _shaped(subject, body, s) for s in {k[2] for k in known}}
                for own, pattern, shape, full in known:
                    found = [m.group(0) for m in pattern.finditer(shapes[shape])]
                    yield own, bool(found), min(len(found) / full, 1.0), found[0] if found else None

        spark.udtf.register(name, Detect)


BUILT_IN = Registry(
    Detector("vendor_status_update", r"\b(on track|shipped|delivered|percent complete|status update|in progress)\b"),
    Detector("stop_work_implication", r"\b(stop(ped)? work|on hold|halted|suspended|until further notice|stand(ing)? down)\b"),
    Detector("blame_displacement", r"\b(their (fault|delay|failure)|not our (fault|doing)|waiting (on|for) them|should have told us)\b"),
    Detector("risk_escalation_language", r"\b(urgent(ly)?|critical|severe(ly)?|alarming|unacceptable|at once|grave)\b", full=4),
    Detector("vote", S.VOTE, "subject", 1),
    Detector("quoted_version", S.VERSION_XYZ, "quoted"),
)
