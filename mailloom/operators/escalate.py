"""Cost-tier escalation: cheap predictions, pools of items worth a second look, frontier predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import subjects as S
from mailloom.operators.evaluate import confusion, precision_recall


def pools(subject: Column, body: Column) -> dict[str, Column]:
    """Membership of a cheap-negative item in each pool."""
    vote, proposal = S.matches(subject, S.VOTE), S.matches(subject, S.PROPOSAL_START)
    return {
        "P0": F.lit(False),
        "P1": body.rlike(S.VERSION_XYZ) & S.matches(body, S.RELEASE_WORDS) & ~S.is_literal_vote(subject),
        "P2": (vote | proposal) & (S.is_root(subject) | (F.length(body) > 800)),
        "P3": vote | proposal,
        "P_full": F.lit(True),
    }


def is_borderline(subject: Column) -> Column:
    """Borderline by subject alone."""
    out = F.lit(False)
    for pattern in (S.VOTE, S.DISCUSS, S.THINKING_AHEAD, S.LOGISTICS, S.PROPOSAL_ANYWHERE):
        out = out | S.matches(subject, pattern)
    return out


def combine(cheap: DataFrame, frontier: DataFrame, members: DataFrame, names: list[str], only_negative: bool = True) -> DataFrame:
    """Cheap predictions, replaced by the frontier's for ``members`` (pool, id); one row per pool of ``names`` and id.

    ``only_negative``: escalate cheap negatives only, else any member that the frontier has.
    """
    front = frontier.select("id", F.col("prediction").alias("front"))
    base = cheap.select("id", F.col("prediction").alias("cheap")).join(front, "id", "left")
    base = base.withColumn("pool", F.explode(F.array(*[F.lit(n) for n in names])))
    joined = base.join(members.select("pool", "id", F.lit(True).alias("member")), ["pool", "id"], "left")
    up = F.coalesce("member", F.lit(False)) & F.col("front").isNotNull()
    up = up & ~F.col("cheap") if only_negative else up
    return joined.select("pool", "id", F.when(up, F.col("front")).otherwise(F.col("cheap")).alias("prediction"), up.alias("escalated"))


def pool_sweep(cheap: DataFrame, frontier: DataFrame, corpus: DataFrame, labels: DataFrame) -> DataFrame:
    """Each pool's size, share of calls and scores. ``corpus``: id (unique), subject, body.

    An id is one row with a flag for each pool, made where its mail is read: no body is moved, tables meet
    once on the id, and one aggregation counts for all pools. A null subject or body is empty; an id without a mail
    is in ``P_full`` only.
    """
    flags = pools(*[F.coalesce(c, F.lit("")) for c in ("subject", "body")])
    inside = corpus.select("id", *[v.alias(f"in_{k}") for k, v in flags.items()])
    rated = labels.groupBy("id").agg(F.count_if(F.col("label") == "positive").alias("pos"), F.count_if(F.col("label") == "negative").alias("neg"))
    rows = cheap.select("id", F.col("prediction").alias("cheap")).join(frontier.select("id", F.col("prediction").alias("front")), "id", "left")
    rows = rows.join(inside, "id", "left").join(rated, "id", "left")
    counts, each = [F.count("*").alias("corpus_size")], []
    for k in flags:
        member = ~F.col("cheap") & (F.lit(True) if k == "P_full" else F.coalesce(f"in_{k}", F.lit(False)))
        said = F.when(member & F.col("front").isNotNull(), F.col("front")).otherwise(F.col("cheap"))
        counts.append(F.count_if(member).alias(f"{k}_size"))
        for cell, when, what in (("tp", said, "pos"), ("fp", said, "neg"), ("fn", ~said, "pos"), ("tn", ~said, "neg")):
            counts.append(F.coalesce(F.sum(F.when(when, F.col(what))), F.lit(0)).alias(f"{k}_{cell}"))
        each.append(F.struct(F.lit(k).alias("pool"), F.col(f"{k}_size").alias("pool_size"), "corpus_size", *[F.col(f"{k}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")]))
    cells = rows.agg(*counts).select(F.inline(F.array(*each)))
    return precision_recall(cells).withColumn("pct_calls", F.try_divide(F.col("pool_size") * 100.0, "corpus_size"))


def pool_overlap(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Size of the pool, and how many of it are labelled, positive and negative."""
    joined = members.select("id").distinct().join(labels.select("id", "label"), "id", "left")
    return joined.agg(F.countDistinct("id").alias("pool_size"), F.count("label").alias("labeled"), F.count_if(F.col("label") == "positive").alias("positive"), F.count_if(F.col("label") == "negative").alias("negative"))


def three_scores(cheap: DataFrame, frontier: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of the cheap tier, the frontier tier and the two combined over one pool, any member that the frontier has escalated."""
    both = combine(cheap, frontier, members.select(F.lit("combined").alias("tier"), "id").withColumnRenamed("tier", "pool"), ["combined"], only_negative=False)
    tiers = cheap.select(F.lit("cheap").alias("tier"), "id", "prediction").unionByName(frontier.select(F.lit("frontier").alias("tier"), "id", "prediction"))
    return precision_recall(confusion(tiers.unionByName(both.select(F.col("pool").alias("tier"), "id", "prediction")), labels, ["tier"]))


def judged_pools(sweep: DataFrame, least_f1: float = 0.90, within: float = 0.05) -> DataFrame:
    """``sweep`` with ``good`` (its f1 is high enough) and ``close`` (it is near enough to that of escalating everything)."""
    full = sweep.where("pool = 'P_full'").select(F.col("f1").alias("__full"))
    judged = sweep.crossJoin(F.broadcast(full))  # one row
    return judged.withColumns({"good": F.col("f1") >= least_f1, "close": F.col("f1") >= F.col("__full") - within}).drop("__full")


def smallest_good_pool(sweep: DataFrame, least_f1: float = 0.90, within: float = 0.05) -> DataFrame:
    """The smallest pool that is good and close; no row where escalation does not pay off."""
    return judged_pools(sweep, least_f1, within).where("good and close").drop("good", "close").orderBy("pool_size", "pool").limit(1)


def moved(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, kind, label) of the positives gained (new) and lost."""
    j = before.select("id", F.col("prediction").alias("a")).join(after.select("id", F.col("prediction").alias("b")), "id").where("a <> b")
    return j.join(labels.select("id", "label"), "id", "left").select("id", F.when(F.col("b"), "new").otherwise("lost").alias("kind"), "label")


def movement(before: DataFrame, after: DataFrame, labels: DataFrame) -> DataFrame:
    """Positives gained and lost, and how many of them are labelled."""
    return moved(before, after, labels).groupBy("kind").agg(F.count("*").alias("total"), F.count("label").alias("labeled"), F.count_if(F.col("label").isNull()).alias("unlabeled"))
