"""What became of concerns: acknowledged, on the formal record, reversed, heard by those who decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators.graph import first_answers


def concern_trails(messages: DataFrame, raised: Column, acknowledges: Column, formal: Column, reverses: Column, flags: Column, decides: Column) -> DataFrame:
    """One row for each id of messages (id, parent, ...) that raise a concern: what the replies below them do.

    ``acknowledged_after``: steps to the nearest reply that takes it up (null: ignored). ``in_formal_record``: a formal
    reply does. ``reversals`` and ``unflagged``: first replies of a branch that turn it round, and those of them that do
    not say so. ``reaches_decider``: one who decides writes below it. Conditions are on message columns; null is no.
    Repeated rows of a message count each; those without an id are left out.
    """
    no = lambda c: F.coalesce(c, F.lit(False))
    told = {"raised": raised, "ack": acknowledges, "formal": formal, "turn": reverses, "flag": flags, "decider": decides}
    nodes = messages.select(F.col("id").alias("node"), "parent", *[no(c).alias(k) for k, c in told.items()]).where("node is not null")
    starts = nodes.where("raised")
    ways = {"ack": F.col("ack"), "formal": F.col("formal") & F.col("ack"), "turn": F.col("turn"), "decider": F.col("decider")}
    edges = nodes.where("parent is not null").select(F.col("parent").alias("src"), F.col("node").alias("dst")).distinct()
    found = first_answers(starts, edges, nodes, ways).join(nodes.select("node", "flag"), "node")
    k = F.col("kind")
    trails = found.groupBy(F.col("start").alias("node")).agg(
        F.min(F.when(k == "ack", F.col("distance"))).alias("acknowledged_after"), F.max(k == "formal").alias("in_formal_record"), F.count_if(k == "turn").alias("reversals"),
        F.count_if((k == "turn") & ~F.col("flag")).alias("unflagged"), F.max(k == "decider").alias("reaches_decider"),
    )
    zero, out = F.lit(0).cast("long"), starts.select("node").distinct().join(trails, "node", "left")
    return out.select(F.col("node").alias("id"), "acknowledged_after", no(F.col("in_formal_record")).alias("in_formal_record"), F.coalesce("reversals", zero).alias("reversals"), F.coalesce("unflagged", zero).alias("unflagged"), no(F.col("reaches_decider")).alias("reaches_decider"))
