"""Connected components of a link table, by contraction rounds of Spark jobs.

In each round every node joins its neighbour of least hashed rank, and links are
rewritten between the nodes that are left; a constant share of nodes goes in
each round on average, whatever the shape of the graph. Nothing is collected, and
nodes with very many links are looked up apart from the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.staging import drop_staged, hot_lookup, stage

SMALL = 200_000


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table of unique numbers as keys: broadcast if it has at most ``SMALL`` rows (10 MB), else apart for hot keys.

    For the latter ``rows`` are read three times, so they are staged: else the plans of lookups on lookups treble each time.
    """
    if table.count() <= SMALL:
        return rows.join(F.broadcast(table), key, "left")
    rows = rows if hasattr(rows, "staged_at") else stage(rows, "looked-up")
    weights = rows.groupBy(key).agg(F.count("*").alias("__weight"))
    out = hot_lookup(rows, table.join(weights, key), key, "__weight", max(1, rows.count()))
    return out.drop("__weight")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Links may repeat, come in either order, or join a node to itself; links with a null end are ignored.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps: list[DataFrame] = []
    while total := edges.count():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(maps)), F.col(c)).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("best"), F.count("*").alias("degree"))
        joined = stage(best.select(F.col("a").alias("node"), F.least("best", rank("a"))["n"].alias("rep"), "degree"), "contracted")
        maps.append(joined.select("node", "rep"))
        left = hot_lookup(edges, joined.select(F.col("node").alias("a"), F.col("rep").alias("ra"), "degree"), "a", "degree", total).drop("degree")
        right = hot_lookup(left, joined.select(F.col("node").alias("b"), F.col("rep").alias("rb"), "degree"), "b", "degree", total)
        fewer = right.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        following = stage(fewer, "links")
        drop_staged(edges)
        edges = following
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[0]
    for later in maps[1:]:
        found = lookup(out, later.select(F.col("node").alias("rep"), F.col("rep").alias("next")), "rep")
        out = found.select("node", F.coalesce("next", "rep").alias("rep"))
    out = stage(out, "reps") if len(maps) > 1 else out
    least = out.groupBy("rep").agg(F.min("node").alias("component"))
    return lookup(out, least, "rep").select("node", "component")
