"""Dependency graphs: longest paths, and the first answer below each of some nodes. Edges are (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators.rounds import new_path, written


def longest_paths(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(node, length): how many nodes the longest path has that starts at each node of an acyclic graph.

    Round r has the nodes with a path of r + 1 nodes: the sources of edges into the round before. Rounds
    only shrink and are appended to one table; there are as many as the longest path has nodes, and
    over ``most`` (as in a graph with a cycle) is an error. Null ends are no nodes; repeated edges count once.
    """
    spark, kind = edges.sparkSession, f"node {dict(edges.dtypes)['src']}"
    path = new_path(spark, "path-rounds")
    left = written(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().write.parquet(f"{path}/round=0")
    for r in range(1, most + 1):
        before = spark.read.schema(kind).parquet(f"{path}/round={r - 1}")
        left = written(left.join(before.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges", left)
        left.select(F.col("src").alias("node")).distinct().write.parquet(f"{path}/round={r}")
        if left.isEmpty():
            return spark.read.schema(f"{kind}, round int").parquet(path).groupBy("node").agg((F.max("round") + 1).cast("long").alias("length"))
    raise ValueError(f"a path of over {most} nodes, or a cycle")


def first_answers(starts: DataFrame, edges: DataFrame, nodes: DataFrame, answers: dict[str, Column], most: int = 1000) -> DataFrame:
    """(start, kind, node, distance): below each row of ``starts``, which are rows of ``nodes``, the first nodes on each branch that answer it in each way.

    ``edges`` lead from a node to its replies; ``answers`` are conditions on the columns of ``nodes`` (node, ...),
    and on the start's as ``start_...``. A branch is followed until it is answered in all ways, one round
    for each step away, so that no table of all pairs of a thread is made. What has no answer has no row.
    Repeated rows of ``starts`` and ``nodes`` count each.
    """
    path = new_path(edges.sparkSession, "answers")
    known = starts.select(*[F.col(c).alias(f"start_{c}") for c in nodes.columns])
    kept = [*known.columns, "todo"]
    open_ = written(known.withColumns({"todo": F.array(*[F.lit(k) for k in answers]), "node": F.col("start_node")}), "branches")
    given = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in answers.items()]), lambda k: k.isNotNull())
    for r in range(1, most + 1):
        step = open_.where(F.size("todo") > 0).select(*kept, F.col("node").alias("src")).join(edges.select("src", "dst"), "src")
        step = step.select(*kept, F.col("dst").alias("node")).join(nodes, "node").withColumn("now", F.array_intersect("todo", given))
        step = step.select(*known.columns, F.array_except("todo", "now").alias("todo"), "node", "now")
        open_ = written(step, "branches", open_)
        open_.select(F.col("start_node").alias("start"), F.explode("now").alias("kind"), "node", F.lit(r).cast("long").alias("distance")).write.mode("append").parquet(path)
        if open_.where(F.size("todo") > 0).isEmpty():
            return edges.sparkSession.read.parquet(path)
    raise ValueError(f"a branch of over {most} nodes, or a cycle")
