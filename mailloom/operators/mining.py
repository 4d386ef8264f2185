"""What goes together: combinations of signals against an outcome, and clusters of rows that no detector matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators.rounds import written


def chi_square(n11: Column, n10: Column, n01: Column, n00: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (n11, n10, n01, n00))
    return F.try_divide((a + b + c + d) * (a * d - b * c) * (a * d - b * c), (a + b) * (c + d) * (a + c) * (b + d))


def signal_combinations(rows: DataFrame, signals: Column, outcome: Column, least: int, most: int = 3) -> DataFrame:
    """(signals, n11, n10, n01, n00, chi2) of each set of up to ``most`` signals that ``least`` rows or more have together.

    Rows with the same signals and outcome are one weighted row from the start. Level by level, a set is
    extended by a signal behind its last; a set goes if one of its parts is not frequent, before it is counted.
    ``signals`` is an array of strings (nulls and repeats do not count); a null outcome is false.
    """
    sets = rows.select(F.array_sort(F.array_distinct(F.array_compact(signals))).alias("all"), F.coalesce(outcome, F.lit(False)).alias("yes"))
    sets = written(sets.groupBy("all", "yes").agg(F.count("*").alias("w")), "signal-sets")
    totals = sets.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("yes"), F.col("w"))), F.lit(0)).alias("n_yes"))
    now = sets.select(F.array().cast("array<string>").alias("set"), F.col("all").alias("rest"), "yes", "w")
    out, frequent = None, None
    for level in range(1, most + 1):
        each = F.transform("rest", lambda x, i: F.struct(F.concat("set", F.array(x)).alias("set"), F.slice("rest", i + 2, F.size("rest")).alias("rest")))
        now = now.select(F.inline(each), "yes", "w")
        for i in range(level - 1 if level > 1 else 0):  # the part without its last signal was frequent already
            part = F.concat(F.slice("set", 1, i), F.slice("set", i + 2, level))
            now = now.withColumn("part", part).join(frequent.select(F.col("set").alias("part")), "part", "left_semi").drop("part")
        counts = now.groupBy("set").agg(F.sum("w").alias("m"), F.coalesce(F.sum(F.when(F.col("yes"), F.col("w"))), F.lit(0)).alias("n11")).where(F.col("m") >= least)
        frequent = written(counts, "frequent-sets")
        out = frequent if out is None else out.unionByName(frequent)
        now = written(now.join(frequent.select("set"), "set", "left_semi"), "signal-rows")
    cells = out.crossJoin(F.broadcast(totals)).select(  # one row
        F.array_join("set", " & ").alias("signals"), "n11", (F.col("m") - F.col("n11")).alias("n10"), (F.col("n_yes") - F.col("n11")).alias("n01"), (F.col("n") - F.col("m") - F.col("n_yes") + F.col("n11")).alias("n00")
    )
    return cells.withColumn("chi2", chi_square(*[F.col(c) for c in ("n11", "n10", "n01", "n00")]))


def clusters(rows: DataFrame, id_col: str, features: list[str], k: int, rounds: int) -> DataFrame:
    """(id, cluster, ``features``): ``rounds`` of Lloyd's algorithm over whole-number features, seeds and ties fixed.

    Seeds are the ``k`` rows of least md5 of the id. Each round is one aggregation; its ``k`` centres are all that
    reaches the driver. A row goes to the nearest centre, of equally near ones the first; a centre without rows stays.
    Null features count as 0. With fewer than ``k`` rows each is a seed.
    """
    id_ = F.col(id_col).alias("id")
    own = written(rows.select(id_, *[F.coalesce(F.col(f).cast("long"), F.lit(0)).alias(f) for f in features]), "cluster-rows")
    seeds = own.orderBy(F.md5(F.col("id").cast("string")), "id").limit(k).collect()
    centres = [[float(s[f]) for f in features] for s in seeds]

    def nearest() -> Column:
        away = [sum(((F.col(f) - F.lit(x)) * (F.col(f) - F.lit(x)) for f, x in zip(features, c, strict=True)), F.lit(0.0)) for c in centres]
        return F.array_min(F.array(*[F.struct(a.alias("d"), F.lit(i).alias("i")) for i, a in enumerate(away)]))["i"]

    for _ in range(rounds if centres else 0):
        sums = own.groupBy(nearest().alias("i")).agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in features]).collect()
        for s in sums:
            centres[s["i"]] = [s[f] / s["n"] for f in features]
    return own.select("id", (nearest() if centres else F.lit(None).cast("int")).alias("cluster"), *features)
