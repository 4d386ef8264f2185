"""Filter interaction audit on the lattice of subsets of filters.

A state is the set of filters applied so far; an edge adds one filter to a state. How
many documents an edge removes depends on the state only, not on the order that led to
it. Forward counts say how many orders reach a state from the empty one, backward counts how
many leave it to the full one; an edge lies on forward(from) * backward(to) orders. Shapley sums
are the edges' removals weighted by that, and each step of each order is one of the edges.

Documents are read once, as counts by part and set of failed filters; what follows
works on at most 2**n counts a part.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.staging import hot_lookup, mark, settled, stage

MOST = 8  # filters; there are n! orders of n steps


class Lattice:
    """Edges (state, filter) of ``n`` filters with their number of orders; ``before`` has pairs (a, b) of which a must come first."""

    def __init__(self, n: int, before: tuple[tuple[int, int], ...] = ()):
        if not 1 <= n <= MOST:
            raise ValueError(f"1 to {MOST} filters")
        needs = [sum(1 << a for a, b in before if b == f) for f in range(n)]
        self.full = (1 << n) - 1
        self.edges = [(s, f) for s in range(self.full + 1) for f in range(n) if not s >> f & 1 and s & needs[f] == needs[f]]
        self.forward, self.backward = [1] + [0] * self.full, [0] * self.full + [1]
        for s, f in self.edges:  # states rise along an edge
            self.forward[s | 1 << f] += self.forward[s]
        for s, f in reversed(self.edges):
            self.backward[s] += self.backward[s | 1 << f]
        if not self.backward[0]:
            raise ValueError("no order meets these constraints")
        self.edges = [(s, f) for s, f in self.edges if self.orders_through(s, f)]

    def orders_through(self, state: int, added: int) -> int:
        return self.forward[state] * self.backward[state | 1 << added]

    def orders(self, state: int = 0) -> Iterator[tuple[int, ...]]:
        """Every order of filters from a state to the full one, along the edges."""
        if state == self.full:
            yield ()
        for s, f in self.edges:
            if s == state:
                yield from ((f, *rest) for rest in self.orders(s | 1 << f))


def audit(rows: DataFrame, filters: dict[str, Column], part: Column, flags: dict[str, Column], weight: Column | None = None, before: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, <flag>_lost ..., shapley): every step of every order in each part.

    ``filters``: name (one letter) and the condition that a document fails by; a null
    condition is not failed. ``flags``: conditions whose documents are counted among the removed.
    ``weight`` is the number of documents that a row stands for, 1 by default. A null part is a
    part of its own. Equal rows count one by one, other columns are not looked at, and without rows there is no part.
    """
    names = list(filters)
    grid = Lattice(len(names), tuple((names.index(a), names.index(b)) for a, b in before))
    failed = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))
    weight = F.lit(1) if weight is None else weight
    counted = rows.select(part.alias("part"), failed.alias("failed"), weight.cast("long").alias("n"), *[F.when(c, weight).otherwise(0).cast("long").alias(f"flag_{k}") for k, c in flags.items()])
    counts = counted.groupBy("part", "failed").agg(F.sum("n").alias("n"), *[F.sum(f"flag_{k}").alias(f"flag_{k}") for k in flags])

    edges = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(1 << f).alias("added"), F.lit(grid.orders_through(s, f)).alias("orders")) for s, f in grid.edges])
    each = counts.select("*", F.inline(edges))
    m, s, f = F.col("failed"), F.col("state"), F.col("added")
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col(name))), F.lit(0)).cast("long")
    fails, fresh = m.bitwiseAND(f) > 0, m.bitwiseAND(s) == 0
    made = each.groupBy("part", "state", "added", "orders").agg(
        total(m.bitwiseAND(s.bitwiseOR(f)) == 0, "n").alias("kept"), total(fails & fresh, "n").alias("removed"), total(fails & ~fresh, "n").alias("redundant"),
        total(m == f, "n").alias("unique_fails"), *[total(fails & fresh, f"flag_{k}").alias(f"{k}_lost") for k in flags],
    )
    made = made.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(Window.partitionBy("part", "added")))
    steps, state = [], 0
    for order in grid.orders():
        state = 0
        for i, f_ in enumerate(order):
            steps.append(("".join(names[x] for x in order), i + 1, state, 1 << f_))
            state |= 1 << f_
    read = rows.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, added int")
    out = made.drop("orders").join(F.broadcast(read), ["state", "added"])  # n * n! rows at most, whatever the documents
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *[f"{k}_lost" for k in flags], "shapley")


def text_faults(text: Column) -> dict[str, Column]:
    """Five conditions on a text but for the last: few words, few different words, many capitals, marks of markup."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    return {"words": words, "A": F.size("words") < 200, "B": 100 * F.size(F.array_distinct("words")) < 50 * F.size("words"), "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), "D": text.rlike(r"[#$%&*|]")}


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``audit`` of filters A to E over whole texts by ``part_col``, with documents lost that are rated good or toxic.

    A: under 200 words; B: under half of the words are different; C: over 3 % of the characters are
    capitals A-Z; D: any of ``#$%&*|``; E: the text of a smaller id, whether that is removed or not.
    A null text is empty (it fails A), a null part an empty one. A row with a null id fails
    E never and makes no other fail; repeated rows of one id do not make each other fail. A document counts as good or
    toxic if any rating of its id says so.
    """
    since = mark()
    text = F.coalesce(F.col(text_col), F.lit(""))
    faults = text_faults(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text")).withColumn("words", faults.pop("words"))
    rows = stage(rows.select("id", "part", F.sha2("text", 256).alias("digest"), *[c.alias(k) for k, c in faults.items()]), "filter-faults")
    copies = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    known = hot_lookup(rows, copies, "digest", "size", max(1, rows.count()))
    known = known.withColumn("E", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))
    merged = known.groupBy("id", "part", *"ABCDE").agg(F.count("*").alias("n"))  # an id is a row for each part and set of faults at most
    rated = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    out = audit(merged.join(rated, "id", "left"), {k: F.col(k) for k in "ABCDE"}, F.col("part"), {"good": F.col("good") == 1, "toxic": F.col("toxic") == 1}, F.col("n"))
    return settled(out, "filter-audit", since)
