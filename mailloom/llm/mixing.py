"""Mixing sources to target weights by blocks, in DataFrame operations only.

The words of a source, document after document in a seeded order, form one
stream that is packed into blocks of a fixed length. The mix is a number of
output shards; each has slots, and a slot holds one block. For each shard the
number of slots per source is drawn multinomially (every slot of a source falls
into a shard by a seeded hash, so a source's counts over the shards are
multinomial and its total is the one its target asks for). Slots then walk
through pseudorandom permutations of their source's block numbers, a new one for
each pass, and are joined with the blocks by (source, block number).

No operation needs all rows of a source together: streams are laid out by a
two-level prefix sum, slots are generated in runs, and the join key is a block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 16
RUN = 4096


def targets(sizes: DataFrame, cap: float = 3.0, share: float = 1.0) -> DataFrame:
    """(source, source_size, source_no, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. The words of the
    mix (``share`` of all) are dealt by weight; a source stops at ``cap`` times
    its size and the excess is dealt again until none is above. That fixed point
    is a water level, found in one ordered scan of the sources (one row each).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("__ratio", "source_no")
    everything = Window.partitionBy()
    s = sizes.withColumn("source_no", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("__w", (F.pmod(F.col("source_no") - 1, F.lit(3)) + 1).cast("double")).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    s = s.withColumn("__ratio", F.col("__cap") / F.col("__w")).withColumn("__total", F.sum("source_size").over(everything) * F.lit(float(share)))
    before = F.coalesce(F.sum("__cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("__level", (F.col("__total") - before) / F.sum("__w").over(level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("__water", F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "source_no", "__level"))).over(everything)["__level"])
    return s.select("source", "source_size", "source_no", F.least("__cap", F.coalesce(F.col("__w") * F.col("__water"), F.col("__cap"))).alias("target"))


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not shuffle: a keyed permutation of 0..n-1, at every n, of a fixed number of rounds."""

    def step(acc: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), n) - acc, n)
        swap = F.xxhash64(*key, r, F.greatest(acc, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, step)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = 64, shard_slots: int = 65536, seed: int = 17):
    """Returns (rows, plan, pieces).

    ``rows``: one row per row of ``docs`` with ``__row``, id, source, size, source_no.
    ``plan``: sources with target, block_len, n_blocks, full passes and slots.
    ``pieces``: the mix: (shard, slot, pass, source_no, block, __row, id,
    start_word, n_words), the spans of words that each slot takes.

    A null text has size 0 and is never taken; null is a source of its own, the
    last. Documents without words get a row and no piece. Repeated rows count
    each. Documents that tie in their seeded hash lie by id, then by size. Texts are
    counted whole and never moved, so a long one is one number. Other columns of
    ``docs`` are not looked at. An empty table gives empty results.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"), F.monotonically_increasing_id().alias("__row")), "sized")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("block_len", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("source_size") / 256))).cast("long"))
    plan = plan.withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_len")).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes)
    rest = F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")) * F.col("n_blocks") / F.greatest(F.lit(1), F.col("source_size"))
    plan = stage(plan.withColumn("slots", F.col("passes") * F.col("n_blocks") + F.floor(rest + 0.5).cast("long")), "plan")

    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_slots))
    tasks = max(1, min(20_000, math.ceil(total / (16 * RUN))))  # a run is one small row until it is exploded, so its bytes say nothing
    n_docs = sized.count()
    buckets = max(1, int(math.sqrt(n_docs)))
    rows = sized.join(plan.select(F.col("source").alias("__source"), "source_no", "source_size", "block_len", "target"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")

    # the stream of each source: offsets of buckets, then of documents in a bucket
    placed = rows.where("size > 0").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(buckets)))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).withColumn("head", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words")
    inside = Window.partitionBy("source_no", "bucket").orderBy("id", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(heads, ["source_no", "bucket"]).withColumn("start", F.col("start") + F.col("head"))
    blocks = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block_len")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block_len")))))
    first = F.greatest(F.col("start"), F.col("block") * F.col("block_len"))
    last = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_len"))
    blocks = blocks.select("source_no", "block", "__row", "id", (first - F.col("start")).alias("start_word"), (last - first).alias("n_words"))

    # multinomial counts of each source in each shard
    runs = plan.where("slots > 0").select("source_no", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN))).alias("run")).repartition(tasks, "source_no", "run")
    thrown = runs.select("source_no", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("slots"), (F.col("run") + 1) * RUN) - 1)).alias("j"))
    draws = thrown.groupBy("source_no", F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "source_no", "j"), F.lit(shards)).alias("shard")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    draws = draws.withColumn("from", F.coalesce(F.sum("n").over(earlier), F.lit(0)))

    # slots walk through the permutations and meet their blocks
    spread = draws.select("source_no", "shard", "n", "from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))).alias("run")).repartition(tasks, "source_no", "shard", "run")
    slots = spread.select("source_no", "shard", F.explode(F.sequence(F.col("from") + F.col("run") * RUN, F.col("from") + F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)).alias("slot"))
    slots = slots.join(F.broadcast(plan.select("source_no", "n_blocks")) if plan.count() <= 100_000 else plan.select("source_no", "n_blocks"), "source_no")
    slots = slots.withColumn("pass", F.floor(F.col("slot") / F.col("n_blocks"))).withColumn("x", F.pmod("slot", "n_blocks"))
    # coalesce: a number that may be null would be worked out once more, in a filter ahead of the join
    at = F.coalesce(permuted(F.col("x"), F.col("n_blocks"), F.lit(seed), F.col("source_no"), F.col("pass")), F.lit(0).cast("long"))
    slots = slots.withColumn("block", at).select("source_no", "shard", "slot", "pass", "block")
    # merge: slots are made from the plan's few bytes, so Spark would take them for a table to broadcast
    pieces = slots.hint("merge").join(blocks, ["source_no", "block"])
    return rows, plan, pieces


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words of the mix, repeats counted) and ``__row``."""
    rows, _, pieces = mix(docs, **options)
    taken = pieces.groupBy("__row").agg(F.sum("n_words").alias("taken"))
    return rows.join(taken, "__row", "left").select("__row", "id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", seed: int = 17, **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, columns unchanged.

    ``taken / size`` is rounded up or down by a seeded hash of the id, so that
    the expected number of copies is the mix's. A document without words stays once.
    Rows that share an id share its mean.
    """
    counts = taken_words(docs, id_col=id_col, seed=seed, **options)
    times = counts.groupBy("id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("__x"))
    unit = F.pmod(F.xxhash64(F.lit(seed), F.lit("copies"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("__x").isNull(), F.lit(1)).otherwise(F.floor(F.col("__x") + F.col("unit"))).cast("int")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("own"), unit.alias("unit"))  # one struct, so that no name can clash
    joined = whole.join(times, F.col("own").eqNullSafe(F.col("id")), "left").withColumn("copies", copies)
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
