"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows by seeded hashes into buckets that fit in memory: the shard
is the one of highest random weight for the id, and a second hash picks one of
the shard's buckets. Pass 2 sorts each bucket by id, shuffles it by Fisher-Yates
with a generator seeded by the bucket, and numbers it from the bucket's first slot.
The order of a shard is thus a uniform permutation of its rows, and rerunning or
losing an executor gives the same one.

Equal texts are not kept together: under the law of the id a row's shard follows from
its id and the number of shards alone, so the rows of a group of equal texts are dealt
one by one and spread over shards and slots like any others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.llm.staging import stage


def shard_of(id_col: str, shards: int, seed: int) -> Column:
    """The shard of highest random weight: the id and the count decide; one more shard takes rows only into itself."""
    weight = F.array(*[F.struct(F.xxhash64(F.lit(seed), F.lit(k), F.col(id_col)), F.lit(k)) for k in range(shards)])
    return F.array_max(weight)["col2"]


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of 0..n-1, by swaps from the end."""
    order = list(range(n))
    draws = np.random.default_rng(seed).integers(0, np.arange(1, n + 1))
    for i in range(n - 1, 0, -1):
        j = int(draws[i])
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def external_shuffle(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 8 << 20, seed: int = 29) -> DataFrame:
    """All columns of ``docs`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot`` (gapless from 0 in each shard).

    A null id is an id like another; rows of one id share its shard, not its
    bucket. A null text counts as empty. Identical rows may swap slots between
    runs. A single row larger than ``bucket_bytes`` makes a larger bucket. An
    empty table gives an empty result. Columns named like a result are replaced, others may have any name.
    """
    names = [c for c in docs.columns if c not in ("shard", "grown_shard", "slot")]
    payload = [f"c{i}" for i in range(len(names))]  # names of its own inside, so that none can clash
    docs = docs.select(*[F.col(c).alias(p) for c, p in zip(names, payload, strict=True)])
    id_col, text_col = payload[names.index(id_col)], payload[names.index(text_col)]
    sized = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64
    total = docs.agg(F.coalesce(F.sum(sized), F.lit(0))).first()[0]
    per_shard = max(1, -(-total // (shards * bucket_bytes)))
    marked = docs.select(
        *payload,
        shard_of(id_col, shards, seed).cast("int").alias("shard"),
        shard_of(id_col, shards + 1, seed).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), F.col(id_col), F.col(text_col)), F.lit(per_shard)).cast("int").alias("__bucket"),
    )
    sizes = marked.groupBy("shard", "__bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(sizes.withColumn("__start", F.coalesce(F.sum("n").over(ahead), F.lit(0)).cast("long")).drop("n"), "starts")
    schema = T.StructType([*marked.drop("__bucket").schema.fields, T.StructField("__pos", T.LongType()), T.StructField("__b", T.IntegerType())])

    def shuffle(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, bucket = int(pdf["shard"].iloc[0]), int(pdf["__bucket"].iloc[0])
        ranked = pdf.sort_values([id_col, text_col], kind="stable", na_position="first")
        mixed = ranked.iloc[fisher_yates(len(ranked), (seed * 1_000_003 + shard) * 1_000_003 + bucket)]
        return mixed.drop(columns="__bucket").assign(__pos=np.arange(len(mixed)), __b=bucket)[schema.names]

    mixed = marked.groupBy("shard", "__bucket").applyInPandas(shuffle, schema)
    starts = starts.select(F.col("shard").alias("__s"), F.col("__bucket").alias("__b2"), "__start")
    joined = mixed.join(F.broadcast(starts) if shards * per_shard <= 200_000 else starts, (F.col("shard") == F.col("__s")) & (F.col("__b") == F.col("__b2")))
    return joined.select(*[F.col(p).alias(c) for c, p in zip(names, payload, strict=True)], "shard", "grown_shard", (F.col("__start") + F.col("__pos")).alias("slot"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled rows as one folder per shard, each in slot order."""
    out = external_shuffle(docs, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shard(spark, path: str, shard: int) -> DataFrame:
    """One shard of ``write_shards``."""
    return spark.read.parquet(path).where(F.col("shard") == shard)


def batches(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Training batches of ``size`` rows from frames in slot order."""
    kept: list[pd.DataFrame] = []
    for frame in rows:
        kept.append(frame)
        joined = pd.concat(kept, ignore_index=True)
        while len(joined) >= size:
            yield joined.iloc[:size]
            joined = joined.iloc[size:]
        kept = [joined]
    if kept and len(kept[0]):
        yield kept[0]
