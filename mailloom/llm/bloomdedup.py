"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass 1 sets the bits of every row's hash in a segmented Bloom filter and keeps
the bits that at least two rows set. Pass 2 tests each row: only a row whose
bits were all set twice can have an equal, and only such rows are shuffled; all
others go straight to the result.

The filter is a table of 4 KB segments that grows with the rows, so that unique rows
pass it at any size. It is broadcast, ``max_segments`` (64 MB) at a time: pass 2
works through ranges of hashes, one for each 33 million rows, and the rows of a range
meet its segments only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.staging import hot_lookup, stage

SEGMENT_BITS = 32768
PROBES = 2


def _positions(text: Column) -> list[Column]:
    h = F.xxhash64(F.lit(0x5EED), text)
    return [F.shiftrightunsigned(h, 15 * i).bitwiseAND(SEGMENT_BITS - 1).cast("int") for i in range(PROBES)]


def _bit_is_set(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)).cast("int") % 2 == 1


def repeated_bits(hashed: DataFrame, segments: int) -> DataFrame:
    """(segment, bits): the bits that two rows or more have set. Copies are counted before the shuffle."""
    each = hashed.select(F.explode(F.array(*[F.col("__seg") * SEGMENT_BITS + F.col(f"__p{i}") for i in range(PROBES)])).alias("bit"))
    twice = each.groupBy("bit").count().where("count >= 2")
    return twice.groupBy(F.floor(F.col("bit") / SEGMENT_BITS).cast("long").alias("__fseg")).agg(
        F.bitmap_construct_agg((F.col("bit") % SEGMENT_BITS).cast("long")).alias("__bits")
    )


RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def annotate_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, **options: int) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest id stays; a null id is smaller than any other. Of repeated
    rows (same id and text) one stays, and ``group_size`` counts them all. An
    empty table gives an empty result. A text of any length is hashed as it is and
    is not moved, unless it is in ``carry``. ``carry`` names the columns to return
    (default all); columns of ``docs`` named like a result column are replaced, others may have any name.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    whole = docs.select(F.struct(*carry).alias("__doc") if carry else F.lit(None).alias("__doc"), F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__doc_text"))
    return _annotated(whole, "__doc_id", "__doc_text", ["__doc"], **options).select(*[F.col("__doc")[c].alias(c) for c in carry], *RESULT)


def _annotated(docs: DataFrame, id_col: str, text_col: str, carry: list[str], bits_per_row: int = 16, max_segments: int = 16384) -> DataFrame:
    """``annotate_duplicates`` of columns with names of its own."""
    rows = docs.count()
    segments = max(1, -(-rows * bits_per_row // SEGMENT_BITS))
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = [F.pmod(F.xxhash64(text), F.lit(segments)).alias("__seg"), *[p.alias(f"__p{i}") for i, p in enumerate(_positions(text))]]
    bits = stage(repeated_bits(docs.select(*named), segments), "bloom")
    hashed = docs.select(*[F.col(c) for c in carry], F.col(id_col).alias("__id"), text.alias("__text"), *named)
    tested = None
    for first in range(0, segments, max_segments):
        one = lambda c: F.col(c).between(first, first + max_segments - 1)  # noqa: B023, E731
        some = hashed if segments <= max_segments else hashed.where(one("__seg"))
        some = some.join(F.broadcast(bits.where(one("__fseg"))), F.col("__seg") == F.col("__fseg"), "left")
        tested = some if tested is None else tested.unionByName(some)
    twice = F.col("__bits").isNotNull()
    for i in range(PROBES):
        twice = twice & _bit_is_set(F.col("__bits"), F.col(f"__p{i}"))
    sha = F.sha2(F.col("__text"), 256).alias("text_sha256")
    tested = tested.withColumn("__twice", F.coalesce(twice, F.lit(False)))
    alone = tested.where(~F.col("__twice")).select(
        *carry, F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha
    )
    suspects = stage(tested.where("__twice").select(*carry, "__id", sha, F.monotonically_increasing_id().alias("__row")), "suspects")
    groups = suspects.groupBy("text_sha256").agg(F.count("*").alias("group_size"), F.max(F.struct("__id", "__row")).alias("__keep"))
    groups = stage(groups.where("group_size > 1"), "groups")
    found = hot_lookup(suspects, groups, "text_sha256", "group_size", max(rows, 1)).select(
        *carry,
        F.when(F.col("__keep").isNull(), F.col("__id")).otherwise(F.col("__keep.__id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("__keep").isNull() | (F.col("__keep.__row") == F.col("__row"))).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(found)


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged, whatever their names."""
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(id_col).alias("__doc_id"), F.col(text_col).alias("__doc_text"))
    return _annotated(whole, "__doc_id", "__doc_text", ["__doc"]).where("kept").select("__doc.*")
