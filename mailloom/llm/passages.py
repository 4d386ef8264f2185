"""Benchmark decontamination: a prefix-filtered join of word shingles.

An item is cut in windows of ``window`` consecutive words (an item of fewer words is
one window). A window's shingles are ordered by rarity, by their count over all documents.
A place that contains the whole window holds each of its n shingles, so of the
n - n + 1 = 1 shingles that a prefix needs, the rarest one is joined with the documents'
shingles. The shingle's offset in the window fixes where the window would start: the
bound on position asks for enough words before and behind it in a run of shingles that
items have, the bound on length for a run that is as long as a window at all. What is
left is compared word by word.

Documents are read once. A bitmap of ``filter_bits`` bits, whose size does not depend on
any table, tells which shingles may belong to an item; only runs of such shingles are kept,
with their words. More items make the bitmap let more runs through, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.staging import mark, settled, stage, trim
from mailloom.llm.textbytes import buffers, lowered, mix64, span_hashes

# What a word is made of, and the letters that are lowered.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTER = np.ones(256, bool)
_LETTER[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_PLACE = np.random.default_rng(1729).integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SEEN = "key long, id string, n_words long, runs array<struct<width:int,start:long,text:string>>"
SPANS = "array<struct<start:long,end:long>>"


def words(text: Column) -> Column:
    """The words of a text, A-Z lowered; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), F.lit(1))


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, window, size): each item's distinct windows as words joined by blanks. A null item id is written as an empty text."""
    each = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    cut = each.select("item", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.slice("words", i, size))).alias("w"))
    return cut.select("item", F.array_join("w", " ").alias("window"), F.size("w").alias("size")).distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """(window, size, width, offset, shingle): all runs of ``shingle`` words of each distinct window; a shorter window is one."""
    width = F.least("size", F.lit(shingle))
    parts = windows.select("window", "size").distinct().withColumn("width", width).withColumn("w", F.split("window", " "))
    each = F.transform(F.sequence(F.lit(0), F.col("size") - F.col("width")), lambda i: F.struct(i.alias("offset"), F.array_join(F.slice("w", i + 1, F.col("width")), " ").alias("shingle")))
    return parts.select("window", "size", "width", F.inline(each))


def _words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts and ends of a buffer, which ends with a blank, and the number of each text's first word (one entry more)."""
    edge = np.flatnonzero(np.diff(_LETTER[data], prepend=False))
    return edge[::2], edge[1::2], np.searchsorted(edge[::2], starts)


def _joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _PLACE[0]
    for j in range(1, width):
        out = out + hashes[j : j + n] * _PLACE[j % len(_PLACE)]
    return mix64(out)


def shingle_bitmap(shingles: DataFrame, bits: int) -> np.ndarray:
    """Words of 64 bits: the bitmap of the hashes of ``shingles`` (shingle, width). At most 2**(bits - 6) rows reach the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for width, part in frame.groupby("width"):
                for _, data, starts in buffers(part["shingle"].tolist()):
                    a, b, first = _words_of(data, starts)
                    at = _joined(span_hashes(data, a, b), int(width))[first[:-1]] >> np.uint64(64 - bits)
                    yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "mask": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    marks = shingles.select("shingle", "width").distinct().mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[marks["word"].to_numpy()] = marks["mask"].to_numpy()
    return out.view(np.uint64)


def runs_of(texts: list[str | None], bitmap: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, list[list[dict]]]:
    """Words of each text, and its runs of at least ``least[width]`` shingles in a row that the bitmap lets through."""
    counts, found = np.zeros(len(texts), np.int64), [[] for _ in texts]
    shift = np.uint64(64 - (len(bitmap).bit_length() - 1 + 6))
    for at, data, starts in buffers(texts):
        data = lowered(data)
        a, b, first = _words_of(data, starts)
        counts[at : at + len(starts) - 1] = np.diff(first)
        text = np.repeat(np.arange(len(starts) - 1), np.diff(first))
        hashes = span_hashes(data, a, b) if least else a
        for width, enough in least.items():
            key = _joined(hashes, width) >> shift
            hit = (bitmap[key >> np.uint64(6)] >> (key & np.uint64(63))) & np.uint64(1) == 1
            hit &= text[: len(key)] == text[width - 1 :][: len(key)]
            place = np.flatnonzero(hit)
            edge = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(text[place], prepend=-1) != 0))
            for s, n in zip(place[edge].tolist(), np.diff(np.append(edge, len(place))).tolist(), strict=True):
                if n >= enough:
                    own = b" ".join(data[a[j] : b[j]].tobytes() for j in range(s, s + n + width - 1))
                    found[at + text[s]].append({"width": width, "start": s - int(first[text[s]]), "text": own.decode("utf-8", "surrogatepass")})
    return counts, found


def _seen(docs: DataFrame, id_col: str, text_col: str, bitmap: np.ndarray, least: dict[int, int]) -> DataFrame:
    """SEEN of every row of ``docs``; ``key`` numbers the rows, for good once the table is written."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = 0
        for frame in frames:
            n_words, runs = runs_of(frame["text"].tolist(), shared.value, least)
            key = frame["pid"].to_numpy(np.int64) * (1 << 33) + made + np.arange(len(frame))
            made += len(frame)
            yield pd.DataFrame({"key": key, "id": frame["id"], "n_words": n_words, "runs": runs})
            trim()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("pid"))
    return rows.mapInPandas(run, SEEN)


def places(seen: DataFrame, window: int) -> DataFrame:
    """(key, shingle, place, lead, context): each shingle of the kept runs, with the words of its run that a window through it can take; ``lead`` of them stand before it."""
    runs = seen.select("key", F.explode("runs").alias("r")).select("key", "r.width", "r.start", F.split("r.text", " ").alias("w"))
    width, n = F.col("width"), F.size("w")

    def at(i: Column) -> Column:
        lead = F.least(i, F.lit(window) - width)
        return F.struct(
            F.array_join(F.slice("w", i + 1, width), " ").alias("shingle"), (F.col("start") + i).alias("place"), lead.alias("lead"),
            F.slice("w", i - lead + 1, F.least(lead + window, n - i + lead)).alias("context"),
        )

    return runs.select("key", F.inline(F.transform(F.sequence(F.lit(0), n - width), at)))


def occurrences(seen: DataFrame, shingles: DataFrame, window: int) -> DataFrame:
    """(key, start, size, window): every place of a document that contains a whole window of an item."""
    found = places(seen, window)
    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")
    prefix = shingles.join(counts, "shingle", "left").groupBy("window", "size").agg(F.min(order).alias("p")).where("p.n > 0").select("window", "size", "p.shingle", "p.offset")
    met = found.join(prefix, "shingle").where((F.col("lead") >= F.col("offset")) & (F.size("context") - F.col("lead") + F.col("offset") >= F.col("size")))
    same = F.array_join(F.slice("context", F.col("lead") - F.col("offset") + 1, F.col("size")), " ") == F.col("window")
    return met.where(same).select("key", (F.col("place") - F.col("offset")).alias("start"), "size", "window")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = 10, shingle: int = 5, filter_bits: int = 26,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items): one row per row of ``docs``.

    ``n_hit`` words lie inside an occurrence of a window of an item; ``spans`` are the
    maximal runs of those, as word numbers from 0, end excluded; ``items`` are the ids of the
    items with a window that occurs, as sorted texts. Texts are read whole whatever
    their length. A null or empty text has no words, as a document or as an item, and is never hit.
    Rows that share an id are documents of their own; items that share an id are one
    item; a null item id is an empty text in ``items``. Other columns, whatever their names, are not looked
    at. An empty table of documents gives an empty result, one of items leaves every word alone.
    """
    since = mark()
    windows = stage(item_windows(items, item_col, item_text_col, window), "item-windows")
    shingles = stage(window_shingles(windows, shingle), "item-shingles")
    least = {r["width"]: r["least"] for r in shingles.groupBy("width").agg(F.min(F.col("size") - F.col("width") + 1).alias("least")).collect()}  # a row for each width up to ``shingle``
    bitmap = shingle_bitmap(shingles, filter_bits)
    seen = stage(_seen(docs, id_col, text_col, bitmap, least), "word-runs")
    hit = seen.where(F.size("runs") > 0)
    spans = stage(occurrences(hit, shingles, window), "occurrences")

    end = F.col("start") + F.col("size")
    w = Window.partitionBy("key").orderBy("start", "size")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("start") > F.coalesce(F.col("before"), F.lit(-1))).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = spans.withColumn("before", before).withColumn("island", island).groupBy("key", "island").agg(F.min("start").alias("start"), F.max(end).alias("end"))
    hits = merged.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    whose = spans.select("key", "window").distinct().join(windows.select("window", "item"), "window").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))

    own = docs.schema[id_col].dataType
    columns = [F.col("id").cast(own).alias("id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")]
    some = hit.select("key", "id", "n_words").join(hits, "key", "left").join(whose, "key", "left").select(*columns)
    none = seen.where(F.size("runs") == 0).select(F.col("id"), "n_words", F.lit(None).alias("n_hit"), F.lit(None).cast(SPANS).alias("spans"), F.lit(None).cast("array<string>").alias("items")).select(*columns)
    return settled(some.unionByName(none), "contaminated", since)
