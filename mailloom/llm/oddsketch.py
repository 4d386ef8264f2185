"""MinHash near-deduplication with odd sketches.

A document's shingles give a one-permutation MinHash. Bands of its values make
bucket keys, and its values are folded into a parity bitmap, the odd sketch: the
population count of the XOR of two sketches estimates their difference, and is
most precise where similarities are high. Sketches of a bucket's members are
compared in tiles; what passes is confirmed on the full shingle sets.

Documents with equal sets are one class from the start. Links are found in two steps.

1. A tile of a bucket emits a best spanning forest of the pairs whose sketches
   pass, never its pairs. The forests' edges are confirmed, and confirmed links join
   documents to parts. In most groups that joins everything.
2. Forests join documents to candidate groups, and so do buckets of several tiles;
   every pair that shares a bucket and passes the sketch lies in one group. Groups
   that still have several parts are cut into tiles, a few megabytes of sketches
   and sets each. A block is a shelf of tiles, which its task holds, and tiles that
   pass by; it compares all its pairs that lie in different parts by sketch and
   confirms what passes on the sets. Blocks are spread over tasks, and emit at most
   one link for each document.

Sets of under ten shingles have no bands; they meet through exact keys of the set
without one or two of its members, which every link between such sets has in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.components import components, lookup
from mailloom.llm.staging import drop_staged, hot_lookup, mark, ranges, settled, stage, trim
from mailloom.llm.textbytes import buffers, lowered, mix64, span_hashes, words_by_text

BINS, BANDS, ROWS = 256, 42, 6
SKETCH_BITS = 512
SMALL_SET = 9
TILE = 1024
BLOCK, BLOCK_SHINGLES = 512, 1 << 19
SHELF_TILES, SHELF_SHINGLES, SPAN = 64, 1 << 21, 4
BROADCAST_IDS = 500_000

_ODD = np.random.default_rng(7).integers(1, 2**62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
_WHERE = np.arange(BINS)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; fewer words make one shingle, none an empty set."""
    for _, data, starts in buffers(texts):
        data = lowered(data)
        a, b, first = words_by_text(data, starts)
        h = span_hashes(data, a, b)
        n = max(0, len(h) - words + 1)
        rolled = np.zeros(n, np.uint64)
        for j in range(words):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
        for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if e - s >= words:
                yield np.unique(rolled[s : e - words + 1])
            elif e > s:
                one = np.uint64(e - s) * np.ones(1, np.uint64)
                for x in h[s:e]:
                    one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + x)
                yield one
            else:
                yield np.zeros(0, np.uint64)


def band_keys(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket keys, samples) of a sorted set: its one-permutation MinHash, in bands."""
    bins = (u >> np.uint64(56)).astype(np.int64)
    keep = np.flatnonzero(np.diff(bins, prepend=-1))
    bins, values = bins[keep], u[keep]
    nearest = np.searchsorted(bins, _WHERE)
    gap = np.where(nearest < len(bins), bins[nearest % len(bins)] - _WHERE, bins[0] + BINS - _WHERE)
    dense = mix64(values[nearest % len(bins)] + gap.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return mix64((dense[: BANDS * ROWS].reshape(BANDS, ROWS) * _ODD).sum(axis=1, dtype=np.uint64) + _BAND), values


def odd_sketch(samples: np.ndarray) -> bytes:
    """The parity bitmap of MinHash samples."""
    bit = (mix64(samples + np.uint64(1)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def small_keys(u: np.ndarray, threshold: float) -> list[int]:
    """Keys of the set and of the set less one (two) of its members, as far as a link can need them."""
    m = mix64(u ^ np.uint64(0x5851F42D4C957F2D))
    whole = m.sum(dtype=np.uint64)
    keys = [whole]
    if (len(u) - 1) / len(u) >= threshold:
        keys += list(whole - m)
    if len(u) > SMALL_SET:
        i, j = np.triu_indices(len(m), 1)
        keys += list(whole - m[i] - m[j])
    return mix64(np.array(keys, np.uint64) + np.uint64(11)).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float) -> DataFrame:
    """(id, n, set_key, keys, m, sketch) of each document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, set_key, keys, m, sketch = [], [], [], [], []
            for u in shingle_sets(frame["text"].tolist(), words):
                n.append(len(u))
                set_key.append(hashlib.blake2b(u.tobytes(), digest_size=16).digest())
                bands, samples = band_keys(u) if len(u) else (u, u)
                own = bands.view(np.int64).tolist() if len(u) > SMALL_SET else []
                own += small_keys(u, threshold) if 4 <= len(u) <= SMALL_SET + 2 else []
                keys.append(own)
                m.append(len(samples))
                sketch.append(odd_sketch(samples))
            yield pd.DataFrame({"id": frame["id"], "n": n, "set_key": set_key, "keys": keys, "m": m, "sketch": sketch})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id long, n long, set_key binary, keys array<long>, m int, sketch binary")


def shared_keys(keyed: DataFrame, sets: int) -> DataFrame:
    """(key, chunk, many, id) for keys that two rows or more have; ``sets``: how many sets the keys are of, at most.

    Rows are range-partitioned by the key and a hash of (key, id), so that a hot key
    spreads over partitions, and over other tiles of TILE rows in each band. A key at
    the edge of a partition may go on in the next one and is kept.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, pid, first = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, True

        def flush(last: bool) -> pd.DataFrame:
            nonlocal key, ids, first
            edge = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
            size = np.diff(edge, append=len(key))
            done = len(edge) if last else max(0, len(edge) - 1)
            outer = np.zeros(len(edge), bool)
            if first and len(edge):
                outer[0] = True
            if last and len(edge):
                outer[-1] = True
            keep = np.flatnonzero((size > 1) | outer)
            keep = keep[keep < done]
            rows = np.repeat(edge[keep], size[keep]) + _within(size[keep])
            out = pd.DataFrame({"key": key[rows], "chunk": pid * (1 << 32) + _within(size[keep]) // TILE, "many": np.repeat(outer[keep] | (size[keep] > TILE), size[keep]), "id": ids[rows]})
            first = first and done == 0
            cut = edge[done] if done < len(edge) else len(key)
            key, ids = key[cut:], ids[cut:]
            return out

        for frame in frames:
            if len(frame):
                pid = int(frame["pid"].iloc[0])
                key, ids = np.concatenate([key, frame["key"].to_numpy()]), np.concatenate([ids, frame["id"].to_numpy()])
                yield flush(False)
        yield flush(True)

    n = ranges(keyed.sparkSession, sets * BANDS * 16)
    order = [F.col("key"), F.xxhash64("key", "id")]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ordered.select("key", "id").withColumn("pid", F.spark_partition_id()).mapInPandas(run, "key long, chunk long, many boolean, id long")


def _within(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, joined."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def estimate(sketch: np.ndarray, m: np.ndarray, other: np.ndarray, m2: np.ndarray) -> np.ndarray:
    """Similarities estimated from sketches (uint64 rows) and their numbers of samples, pair by pair by broadcasting."""
    x = np.bitwise_count(sketch ^ other).sum(axis=-1, dtype=np.int64)
    apart = -SKETCH_BITS / 2 * np.log(np.maximum(1 - 2 * x / SKETCH_BITS, 1e-9))
    return np.clip((m + m2 - apart) / 2, 0, None) / np.maximum(np.maximum(m, m2), 1)


def forest(score: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a best spanning forest over scores of ``least`` or more."""
    n, made = len(score), []
    best, via, out = np.full(n, -1.0), np.full(n, -1), np.ones(n, bool)
    for _ in range(n):
        i = int(np.argmax(np.where(out, best, -2.0)))
        if best[i] < least:
            i = int(np.argmax(out))
        else:
            made.append((int(via[i]), i))
        out[i] = False
        better = out & (score[i] > best)
        best[better], via[better] = score[i][better], i
    return made


def alike(n: np.ndarray, other: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sizes can be similar enough."""
    return np.minimum(n, other) >= threshold * np.maximum(n, other) - 1e-9


def compare(frame: pd.DataFrame, threshold: float, slack: float) -> list[tuple[int, int]]:
    """A best spanning forest of the pairs of one tile that pass (row numbers)."""
    sk = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
    m, n = frame["m"].to_numpy(np.float64), frame["n"].to_numpy(np.float64)
    score = np.empty((len(frame), len(frame)), np.float32)
    for i in range(0, len(frame), 64):
        score[i : i + 64] = estimate(sk[i : i + 64, None], m[i : i + 64, None], sk[None], m[None])
        score[i : i + 64][~alike(n[i : i + 64, None], n[None], threshold)] = -1
    np.fill_diagonal(score, -1)
    return forest(score, threshold - slack)


def bucket_edges(members: DataFrame, threshold: float, slack: float) -> DataFrame:
    """(a, b): candidate edges within each (key, chunk)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []

        def flush(frame: pd.DataFrame) -> pd.DataFrame:
            key, chunk = frame["key"].to_numpy(), frame["chunk"].to_numpy()
            edge = np.flatnonzero((np.diff(key, prepend=key[:1] - 1) != 0) | (np.diff(chunk, prepend=chunk[:1]) != 0))
            size, ids, many = np.diff(edge, append=len(key)), frame["id"].to_numpy(), frame["many"].to_numpy()
            out = []
            two = edge[(size == 2) & ~many[edge]]
            if len(two):
                sk = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
                m, n = frame["m"].to_numpy(np.float64), frame["n"].to_numpy(np.float64)
                ok = estimate(sk[two], m[two], sk[two + 1], m[two + 1]) >= threshold - slack
                two = two[ok & alike(n[two], n[two + 1], threshold)]
                out.append(pd.DataFrame({"a": ids[two], "b": ids[two + 1]}))
            for s, k in zip(edge.tolist(), size.tolist(), strict=True):
                if k > 2 or (k == 2 and many[s]):
                    if made := compare(frame.iloc[s : s + k], threshold, slack):
                        pairs = ids[s + np.array(made)]
                        out.append(pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]}))
            return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"a": [], "b": []}, dtype=np.int64)

        for frame in frames:
            kept.append(frame)
            joined = pd.concat(kept, ignore_index=True) if len(kept) > 1 else frame
            if not len(joined):
                continue
            last = (joined["key"] == joined["key"].iloc[-1]) & (joined["chunk"] == joined["chunk"].iloc[-1])
            kept = [joined[last]]
            if not last.all():
                yield flush(joined[~last])
        if kept and len(kept[0]):
            yield flush(kept[0].reset_index(drop=True))

    ordered = members.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "id")
    return ordered.select("key", "chunk", "many", "id", "n", "m", "sketch").mapInPandas(run, "a long, b long")


def tiled(rows: DataFrame) -> DataFrame:
    """``rows`` (key, part, id, n, ...) with ``chunk``, a tile of the key.

    A tile is full at BLOCK rows or BLOCK_SHINGLES of their ``n``. A part that half fills one
    has tiles of its own, and its rows are dealt to them by a hash; the other parts of a key
    share tiles, each part as a whole. On average tiles are half full, in any partitioning.
    """
    load = F.sum(F.col("n") / BLOCK_SHINGLES + 1 / BLOCK)
    parts = rows.groupBy("key", "part").agg(load.alias("load")).withColumn("own", F.col("load") > 0.5)
    mixed = parts.where("not own").groupBy("key").agg(F.sum("load").alias("rest"))
    sized = parts.join(mixed, "key", "left").withColumn("tiles", F.ceil(2 * F.when(F.col("own"), F.col("load")).otherwise(F.col("rest"))))
    sized = sized.select(F.xxhash64("key", "part").alias("__part"), "own", "tiles")
    dealt = lookup(rows.withColumn("__part", F.xxhash64("key", "part")), sized, "__part")
    tile = F.when(F.col("own"), F.xxhash64("part", F.pmod(F.xxhash64("id"), "tiles"))).otherwise(F.xxhash64(F.lit("mixed"), F.pmod(F.xxhash64("part"), "tiles")))
    return dealt.withColumn("chunk", tile).select(*rows.columns, "chunk")


def shelved(tiles: DataFrame) -> DataFrame:
    """``tiles`` with shelves as their chunks: a key's chunks in the order of their parts, SHELF_TILES of them or SHELF_SHINGLES, numbered."""
    each = tiles.groupBy("key", "chunk").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum("n").alias("load"))
    ahead = Window.partitionBy("key").orderBy("lo", "hi", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.col("load") / SHELF_SHINGLES, F.lit(1 / SHELF_TILES))
    each = each.select("key", "chunk", F.floor(F.coalesce(F.sum(room).over(ahead), F.lit(0.0))).alias("shelf"))
    return tiles.join(each, ["key", "chunk"]).withColumn("chunk", F.col("shelf")).drop("shelf")


def blocks(tiles: DataFrame) -> DataFrame:
    """(key, chunk, i, j, side): the pairs of a key's chunks that do not lie in one and the same part; a chunk is side 0 or 1."""
    each = tiles.groupBy("key", "chunk").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    other = each.select("key", F.col("chunk").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = each.withColumnRenamed("chunk", "i").join(other, "key").where("i <= j and least(lo, lo2) < greatest(hi, hi2)").select("key", "i", "j")
    first = pairs.select("key", F.col("i").alias("chunk"), "i", "j", F.lit(0).alias("side"))
    return first.unionByName(pairs.where("i < j").select("key", F.col("j").alias("chunk"), "i", "j", F.lit(1).alias("side")))


def spans(pairs: DataFrame) -> DataFrame:
    """(key, chunk, i, span, side) from ``blocks`` of shelves: shelf i, side 0, is sent once to meet SPAN others, side 1."""
    at = pairs.withColumn("span", F.floor(F.col("j") / SPAN)).select("key", "chunk", "i", "span", "side")
    return at.where("side = 0").distinct().unionByName(at.where("side = 1"))


class Shelf:
    """The rows on side 0 of a block, which those of side 1 are compared with one by one."""

    def __init__(self, frame: pd.DataFrame, threshold: float, slack: float) -> None:
        size = frame["shingles"].str.len().to_numpy(np.int64) // 8
        frame, self.size = frame.iloc[(order := np.argsort(size, kind="stable"))], size[order]
        self.least, self.share, self.threshold = threshold - slack, int(round(threshold * 100)), threshold
        self.id, self.part, self.m = frame["id"].to_numpy(), frame["part"].to_numpy().copy(), frame["m"].to_numpy(np.float64)
        self.sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(len(frame), -1)
        self.known, self.shingle = np.unique(np.frombuffer(b"".join(frame["shingles"]), np.int64), return_inverse=True)
        self.first, self.hit = np.cumsum(self.size) - self.size, np.zeros(len(self.known), bool)
        self.joined: dict[int, int] = {}

    def among(self) -> list[tuple[int, int]]:
        """Links between rows of the shelf."""
        out = []
        for b, n in enumerate(self.size.tolist()):
            out += self.links(self.id[b], self.part[b], n, self.m[b], self.sketch[b], self.shingle[self.first[b] : self.first[b] + n], b)
        return out

    def to(self, frame: pd.DataFrame) -> list[tuple[int, int]]:
        """Links between rows of the shelf and those of ``frame``."""
        out = []
        for i, part, m, sketch, shingles in zip(*[frame[c] for c in ("id", "part", "m", "sketch", "shingles")], strict=True):
            own = np.frombuffer(shingles, np.int64)
            at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
            out += self.links(i, part, len(own), m, np.frombuffer(sketch, np.uint64), at[self.known[at] == own], len(self.id))
        return out

    def links(self, i: int, part: int, n: int, m: float, sketch: np.ndarray, own: np.ndarray, before: int) -> list[tuple[int, int]]:
        """Confirmed links of a row with rows ahead of ``before``, one for each part; ``own``: its shingles that the shelf knows."""
        while part in self.joined:
            part = self.joined[part]
        low, high = np.searchsorted(self.size, [self.threshold * n - 1e-9, (n + 1e-9) / self.threshold + 1e-9])
        b = low + np.flatnonzero(self.part[low : min(high, before)] != part)
        b = b[estimate(sketch, m, self.sketch[b], self.m[b]) >= self.least] if n else b[:0]
        if not len(b):
            return []
        self.hit[own] = True
        both = np.array([np.count_nonzero(self.hit[self.shingle[s:e]]) for s, e in zip(self.first[b].tolist(), (self.first[b] + self.size[b]).tolist(), strict=True)])
        self.hit[own] = False
        b, out = b[both * 100 >= self.share * (n + self.size[b] - both)], []
        for p, at in zip(*np.unique(self.part[b], return_index=True), strict=True):
            out.append((int(self.id[b[at]]), int(i)))
            self.part[self.part == p] = part
            self.joined[int(p)] = int(part)
        return out


def links_of_blocks(members: DataFrame, threshold: float, slack: float) -> DataFrame:
    """(a, b): confirmed links between different parts in each block (key, i, span): side 0 is held, side 1 passes by."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, shelf = None, [], None

        def filled() -> list[tuple[int, int]]:
            nonlocal held, shelf
            if not held:
                return []
            shelf, held = Shelf(pd.concat(held, ignore_index=True), threshold, slack), []
            return shelf.among() if at[1] // SPAN == at[2] else []

        for frame in frames:
            made = []
            for block, rows in frame.groupby(["key", "i", "span"], sort=False):
                if block != at:
                    made += filled()
                    at, shelf = block, None
                held += [side] if len(side := rows[rows["side"] == 0]) else []
                if len(side := rows[rows["side"] == 1]):
                    made += filled()
                    made += shelf.to(side)
            yield pd.DataFrame(np.array(made, np.int64).reshape(-1, 2), columns=["a", "b"])
        yield pd.DataFrame(np.array(filled(), np.int64).reshape(-1, 2), columns=["a", "b"])
        trim()

    ordered = members.repartition("key", "i", "span").sortWithinPartitions("key", "i", "span", "side")
    return ordered.select("key", "i", "span", "side", "id", "part", "m", "sketch", "shingles").mapInPandas(run, "a long, b long")


def confirmed(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, edges: DataFrame) -> DataFrame:
    """The edges (a, b) whose full sets are similar enough."""
    sets = stage(full_sets(docs, id_col, text_col, words, edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    pairs = edges.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    linked = stage(pairs.where(both * 100 >= (F.size("sa") + F.size("sb") - both) * int(round(threshold * 100))).select("a", "b"), "confirmed")
    drop_staged(sets)
    return linked


def full_sets(docs: DataFrame, id_col: str, text_col: str, words: int, wanted: DataFrame, packed: bool = False) -> DataFrame:
    """(id, shingles) of the wanted documents, as an array or as bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [u.tobytes() if packed else u.view(np.int64) for u in shingle_sets(frame["text"].tolist(), words)]
            yield pd.DataFrame({"id": frame["id"], "shingles": sets})

    if wanted.count() <= BROADCAST_IDS:  # numbers: 20 MB as a hash table; else texts are shuffled
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(wanted, "id", "left_semi")
    return rows.mapInPandas(run, "id long, shingles " + ("binary" if packed else "array<long>"))


def open_links(docs: DataFrame, id_col: str, text_col: str, words: int, threshold: float, slack: float, classes: DataFrame, parts: DataFrame, joint: DataFrame) -> DataFrame:
    """(a, b): confirmed links between parts of one candidate group; ``joint`` (a, b) joins documents to groups."""
    own = parts.select("node", F.col("component").alias("part"))
    a = lookup(joint, own.select(F.col("node").alias("a"), F.col("part").alias("pa")), "a")
    both = lookup(a, own.select(F.col("node").alias("b"), F.col("part").alias("pb")), "b").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    groups = stage(components(both), "groups")
    if not groups.take(1):
        return both.limit(0)
    rows = lookup(classes.select(F.col("class_id").alias("node"), "n", "m", "sketch"), own, "node").withColumn("part", F.coalesce("part", "node"))
    rows = lookup(rows, groups.select(F.col("node").alias("part"), F.col("component").alias("key")), "part").where("key is not null").dropDuplicates(["node"])
    tiles = stage(shelved(tiled(rows.select("key", "part", F.col("node").alias("id"), "n", "m", "sketch"))), "tiles")
    sets = stage(full_sets(docs, id_col, text_col, words, tiles.select("id").distinct(), packed=True).dropDuplicates(["id"]), "sets")
    pairs = stage(spans(blocks(tiles)), "blocks")
    members = tiles.join(sets, "id").join(F.broadcast(pairs) if pairs.count() <= BROADCAST_IDS else pairs, ["key", "chunk"])
    return stage(links_of_blocks(members, threshold, slack), "block-links", rows=BLOCK)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, slack: float = 0.14) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``docs``.

    Documents are linked when their sets' intersection is at least ``threshold``
    of their union. ``component_id`` is the smallest id reachable; ``kept`` marks
    it. A null or blank text has an empty set and links with nothing. Rows that
    share an id are one document for links; where their texts differ, sets are
    confirmed on one of them. A null id has a null component and is kept. Other
    columns of ``docs`` are not looked at. A long text needs about 60 bytes of memory
    for each of its bytes. An empty table gives an empty result.
    """
    since = mark()
    sigs = stage(signatures(docs, id_col, text_col, words, threshold), "signatures")
    total = sigs.count()
    filled = sigs.where("n > 0 and id is not null")
    classes = filled.groupBy("set_key").agg(F.min(F.struct("id", "n", "m", "sketch", "keys")).alias("r"), F.count("*").alias("members"))
    classes = stage(classes.select("set_key", "members", F.col("r.id").alias("class_id"), "r.n", "r.m", "r.sketch", "r.keys"), "classes")
    shared = stage(shared_keys(classes.select(F.col("class_id").alias("id"), F.explode("keys").alias("key")), total), "shared-keys")
    sketches = classes.select(F.col("class_id").alias("id"), "n", "m", "sketch")
    found = stage(bucket_edges(shared.join(sketches, "id"), threshold, slack), "buckets")
    edges = stage(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    linked = confirmed(docs, id_col, text_col, words, threshold, edges)
    parts = stage(components(linked), "parts")
    large = shared.where("many")
    stars = lookup(large, large.groupBy("key").agg(F.min("id").alias("a")), "key").where("a <> id").select("a", F.col("id").alias("b"))
    more = open_links(docs, id_col, text_col, words, threshold, slack, classes, parts, edges.unionByName(stars.distinct()))
    first = lookup(classes.select("set_key", "members", F.col("class_id").alias("node")), parts, "node").withColumn("component", F.coalesce("component", "node"))
    ends = lookup(lookup(more, parts.select(F.col("node").alias("a"), F.col("component").alias("pa")), "a"), parts.select(F.col("node").alias("b"), F.col("component").alias("pb")), "b")
    joined = components(ends.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")))
    last = lookup(first, joined.select(F.col("node").alias("component"), F.col("component").alias("component_id")), "component")
    keyed = stage(last.select("set_key", "members", F.coalesce("component_id", "component").alias("component_id")), "labelled")
    out = hot_lookup(sigs.select("id", "n", "set_key"), keyed, "set_key", "members", max(1, total))
    component = F.when(F.col("id").isNull() | (F.col("n") == 0), F.col("id")).otherwise(F.coalesce("component_id", "id"))
    out = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return settled(out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), "near-duplicates", since)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that are not their component's first, columns unchanged.

    Rows are told apart by id, so rows that share one stay or go together; a null id stays.
    """
    gone = near_duplicates(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col("id").alias("__gone")).distinct()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own"))  # one struct, so that no name can clash
    return whole.join(gone, F.col("own") == F.col("__gone"), "left_anti").select("row.*")
