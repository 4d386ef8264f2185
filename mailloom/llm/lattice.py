"""Embedding near-deduplication by E8 lattice hashing.

Each table projects unit vectors to eight dimensions and decodes them to the
nearest point of the E8 lattice; that point is the vector's cell. Neighbouring
cells are probed: the cells that the vector reaches when it is moved a little
along random directions. A cell is a pair of lattice points of two projections, at every size of the
table: cells of one point would hold ever more vectors that are not alike.

Vectors that meet in a cell are compared by their cosine in double precision. A
cell of over ``TILE`` vectors is cut in tiles, and each two of its tiles are a block
of their own. Equal vectors are one class from the start. A pair that meets in
several cells is counted in the first only, the largest, which both rows tell from the
cells that they bring along, so that blocks emit one count per member and spanning
links, never their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.components import components, lookup
from mailloom.llm.staging import hot_lookup, mark, settled, stage, trim
from mailloom.llm.textbytes import mix64

PROBES = 6
STEP = 0.45
TILE = 512
PAIRS = 1 << 18


def e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8 (D8 and D8 + 1/2), doubled so that they are integers."""

    def d8(y: np.ndarray) -> np.ndarray:
        z = np.rint(y)
        rest = y - z
        worst = np.abs(rest).argmax(axis=1)
        rows = np.arange(len(y))
        odd = z.sum(axis=1) % 2 != 0
        z[rows[odd], worst[odd]] += np.where(rest[rows, worst] >= 0, 1.0, -1.0)[odd]
        return z

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


Shape = tuple[int, int, float]
SHAPE: Shape = (2, 12, 0.8)  # lattice points of a cell, tables, scale of the projections


def cells(unit: np.ndarray, shape: Shape, seed: int = 3) -> np.ndarray:
    """Cell hashes [vector, table, cell]: the own cell, then the cells with one lattice point probed (some repeat)."""
    points, tables, scale = shape
    rng = np.random.default_rng(seed)
    out = np.empty((len(unit), tables, 1 + points * PROBES), np.uint64)
    odd = rng.integers(1, 2**62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for t in range(tables):
        own = np.empty((points, 1 + PROBES, len(unit)), np.uint64)
        for p in range(points):
            y = unit @ rng.standard_normal((unit.shape[1], 8)) * scale
            moves = rng.standard_normal((PROBES, 8))
            moves *= STEP / np.linalg.norm(moves, axis=1, keepdims=True)
            for k in range(1 + PROBES):
                z = e8(y + (moves[k - 1] if k else 0))
                own[p, k] = mix64((z.view(np.uint64) * odd).sum(axis=1, dtype=np.uint64) + np.uint64((t * points + p) * 0x9E3779B97F4A7C15 % 2**64))
        whole = own[:, 0].sum(axis=0, dtype=np.uint64)
        out[:, t, 0] = whole
        for p in range(points):
            out[:, t, 1 + p * PROBES : 1 + (p + 1) * PROBES] = (whole - own[p, 0] + own[p, 1:]).T
    return out


def _unit(vectors: list) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the norm
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _bits(earlier: list[np.ndarray]) -> np.ndarray:
    """[word, member]: a bit for each cell that two members have, the commonest in the first words."""
    owner = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    found, at, n = np.unique(np.concatenate(earlier), return_inverse=True, return_counts=True)
    place = np.empty(len(found), np.int64)
    place[np.argsort(-n, kind="stable")] = np.arange(len(found))
    shared = n[at] > 1
    place, owner = place[at[shared]], owner[shared]
    bits = np.zeros((-(-int((n > 1).sum()) // 64), len(earlier)), np.uint64)
    np.bitwise_or.at(bits, (place // 64, owner), np.uint64(1) << (place % 64).astype(np.uint64))
    return bits


def _met_before(earlier: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the members ``a`` and ``b`` of pairs have one of their ``earlier`` cells in common."""
    before, left = np.ones(len(a), bool), np.arange(len(a))
    for word in _bits(earlier):
        left = left[(word[a[left]] & word[b[left]]) == 0]
        if not len(left):
            break
    before[left] = False
    return before


def spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of links that join all that the links (a, b) join."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root, used = np.arange(len(nodes)), []
    while True:  # hook the larger root to the smaller, then shorten paths
        apart = np.flatnonzero(root[a] != root[b])
        if not len(apart):
            return np.array(used, np.int64)
        high, low = np.maximum(root[a], root[b])[apart], np.minimum(root[a], root[b])[apart]
        once, first = np.unique(high, return_index=True)
        root[once] = low[first]
        used += apart[first].tolist()
        while not np.array_equal(root, root[root]):
            root = root[root]


def block_counts(frame: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    """(a, b, n) of whole blocks, sorted by ``key, i, j, side``: links first met here of each member, with b = a, and links that span these with n = 0."""
    size = frame["v"].str.len()
    if size.nunique() > 1:  # a block's vectors have one length
        for _, own in frame.groupby(size):
            yield from block_counts(own, threshold)
        return
    u = _unit(frame["v"].tolist())
    key = frame[["key", "i", "j"]].to_numpy()
    edge = np.append(np.flatnonzero(np.any(np.diff(key, axis=0, prepend=key[:1] - 1) != 0, axis=1)), len(frame))
    side, ids, weight = frame["side"].to_numpy(), frame["class_id"].to_numpy(), frame["members"].to_numpy()
    earlier = frame["earlier"].tolist()
    left, right = [], []

    def flush() -> pd.DataFrame:
        a, b = np.concatenate(left), np.concatenate(right)
        counts = np.bincount(a, weights=weight[b], minlength=len(u)) + np.bincount(b, weights=weight[a], minlength=len(u))
        got, link = np.flatnonzero(counts), spanning(ids[a], ids[b])
        left.clear()
        right.clear()
        n = np.concatenate([counts[got].astype(np.int64), np.zeros(len(link), np.int64)])
        return pd.DataFrame({"a": np.concatenate([ids[got], ids[a[link]]]), "b": np.concatenate([ids[got], ids[b[link]]]), "n": n})

    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        cut = s + int((side[s:e] == 0).sum())
        within = key[s, 1] == key[s, 2]
        for r in range(s, cut, TILE):
            rest = r if within else cut
            a, b = np.nonzero(u[r : min(cut, r + TILE)] @ u[rest:e].T >= threshold)
            a, b = a + r, b + rest
            a, b = a[a < b], b[a < b]
            if not len(a):
                continue
            new = ~_met_before(earlier[s:e], a - s, b - s)
            left.append(a[new])
            right.append(b[new])
            if sum(map(len, left)) >= PAIRS:
                yield flush()
    if sum(map(len, left)):
        yield flush()


def links_of_cells(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) of ``members`` (key, i, j, side, class_id, members, v, earlier); see ``block_counts``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for frame in frames:
            kept.append(frame)
            joined = pd.concat(kept, ignore_index=True) if len(kept) > 1 else frame
            if len(joined) < 4 * TILE:
                continue
            end = joined.iloc[-1]
            open_ = (joined["key"] == end["key"]) & (joined["i"] == end["i"]) & (joined["j"] == end["j"])
            kept = [joined[open_]]
            if not open_.all():
                yield from block_counts(joined[~open_], threshold)
        if kept and sum(map(len, kept)):
            yield from block_counts(pd.concat(kept, ignore_index=True), threshold)
        trim()

    ordered = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "class_id")
    return ordered.select("key", "i", "j", "side", "class_id", "members", "v", "earlier").mapInPandas(run, "a long, b long, n long")


def first_meetings(met: DataFrame) -> DataFrame:
    """(class_id, key, size, earlier) of the rows of ``met`` (class_id, key, size) whose cells bring together a pair for the first time.

    Larger cells come first; ``earlier`` are the cells of the class before this one. A cell all of whose
    members share an earlier one, the first of each, brings no new pair and is left out, also from ``earlier``.
    """
    place = F.struct((-F.col("size")).alias("rank"), F.col("key").alias("key"))
    first = met.select("key", F.min(place).over(Window.partitionBy("class_id")).alias("first"))
    held = first.groupBy("key").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    held = held.where((F.col("low") == F.col("high")) & (F.col("low.key") != F.col("key"))).select("key")
    lists = met.join(held, "key", "left_anti").groupBy("class_id").agg(F.sort_array(F.collect_list(place)).alias("own"))
    each = lists.select("class_id", "own", F.posexplode("own").alias("at", "cell"))
    return each.select("class_id", "cell.key", (-F.col("cell.rank")).alias("size"), F.slice("own.key", F.lit(1), F.col("at")).alias("earlier"))


def tile_pairs(members: DataFrame) -> DataFrame:
    """``members`` (key, class_id, size, ...) of cells with i, j and side, in every block of two tiles of its cell.

    A cell of up to ``TILE`` members is one tile. Else a member's tile is drawn by its hash, from as many as give a tile about half of ``TILE`` members.
    """
    tiles = F.when(F.col("size") <= TILE, 1).otherwise(F.ceil(F.col("size") * 2 / TILE)).cast("int")
    own = F.pmod(F.xxhash64("key", "class_id"), tiles).cast("int")
    each = members.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    return each.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")}).drop("own", "other")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``.

    A vector that is null, empty, zero, or holds a null or a component that is
    not finite links with nothing. Equal vectors have cosine 1; each counts the
    others. Vectors of different lengths never link. Rows that share an id are
    vectors of one node: the links of its different vectors are added up, and its
    component is that of all of them. A null id has a null component and is kept. Other columns of
    ``vectors`` are not looked at. An empty table gives an empty result.

    Equal vectors are one class, whose number is its own and not an id's, since ids may repeat.
    """
    since = mark()
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    bad = v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(v, lambda x: x == 0)
    good = ~F.coalesce(bad, F.lit(True))
    exact = F.to_json(F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double"))))
    rows = stage(vectors.select(F.col(id_col).cast("long").alias("id"), F.when(good, v).alias("v"), F.when(good, F.sha2(exact, 256)).alias("vkey")), "vectors")
    total = rows.count()
    shape = SHAPE
    linked = rows.where("vkey is not null and id is not null")
    classes = linked.groupBy("vkey").agg(F.min("id").alias("least"), F.count("*").alias("members"), F.first("v").alias("v"))
    classes = stage(classes.withColumns({"dim": F.size("v"), "class_id": F.monotonically_increasing_id()}), "vector-classes")  # written once, so the numbers stay
    members_of = stage(hot_lookup(linked.select("id", "vkey"), classes.select("vkey", "class_id", "members"), "vkey", "members", max(1, total)).select("id", "class_id"), "class-members")
    own = members_of.distinct()
    several = stage(own.groupBy("id").agg(F.min("class_id").alias("hub"), F.count("*").alias("classes")).where("classes > 1").select("id", "hub"), "ids-of-several")
    shared = stage(own.join(several, "id"), "shared-ids")

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                own = cells(_unit(part["v"].tolist()), shape)
                ids = part["class_id"].to_numpy()
                for t in range(own.shape[1]):
                    for k in range(own.shape[2]):
                        fresh = ~(own[:, t, :k] == own[:, t, k : k + 1]).any(axis=1)
                        yield pd.DataFrame({"tab": t, "cell": own[fresh, t, k].view(np.int64), "class_id": ids[fresh], "dim": dim})

    cell_rows = classes.select("class_id", "v", "dim").mapInPandas(hashed, "tab int, cell long, class_id long, dim int")
    cell_rows = stage(cell_rows.select(F.xxhash64("tab", "cell", "dim").alias("key"), "class_id"), "cells", codec="zstd")
    sizes = cell_rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = stage(cell_rows.join(sizes, "key"), "shared-cells", codec="zstd")
    meetings = stage(first_meetings(met), "first-meetings", codec="zstd")
    members = tile_pairs(meetings.join(classes.select("class_id", "members", "v"), "class_id"))
    found = stage(links_of_cells(members, threshold), "vector-links", rows=4 * TILE)
    counts = found.where("n > 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("linked"))
    joined = found.where("n = 0").select("a", "b").union(shared.where("hub <> class_id").select("hub", "class_id"))
    parts = components(joined).withColumnRenamed("node", "class_id")
    labelled = lookup(classes.select("members", "class_id", "least"), parts, "class_id").join(counts, "class_id", "left")
    labelled = labelled.select("class_id", "members", "least", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component"))
    labelled = stage(labelled, "labelled")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stage(lookup(labelled, smallest, "component").select("class_id", "members", "n_links", "component_id"), "named")
    out = hot_lookup(members_of, named, "class_id", "members", max(1, total)).select("id", "n_links", "component_id")
    sums = shared.join(named, "class_id").groupBy("id").agg(F.sum("n_links").alias("all_links"))
    if not several.isEmpty():
        out = lookup(out, sums, "id").select("id", F.coalesce("all_links", "n_links").alias("n_links"), "component_id")
    alone = rows.where("vkey is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return settled(out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))), "vector-duplicates", since)
