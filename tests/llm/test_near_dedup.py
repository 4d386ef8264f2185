"""Near-deduplication against all pairs."""

import random

import numpy as np

from mailloom.llm import oddsketch


def near_components(texts, words, threshold=0.8):
    """Smallest reachable number of each text, by comparing all pairs of sets, as bits of a number each."""
    number: dict[tuple, int] = {}
    sets = []
    for w in map(str.split, texts):
        own = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        sets.append(sum(1 << number.setdefault(x, len(number)) for x in own))
    size = [s.bit_count() for s in sets]
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if part[i] == part[j]:
                continue
            both = (a & sets[j]).bit_count()
            if both >= threshold * (size[i] + size[j] - both) - 1e-9:
                low, high = sorted((part[i], part[j]))
                part = [low if x == high else x for x in part]
    return part


def templated(groups, size, shared, own, rng):
    """Texts of ``shared`` common words; the texts of a group of two also share most of their own words."""
    base = [f"t{i}" for i in range(shared)]
    out = []
    for g in range(groups):
        mine = [f"g{g}x{i}" for i in range(own)]
        for k in range(size):
            text = base + [m if rng.random() < 0.5 else f"g{g}k{k}x{i}" for i, m in enumerate(mine)]
            out.append(" ".join(text))
    return out


def test_near_dedup_of_a_template(spark):
    # alike by 0.78 between groups, by 0.79 to 0.83 within
    texts = templated(150, 2, 450, 64, random.Random(5))
    expected = near_components(texts, 1)
    assert 150 <= len(set(expected)) < 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.component_id for r in oddsketch.near_duplicates(docs, words=1).orderBy("id").collect()]
    assert got == expected


def test_near_dedup_across_tiles(spark, monkeypatch):
    texts = templated(150, 2, 450, 64, random.Random(6))
    texts = texts[::2] + texts[1::2]
    monkeypatch.setattr(oddsketch, "TILE", 16)
    monkeypatch.setattr(oddsketch, "BLOCK", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in oddsketch.near_duplicates(docs, words=1).orderBy("id").collect()]
    assert got == near_components(texts, 1)


def test_near_dedup_about_the_threshold(spark):
    """400 texts of one template, most pairs close to 0.8."""
    rng = np.random.default_rng(1)
    texts = []
    for d in range(400):
        words = [f"b{i}" for i in range(300)]
        for i in rng.choice(300, 10, replace=False):
            words[i] = f"d{d}x{i}"
        texts.append(" ".join(words))
    expected = near_components(texts, 2)
    assert len(set(expected)) > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.component_id for r in oddsketch.near_duplicates(docs, words=2).orderBy("id").collect()]
    assert got == expected


def test_bucket_of_many_unlike_sets(spark):
    """1200 sets share every band key of their template, and few links are among them."""
    texts = templated(600, 2, 310, 90, random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = [r.component_id for r in oddsketch.near_duplicates(docs, words=1).orderBy("id").collect()]
    assert got == near_components(texts, 1)


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(oddsketch, "BLOCK", 16)
    rows = [(7, i, 0 if i < 900 else i, 3) for i in range(1000)] + [(8, 1, 1, 3)]
    tiles = oddsketch.tiled(spark.createDataFrame(rows, "key long, id long, part long, n long")).cache()
    assert tiles.count() == len(rows)
    size = {(r.key, r.chunk): r["count"] for r in tiles.groupBy("key", "chunk").count().collect()}
    assert max(size.values()) <= 2 * 16 and 60 < len(size) <= 130
    blocks = oddsketch.blocks(tiles).collect()
    pairs = {(r.key, r.i, r.j) for r in blocks}
    whole = {r.chunk for r in tiles.where("key = 7").groupBy("chunk").agg({"part": "max"}).collect() if r["max(part)"] == 0}
    assert not [p for p in pairs if p[1] in whole and p[2] in whole] and len(blocks) == 2 * len(pairs) - sum(i == j for _, i, j in pairs)
    mixed = {c for (k, c) in size if k == 7} - whole
    assert {(7, min(x, y), max(x, y)) for x in mixed for y in mixed | whole} >= pairs > {(7, min(x, y), max(x, y)) for x in mixed for y in whole}
    monkeypatch.setattr(oddsketch, "BLOCK_SHINGLES", 30)
    assert max(r["count"] for r in oddsketch.tiled(tiles.drop("chunk")).groupBy("key", "chunk").count().collect()) < 16


def test_a_large_group_is_not_sent_once_for_each_tile(spark, monkeypatch):
    """Tiles meet shelf by shelf: each pair of rows in different parts meets once, and rows are copied a few times only."""
    monkeypatch.setattr(oddsketch, "BLOCK", 16)
    monkeypatch.setattr(oddsketch, "SHELF_TILES", 16)
    rows = [(7, i, 0 if i < 300 else i, 3) for i in range(2000)] + [(8, 1, 1, 3), (8, 2, 2, 3)]
    tiles = oddsketch.shelved(oddsketch.tiled(spark.createDataFrame(rows, "key long, id long, part long, n long"))).cache()
    sent = tiles.join(oddsketch.spans(oddsketch.blocks(tiles)), ["key", "chunk"]).collect()
    assert len(sent) < 16 * len(rows)  # 125 tiles or more of 16 rows; pairs of tiles would take over 100 copies of each row
    by = {}
    for r in sent:
        by.setdefault((r.key, r.i, r.span), ([], []))[r.side].append(r)
    met = {}
    for (_, i, span), (held, passing) in by.items():
        own = [(a, b) for a in held for b in held if a.id < b.id] if i // oddsketch.SPAN == span else []
        for a, b in own + [(a, b) for a in held for b in passing]:
            if a.part != b.part:
                k = (a.key, *sorted((a.id, b.id)))
                met[k] = met.get(k, 0) + 1
    every = {(k, x, y) for k, x, p, _ in rows[:400] + rows[-2:] for l, y, q, _ in rows if k == l and x < y and p != q}
    assert set(met.values()) == {1} and every <= met.keys()


def test_small_sets_and_odd_rows(spark):
    texts = [f"{a} b c d e" for a in "xyz"] + ["a b c d e f g h i j", "a b c d e f g h i k", "", None, "one", "ONE", "  ", "two"]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "one", 5), (3, texts[3], 7)]
    out = oddsketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long"), words=1, threshold=0.8).collect()
    got = {r.id: r.component_id for r in out}
    assert len(out) == len(rows) and [got[i] for i in range(11)] == [0, 1, 2, 3, 3, 5, 6, 7, 7, 9, 10] and got[None] is None
    empty = oddsketch.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    out = oddsketch.near_duplicates(spark.createDataFrame([(1, long), (2, long + " x"), (3, "w1")], "doc_id long, text string")).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in out} == {1: (199_996, 1), 2: (199_997, 1), 3: (1, 3)}


def test_dropping_keeps_columns_and_other_rows(spark):
    rows = [(1, "a b c d e f", 0), (2, "a b c d e f", 1), (3, None, 2), (4, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    left = oddsketch.drop_near_duplicates(docs, words=2, threshold=0.8)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 3, 4]
