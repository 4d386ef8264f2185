"""E8 lattice hashing against all pairs."""

import numpy as np
import pytest

from mailloom.llm import lattice


def test_nearest_lattice_points():
    """No lattice point among the neighbours of the decoded one is nearer."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((200, 8)) * 2
    z = lattice.e8(x) / 2
    roots = [np.array(r) for r in np.ndindex(*[3] * 8) if sum(abs(y - 1) for y in r) == 2]
    steps = np.array([r - 1.0 for r in roots] + [np.array(s) - 0.5 for s in np.ndindex(*[2] * 8) if sum(s) % 2 == 0])
    assert len(steps) == 240
    whole = np.all(z == np.rint(z), axis=1)
    assert np.all(whole | np.all(z - 0.5 == np.rint(z - 0.5), axis=1)) and np.all(z.sum(axis=1) % 2 == 0)
    own = ((x - z) ** 2).sum(axis=1)
    assert all((((x - z - s) ** 2).sum(axis=1) >= own - 1e-9).all() for s in steps)


def test_recall_at_the_threshold():
    """Random pairs of cosine 0.95 to 0.96, the hardest ones."""
    shape = lattice.SHAPE
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.95, 0.96, (2000, 1))
    x, y = lattice.cells(a, shape), lattice.cells(c * a + np.sqrt(1 - c * c) * o, shape)
    met = np.any([(x[:, t, :, None] == y[:, t, None, :]).any(axis=(1, 2)) for t in range(shape[1])], axis=0)
    assert met.mean() >= 0.99


def brute(vectors, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    n = len(vectors)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                link[i, j] = a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold
    part = list(range(n))
    for _ in range(n):
        new = [min([part[i], *(part[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == part:
            break
        part = new
    return [(i, int(link[i].sum()), part[i]) for i in range(n)]


@pytest.mark.parametrize("tile", [512, 8])
def test_against_all_pairs(spark, monkeypatch, tile):
    """Clusters of close vectors, one of them larger than a tile, and odd rows."""
    monkeypatch.setattr(lattice, "TILE", tile)
    monkeypatch.setattr(lattice, "PAIRS", 100)
    rng = np.random.default_rng(1)
    vectors = []
    for size in (40, 3, 2, 1, 1, 1):
        centre = rng.standard_normal(16)
        vectors += [(centre + 0.1 * rng.standard_normal(16)).tolist() for _ in range(size)]
    vectors += [vectors[0], vectors[0], None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [1.0, None] + [0.0] * 14, [2.0], [3.0]]
    docs = spark.createDataFrame([(i, v, i) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, kept long").repartition(3)
    got = [tuple(r)[:3] for r in lattice.near_duplicates(docs).orderBy("id").collect()]
    assert got == brute(vectors)


def test_odd_tables(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (None, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)]


def test_a_pair_is_emitted_once(spark, monkeypatch):
    """Vectors that meet in many cells: blocks emit a few rows for each vector, not some for each of its cells."""
    rows = {}
    stage = lattice.stage

    def counted(df, label, **options):
        out = stage(df, label, **options)
        if label == "vector-links":
            rows[label] = out.count()
        return out

    monkeypatch.setattr(lattice, "stage", counted)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    vectors = [(centre + 0.15 * rng.standard_normal(64)).tolist() for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = [tuple(r)[:3] for r in lattice.near_duplicates(docs).orderBy("id").collect()]
    assert got == brute(vectors)
    assert rows["vector-links"] <= 6 * len(vectors)


def test_first_meetings(spark):
    """Cells 7 and 9 hold no pair that cell 8 lacks; cell 6 brings 4 together with 1."""
    met = {9: [1, 2, 3], 8: [1, 2, 3], 7: [2, 3], 6: [1, 4]}
    rows = [(c, k, len(m)) for k, m in met.items() for c in m]
    order = {k: i for i, k in enumerate([8, 9, 6])}
    got = lattice.first_meetings(spark.createDataFrame(rows, "class_id long, key long, size long")).collect()
    assert sorted((order[r["key"]], r["class_id"], r["size"], r["earlier"]) for r in got) == [(0, 1, 3, []), (0, 2, 3, []), (0, 3, 3, []), (2, 1, 2, [8]), (2, 4, 2, [])]
