"""Path counts of the lattice, and audits against orders applied one by one."""

from itertools import permutations
from math import factorial

import pytest
from pyspark.sql import functions as F

from mailloom.llm import interplay


def test_paths_of_the_lattice():
    grid = interplay.Lattice(5)
    assert len(grid.edges) == 80 and grid.forward[31] == grid.backward[0] == 120
    assert all(grid.forward[s] == factorial(bin(s).count("1")) for s in range(32))
    assert sorted(grid.orders()) == sorted(permutations(range(5)))
    some = interplay.Lattice(4, ((0, 1), (1, 3)))
    orders = [o for o in permutations(range(4)) if o.index(0) < o.index(1) < o.index(3)]
    assert sorted(some.orders()) == orders and some.forward[15] == len(orders)
    for s, f in some.edges:
        assert some.orders_through(s, f) == sum(any(set(o[:i]) == {x for x in range(4) if s >> x & 1} and o[i] == f for i in range(4)) for o in orders)
    with pytest.raises(ValueError):
        interplay.Lattice(2, ((0, 1), (1, 0)))


def faults(text, smaller):
    w = (text or "").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    t = text or ""
    return "".join(k for k, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), smaller), strict=True) if x)


def brute(docs, labels, orders):
    rows, out = [], []
    for i, text, lang in docs:
        same = i is not None and any((t or "") == (text or "") and j is not None and j < i for j, t, _ in docs)
        rate = [(q, x) for j, q, x in labels if j == i and i is not None]
        rows.append((lang or "", faults(text, same), any(q == 1 for q, _ in rate), any(x == 1 for _, x in rate)))
    for part in {r[0] for r in rows}:
        own, sums = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        steps = []
        for o in orders:
            left = own
            for k, f in enumerate(o):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                sums[f] += len(gone)
                steps.append((part, o, k + 1, len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out += [(*s, sums[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_of_texts(spark):
    """Copies, nulls, repeated rows, ids with several ratings."""
    many = " ".join(f"word{i}" for i in range(300))
    texts = [many, many, "SHOUT " * 300, "a # b", None, "", many + " $", "same " * 250, "x", "\t x ", many.upper()]
    docs = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 3)] + [(0, many, "en"), (None, many, "en"), (None, None, None)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 30, 2)] + [(4, 1, 1), (4, None, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, lang string, part int, n int").repartition(3)
    out = interplay.filter_audit(d, spark.createDataFrame([(i, q, int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, out.collect())) == brute(docs, labels, ["".join(o) for o in permutations("ABCDE")])


def test_audit_with_an_order_and_weights(spark):
    rows = spark.createDataFrame([("p", True, False, None, 2), ("p", True, True, True, 1), ("q", False, True, True, 5)], "part string, a boolean, b boolean, c boolean, n int")
    out = interplay.audit(rows, {k: F.col(k) for k in "abc"}, F.col("part"), {}, F.col("n"), (("a", "b"),)).collect()
    assert len(out) == 2 * 3 * 3 and {r.filter_order for r in out} == {"abc", "acb", "cab"}
    first = next(r for r in out if r.part == "p" and r.filter_order == "abc" and r.step == 1)
    assert (first.kept, first.removed, first.redundant, first.unique_fails, first.shapley) == (0, 3, 0, 2, 3 + 3 + 2)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert interplay.filter_audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
