"""Benchmark decontamination against a plain search."""

import re

import pytest

from mailloom.llm import passages


def words(text):
    return re.findall(passages.WORD, (text or "").translate(str.maketrans(passages.UPPER, passages.LOWER)))


def brute(docs, items, window=10):
    known = {}
    for item, text in items:
        w = words(text)
        size = min(len(w), window)
        for i in range(len(w) - size + 1 if size else 0):
            known.setdefault(tuple(w[i : i + size]), set()).add("" if item is None else str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in known}:
            for s in range(len(w) - size + 1):
                if own := known.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    found |= own
        spans = [(s, next(e for e in range(s, len(w) + 1) if e not in hit)) for s in sorted(hit) if s - 1 not in hit]
        out.append((i, len(w), len(hit), spans, sorted(found)))
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, key int, runs string").repartition(3)
    out = passages.contaminated(d, spark.createDataFrame(items, "item_id long, text string"), filter_bits=16, **kw).collect()
    return [(r.id, r.n_words, r.n_hit, [(s.start, s.end) for s in r.spans], r["items"]) for r in out]


LONG = " ".join(f"w{i}" for i in range(40))
SOME = "The Quick brown fox, jumps over the lazy dog; and RUNS far away from here."


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize(("window", "shingle"), [(10, 5), (4, 5), (6, 2), (1, 1)])
def test_against_plain_search(spark, window, shingle):
    """Long, short, shared and repeated items; copies, cut copies, hot passages, edges of texts, odd rows."""
    items = [(1, LONG), (1, LONG), (2, SOME), (10, SOME + " again"), (3, "tiny item"), (4, "one"), (None, "née Ünïcode ÀÉ 42"), (5, None), (6, " ... "), (7, "a a a a a a a a a a a a")]
    docs = [
        (1, SOME), (2, SOME.upper() + " trailing"), (3, "lead " + LONG), (4, LONG[:50] + " broken " + LONG[50:]), (5, "tiny, ITEM!"), (6, "ONE"), (7, "née Ünïcode ÀÉ 42"), (8, "née ünïcode àé 42"),
        (9, None), (10, ""), (11, "a " * 25), (12, "clean words of their own kind"), (None, SOME), (1, "the quick brown"), (13, (SOME + " x ") * 50), (14, LONG + " " + LONG), (15, "tiny\x00item"), (16, "x" * 100_000),
    ] + [(100 + i, "common " + LONG) for i in range(60)]
    assert order(found(spark, docs, items, window=window, shingle=shingle)) == order(brute(docs, items, window))


def test_no_word_crosses_documents(spark):
    half = SOME.split()
    docs = [(i, " ".join(half[:7] if i % 2 else half[7:])) for i in range(40)]
    assert all(r[2] == 0 for r in found(spark, docs, [(1, SOME)]))


def test_empty_tables(spark):
    assert found(spark, [], [(1, SOME)]) == []
    docs = [(1, SOME), (2, None)]
    assert order(found(spark, docs, [])) == order(brute(docs, []))
