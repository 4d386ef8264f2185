"""The backoff automaton against a plain version that walks each text."""

import re
from collections import Counter
from math import log10
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from mailloom.llm import chunks, lm

WORD = "\x20\t\n\x0b\x0c\r"


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [w for w in re.split(f"[{WORD}]+", low) if w]


def held(i):
    return i is not None and crc32(str(i).encode()) % 7 == 2


def plain_scores(rows):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    one, two, three = Counter(), Counter(), Counter()
    for i, text in rows:
        if not held(i):
            run = [*words(text), None]
            one.update(run)
            two.update(zip(["^", *run[:-1]], run))
            three.update(zip(["^", *run[:-2]], run[:-1], run[1:]))
    total, states = sum(one.values()), one | Counter({"^": one[None]})
    n1, n2 = (sum(v == k for v in one.values()) for k in (1, 2))
    d = min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    out = []
    for i, text in rows:
        run, before, score, base = [*words(text), None], ("^",), 0.0, 0.0
        for w in run:
            q = max(one[w] - d, 0) / total if one[w] else d * len(one) / total if total else 1.0
            v = before[-1]
            p = (two[v, w] + lm.PAIR_PRIOR * q) / (states[v] + lm.PAIR_PRIOR)
            if len(before) == 2 and two[before] >= lm.STATE_LEAST:
                p = (three[(*before, w)] + lm.TRIPLE_PRIOR * p) / (two[before] + lm.TRIPLE_PRIOR)
            score += log10(p)
            base += log10((one[w] + 1) / (total + len(one) + 1))
            before = (v, w)
        out.append((held(i), len(run), sum(one[w] > 0 for w in run), total, base, score))
    return out


def compared(spark, rows):
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, score long").repartition(3)
    got = sorted((r for r in lm.score(docs).collect()), key=lambda r: (r.id is None, r.id, r.score))
    want = sorted(zip([i for i, _ in rows], plain_scores(rows)), key=lambda r: (r[0] is None, r[0] or 0, r[1][-1]))
    assert [(g.id, g.held_out, g.n_tokens, g.n_known, g.train_tokens) for g in got] == [(i, *w[:4]) for i, w in want]
    assert [x for g in got for x in (g.base_score, g.score)] == pytest.approx([x for _, w in want for x in w[4:]], rel=1e-9)


def test_scores(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 30), p=np.arange(40, 0, -1) / 820))) for i in range(80)]
    rows += [(i + 100, rows[i][1].upper()) for i in range(20)]  # copies
    rows += [(200, None), (201, ""), (202, " \n"), (7, "same id"), (7, "same id"), (None, "no id w1"), (203, "Ünï cödé\u00a0x W1")]
    compared(spark, rows)


def test_scores_of_several_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"v{x}" for x in rng.zipf(1.5, 40) % 300)) for i in range(120)]
    monkeypatch.setattr(lm, "CHUNK_BYTES", 500)
    compared(spark, rows)


def test_nothing_to_learn_from(spark):
    some = [i for i in range(60) if held(i)][:3]
    compared(spark, [(i, "a b") for i in some])
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text(spark):
    compared(spark, [(1, "a b c " * 100_000), (2, "a b c d")])


def test_counts_above_32_bits():
    keys = np.array([5, 9, 1 << 50], np.uint64)
    numbers = np.array([3_000_000_000, 1, 4_000_000_000], np.uint64)
    frame = pd.concat([chunks.question(c, keys, numbers, 8) for c in (1, 2)])
    sums = [chunks.summed(f)[1].tolist() for _, f in frame.groupby("part")]
    assert sums == [[6_000_000_000, 2, 8_000_000_000]]
    assert chunks.unpacked(chunks.packed(np.array([0, 2**40, 7]))).tolist() == [0, 2**40, 7]
    assert len(chunks.unpacked(chunks.packed(np.zeros(0, np.int64)))) == 0


def test_walk_in_pieces(spark, monkeypatch):
    """Pieces of any length give what one walk from the document's start gives."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"u{x}" for x in rng.zipf(1.4, n) % 60)) for i, n in enumerate([0, 1, 2, 3, 4, 5, 9, 10, 11, 400, 77])]
    for piece in (2, 5):
        monkeypatch.setattr(lm, "PIECE", piece)
        compared(spark, rows)


def test_failure_arcs():
    """A state has arcs for what followed it in training alone; the rest goes by failure arcs, and each state's probabilities sum to one."""
    tok, owner = lm.tokens(["a b c", "a b c", "a b d", "c b"])
    found, at = np.unique(chunks.short(tok), return_inverse=True)
    blobs = [chunks.packed(x) for x in (np.bincount(owner), np.diff(found, prepend=np.uint64(0)), at)]
    t = lm.Tokens([None] * 4, *blobs)
    pairs = np.bincount(np.unique(chunks.short(t.pairs), return_inverse=True)[1])
    places = t.places(pairs[np.unique(chunks.short(t.pairs), return_inverse=True)[1]])
    triples = np.bincount(np.unique(t.triples(places), return_inverse=True)[1])
    words = np.bincount(t.at)
    machine = lm.Automaton(t, words, pairs, triples, len(at), len(words), 0.5)
    states, arcs = len(machine.fail), np.bincount(machine.keys // machine.symbols, minlength=len(machine.fail))
    a, b, c, d = t.at[:3].tolist() + [t.at[10]]
    assert states == 1 + len(words) + 3 and arcs[0] == len(words) and arcs[1 + a] == 1 and arcs[1 + b] == 3
    everything = np.arange(len(words))
    for s in range(states):
        p = 10 ** machine.step(np.full(len(words), s), everything)[1]
        unknown = 0.5 * len(words) / len(at) * 10 ** sum(machine.penalty[x] for x in chain(machine, s))
        assert p.sum() + unknown == pytest.approx(1)
    ab = machine.step(machine.step(np.array([machine.start]), np.array([a]))[0], np.array([b]))[0][0]
    assert ab > len(words) and machine.fail[ab] == 1 + b
    assert machine.step(np.array([ab]), np.array([d]))[0][0] == 1 + d  # seen once after b: the word's own state


def chain(machine, state):
    while state:
        yield state
        state = machine.fail[state]
