"""Small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib

import numpy as np
import pytest

from mailloom.llm import bloomdedup, langid, lm, oddsketch, packing, suffix

LONG = " ".join(f"word{i}" for i in range(60))
ROWS = [(1, LONG, "en", "a", 5), (2, LONG, "en", "a", 5), (3, None, None, None, 0), (4, "", "en", "b", 0), (5, LONG + " more", "en", "b", 1), (6, "12 !!", "fr", "b", 1), (7, "Ünïcode text", "fr", None, 1)]
SCHEMA = "doc_id long, text string, lang string, source string, kept long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_exact_dedup(docs):
    r = {x.doc_id: x for x in bloomdedup.annotate_duplicates(docs).collect()}
    assert len(r) == 7 and (r[1].keep_id, r[1].group_size, r[1].kept) == (2, 2, False) and r[4].kept and not r[3].kept
    assert r[7].text_sha256 == hashlib.sha256(ROWS[6][1].encode()).hexdigest()
    assert bloomdedup.annotate_duplicates(docs.where("false")).count() == 0


def test_near_dedup(docs):
    r = {x.id: (x.n_shingles, x.component_id, x.kept) for x in oddsketch.near_duplicates(docs, words=2).collect()}
    assert r[1] == (59, 1, True) and r[2] == (59, 1, False) and r[5] == (60, 1, False) and r[3] == (0, 3, True) and r[6][0] == 1


def test_suffix(docs):
    r = {x.id: x for x in suffix.remove_repeats(docs).collect()}
    assert r[2].n_removed == len(LONG) and r[1].n_removed == 0 and r[5].n_removed == len(LONG) and r[3].n_bytes == 0


def test_language_and_lm(docs):
    r = {x.id: x for x in langid.identify(docs, steps=20).collect()}
    assert r[3].lang_pred == r[6].lang_pred == "und" and all(0 <= x.score <= 1 for x in r.values())
    s = {x.id: x for x in lm.score(docs).collect()}
    assert s[3].n_tokens == 1 and s[1].n_tokens == 61 and s[1].score < 0


def test_tokens_of_rare_characters():
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    texts = ["İstanbul É, x", "x\x1cy z", "<|ENDOFTEXT|> <|endoftext|>. Ab|C", "日本語 test!!", "a.b,c d,", "été it's 12", " \n", "", None]
    plain = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert packing.token_ids(texts, path) == [np.array(e.ids, "<u2").tobytes() for e in plain]


@pytest.mark.parametrize("often", [20_000, 3])
def test_suffix_against_brute_force(spark, often):
    """Also with anchors that go apart, and chunks of a few texts."""
    hot = " ".join(f"hot{i}" for i in range(30))
    texts = [f"{i % 3} {hot} tail{i} {hot}" if i % 2 else f"{hot[: 100 + i]}" for i in range(40)]
    seen, expected = set(), []
    for t in texts:
        covered = set()
        for i in range(len(t) - 99):
            if t[i : i + 100] in seen:
                covered.update(range(i, i + 100))
            seen.add(t[i : i + 100])
        expected.append((len(covered), hashlib.sha256("".join(c for i, c in enumerate(t) if i not in covered).encode()).hexdigest()))
    got = suffix.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), hot=often).orderBy("id").collect()
    assert [(r.n_removed, r.kept_sha256) for r in got] == expected
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string"), hot=often).count() == 0


def test_suffix_of_odd_rows(spark):
    part = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 150)))
    rows = [(1, "é" * 60, "a"), (2, "é" * 60, "b"), (2, part, "c"), (2, part, "d"), (None, part, "e"), (3, None, "f"), (4, part * 2000, "g")]
    out = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)).collect()
    got = sorted((r.id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in out)
    assert got == [(0, 150, 150, 1), (1, 120, 118, 1), (2, 120, 120, 1), (2, 150, 0, 0), (2, 150, 150, 1), (3, 0, 0, 0), (4, 300_000, 300_000, 1)]
