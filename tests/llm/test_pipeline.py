"""The stages of the corpus pipeline on a small corpus with odd rows."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mailloom.llm import packing, staging

CLASHING = ["kept", "score", "accepted", "size", "taken", "id", "n", "key", "part", "component_id", "row", "own", "graded", "__graded", "__id", "__x", "__copies", "__gone", "__seg", "__doc", "__bucket", "__pos", "__b", "__start", "c0"]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]


def corpus():
    rng = np.random.default_rng(9)
    good, bad = [f"good{i}" for i in range(300)], [f"vile{i}" for i in range(30)]
    rows, ratings = [], []
    for i in range(200):
        words = list(rng.choice(good, 40))
        if i % 5 == 0:
            words[:10] = rng.choice(bad, 10)
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        ratings.append((i, 1, int(i % 5 == 0)))
    rows += [(300, rows[1][1], "en", "s1", 0), (301, rows[1][1], "en", None, 0), (302, rows[2][1] + " tail", "en", "s2", 0)]
    rows += [(400, None, None, None, None), (401, "", "en", "s0", 0), (402, " ".join(rng.choice(good, 30_000)), "en", "s0", 0)]
    return [(*r, *[f"own {c} {r[0]}" for c in CLASHING]) for r in rows], ratings


def written(spark, folder, rows, ratings):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ratings, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tmp_path):
    rows, ratings = corpus()
    by_id = {r[0]: r for r in rows}
    folder = written(spark, tmp_path, rows, ratings)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = []
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS, name
            got = docs.collect()
            assert all(tuple(r) == by_id[r.doc_id] for r in got), name
            seen.append([r.doc_id for r in got])
    rated, exact, near, mixed = seen
    toxic = {i for i, _, t in ratings if t}
    assert not toxic & set(rated) and set(range(200)) - toxic <= set(rated) and {300, 301, 302} <= set(rated)
    assert set(rated) - set(exact) == {1, 300} | ({400} & set(rated)) and len(set(exact)) == len(exact)
    assert set(exact) - set(near) == {302}
    assert set(mixed) <= set(near) and max(mixed.count(i) for i in set(mixed)) <= 3
    pieces = docs.orderBy("sequence_id", "offset").collect()
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    want = sorted(tuple(encoder.encode(by_id[i][1] or "", add_special_tokens=False).ids) + (2,) for i in mixed)
    got, last = [], {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2").tolist()
        assert len(ids) == p.length and p.offset == last.get(p.sequence_id, 0) and p.offset + p.length <= 4096
        last[p.sequence_id] = p.offset + p.length
        got += [[]] if p.start == 0 else []
        got[-1] += ids
    assert sorted(map(tuple, got)) == want and all(n == 4096 for s, n in last.items() if s < max(last))


def test_run_leaves_its_result_only(spark, tmp_path):
    folder = written(spark, tmp_path, *corpus())
    before = len(staging._staged)
    assert corpus_pipeline.run(spark, folder).count() > 150 and len(staging._staged) == before + 1
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("mailloom_")]


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, tmp_path, k):
    folder = written(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert out.count() == 0 and (k == 4 or out.columns == COLUMNS)
