"""Mixing, sharding and packing against plain versions."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailloom.llm import bloomdedup, mixing, packing, sharding
from mailloom.llm.staging import ranges

SMALL = "/root/testdata/sf0.01"


def plain_targets(sizes, cap=3.0):
    """Deal by weight; cap; deal the excess again until none is above."""
    weight = {s: float(i % 3 + 1) for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, left, open_ = {}, float(sum(sizes.values())), set(sizes)
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * share >= cap * sizes[s]}
        if not full:
            return out | {s: weight[s] * share for s in open_}
        out |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return out


def test_targets(spark):
    rng = np.random.default_rng(5)
    for _ in range(4):
        sizes = {f"s{i:02d}": int(rng.zipf(1.3) % 10_000) for i in range(12)} | {None: 40}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: r.target for r in got} == pytest.approx(plain_targets(sizes))


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        x = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3), F.lit(4)).alias("y")).collect()
        assert sorted(r.y for r in x) == list(range(n))


def test_mix_of_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = mixing.taken_words(docs).collect()
    again = {r.id: r.taken for r in mixing.taken_words(docs).collect()}
    by_source = defaultdict(lambda: [0, 0.0, 0])
    for r in rows:
        own = by_source[r.source]
        own[0], own[1], own[2] = own[0] + r.size, r.target, own[2] + r.taken
        assert r.taken <= 3 * r.size and again[r.id] == r.taken
    want = plain_targets({s: v[0] for s, v in by_source.items()})
    for s, (_, target, taken) in by_source.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 0.01 * target + 64


def test_odd_rows_of_a_mix(spark):
    rows = [(1, None, "a", 7), (2, "", None, 7), (3, "one", "a", 7), (3, "one", "a", 7), (None, "two words", None, 7), (4, "w " * 300_000, "b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.taken_words(docs).collect()
    assert sorted((r.id or 0, r["size"]) for r in out) == [(0, 2), (1, 0), (2, 0), (3, 1), (3, 1), (4, 300_000)]
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.taken_words(docs.where("false")).count() == mixing.mix_documents(docs.where("false")).count() == 0


def test_slots_are_not_broadcast(spark):
    """They are as many as the words of the mix, but come from a table of a few bytes."""
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('w ', 3000) AS text", "concat('s', id % 2) AS source")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    pieces = mixing.mix(docs)[2]
    assert re.findall(r"(\w+Join) \[source_no#\w+, block#\w+\]", pieces._jdf.queryExecution().sparkPlan().toString()) == ["SortMergeJoin"]
    assert pieces.agg(F.sum("n_words")).first()[0] == pytest.approx(120_000, rel=0.01)


def test_copies_of_documents_do_not_broadcast_slots(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('w ', 3000) AS text", "concat('s', id % 2) AS source")
    plan = mixing.mix_documents(docs)._jdf.queryExecution().sparkPlan().toString()
    assert re.findall(r"(\w+Join) \[source_no#\w+, block#\w+\]", plan) == ["SortMergeJoin"]


def test_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = sharding.external_shuffle(docs, bucket_bytes=100_000)
    rows = out.select("doc_id", "shard", "slot", "grown_shard", "text").collect()
    source = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.text for r in rows} == source and len(rows) == len(source)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert set(slots) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    shuffled = sharding.external_shuffle(docs.repartition(7), bucket_bytes=100_000)
    assert {tuple(r) for r in shuffled.select("doc_id", "shard", "slot").collect()} == {(r.doc_id, r.shard, r.slot) for r in rows}
    grown = {r.doc_id: r.shard for r in sharding.external_shuffle(docs.select("doc_id", "text"), shards=41).collect()}
    assert grown == {r.doc_id: r.grown_shard for r in rows}


def test_fisher_yates_is_uniform():
    counts = np.zeros((4, 4))
    for seed in range(2000):
        order = sharding.fisher_yates(4, seed)
        assert sorted(order) == [0, 1, 2, 3]
        counts[order, np.arange(4)] += 1
    assert np.abs(counts / 2000 - 0.25).max() < 0.05


def test_odd_rows_of_shards(spark, tmp_path):
    rows = [(1, None, 9), (2, "", 9), (2, "same id", 9), (3, "x", 9), (3, "x", 9), (None, "no id", 9), (4, "long " * 400_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    out = sharding.external_shuffle(docs, shards=2, bucket_bytes=1000).collect()
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str(r[:2]) for r in rows)
    assert sharding.external_shuffle(docs.where("false")).count() == 0
    sharding.write_shards(docs, f"{tmp_path}/shards", shards=2)
    back = [r for k in (0, 1) for r in sharding.read_shard(spark, f"{tmp_path}/shards", k).collect()]
    assert sorted(str((r.doc_id, r.text)) for r in back) == sorted(str(r[:2]) for r in rows)


def test_hilbert_keys():
    """Every cell of a grid once, and neighbours on the curve are neighbours in space."""
    grid = np.array(list(np.ndindex(8, 8, 8)))
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert np.all(np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1)


def test_packed_tokens(spark):
    """Pieces put together are the tokenizer's ids, along the curve, in full sequences."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 150").union(spark.createDataFrame([(9001, None, "en", "x", 0), (9002, "", "en", "x", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    encoder = Tokenizer.from_file(packing.default_tokenizer())
    want = {r.doc_id: [*encoder.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces = packing.pack(docs).orderBy("sequence_id", "offset").collect()
    got, fill, order = defaultdict(list), defaultdict(int), []
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u2")
        assert p.start == len(got[p.id]) and p.offset == fill[p.sequence_id] and p.doc_tokens == len(want[p.id]) and p.length == len(ids) > 0
        assert p.ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        got[p.id] += ids.tolist()
        fill[p.sequence_id] += p.length
        order.append((p.curve_key, p.id))
    assert dict(got) == want and order == sorted(order)
    assert sorted(fill) == list(range(len(fill))) and [fill[s] for s in range(len(fill) - 1)] == [4096] * (len(fill) - 1)


def test_odd_rows_of_packing(spark):
    rows = [(1, "same", 5), (1, "same", 5), (1, "other", 5), (None, "no id", 5), (2, "long word " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long")
    out = packing.pack(docs, with_ids=False).collect()
    assert {r.id for r in out} == {1, 2, None} and sum(r.length for r in out if r.id == 1) == sum(r.doc_tokens for r in out if r.id == 1 and r.start == 0)
    assert packing.pack(docs.where("false")).count() == 0


def test_exact_dedup_by_ranges(spark):
    """A filter of several ranges, of one segment each, gives the same rows."""
    rows = [(i, f"text {i % 3000}" if i % 3 else f"own {i}", i) for i in range(6000)] + [(None, "text 1", 0), (7, "text 7", 0), (8, None, 0), (9, "", 0), (10, "z" * 500_000, 0), (11, "z" * 500_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long").repartition(3)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    want = sorted((i or 0, max(x or 0 for x in groups[t or ""]), len(groups[t or ""])) for i, t, _ in rows)
    for most in (1, 16384):
        out = bloomdedup.annotate_duplicates(docs, max_segments=most).collect()
        assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size) for r in out) == want
        assert sum(r.kept for r in out) == len(groups)
    left = bloomdedup.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.kept for r in left.collect()).count(0) < 10 and left.count() == len(groups)


def test_columns_of_any_name_pass_through(spark):
    """Names that the operators use inside come back as they were."""
    names = ["__id", "__seg", "__x", "__copies", "__doc", "__bucket", "__pos", "__b", "__start", "c0", "c1", "row", "own", "shard_", "n"]
    rows = [(i, f"text {i // 2}", *[f"{n} {i}" for n in names]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    for out in (sharding.external_shuffle(docs, shards=2), bloomdedup.annotate_duplicates(docs)):
        assert sorted(map(tuple, out.select(*docs.columns).collect())) == rows and set(docs.columns) < set(out.columns)


def test_ranges_follow_the_data(spark, monkeypatch):
    """More ranges than the session's number change neither the order of the stream nor the pieces."""
    assert ranges(spark, 0) == ranges(spark, 1 << 20) == 4 and ranges(spark, 1 << 40) == 1 << 13
    docs = spark.createDataFrame([(i, f"words of kind {i % 7} and {i}" * (i % 5)) for i in range(300)], "doc_id long, text string")
    few = [tuple(r) for r in packing.pack(docs, with_ids=False).orderBy("sequence_id", "offset").collect()]
    monkeypatch.setattr(packing, "ranges", lambda spark, size: ranges(spark, size, per_range=1 << 9))
    more = packing.pack(docs, with_ids=False)
    assert [tuple(r) for r in more.orderBy("sequence_id", "offset").collect()] == few
