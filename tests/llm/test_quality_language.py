"""Quality classifier and language identification: gradients, held-out accuracy, odd rows."""

import numpy as np
import pytest

from mailloom.llm import langid, quality

SMALL, RATED = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_ordinal_gradients():
    rng = np.random.default_rng(1)
    rows = np.arange(0, 31, 3)
    col, val = rng.integers(0, 12, 30).astype(np.int32), rng.standard_normal(30).astype(np.float32)
    y, w, cuts = rng.integers(0, 3, 10), rng.standard_normal(12), np.array([0.2, -0.3])
    _, by_weight, by_cut = quality.likelihood_gradients(rows, col, val, y, w, cuts)
    for x, grad in ((w, by_weight), (cuts, by_cut)):
        for i in range(len(x)):
            d = np.zeros_like(x)
            d[i] = 1e-5
            up, low = (quality.likelihood_gradients(rows, col, val, y, w + s * d if x is w else w, cuts + s * d if x is cuts else cuts)[0] for s in (1, -1))
            assert grad[i] == pytest.approx((up - low) / 2e-5, rel=1e-3, abs=1e-4)


def test_thresholds_are_ordered_and_grades_learned():
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 4, 600)
    rows = [(np.array([100 + g, 200 + rng.integers(50)]), np.ones(2)) for g in grades]
    model = quality.fit(rows, grades.tolist(), 4)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(np.array([model.weights[c] @ v for c, v in rows]))
    assert tails.shape == (600, 3) and np.all(np.diff(tails, axis=1) <= 0)
    mean = [tails.sum(axis=1)[grades == g].mean() for g in range(4)]
    assert mean == sorted(mean) and mean[3] - mean[0] > 1


def test_held_out_ratings(spark):
    """Learned from every second rated document, the grades of the others are told apart."""
    docs, labels = (spark.read.parquet(f"{RATED}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    out = quality.grade_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic, good = [r.accepted for r in out if r.toxic], [r.accepted for r in out if r.quality and not r.toxic]
    assert np.mean(toxic) < 0.15 and np.mean(good) > 0.9


def test_odd_rows_of_the_classifier(spark):
    rows = [(1, "fine words here", "x"), (1, "fine words here", "x"), (2, None, None), (3, "", "y"), (None, "vile", "z"), (4, "fine " * 200_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (3, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.grade_documents(docs, model)
    assert out.count() == 6 and out.columns.count("score") == 1
    by_id = {}
    for r in out.collect():
        assert by_id.setdefault(r.doc_id, r) == r and 0 <= r.p_good <= r.p_not_toxic <= 1
        assert r.expected_grade == pytest.approx(r.p_good + r.p_not_toxic)
    assert by_id[2].score == by_id[3].score == 0
    assert quality.select_documents(docs, model).columns == docs.columns
    none = quality.train(docs, labels.where("false"))
    assert quality.select_documents(docs, none).count() == 6


def test_recurrent_gradients():
    rng = np.random.default_rng(4)
    net = langid.ByteNet.fresh(["a", "b", "c"], hidden=3)
    x, y = rng.integers(0, 256, (7, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = net.gradients(x, y)
    for name, p in net.p.items():
        for i in rng.choice(p.size, 6):
            at = np.unravel_index(i, p.shape) if not name.startswith("e") else (i % p.shape[0], x.ravel()[i % x.size])
            before = p[at]
            p[at] = before + 1e-2
            up = net.gradients(x, y)[0]
            p[at] = before - 1e-2
            low = net.gradients(x, y)[0]
            p[at] = before
            assert grad[name][at] == pytest.approx((up - low) / 2e-2, rel=0.1, abs=2e-3)


def test_pooled_probabilities_of_windows():
    """Windows of several texts in one batch give what each text gives alone."""
    net = langid.ByteNet.fresh(["a", "b"])
    texts = [b"x" * 5, b"", bytes(range(256)) * 3, b"hello" * 60]
    both = langid.pooled(net, texts)
    assert both == pytest.approx(np.concatenate([langid.pooled(net, [t]) for t in texts]), abs=1e-5)
    assert both.sum(axis=1) == pytest.approx([1, 0, 1, 1], abs=1e-4)
    own = net.positions(np.frombuffer(texts[3], np.uint8)[:256, None]).sum(axis=1)[:, 0] + net.positions(np.frombuffer(texts[3], np.uint8)[256:, None]).sum(axis=1)[:, 0]
    assert both[3] == pytest.approx(own / 300, abs=1e-5)


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = langid.identify(docs, steps=150).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(out) > 200 and np.mean([r.lang_pred == r.lang for r in out]) > 0.95


def test_odd_rows_of_languages(spark):
    rows = [(1, "ein Haus am See", "de", 1)] * 50 + [(2, "une maison au bord du lac", "fr", 1), (3, None, "de", 0), (4, "12 !?", "fr", 0), (5, "", None, 0), (None, "ein See", None, 0), (6, "une " * 100_000, "fr", 2)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score long"), steps=30).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_id = {r.id: r for r in out}
    assert {i for i, r in by_id.items() if r.lang_pred == "und"} == {3, 4, 5} and not by_id[None].held_out
    assert len({(r.lang_pred, r.score) for r in out if r.id == 1}) == 1
    seen = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string, score long"), 300, 4, "doc_id", "text", "lang")
    assert seen.where("lang = 'de'").count() == (4 if not by_id[1].held_out else 0)
    blank = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(blank).count() == 0
