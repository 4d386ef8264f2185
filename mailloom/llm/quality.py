"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text is a sparse vector of hashed features: the presence of its words (lower
case, letters only) and of their beginnings, and the share of its words that have a certain
shape (trailing marks, capitals). One weight vector is shared by all grades and ordered
thresholds cut its score: P(grade <= k) = sigmoid(threshold_k - score). The
expected grade ranks documents and a tail probability selects them.

The model is fitted on a bounded sample of the rated documents (``sample`` of
them, by a hash of the id, and at most ``entries`` numbers of their vectors). A fifth of the sample, by another hash of the id, is held
out to choose the penalty and the probability at which a document is accepted; then
the model is fitted to the whole sample. Every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.staging import drop_since, mark, stage, trim

WIDTH = 1 << 17
SHAPES = 1 << 10
_CUT = re.compile(r"[^\W\d_]+")
_CACHE = 200_000  # words; a Python worker that is used again keeps them
_features: dict[str, tuple[int, ...]] = {}
BEGINNINGS = (5, 7)  # letters


def _feature(word: str) -> tuple[int, ...]:
    """Columns of the word's letters, of its beginnings, and of its shape."""
    letters = "".join(_CUT.findall(word)).lower()
    rest = word.strip("\"'()[]«»").lstrip("".join(_CUT.findall(word[:1])))
    tail = re.sub(r"^[\w]*", "", rest)[:4]
    kind = ("U" if word.isupper() and len(word) > 1 else "l") + ("d" if any(c.isdigit() for c in word) else "") + tail
    hashed = [crc32(x.encode()) for x in (letters, *(f"{n}:{letters[:n]}" if len(letters) > n else letters for n in BEGINNINGS))]
    return *[SHAPES + h % (WIDTH - SHAPES) for h in hashed], crc32(kind.encode()) % SHAPES


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text. An empty text has none."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    if len(_features) > _CACHE:
        _features.clear()
    for w in set(words):
        if w not in _features:
            _features[w] = _feature(w)
    found = np.array([_features[w] for w in words])
    columns = np.unique(found[:, :-1])
    shapes, counts = np.unique(found[:, -1], return_counts=True)
    return np.concatenate([columns, shapes]), np.concatenate([np.ones(len(columns)), 8.0 * counts / len(words)])


@dataclass
class OrdinalModel:
    """Shared weights and ordered thresholds; ``cut`` is the probability of the upper grade that a document needs."""

    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.45

    def score(self, text: str | None) -> float:
        columns, values = vector(text)
        return float(self.weights[columns] @ values)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(scores)[:, None], -50, 50)))


SLICE = 1000


def likelihood_gradients(rows: np.ndarray, col: np.ndarray, val: np.ndarray, y: np.ndarray, w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log-likelihood, gradient by the weights, gradient by ``cuts``) of texts in rows[i]:rows[i + 1] of ``col`` and ``val`` with grades ``y``.

    ``cuts`` are the first threshold and the logarithms of the gaps between thresholds.
    """
    thresholds = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
    at = np.repeat(np.arange(len(y)), np.diff(rows))
    s = np.bincount(at, weights=w[col] * val, minlength=len(y))
    edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
    with np.errstate(over="ignore"):
        up, low = 1 / (1 + np.exp(-(edges[y + 1] - s))), 1 / (1 + np.exp(-(edges[y] - s)))
    p = np.maximum(up - low, 1e-9)
    gu, gl = up * (1 - up) / p, low * (1 - low) / p  # of the log-likelihood by upper and lower edge
    by_weight = np.bincount(col, weights=(gl - gu)[at] * val, minlength=len(w))
    by_cut = np.array([gu[y == k].sum() - gl[y == k + 1].sum() for k in range(len(thresholds))])
    return float(np.log(p).sum()), by_weight, np.array([by_cut.sum(), *(by_cut[k:].sum() * np.exp(cuts[k]) for k in range(1, len(cuts)))])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], n_grades: int, rounds: int = 100, l2: float = 1e-3, rate: float = 0.05, least: float = 0.002) -> OrdinalModel:
    """Maximum penalised likelihood by Adam on the whole sample of vectors; thresholds stay ordered by positive gaps.

    The sample is held once, 8 bytes for each entry, and gone through in slices.
    """
    seen = np.zeros(WIDTH, np.int64)
    for columns, _ in rows:
        seen[columns] += 1
    common = seen >= max(3, least * len(rows))  # a column of a few texts cannot tell
    used = [common[c] for c, _ in rows]
    first = np.cumsum([0, *(int(u.sum()) for u in used)])
    col, val = np.empty(first[-1], np.int32), np.empty(first[-1], np.float32)
    for (columns, values), u, at in zip(rows, used, first, strict=False):
        n = int(u.sum())
        col[at : at + n], val[at : at + n] = columns[u], values[u]
    y, n = np.asarray(grades, np.int64), max(1, len(rows))
    w, cuts = np.zeros(WIDTH), np.zeros(max(1, n_grades - 1))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(cuts), np.zeros_like(cuts)]
    for step in range(1, rounds + 1):
        grad_w, grad_c = l2 * w, np.zeros_like(cuts)
        for i in range(0, len(y), SLICE):
            own = first[i : i + SLICE + 1]
            part = slice(own[0], own[-1])
            _, gw, gc = likelihood_gradients(own - own[0], col[part], val[part], y[i : i + SLICE], w, cuts)
            grad_w -= gw / n
            grad_c -= gc / n
        for i, (x, g) in enumerate(((w, grad_w), (cuts, grad_c))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return OrdinalModel(w, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))


FOLDS = 5
SCREENS = (10.0, 24.0)
PENALTIES = (1e-4, 1e-3)
_VECTORS = "id string, grade int, held boolean, columns binary, values binary"


def rated(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 12_000) -> DataFrame:
    """_VECTORS of the documents of at most ``sample`` rated ids, as 32-bit words in bytes; a fifth of the ids is ``held`` out.

    Grades: 0 toxic, 1 of low quality, 2 good. Ratings that are null, or that differ for an id, are left out.
    """
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    good = labels.groupBy(F.col(id_col).alias("__id")).agg(F.min(grade).alias("grade"), F.max(grade).alias("__g")).where("grade = __g")
    chosen = good.orderBy(F.xxhash64("__id"), "__id").limit(sample).select("__id", "grade")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [vector(t) for t in frame["text"]]
            columns, values = [c.astype("<i4").tobytes() for c, _ in rows], [v.astype("<f4").tobytes() for _, v in rows]
            yield pd.DataFrame({"id": frame["id"], "grade": frame["grade"], "held": frame["held"], "columns": columns, "values": values})

    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    held = F.crc32(F.col("__id").cast("string")) % FOLDS == 0
    return texts.select(F.col("__id").cast("string").alias("id"), "grade", held.alias("held"), "text").mapInPandas(run, _VECTORS)


def column_counts(vectors: DataFrame, n_grades: int) -> np.ndarray:
    """Number of texts by [held, grade, column]. At most 2 * n_grades * WIDTH rows reach the driver, whatever the texts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, n_grades, WIDTH), np.int64)
        for frame in frames:
            for grade, held, columns in zip(frame["grade"], frame["held"], frame["columns"], strict=True):
                seen[int(held), grade, np.frombuffer(columns, "<i4")] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"cell": at, "n": seen.reshape(-1)[at]})

    found = vectors.select("grade", "held", "columns").mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * n_grades * WIDTH, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(2, n_grades, WIDTH)


def screened(counts: np.ndarray, grades: np.ndarray, least: float, most: int) -> np.ndarray:
    """Whether each column's chi-square with the grade is at least ``least``, for the ``most`` largest ones; columns of shapes always stay.

    ``counts``: texts by [grade, column]; ``grades``: texts by grade.
    """
    expected = counts.sum(axis=0) * (grades / max(1, grades.sum()))[:, None]
    rest = grades[:, None] - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.nan_to_num((counts - expected) ** 2 / expected).sum(axis=0) + np.nan_to_num((counts - expected) ** 2 / rest).sum(axis=0)
    kept = chi >= max(least, np.partition(chi, -most)[-most])
    kept[:SHAPES] = True
    return kept


def train(docs: DataFrame, labels: DataFrame, **options) -> OrdinalModel:
    """``fitted_model``, and the driver's memory for it given back."""
    model = fitted_model(docs, labels, **options)
    trim()
    return model


def fitted_model(docs: DataFrame, labels: DataFrame, sample: int = 12_000, most: int = 4096, keep: float = 0.98, **columns: str) -> OrdinalModel:
    """The model of ``docs`` and ``labels``. Without any rating every document scores 0 and passes.

    Columns are screened by their association with the grade, ``most`` of them at most. The screen
    and the penalty are those under which held-out documents are likeliest; ``cut`` is the largest
    probability that ``keep`` of the held-out good documents reach, 0.45 where fewer than 50 are held out. The driver
    gets at most ``sample`` vectors of at most ``most`` + SHAPES columns, also where rows share a rated id.
    """
    since = mark()
    vectors = stage(rated(docs, labels, sample=sample, **columns), "rated")
    counts = column_counts(vectors, 3)
    rows = {(r["held"], r["grade"]): r["n"] for r in vectors.groupBy("held", "grade").agg(F.count("*").alias("n")).collect()}
    sizes = np.array([[rows.get((h, g), 0) for g in range(3)] for h in (False, True)])
    if not sizes.sum():
        drop_since(docs.sparkSession, since)
        return OrdinalModel(np.zeros(WIDTH), np.array([-1.0, -1.0]))
    useful = screened(counts.sum(axis=0), sizes.sum(axis=0), min(SCREENS), most) | screened(counts[0], sizes[0], min(SCREENS), most)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept = [useful[np.frombuffer(c, "<i4")] for c in frame["columns"]]
            for name, kind in (("columns", "<i4"), ("values", "<f4")):
                frame[name] = [np.frombuffer(b, kind)[k].tobytes() for b, k in zip(frame[name], kept, strict=True)]
            yield frame

    kept = vectors.mapInPandas(run, _VECTORS)
    if sizes.sum() > sample:  # rows that share a rated id
        kept = kept.orderBy(F.xxhash64("id", "columns", "values"), "id").limit(sample)
    got = kept.toArrow()
    seen = sorted(zip(*[got[c].to_pylist() for c in kept.columns], strict=True))
    drop_since(docs.sparkSession, since)
    own = [(np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")) for _, _, _, c, v in seen]
    grades, held = np.array([r[1] for r in seen]), np.array([r[2] for r in seen])

    def fitted(part: np.ndarray, screen: float, l2: float) -> OrdinalModel:
        kept = screened(counts[0] if part is not every else counts.sum(axis=0), sizes[0] if part is not every else sizes.sum(axis=0), screen, most)
        return fit([(own[i][0][kept[own[i][0]]], own[i][1][kept[own[i][0]]]) for i in part], grades[part].tolist(), 3, l2=l2)

    every, learned, judged = np.arange(len(seen)), np.flatnonzero(~held), np.flatnonzero(held)
    if not len(judged) or not len(learned):
        return fitted(every, max(SCREENS), max(PENALTIES))
    tried = []
    for screen in SCREENS:
        for l2 in PENALTIES:
            tail = (model := fitted(learned, screen, l2)).tails(np.array([model.weights[own[i][0]] @ own[i][1] for i in judged]))
            p = np.column_stack([np.ones(len(judged)), tail, np.zeros(len(judged))])
            told = p[np.arange(len(judged)), grades[judged]] - p[np.arange(len(judged)), grades[judged] + 1]
            tried.append((-float(np.log(np.maximum(told, 1e-9)).mean()), screen, l2, tail[:, 1]))
    _, screen, l2, p_good = min(tried, key=lambda x: x[:3])
    model, good = fitted(every, screen, l2), np.sort(p_good[grades[judged] == 2])
    if len(good) >= 50:
        model.cut = float(good[int((1 - keep) * len(good))])
    return model


GRADES = "score double, expected_grade double, p_not_toxic double, p_good double"


def _graded(docs: DataFrame, model: OrdinalModel, text_col: str) -> DataFrame:
    """(row, graded): the rows of ``docs`` as one struct, so that no name can clash, and GRADES."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH numbers: 1 MB at any size of the corpus

    @F.pandas_udf(GRADES)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            score = np.array([weights.value.score(t) for t in part])
            tail = weights.value.tails(score) if len(part) else np.zeros((0, 2))
            yield pd.DataFrame({"score": score, "expected_grade": tail.sum(axis=1), "p_not_toxic": tail[:, 0], "p_good": tail[:, 1]})

    return docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")).select("row", run(F.col("text")).alias("graded"))


def grade_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float | None = None) -> DataFrame:
    """``docs`` with ``score``, ``expected_grade`` (0 to 2), ``p_not_toxic``, ``p_good`` and ``accepted``.

    ``accepted``: the tail probability of the upper grade reaches ``cut``, the model's own if None. A null
    or empty text has score 0. Columns of ``docs`` with these names are replaced.
    Rows are graded one by one, so repeated rows and ties in the score get equal
    results, and an empty table an empty one. A text is read whole; a pass takes
    about 20 bytes for each byte of the longest text.
    """
    names = [x.split()[0] for x in GRADES.split(", ")]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in (*names, "accepted")]
    return _graded(docs, model, text_col).select(*kept, *[F.col("graded")[n].alias(n) for n in names], (F.col("graded.p_good") >= (model.cut if cut is None else cut)).alias("accepted"))


def select_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", cut: float | None = None) -> DataFrame:
    """The accepted documents, with the columns of ``docs`` as they are, whatever their names."""
    return _graded(docs, model, text_col).where(F.col("graded.p_good") >= (model.cut if cut is None else cut)).select("row.*")
