"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded
sample of labelled texts: ``per_lang`` documents of each language, ``windows``
windows of each. Every byte of every text is then labelled: a text is cut into
windows of ``WINDOW`` bytes, both directions run over each window, each position
gets language probabilities, and their mean over the text's bytes decides.

Gates use x / (1 + |x|) in place of tanh, and half of it plus a half in place of
the logistic function. Arrays hold one window per column, so that a step over
thousands of windows is one small matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.staging import crc_mod

HIDDEN = 8
WINDOW = 256
LANES = 2048
TRAIN_WINDOW = 64
UNKNOWN = "und"


def _soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class ByteNet:
    """Parameters by name: for each direction d byte gates ``e{d}`` and recurrent gates ``u{d}``; ``w``, ``b`` of the output."""

    langs: list[str]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 5) -> ByteNet:
        rng = np.random.default_rng(seed)
        shape = {"e0": (3 * hidden, 256), "e1": (3 * hidden, 256), "u0": (3 * hidden, hidden), "u1": (3 * hidden, hidden), "w": (len(langs), 2 * hidden), "b": (len(langs), 1)}
        return cls(langs, {k: (rng.standard_normal(s) * (0 if k == "b" else 0.3)).astype(np.float32) for k, s in shape.items()})

    def run(self, x: np.ndarray, d: int, mask: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """States [time, hidden, lane] of one direction over bytes x [time, lane]."""
        e, u = self.p[f"e{d}"], self.p[f"u{d}"]
        k = u.shape[1]
        out = np.empty((len(x), k, x.shape[1]), np.float32)
        h = np.zeros((k, x.shape[1]), np.float32)
        for t in range(len(x)) if d == 0 else range(len(x) - 1, -1, -1):
            a, g = e.take(x[t], axis=1), u @ h
            rz = _soft(a[: 2 * k] + g[: 2 * k])
            rz *= 0.5
            rz += 0.5
            n = _soft(a[2 * k :] + rz[:k] * g[2 * k :])
            if keep is not None:
                keep.append((t, h, rz, n, g[2 * k :]))
            h = n + rz[k:] * (h - n)
            if mask is not None:
                h *= mask[t]
            out[t] = h
        return out

    def positions(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Language probabilities [language, time, lane] at every byte."""
        both = np.concatenate([self.run(x, 0, mask), self.run(x, 1, mask)], axis=1)
        z = np.einsum("ck,tkb->ctb", self.p["w"], both, optimize=True) + self.p["b"][:, :, None]
        z = np.exp(z - z.max(axis=0))
        return z / z.sum(axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, back through time. x [time, lane], y [lane]."""
        kept: list[list] = [[], []]
        both = np.concatenate([self.run(x, d, None, kept[d]) for d in (0, 1)], axis=1)
        z = np.einsum("ck,tkb->ctb", self.p["w"], both) + self.p["b"][:, :, None]
        z = np.exp(z - z.max(axis=0))
        z /= z.sum(axis=0)
        lanes = np.arange(x.shape[1])
        loss = float(-np.log(np.maximum(z[y, :, lanes], 1e-9)).mean())
        z[y, :, lanes] -= 1
        z /= x.size
        grad = {"w": np.einsum("ctb,tkb->ck", z, both), "b": z.sum(axis=(1, 2))[:, None]}
        back = np.einsum("ck,ctb->tkb", self.p["w"], z)
        k = HIDDEN if "u0" not in self.p else self.p["u0"].shape[1]
        for d in (0, 1):
            u = self.p[f"u{d}"]
            de, du = np.zeros_like(self.p[f"e{d}"]), np.zeros_like(u)
            dh = np.zeros((k, x.shape[1]), np.float32)
            for t, h, rz, n, un in reversed(kept[d]):
                dh = dh + back[t, d * k : (d + 1) * k]
                r, q = rz[:k], rz[k:]
                da = np.empty((3 * k, x.shape[1]), np.float32)
                da[2 * k :] = dh * (1 - q) * (1 - np.abs(n)) ** 2
                da[:k] = da[2 * k :] * un * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                da[k : 2 * k] = dh * (h - n) * 0.5 * (1 - np.abs(2 * q - 1)) ** 2
                de += da @ (x[t][:, None] == np.arange(256)).astype(np.float32)
                da[2 * k :] *= r
                du += da @ h.T
                dh = dh * q + u.T @ da
            grad[f"e{d}"], grad[f"u{d}"] = de, du
        return loss, grad


def train(texts: list[bytes], langs: list[str], steps: int = 400, lanes: int = 256, rate: float = 0.01, seed: int = 5) -> ByteNet | None:
    """A network fitted by Adam on windows of the given texts; None without any."""
    samples = [(t[i : i + TRAIN_WINDOW], g) for t, g in zip(texts, langs, strict=True) for i in range(0, max(1, len(t) - TRAIN_WINDOW + 1), TRAIN_WINDOW)]
    samples = [((s * TRAIN_WINDOW)[:TRAIN_WINDOW] if len(s) < TRAIN_WINDOW else s, g) for s, g in samples if s]
    if not samples:
        return None
    names = sorted({g for _, g in samples})
    x = np.frombuffer(b"".join(s for s, _ in samples), np.uint8).reshape(-1, TRAIN_WINDOW)
    y = np.array([names.index(g) for _, g in samples])
    net, rng = ByteNet.fresh(names, seed=seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(x), lanes)
        _, grad = net.gradients(x[pick].T.copy(), y[pick])
        now = rate * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: ByteNet, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities [text, language] over all bytes of each text; an empty text has zeros."""
    size = np.array([len(t) for t in texts], np.int64)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    base = np.cumsum(size) - size
    start = base[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
    length = np.minimum(WINDOW, (base + size)[owner] - start)
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    total = np.zeros((len(texts), len(net.langs)))
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), LANES):
        part = order[at : at + LANES]
        time = int(length[part[0]])
        x = data[start[part] + np.arange(time)[:, None]]
        mask = None if length[part[-1]] == time else (np.arange(time)[:, None] < length[part]).astype(np.float32)
        prob = net.positions(x, mask)
        sums = prob.sum(axis=1) if mask is None else (prob * mask).sum(axis=1)
        np.add.at(total, owner[part], sums.T)
    return total / np.maximum(size, 1)[:, None]


def training_sample(docs: DataFrame, per_lang: int, windows: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, part): windows of 192 characters of at most ``per_lang`` texts with a letter in each language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.coalesce(crc_mod(id_col, 4), F.lit(0)) != 2))
    text_hash = F.xxhash64(text_col)
    marks = known.select(F.col(lang_col).alias("__lang"), F.col(id_col).alias("__id"), text_hash.alias("__h"))
    order = [F.xxhash64("__id", "__h"), "__id", "__h"]  # equal rows have one rank
    near = Window.partitionBy("__lang", F.pmod(F.xxhash64("__id", "__h"), F.lit(64))).orderBy(*order)
    best = marks.withColumn("__r", F.dense_rank().over(near)).where(F.col("__r") <= per_lang).dropDuplicates(["__lang", "__id", "__h"])
    best = best.withColumn("__r", F.row_number().over(Window.partitionBy("__lang").orderBy(*order))).where(F.col("__r") <= per_lang).drop("__r")
    same = (F.col(lang_col) == F.col("__lang")) & F.col(id_col).eqNullSafe(F.col("__id")) & (text_hash == F.col("__h"))
    chosen = known.select(id_col, text_col, lang_col).join(F.broadcast(best), same)  # per_lang rows of each language
    part = chosen.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(windows))))
    at = F.pmod(F.xxhash64(id_col, "__k"), F.greatest(F.lit(1), F.length(text_col) - 192)) + 1
    return part.select(F.col(lang_col).alias("lang"), F.substring(F.col(text_col), at.cast("int"), F.lit(192)).alias("part"), id_col, text_hash.alias("__h"), "__k").dropDuplicates(["lang", id_col, "__h", "__k"]).select("lang", "part").orderBy("lang", "part")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, windows: int = 4, steps: int = 400) -> DataFrame:
    """(id, held_out, lang_pred, score) for every document.

    Learns from documents with a language whose crc32(id as text) mod 4 is not 2;
    the rest are held out. ``score`` is the mean probability of the language
    predicted. A null text, one without a letter, or any text when nothing could
    be learned, is ``und`` with score 0. A null id is not held out. Repeated rows
    count once in the sample and get equal results; of languages with one
    probability the first by name is predicted. Other columns are not looked at. An
    empty table gives an empty result. A pass needs about 50 bytes of memory for
    each byte of the longest text.
    """
    seen = training_sample(docs, per_lang, windows, id_col, text_col, lang_col).toPandas()
    net = train([p.encode("utf-8", "surrogatepass") for p in seen["part"]], seen["lang"].tolist(), steps)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # 60 KB

    @F.pandas_udf("lang_pred string, score double")
    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            names, scores = [], []
            at = 0
            while at < len(raw) and sent.value is not None:  # about 4 MB of text at a time
                end, size = at, 0
                while end < len(raw) and (end == at or size + len(raw[end]) <= 4 << 20):
                    size += len(raw[end])
                    end += 1
                prob = pooled(sent.value, raw[at:end])
                best = prob.argmax(axis=1)
                names += [sent.value.langs[i] for i in best]
                scores += prob[np.arange(len(best)), best].tolist()
                at = end
            if sent.value is None:
                names, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object), "score": pd.Series(scores, dtype=float)})

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False)).alias("held_out"), letter.alias("__letter"), label(F.col(text_col)).alias("__l"))
    return out.select("id", "held_out", F.when(F.col("__letter"), F.col("__l.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("__letter"), F.least(F.lit(1.0), F.col("__l.score"))).otherwise(0.0).alias("score"))
