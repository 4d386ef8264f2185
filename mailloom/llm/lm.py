"""Scoring by a weighted backoff automaton of smoothed n-grams.

States are the root, one for each training word, and one for each pair of words
that training holds ``STATE_LEAST`` times or more; a state is the longest context read
so far that has one. A state's arcs are the words that follow it in training. What
has no arc follows the failure arc to the state of the context without its first
word and pays its weight. The root has an arc for every training word and one for
unknown words. A text is read once from left to right, starting in the state of the
document's boundary: each token takes an arc (after failure arcs, if need be), adds
its log-probability and sets the next state.

Counts are smoothed by Dirichlet priors: a state of count c gives a word
(n + K * q) / (c + K), n the count of its arc and q the probability of the word in
the failure state; so the failure weight is K / (c + K), and the probabilities of a
state sum to one over the training words and the unknown word. The root discounts
counts and gives what that leaves to the unknown word.

Counts cover all training documents and every n-gram. A chunk of documents keeps
its tokens as numbers of its own words, and fetches just the counts of its words,
pairs and triples (``chunks``); from these it builds the states and arcs that its
texts can reach, so memory is a chunk's, not the corpus's.

The state is settled by the two tokens read last. So a long text is walked in pieces
side by side, each of which first reads the two tokens before it from the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.chunks import QUESTION, packed, parts_for, per_chunk, question, short, summed, unpacked, with_answers
from mailloom.llm.staging import mark, settled, stage, stage_bucketed
from mailloom.llm.textbytes import buffers, lowered, mix64, span_hashes, words_by_text

STATE_LEAST = 2
PAIR_PRIOR, TRIPLE_PRIOR = 32.0, 4.0
CHUNK_BYTES = 12 << 20
PART_TOKENS = 3 << 20
END = np.uint64(0x0E0F0E0F12345677)
HELD = 2
CONTEXT = 2  # tokens that settle a state
PIECE = 256  # tokens


def held_out(ids: list) -> np.ndarray:
    """Whether crc32(id as text) mod 7 is 2; a null id is not held out."""
    return np.array([i is not None and i == i and crc32(str(int(i)).encode()) % 7 == HELD for i in ids], bool)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all tokens: a text's words in lower case (A-Z), then the end."""
    out, owner = [], []
    for at, data, starts in buffers(texts):
        data = lowered(data)
        a, b, first = words_by_text(data, starts)
        out.append(np.insert(span_hashes(data, a, b), first[1:], END))
        owner.append(at + np.repeat(np.arange(len(starts) - 1), np.diff(first) + 1))
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def token_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, n, ids, sizes, words, at): tokens of runs of whole documents, bucketed by chunk.

    ``words`` are a chunk's distinct tokens as ``short`` keys, in order; ``at`` are the places there of all
    its tokens, ``sizes`` the numbers of tokens of its documents.
    """

    def row(chunk: int, ids: list, texts: list[str]) -> pd.DataFrame:
        tok, owner = tokens(texts)
        words, at = np.unique(short(tok), return_inverse=True)
        sizes = np.bincount(owner, minlength=len(texts))
        blobs = {"sizes": [packed(sizes)], "words": [packed(np.diff(words, prepend=np.uint64(0)))], "at": [packed(at)]}
        return pd.DataFrame({"chunk": [chunk], "n": [len(tok)], "ids": [ids], **blobs})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size, made, pid = [], [], 0, 0, 0
        for frame in frames:
            for i, t, pid in zip(frame["id"].astype(object), frame["text"], frame["pid"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t or "")
                size += len(texts[-1]) + 16
                if size >= CHUNK_BYTES:
                    yield row(int(pid) * (1 << 32) + made, ids, texts)
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield row(int(pid) * (1 << 32) + made, ids, texts)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("pid"))
    return stage_bucketed(rows.mapInPandas(run, "chunk long, n long, ids array<long>, sizes binary, words binary, at binary"), "chunk", "zstd")


class Tokens:
    """One row of the token table, with the keys of its pairs and triples."""

    def __init__(self, ids: list, sizes: bytes, words: bytes, at: bytes) -> None:
        self.sizes = unpacked(sizes).astype(np.int64)
        self.words = np.cumsum(unpacked(words), dtype=np.uint64)
        self.at = unpacked(at).astype(np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~held_out(ids), self.sizes)
        self.boundary = int(np.searchsorted(self.words, short(np.array([END], np.uint64)))[0])
        self.before = np.concatenate([self.at[:1], self.at[:-1]])  # the word before each token
        self.before[self.starts] = self.boundary
        left = mix64(self.words + np.uint64(0x9E3779B97F4A7C15))
        self.pairs = mix64(left[self.before] + self.words[self.at])  # 64 bits

    def triples(self, some: np.ndarray) -> np.ndarray:
        """Keys of (the pair before, token) at the given places, none the first of its document."""
        return short(mix64(mix64(self.pairs[some - 1] + np.uint64(0xA24BAED4963EE407)) + self.words[self.at[some]]))

    def places(self, pair_counts: np.ndarray) -> np.ndarray:
        """Tokens read in the state of a pair, from the count of the pair that each token ends."""
        inner = np.ones(len(self.at), bool)
        inner[self.starts] = False
        return np.flatnonzero(inner & (np.concatenate([[0], pair_counts[:-1]]) >= STATE_LEAST))


class Automaton:
    """The states and arcs that the texts of one chunk can reach.

    State 0 is the root, 1 + w that of word w, and those of pairs follow. ``keys`` are the arcs in order,
    each state * ``symbols`` + word, with the log10 probability and the next state of each. The
    failure arc of a state leads to ``fail`` and costs ``penalty``.
    """

    def __init__(self, t: Tokens, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, total: int, vocabulary: int, discount: float) -> None:
        """``words``, ``pairs``, ``triples``: training counts by word, by distinct pair, and by distinct triple read in the state of a pair."""
        self.symbols = len(words)
        _, shown, self.pair_at = np.unique(short(t.pairs), return_index=True, return_inverse=True)
        first, last = t.before[shown].astype(np.int64), t.at[shown].astype(np.int64)
        has_state = (pairs >= STATE_LEAST) & (last != t.boundary)  # nothing follows the end
        pair_state = np.where(has_state, self.symbols + np.cumsum(has_state), 0)
        known = words > 0
        word_state = np.where(known, 1 + np.arange(self.symbols), 0)
        after_pair = np.where(has_state, pair_state, word_state[last])
        by_root = np.where(known, np.maximum(words - discount, 0) / max(1, total), discount * vocabulary / total if total else 1.0)
        by_word = (pairs + PAIR_PRIOR * by_root[last]) / (words[first] + PAIR_PRIOR)
        some = t.places(pairs[self.pair_at])
        at = some[np.unique(t.triples(some), return_index=True)[1]]
        context, ending = self.pair_at[at - 1], self.pair_at[at]
        by_pair = (triples + TRIPLE_PRIOR * by_word[ending]) / (pairs[context] + TRIPLE_PRIOR)
        seen, full = pairs > 0, triples > 0
        keys = np.concatenate([np.arange(self.symbols), (1 + first[seen]) * self.symbols + last[seen], pair_state[context[full]] * self.symbols + t.at[at[full]]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.log10(np.concatenate([by_root, by_word[seen], by_pair[full]]))[order]
        self.to = np.concatenate([word_state, after_pair[seen], after_pair[ending[full]]])[order]
        self.fail = np.concatenate([np.zeros(1 + self.symbols, np.int64), 1 + last[has_state]])
        self.penalty = np.log10(np.concatenate([[1.0], PAIR_PRIOR / (words + PAIR_PRIOR), TRIPLE_PRIOR / (pairs[has_state] + TRIPLE_PRIOR)]))
        self.start = word_state[t.boundary]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, log10 probabilities) of one word read in each state, failure arcs included. The root has an arc for every word."""
        state, gained, todo = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            key = state[todo] * self.symbols + word[todo]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            taken, arc, todo = todo[found], arc[found], todo[~found]
            gained[taken] += self.weight[arc]
            state[taken] = self.to[arc]
            gained[todo] += self.penalty[state[todo]]
            state[todo] = self.fail[state[todo]]
        return state, gained

    def walk(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 probability of each document of ``sizes`` tokens, which are not none; ``at`` holds the words of all, one document after the other."""
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        lead = np.where(nth, CONTEXT, 0)  # tokens read for the state alone
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * PIECE - lead
        length = np.minimum(PIECE, sizes[owner] - nth * PIECE) + lead
        order = np.argsort(-length, kind="stable")
        owner, lead, begin, length = owner[order], lead[order], begin[order], length[order]
        state, total = np.where(lead, 0, self.start), np.zeros(len(owner))
        for i in range(length.max(initial=0)):
            live = np.searchsorted(-length, -i)  # pieces longer than i
            state[:live], gained = self.step(state[:live], at[begin[:live] + i])
            total[:live] += np.where(i >= lead[:live], gained, 0.0)
        return np.bincount(owner, weights=total, minlength=len(sizes))


def _answered(answers: pd.DataFrame, kind: int) -> np.ndarray:
    own = answers[answers["kind"] == kind].sort_values("part")
    return np.concatenate([np.zeros(0, np.int64), *(unpacked(b).astype(np.int64) for b in own["blob"])])


def _sum_parts(asked: DataFrame) -> DataFrame:
    """(kind, chunk, part, value, blob): the sums of each question; rows of kind -1 to -4 hold the words' total and how many occur, once, twice."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, sums, places = summed(frame)
        answers = pd.DataFrame({"kind": frame["kind"], "chunk": frame["chunk"], "part": frame["part"], "value": 0, "blob": [packed(sums[p]) for p in places]})
        if frame["kind"].iloc[0]:
            return answers
        facts = {"kind": [-1, -2, -3, -4], "value": [sums.sum(), (sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum()]}
        return pd.concat([answers, pd.DataFrame({**facts, "chunk": 0, "part": 0, "blob": None})])

    return asked.groupBy("kind", "part").applyInPandas(run, "kind int, chunk long, part long, value long, blob binary")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``score`` is the automaton's log10 probability of the text, ``base_score`` that
    of add-one smoothed words. A null or blank text is the end alone. Without
    training documents every token is unknown. Rows are scored one by one, also
    those that share an id, and each counts in training. A null id is in training.
    Other columns of ``docs`` are not looked at. A text is read whole; a long one
    makes a chunk of its own and needs about 60 bytes for each of its bytes. An
    empty table gives an empty result.
    """
    since = mark()
    table = token_table(docs, id_col, text_col)
    parts = parts_for(table.agg(F.sum("n")).first()[0] or 0, PART_TOKENS)

    def ask_words_and_pairs(chunk: int, n: int, ids: list, *blobs: bytes) -> pd.DataFrame:
        t = Tokens(ids, *blobs)
        words = np.bincount(t.at, weights=t.training, minlength=len(t.words))
        keys, inverse = np.unique(short(t.pairs), return_inverse=True)
        pairs = np.bincount(inverse, weights=t.training, minlength=len(keys))
        return pd.concat([question(chunk, t.words, words, parts), question(chunk, keys, pairs, parts, kind=1)])

    counted = stage(_sum_parts(per_chunk(table, ask_words_and_pairs, QUESTION)), "counts", codec="zstd")
    facts = {r["kind"]: r["n"] for r in counted.where("kind < 0").groupBy("kind").agg(F.sum("value").alias("n")).collect()}
    total, vocabulary, once, twice = (facts.get(-k, 0) for k in (1, 2, 3, 4))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))

    def ask_triples(chunk: int, n: int, ids: list, *rest) -> pd.DataFrame:
        t = Tokens(ids, *rest[:-1])
        some = t.places(_answered(rest[-1], 1)[np.unique(short(t.pairs), return_inverse=True)[1]])
        keys, inverse = np.unique(t.triples(some), return_inverse=True)
        return question(chunk, keys, np.bincount(inverse, weights=t.training[some], minlength=len(keys)), parts, kind=2)

    answers = counted.where("kind >= 0").select("kind", "chunk", "part", "blob")
    triples = stage(_sum_parts(with_answers(table, answers.where("kind = 1"), ask_triples, QUESTION)), "triples", codec="zstd")

    def read(chunk: int, n: int, ids: list, *rest) -> pd.DataFrame:
        t = Tokens(ids, *rest[:-1])
        words, pairs, triples = (_answered(rest[-1], kind) for kind in range(3))
        score = Automaton(t, words, pairs, triples, total, vocabulary, discount).walk(t.at, t.sizes)
        c = words[t.at]
        owner = np.repeat(np.arange(len(t.sizes)), t.sizes)
        sums = {k: np.bincount(owner, weights=v, minlength=len(t.sizes)) for k, v in (("n_known", c > 0), ("base_score", np.log10((c + 1) / (total + vocabulary + 1))))}
        sums["score"] = score
        return pd.DataFrame({"id": pd.array(list(ids), dtype="Int64"), "held_out": held_out(ids), "n_tokens": t.sizes, "train_tokens": total, **sums}).astype({"n_known": np.int64})[SCORES]

    replies = answers.unionByName(triples.select("kind", "chunk", "part", "blob"))
    out = with_answers(table, replies, read, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return settled(out, "lm-scores", since)


SCORES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
