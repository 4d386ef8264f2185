"""Packing along a space-filling curve.

Documents are tokenised and their hashed token vectors are projected to three
dimensions; the Hilbert key of the projection orders them, so that neighbours on
the curve share vocabulary. A range partition by (key, id) sorts the corpus, an
offset per partition places every document in one stream of tokens, and the
stream is cut every ``seq_len`` tokens: only the last sequence is not full.

A document may be cut at a sequence's end. Hot keys (copies) are split by id, so
no partition holds a whole group of equal documents.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.staging import drop_staged, ranges, stage, trim

END = 2
DIMS, BITS = 3, 10
VECTOR = 256
CACHE_WORDS = 250_000
SPLITS_AS = (
    "Sequence(normalizers=[NFC(), Replace(pattern=Regex(\"\\s+\"), content=\" \"), Lowercase()])",
    "Sequence(pretokenizers=[Split(pattern=Regex(\"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+\"), behavior=Removed, invert=True), "
    "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])",
)  # what a vocabulary file must say for words to be looked up one by one
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())

_encoders: dict[str, Words] = {}
_rng = np.random.default_rng(41)
_PROJECT = _rng.standard_normal((VECTOR, DIMS))
_SLOT = _rng.integers(0, VECTOR, 1 << 16)
_SIGN = _rng.choice([-1.0, 1.0], 1 << 16)


def _byte_chars() -> list[str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


_AS_BYTES = dict(enumerate(_byte_chars()))


def default_tokenizer() -> str:
    """The place of the word-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """The ids of words as little-endian words of ``width`` bytes, filled as words are met.

    A tokenizer that drops white space, and whose tokens never span it, gives a
    text the ids of its words. At most ``CACHE_WORDS`` words are kept, and as many
    again of the generation before; a word met in both moves to the new one. For a
    tokenizer that splits otherwise texts are encoded whole.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.encoder, self.before = Tokenizer.from_file(path), {}
        self.by_word = (str(self.encoder.normalizer), str(self.encoder.pre_tokenizer)) == SPLITS_AS
        self.width = 2 if self.encoder.get_vocab_size() <= 1 << 16 else 4

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def run_ids(self, run: str) -> bytes:
        """Ids of one run of letters, one digit or one run of marks, in lower case: the model alone decides."""
        plain = run if run.isascii() else run.encode().decode("latin-1").translate(_AS_BYTES)
        return self.packed([t.id for t in self.encoder.model.tokenize(plain)])

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.word_ids(word)
        self[word] = found
        return found

    def word_ids(self, word: str) -> bytes:
        if "|" in word:  # special tokens hold a bar and have a case
            return self.packed(self.encoder.encode(word, add_special_tokens=False).ids)
        if word.isascii():
            low = word.lower()
            stem = low.rstrip(_MARKS)
            if not stem.isalpha():
                pieces = _PIECES.findall(low)
                return self.run_ids(low) if len(pieces) == 1 else b"".join([self[p] for p in pieces])
        elif max(word) < "\u0250" and "\u0130" not in word:  # lower case is letter by letter and nothing composes
            low = word.lower()
            stem = low.rstrip(_MARKS)
            if not stem.isalpha():
                return self.packed(self.encoder.encode(word, add_special_tokens=False).ids)
        else:
            return self.packed(self.encoder.encode(word, add_special_tokens=False).ids)
        if stem == word:
            return self.run_ids(stem)
        return self[stem] + self[low[len(stem) :]] if len(stem) < len(low) else self[stem]

    def text_ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space in Python only
            return self.packed(self.encoder.encode(text, add_special_tokens=False).ids)
        if len(self) > CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


def words_of(tokenizer: str) -> Words:
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Words(tokenizer)
    return _encoders[tokenizer]


def width_of(tokenizer: str) -> int:
    """Bytes of an id. The vocabulary is not kept: the driver needs no more of it."""
    width = Words(tokenizer).width
    trim()
    return width


def token_ids(texts: list[str | None], tokenizer: str) -> list[bytes]:
    """Ids of each text as little-endian words: of 16 bits, or of 32 for a vocabulary of over 65,536 tokens."""
    words = words_of(tokenizer)
    return [words.text_ids(t) for t in texts]


def hilbert_keys(grid: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert curve positions of points with coordinates below 2**bits, row by row."""
    x = grid.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:  # undo the rotations from the coarsest bit down
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents by their hashed and projected token vectors; no token gives key of the origin."""
    v = np.stack([np.bincount(_SLOT[i & 0xFFFF], weights=_SIGN[i & 0xFFFF], minlength=VECTOR) for i in ids]) if ids else np.zeros((0, VECTOR))
    v = v.astype(np.float64)  # counts of nothing but empty texts are whole numbers
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    z = v @ _PROJECT
    unit = 0.5 + 0.5 * z / np.sqrt(1 + z * z)
    return hilbert_keys(np.minimum((unit * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def pack(docs: DataFrame, tokenizer: str | None = None, seq_len: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Pieces: (id, start, length, doc_tokens, sequence_id, offset, curve_key, ids_crc32, ids), ``ids`` as little-endian words (``token_ids``).

    Each document's ids end with an end-of-text id; each id lies in exactly one
    piece. A null or blank text has that one id. Rows that share an id are placed
    one after the other. ``ids_crc32`` is of the ids as little-endian unsigned
    32-bit words; ``with_ids=False`` leaves out ``ids``. Other columns of ``docs``
    are not looked at. Documents of one curve key lie by id, so ties have a fixed
    order. A long text is one value: its ids take a third of its bytes or so, and
    it spans as many sequences as it needs. An empty table gives an empty result.
    """
    tokenizer = tokenizer or default_tokenizer()
    width = width_of(tokenizer)
    kind = f"<u{width}"
    end = np.array([END], kind).tobytes()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 1000):
                part = frame.iloc[at : at + 1000]
                ids = [b + end for b in token_ids(part["text"].tolist(), tokenizer)]
                trim()
                yield pd.DataFrame({"id": part["id"], "curve_key": curve_keys([np.frombuffer(b[:-width], kind) for b in ids]), "n": [len(b) // width for b in ids], "ids": ids})

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for frame in frames:
            n = frame["n"].to_numpy()
            yield frame.assign(local=at + np.cumsum(n) - n)
            at += int(n.sum())

    def pieces_of(frame: pd.DataFrame) -> pd.DataFrame:
        at, n = frame["at"].to_numpy(), frame["n"].to_numpy()
        first = at // seq_len
        pieces = (at + n - 1) // seq_len - first + 1
        row = np.repeat(np.arange(len(frame)), pieces)
        seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = np.maximum(at[row], seq * seq_len)
        high = np.minimum((at + n)[row], (seq + 1) * seq_len)
        start, ids = low - at[row], frame["ids"].to_numpy()
        own = [ids[r][width * s : width * e] for r, s, e in zip(row, start, start + high - low, strict=True)]
        crc = np.array([zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in own], np.int64)
        out = pd.DataFrame({"id": frame["id"].to_numpy()[row], "start": start, "length": high - low, "doc_tokens": n[row], "sequence_id": seq, "offset": low - seq * seq_len, "curve_key": frame["curve_key"].to_numpy()[row], "ids_crc32": crc})
        return out.assign(ids=own) if with_ids else out

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 1000):
                yield pieces_of(frame.iloc[i : i + 1000])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tokens = stage(rows.mapInPandas(encode, "id long, curve_key long, n long, ids binary"), "tokens")
    parts = ranges(docs.sparkSession, width * (tokens.agg(F.sum("n")).first()[0] or 0))
    ordered = tokens.repartitionByRange(parts, "curve_key", "id").sortWithinPartitions("curve_key", "id", "n", "ids").withColumn("part", F.spark_partition_id())
    placed = stage(ordered.mapInPandas(place, "id long, curve_key long, n long, ids binary, part int, local long"), "placed")
    drop_staged(tokens)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    heads = placed.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("head"))
    return placed.join(F.broadcast(heads), "part").select("id", "curve_key", "n", "ids", (F.col("local") + F.col("head")).alias("at")).mapInPandas(
        cut, "id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve_key long, ids_crc32 long" + ", ids binary" * with_ids
    )
