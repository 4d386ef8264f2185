"""A corpus in chunks, and questions that chunks put to a key-partitioned table.

A chunk is one row of some megabytes of whole texts. The chunk table is bucketed
by chunk number, so that answers are joined to it without moving the texts again.

A chunk asks about its distinct keys, 56 bits of a hash, which are sent in order as
differences. Keys are cut by their leading bits into parts; the rows of one part meet in one group, which sums the numbers that
chunks have sent and answers each chunk in the order of its question. An answer
need not repeat the keys, and a hot key is one entry in each chunk at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.staging import stage_bucketed, trim


def chunk_table(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int = 4 << 20, codec: str = "snappy") -> DataFrame:
    """(chunk, ids, texts): rows of whole texts that reach ``chunk_bytes``, bucketed by chunk."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, texts, size, made, pid = [], [], 0, 0, 0
        for frame in frames:
            for i, t, pid in zip(frame["id"].astype(object), frame["text"], frame["pid"], strict=True):
                ids.append(None if pd.isna(i) else int(i))
                texts.append(t or "")
                size += len(texts[-1]) + 16
                if size >= chunk_bytes:
                    yield pd.DataFrame({"chunk": [int(pid) * (1 << 32) + made], "ids": [ids], "texts": [texts]})
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield pd.DataFrame({"chunk": [int(pid) * (1 << 32) + made], "ids": [ids], "texts": [texts]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("pid"))
    return stage_bucketed(rows.mapInPandas(run, "chunk long, ids array<long>, texts array<string>"), "chunk", codec)


def parts_for(size: int, per_part: int) -> int:
    """A power of two: one part of keys for each ``per_part`` of ``size``, 8 at least."""
    return 1 << max(3, (size // per_part).bit_length())


def text_bytes(table: DataFrame) -> int:
    """Bytes of all texts of a chunk table."""
    return table.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t)))).first()[0] or 0


KEY_BITS = 56


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as the planes of their bytes, without the planes that are zero throughout."""
    planes = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return bytes([planes]) + len(x).to_bytes(4, "little") + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpacked(b: bytes) -> np.ndarray:
    """The numbers of ``packed``."""
    planes, n = b[0], int.from_bytes(b[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :planes] = np.frombuffer(b, np.uint8, offset=5).reshape(planes, n).T
    return out.reshape(-1).view("<u8")


def short(hashes: np.ndarray) -> np.ndarray:
    """Keys of KEY_BITS bits from hashes of 64."""
    return hashes >> np.uint64(64 - KEY_BITS)


def question(chunk: int, keys: np.ndarray, numbers: np.ndarray, parts: int, kind: int = 0) -> pd.DataFrame:
    """Rows (kind, part, chunk, keys, numbers) of one chunk's sorted distinct ``short`` keys with a number for each."""
    width = KEY_BITS - (parts.bit_length() - 1)
    edges = np.arange(parts, dtype=np.uint64) << np.uint64(width)
    at = np.append(np.searchsorted(keys, edges), len(keys))
    full = np.flatnonzero(np.diff(at))
    blobs = [packed(np.diff(keys[at[i] : at[i + 1]], prepend=edges[i])) for i in full]
    return pd.DataFrame({"kind": kind, "part": full, "chunk": chunk, "keys": blobs, "numbers": [packed(numbers[at[i] : at[i + 1]].astype(np.uint64)) for i in full]})


QUESTION = "kind int, part long, chunk long, keys binary, numbers binary"


def summed(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys less the part's first, sums, places of each row's keys) of one part."""
    each = [np.cumsum(unpacked(b), dtype=np.uint64) for b in frame["keys"]]
    keys, inverse = np.unique(np.concatenate(each), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, inverse, np.concatenate([unpacked(b) for b in frame["numbers"]]).astype(np.int64))
    return keys, sums, np.split(inverse, np.cumsum([len(x) for x in each])[:-1])


def per_chunk(table: DataFrame, run: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``run(*row)``, a frame of rows, for each chunk."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                yield run(*row)
            trim()

    return table.mapInPandas(each, schema)


def with_answers(table: DataFrame, answers: DataFrame, run: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """``run(*row, answers)``, a frame of rows, for each chunk and its answers."""

    def each(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [run(*row, right) for row in left.itertuples(index=False, name=None)]
        trim()
        return pd.concat(out) if out else pd.DataFrame({x.strip().split()[0]: [] for x in schema.split(",")})

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(each, schema)
