"""Words and 64-bit hashes of many texts at once, on one byte buffer in numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D. Hashes are polynomial
over a table of random odd multipliers and are finished by a mixer. Memory is
about 50 bytes for each byte of a buffer; a buffer holds ``limit`` bytes or one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    ahead, back = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 2**64), np.uint64)
    ahead[0] = back[0] = 1
    return np.multiply.accumulate(ahead), np.multiply.accumulate(back)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first ``n`` powers and their inverses."""
    size = 1 << max(16, (n - 1).bit_length())
    ahead, back = _powers(size)
    return ahead[:n], back[:n]


def prefix(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the hash of data[i:j] times base**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each data[start:end]."""
    p = prefix(data)
    raw = (p[ends] - p[starts]) * powers(len(data) + 1)[1][starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def buffers(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, bytes, starts) for runs of texts; each text is followed by one space, ``starts`` has one entry more."""
    at, size, part = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if part and size + len(raw) > limit:
            yield at, *_joined(part)
            at, size, part = i, 0, []
        part.append(raw)
        size += len(raw) + 1
    if part:
        yield at, *_joined(part)


def _joined(part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.zeros(len(part) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in part], out=starts[1:])
    return np.frombuffer(b" ".join(part) + b" ", np.uint8), starts


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer, which ends with a space."""
    letter = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(letter, prepend=False))
    return edge[::2], edge[1::2]


def words_by_text(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and for each text the number of the first of its words (one entry more)."""
    a, b = word_spans(data)
    return a, b, np.searchsorted(a, starts)
