"""Deduplication of repeated strings by a sparse, distributed suffix array.

A string of ``LENGTH`` bytes that occurs twice contains, at the same offset, the
same anchor: the window's least-hashed run of ``GRAM`` bytes. So only suffixes
that begin at anchors are sorted, about one in 26, and of these only the ones
whose anchor occurs more than once in the corpus.

Suffixes are range-partitioned by splitters that Spark samples from their leading
``GRAM`` bytes. In each bucket a multikey quicksort orders them, some ten thousands
at a time, and the common prefixes of neighbours, together with the bytes left of
the anchor, tell which strings are equal and which is the earliest. Splitters, and
cuts inside a bucket, lie between different anchors, so suffixes on two sides
of a boundary differ within the anchor and no match crosses.

Of equal suffixes with equal bytes on the left, a chunk sends its earliest only;
the others repeat that one. A hot passage thus puts one suffix per chunk and
context into its bucket, however often it occurs.

An anchor of over ``hot`` occurrences, which may stand in as many contexts, has no
bucket: its strings go apart, by their hashes. A chunk sends each string once, with its
earliest place, and the earliest of all is a minimum that Spark sums up before it shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.chunks import QUESTION, chunk_table, parts_for, per_chunk, question, short, summed, text_bytes, with_answers
from mailloom.llm.staging import drop_staged, hot_lookup, mark, settled, stage, trim
from mailloom.llm.textbytes import buffers, mix64, powers, prefix

LENGTH = 100
GRAM = 50
SPAN = LENGTH - GRAM + 1
LEFTS = LENGTH - GRAM + 1
RUN = 50_000


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best() over each ``width`` neighbours: out[i] = best(x[i : i + width])."""
    out, have = x, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of a buffer's texts, each of which is followed by one byte that is not its own."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p = prefix(data)
    h = mix64((p[GRAM:] - p[:-GRAM]) * powers(len(data))[1][: len(data) - GRAM + 1]) | np.uint64(1)
    least = sliding(h, SPAN, np.minimum)  # of each window of LENGTH bytes
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ends = starts[1:][text] - 1
    at = np.arange(len(least))
    least[at + LENGTH > ends[: len(least)]] = 0
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    most = sliding(padded, SPAN, np.maximum)
    places = np.flatnonzero(most == h)
    return places, h[places]


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words by three-way partition on one word after the other."""
    out, stack = [], [(np.arange(len(words)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows):
            continue
        if len(rows) <= 4096 or depth == words.shape[1] - 1:
            rest = words[rows, depth:]
            out.append(rows[np.lexsort(rest.T[::-1])])
            continue
        column = words[rows, depth]
        pivot = np.partition(column[:: max(1, len(column) // 99)], len(column[:: max(1, len(column) // 99)]) // 2)[len(column[:: max(1, len(column) // 99)]) // 2]
        stack.append((rows[column > pivot], depth))
        equal = rows[column == pivot]
        if depth + 1 < words.shape[1]:
            stack.append((equal, depth + 1))
        else:
            out.append(equal)
        stack.append((rows[column < pivot], depth))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def repeats_in_bucket(right: list[bytes], left: list[bytes], rank: np.ndarray) -> np.ndarray:
    """For each suffix a bit mask: bit k says that the string from k bytes left of the anchor occurs earlier (by ``rank``).

    ``right`` are up to LENGTH bytes from the anchor on, ``left`` up to LENGTH - GRAM bytes before it.
    """
    n = len(right)
    r_len, l_len = np.array([len(x) for x in right]), np.array([len(x) for x in left])
    wide = np.frombuffer(b"".join(x.ljust(104, b"\0") for x in right), np.uint8).reshape(n, 104)
    order = multikey_quicksort(wide.view(">u8").astype(np.uint64))
    wide, r_len, l_len, rank = wide[order], r_len[order], l_len[order], rank[order]
    before = np.frombuffer(b"".join(left[i].rjust(LEFTS - 1, b"\0") for i in order), np.uint8).reshape(n, LEFTS - 1)
    differ = wide[1:, :LENGTH] != wide[:-1, :LENGTH]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    masks, h = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for k in range(LEFTS):
        if k:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + before[:, LEFTS - 1 - k] + np.uint64(1))
        run = np.concatenate([[0], np.cumsum(common < LENGTH - k)]).astype(np.uint64)
        ok = np.flatnonzero((r_len >= LENGTH - k) & (l_len >= k))
        if len(ok) < 2:
            continue
        key = mix64(h[ok] + run[ok] * np.uint64(0xA24BAED4963EE407))
        by = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.diff(key[by], prepend=key[by[:1]] + np.uint64(1)) != 0)
        first = np.minimum.reduceat(rank[ok][by], edge)
        size = np.diff(edge, append=len(by))
        later = rank[ok][by] > np.repeat(first, size)
        masks[ok[by[later]]] |= np.uint64(1) << np.uint64(k)
    out = np.empty(n, np.uint64)
    out[order] = masks
    return out


def _windows(places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Starts of the strings that masks name."""
    bits = (masks[:, None] >> np.arange(LEFTS, dtype=np.uint64)) & np.uint64(1)
    row, k = np.nonzero(bits)
    return places[row] - k


def spans_of(size: int, windows: np.ndarray) -> np.ndarray:
    """Maximal covered runs [start, end) of a text with strings removed from the given starts."""
    if not len(windows):
        return np.zeros((0, 2), np.int64)
    w = np.unique(windows)
    fresh = np.flatnonzero(np.diff(w, prepend=w[0] - LENGTH - 1) > LENGTH)
    last = np.append(fresh[1:] - 1, len(w) - 1)
    return np.stack([w[fresh], w[last] + LENGTH], axis=1)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = 20_000) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept_sha256): one row per document.

    A byte is removed when a string of 100 bytes that covers it also starts
    earlier: in a document of smaller id, or further left in the same. ``spans``
    lists start and end of each removed run. A null text is empty. Rows that
    share an id come in a fixed order of their own. Null ids come last. Other columns
    of ``docs`` are not looked at. An empty table gives an empty result. Memory: 60
    bytes for each byte of the longest text.
    """
    since = mark()
    table = chunk_table(docs, id_col, text_col, chunk_bytes=2 << 20, codec="zstd")
    parts = parts_for(text_bytes(table), 16 << 20)

    def all_anchors(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the text, hash) of a chunk's anchors."""
        text, place, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for at, data, starts in buffers(texts, 1 << 18):
            p, h = anchors(data, starts)
            t = np.searchsorted(starts, p, side="right") - 1
            text.append(t + at)
            place.append(p - starts[t])
            hashes.append(h)
        return np.concatenate(text), np.concatenate(place), np.concatenate(hashes)

    def ask(chunk: int, ids: list, texts: list) -> pd.DataFrame:
        _, _, h = all_anchors(texts)
        keys, counts = np.unique(short(h), return_counts=True)
        return question(chunk, keys, counts, parts)

    asked = stage(per_chunk(table, ask, QUESTION), "anchors", rows=1)

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        _, sums, places = summed(frame)
        return pd.DataFrame({"chunk": frame["chunk"], "part": frame["part"], "n": [len(p) for p in places], "blob": [np.packbits(sums[p] > 1).tobytes() for p in places], "hot": [np.packbits(sums[p] > hot).tobytes() if (sums[p] > hot).any() else b"" for p in places]})

    replied = stage(asked.groupBy("part").applyInPandas(answer, "chunk long, part long, n long, blob binary, hot binary"), "repeated")
    drop_staged(asked)

    def emit(chunk: int, ids: list, texts: list, answers: pd.DataFrame) -> pd.DataFrame:
        text, place, h = all_anchors(texts)
        own = answers.sort_values("part")
        bits = lambda b, n: np.unpackbits(np.frombuffer(b or bytes(n // 8 + 1), np.uint8), count=n).astype(bool)
        _, inverse = np.unique(short(h), return_inverse=True)
        again, often = (np.concatenate([np.zeros(0, bool), *(bits(b, n) for b, n in zip(own[c], own["n"], strict=True))])[inverse] for c in ("blob", "hot"))
        text, place, often = text[again], place[again], often[again]
        order = np.array([(1 << 62) if i is None or i != i else int(i) for i in ids], np.int64)
        go = np.lexsort((place, text, order[text])) if len(text) else np.zeros(0, np.int64)
        raw = {t: texts[t].encode("utf-8", "surrogatepass") for t in np.unique(text).tolist()}
        seen: dict[bytes, int] = {}
        rows, copies, strings, windows, done = [], [], {}, [], set()
        for t, p, many in zip(text[go].tolist(), place[go].tolist(), often[go].tolist(), strict=True):
            b = raw[t]
            if many:
                for w in range(max(0, p - LEFTS + 1), min(p, len(b) - LENGTH) + 1):
                    if (t, w) not in done:
                        done.add((t, w))
                        digest = hashlib.blake2b(b[w : w + LENGTH], digest_size=16).digest()
                        first = strings.get(digest)
                        if first is None or (int(order[t]), t, w) < first:
                            strings[digest], first = (int(order[t]), t, w), first
                            if first is not None:
                                windows.append(first[1:])
                        else:
                            windows.append((t, w))
                continue
            right, left = b[p : p + LENGTH], b[max(0, p - LEFTS + 1) : p]
            context = hashlib.blake2b(right + b"|" + left, digest_size=12).digest() + bytes([len(left)])
            if context in seen:
                copies.append((t, p))
            else:
                seen[context] = p
                rows.append((right, left, int(order[t]), t, p))
        out = pd.DataFrame({"kind": 0, "right": [r[0] for r in rows], "left": [r[1] for r in rows], "lead": [int.from_bytes(r[0][:7], "big") for r in rows], "id": [r[2] for r in rows], "text": [r[3] for r in rows], "place": [r[4] for r in rows], "chunk": chunk})
        local = pd.DataFrame({"kind": 1, "right": [np.array(copies, "<u4").tobytes()], "left": [np.array(windows, "<u4").tobytes()], "lead": 0, "id": 0, "text": 0, "place": 0, "chunk": chunk})
        at = list(strings.values())
        apart = pd.DataFrame({"kind": 2, "right": list(strings), "left": b"", "lead": 0, "id": [x[0] for x in at], "text": [x[1] for x in at], "place": [x[2] for x in at], "chunk": chunk})
        return pd.concat([x for x in (out, local, apart) if len(x)], ignore_index=True)

    sent = stage(with_answers(table, replied, emit, "kind int, right binary, left binary, lead long, id long, text long, place long, chunk long"), "suffixes", codec="zstd")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        rank = np.empty(len(frame), np.int64)
        rank[np.lexsort((frame["place"], frame["text"], frame["chunk"], frame["id"]))] = np.arange(len(frame))
        masks = repeats_in_bucket(frame["right"].tolist(), frame["left"].tolist(), rank)
        hit = masks != 0
        return pd.DataFrame({"chunk": frame["chunk"][hit], "kind": 0, "text": frame["text"][hit], "place": frame["place"][hit], "mask": masks[hit].view(np.int64), "blob": None})

    def bucket(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        need = RUN
        for frame in frames:
            kept.append(frame)
            if sum(map(len, kept)) < need:
                continue
            joined = pd.concat(kept, ignore_index=True)
            last = joined["right"].iloc[-1][:GRAM]
            cut = len(joined)
            while cut and joined["right"].iat[cut - 1][:GRAM] == last:
                cut -= 1
            kept = [joined.iloc[cut:]]
            need = max(RUN, 2 * (len(joined) - cut))
            if cut:
                yield compare(joined.iloc[:cut])
        if kept and sum(map(len, kept)):
            yield compare(pd.concat(kept, ignore_index=True))
        trim()

    suffixes = sent.where("kind = 0").select("lead", "right", "left", "id", "text", "place", "chunk")
    order = ["lead", F.substring("right", 1, GRAM)]
    bucketed = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    masks = bucketed.select("right", "left", "id", "text", "place", "chunk").mapInPandas(bucket, "chunk long, kind int, text long, place long, mask long, blob binary")
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    local = sent.where("kind = 1").select("chunk", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("right").alias("blob")), F.struct(F.lit(2).alias("kind"), F.col("left").alias("blob")))).alias("l"))
    local = local.select("chunk", "l.kind", zero.alias("text"), zero.alias("place"), zero.alias("mask"), "l.blob")
    strings = sent.where("kind = 2").select(F.col("right").alias("string"), F.struct("id", "chunk", "text", "place").alias("at"))
    least = strings.groupBy("string").agg(F.min("at").alias("least"), F.count("*").alias("chunks")).where("chunks > 1")
    least = stage(least, "hot-strings")
    later = hot_lookup(strings, least, "string", "chunks", max(1, strings.count()))
    later = later.where("least is not null and at > least").select("at.chunk", F.lit(3).alias("kind"), "at.text", "at.place", zero.alias("mask"), none.alias("blob"))

    def finish(chunk: int, ids: list, texts: list, answers: pd.DataFrame) -> pd.DataFrame:
        own = answers[answers["kind"] == 0]
        text, place, mask = own["text"].to_numpy(), own["place"].to_numpy(), own["mask"].to_numpy().view(np.uint64)
        pairs = lambda kind: np.frombuffer(b"".join(answers["blob"][answers["kind"] == kind]), "<u4").astype(np.int64).reshape(-1, 2)
        copies, windows = pairs(1), np.concatenate([pairs(2), answers.loc[answers["kind"] == 3, ["text", "place"]].to_numpy(np.int64)])
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(b) for b in raw], np.int64)
        k = np.arange(LEFTS)
        full = (k <= copies[:, 1:]) & (copies[:, 1:] - k + LENGTH <= size[copies[:, :1]])
        row, left = np.nonzero(full)
        bits = (mask[:, None] >> k.astype(np.uint64)) & np.uint64(1)
        row2, left2 = np.nonzero(bits)
        owner = np.concatenate([copies[row, 0], text[row2], windows[:, 0]])
        begin = np.concatenate([copies[row, 1] - left, place[row2] - left2, windows[:, 1]])
        by = np.argsort(owner, kind="stable")
        at = np.searchsorted(owner[by], np.arange(len(raw) + 1))
        out = []
        for i, b in enumerate(raw):
            spans = spans_of(len(b), begin[by[at[i] : at[i + 1]]])
            kept, pos = hashlib.sha256(), 0
            for s, e in spans.tolist():
                kept.update(b[pos:s])
                pos = e
            kept.update(b[pos:])
            out.append((len(b), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), spans.ravel(), kept.hexdigest()))
        return pd.DataFrame({"id": pd.array(ids, dtype="Int64"), "n_bytes": [o[0] for o in out], "n_removed": [o[1] for o in out], "n_spans": [o[2] for o in out], "spans": [o[3] for o in out], "kept_sha256": [o[4] for o in out]})

    out = with_answers(table, masks.unionByName(local).unionByName(later), finish, "id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string")
    return settled(out, "kept-spans", since)
