"""Evaluation passages inside training text.

Pigeonhole edit matching: a passage of ``window`` words is split into
``errors`` + 1 pieces, so a text that holds the passage with at most ``errors``
word edits holds one piece unchanged. What is left of the passage is split into
``errors`` + 1 parts once more, so one of these is unchanged too, at most
``errors`` words from its place: piece and part together are the key by which
texts and items meet, and phrases that very many texts hold meet nothing. Texts
are scanned once: only keys that may be items' keys (told by bit tables of
bounded size, which let none of them slip) go on with the words around them.
Each meeting is verified with Myers' bit-parallel distance.

Every ``window`` words of an item are a passage of their own, so partial leaks
count. Neither items nor texts ever come to the driver; pieces that very many
texts hold are salted.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrail.session import ROWS_PER_TASK, cut_lineage, salted_join

WINDOW = 12
ERRORS = 1
#: Bits of the table of pieces: sixteen a piece within these bounds (8 MB at most). Beyond them more hits are checked in vain.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 26
_CHUNK = 1 << 13

#: Words that a worker scans together; a longer text is scanned by itself.
WORDS_AT_ONCE = 100_000
_BETWEEN = ["\n"]

_WORD = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []


def myers(pattern: list[str], text: list[str], most: int) -> tuple[int, int]:
    """Least edits from ``pattern`` to any stretch of ``text``, and where that stretch ends.

    Bit-parallel: one bit for each word of the pattern. Returns ``most`` + 1 if
    no stretch is that near.
    """
    m = len(pattern)
    at: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        at[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = min((most + 1, -1), (m, 0))  # an empty stretch costs the whole pattern
    for j, w in enumerate(text):
        eq = at.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


class _Hashes(dict):
    """Hashes of words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = crc32(word.encode())
        return value


_hashes = _Hashes()


def piece_hashes(words: list[str], length: int) -> np.ndarray:
    """Hashes of every ``length`` words that follow each other, by their start."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, np.int64)
    one = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    total = np.full(n, length, np.uint64)
    for k in range(length):
        total = (total ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def spans(window: int, errors: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """The pieces of a passage: start, length, and the parts of the rest as (start from the piece's start, length)."""
    cuts = [window * i // (errors + 1) for i in range(errors + 2)]
    out = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        rest, parts = window - (b - a), []
        for low, high in ((0, a), (b, window)):
            many = min(high - low, -(-(errors + 1) * (high - low) // max(rest, 1)))
            marks = [low + (high - low) * i // max(many, 1) for i in range(many + 1)]
            parts += [(x - a, y - x) for x, y in zip(marks, marks[1:], strict=False)]
        out.append((a, b - a, parts if len(parts) > errors else []))
    return out


def meeting_keys(piece: np.ndarray, part: np.ndarray | None, at: int, which: int) -> np.ndarray:
    """Keys of pieces, the ``at``-th of their passage, with one part of the rest."""
    key = (piece.view(np.uint64) ^ np.uint64(at * 64 + which + 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    if part is not None:
        key = ((key ^ (key >> np.uint64(31))) ^ part.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(29))).view(np.int64)


def passages(items: DataFrame, window: int, errors: int) -> DataFrame:
    """(``piece``, ``key``, ``item_id``, ``item_start``, ``passage``): each passage by all keys that a text may meet it with."""
    pieces = spans(window, errors)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item_id"], frame["text"], strict=True):
                words = text_words(text)
                starts = np.arange(len(words) - window + 1)
                if not len(starts):
                    continue
                passage = [" ".join(words[i : i + window]) for i in starts]
                for k, (a, n, parts) in enumerate(pieces):
                    piece = piece_hashes(words, n)[starts + a]
                    for m, part in enumerate(parts or [None]):
                        other = piece_hashes(words, part[1])[starts + a + part[0]] if part else None
                        key = meeting_keys(piece, other, k, m)
                        yield pd.DataFrame({"piece": piece, "key": key, "item_id": item, "item_start": starts, "passage": passage})

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null")
    return rows.mapInPandas(cut, "piece bigint, key bigint, item_id bigint, item_start int, passage string")


def bit_table(rows: DataFrame, column: str) -> np.ndarray:
    """Bits of all hashes in a column, packed into bytes; chunks are packed by tasks."""
    count = rows.select(column).distinct().count()
    bits = LEAST_BITS
    while bits < MOST_BITS and bits < 16 * count:
        bits *= 2
    place = F.pmod(column, F.lit(bits))
    chunks = rows.select(F.shiftright(place, 13).alias("chunk"), place.bitwiseAND(_CHUNK - 1).cast("int").alias("bit")).distinct()

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(_CHUNK, bool)  # at most so many rows a chunk
        held[frame["bit"].to_numpy()] = True
        return pd.DataFrame({"chunk": [key[0]], "packed": [np.packbits(held).tobytes()]})

    table = np.zeros(bits // 8, np.uint8)
    for row in chunks.groupBy("chunk").applyInPandas(pack, "chunk bigint, packed binary").toLocalIterator():
        start = row["chunk"] * _CHUNK // 8
        table[start : start + _CHUNK // 8] = np.frombuffer(bytes(row["packed"]), np.uint8)
    return table


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.uint64) & np.uint64(len(table) * 8 - 1)
    return (table[place >> np.uint64(3)] & (128 >> (place & np.uint64(7)).astype(np.uint8))) > 0


def text_hits(documents: DataFrame, pieces: np.ndarray, keys: np.ndarray, window: int, errors: int) -> DataFrame:
    """(``doc_id``, ``key``, ``before``, ``near``) of keys of texts that may be items' keys.

    ``near`` are the words that a passage met there can reach, ``before`` how
    many of them stand before its start if nothing was put in or left out.
    """
    held = documents.sparkSession.sparkContext.broadcast((pieces, keys))
    parted = spans(window, errors)
    lengths = {n for _, n, _ in parted}

    def lot_hits(docs: list[int], starts: list[int], words: list[str]) -> pd.DataFrame:
        """Hits of many texts' words, one text after another."""
        known_pieces, known_keys = held.value
        hashes = {n: piece_hashes(words, n) for n in lengths}
        out = []
        for k, (a, n, parts) in enumerate(parted):
            at = np.flatnonzero(_held(known_pieces, hashes[n]))
            for m, part in enumerate(parts or [None]) if len(at) else ():
                if part and part[1] not in hashes:
                    hashes[part[1]] = piece_hashes(words, part[1])
                for shift in range(-errors, errors + 1) if part else (0,):
                    start, other = at, None
                    if part:
                        there = at + part[0] + shift
                        fits = (there >= 0) & (there < len(hashes[part[1]]))
                        start, other = at[fits], hashes[part[1]][there[fits]]
                    key = meeting_keys(hashes[n][start], other, k, m)
                    found = _held(known_keys, key)
                    out.append((start[found], start[found] - a, key[found]))
        none = np.zeros(0, np.int64)
        start, first, keys = (np.concatenate([none, *column]) for column in (zip(*out, strict=True) if out else ([], [], [])))
        low = np.maximum(first - errors, 0)
        of_doc = np.array(docs, np.int64)[np.searchsorted(starts, start, side="right") - 1]
        near = [" ".join(words[i : j + window + errors]) for i, j in zip(low.tolist(), first.tolist(), strict=True)]
        return pd.DataFrame({"doc_id": of_doc, "key": keys, "before": first - low, "near": pd.Series(near, dtype=object)})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, starts, words = [], [], []
        for frame in frames:
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"], strict=True):
                docs.append(doc)
                starts.append(len(words))
                words += text_words(text)
                words += _BETWEEN * (errors + 1)  # no passage reaches over it
                if len(words) >= WORDS_AT_ONCE:
                    yield lot_hits(docs, starts, words)
                    docs, starts, words = [], [], []
        if docs:
            yield lot_hits(docs, starts, words)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null")
    return texts.mapInPandas(scan, "doc_id bigint, key bigint, before int, near string")


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    errors: int = ERRORS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """(``doc_id``, ``item_id``, ``distance``, ``passages``, ``exact``) of every leak.

    One row for each text and item with at least one passage of ``window``
    words within ``errors`` word edits: the least distance, how many of the
    item's passages leaked, and how many of them word for word. Null or empty
    texts and items under ``window`` words leak nothing. Rows that repeat an id
    are read each and counted as one text or item.
    """
    if window < 2 or not 0 <= errors < window:
        raise ValueError("window must exceed errors")
    wanted = cut_lineage(passages(items, window, errors))
    tables = bit_table(wanted, "piece"), bit_table(wanted, "key")
    hits = cut_lineage(text_hits(documents, *tables, window, errors))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            columns = ("doc_id", "item_id", "item_start", "before", "near", "passage")
            for doc, item, start, before, near, passage in zip(*(frame[c] for c in columns), strict=True):
                words, pattern = near.split(" "), passage.split(" ")
                if before >= 0 and words[before : before + window] == pattern:
                    out.append((doc, item, start, 0))
                elif (distance := myers(pattern, words, errors)[0]) <= errors:
                    out.append((doc, item, start, distance))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "item_start", "distance"])

    met = salted_join(hits, wanted.drop("piece"), "key", "inner", rows_per_task)
    near = met.mapInPandas(verify, "doc_id bigint, item_id bigint, item_start int, distance int")
    each = near.groupBy("doc_id", "item_id", "item_start").agg(F.min("distance").alias("distance"))
    return each.groupBy("doc_id", "item_id").agg(
        F.min("distance").alias("distance"), F.count(F.lit(1)).alias("passages"), F.count_if(F.col("distance") == 0).alias("exact")
    )


def exact_leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(``doc_id``, ``item_id``) of texts that share ``window`` consecutive words with an item."""
    return find_leaks(documents, items, window).where("exact > 0").select("doc_id", "item_id")
