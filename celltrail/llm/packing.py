"""Filling fixed-capacity containers with items: best-two-fit.

Texts are sized in tokens of a public tokenizer. A text above the capacity is
split into full containers and a rest; nothing else is split. Items are packed
in buckets of bounded size: each bin is filled greedily with the largest item
that fits, then its smallest item is replaced by the two unpacked items that
together fill the gap so enlarged most tightly. What a bucket leaves in bins
that are not full is repacked across buckets in further rounds.
"""

from __future__ import annotations

import os
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrail.session import cut_lineage

CAPACITY = 1024
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
ITEMS_PER_BUCKET = 20_000
#: A bin at least this full is final after its first round.
FULL = 0.995


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(``doc_id``, ``n_tokens``): the whole text's tokens; null or empty texts have none."""
    path = os.path.join(folder, name)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            sizes: list[int] = []
            for i in range(0, len(texts), 256):
                sizes += [len(e) for e in tokenizer.encode_batch(texts[i : i + 256], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_tokens": sizes})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, n_tokens int")


class Shelf:
    """Unpacked items by size: how many there are, and which."""

    def __init__(self, sizes: list[int], capacity: int):
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]
        for i, s in enumerate(sizes):
            self.of[s].append(i)
        self.present = [s for s in range(1, capacity + 1) if self.of[s]]  # ascending
        self.count = len(sizes)

    def largest(self, most: int) -> int:
        """The largest size there is up to ``most``, or 0."""
        at = bisect_right(self.present, most)
        return self.present[at - 1] if at else 0

    def take(self, size: int) -> int:
        item = self.of[size].pop()
        if not self.of[size]:
            del self.present[bisect_right(self.present, size) - 1]
        self.count -= 1
        return item

    def give(self, size: int, item: int) -> None:
        if not self.of[size]:
            self.present.insert(bisect_right(self.present, size), size)
        self.of[size].append(item)
        self.count += 1

    def best_two(self, room: int, more_than: int) -> tuple[int, int] | None:
        """Two sizes whose sum is the largest within ``room`` and above ``more_than``."""
        best, pair = more_than, None
        low, high = 0, bisect_right(self.present, room - 1) - 1
        while low <= high:
            a, b = self.present[low], self.present[high]
            if a + b > room or (low == high and len(self.of[a]) < 2):
                high -= 1
                continue
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            low += 1
        return pair


def best_two_fit(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item positions. Every size must lie between 1 and ``capacity``."""
    shelf, bins = Shelf(sizes, capacity), []
    while shelf.count:
        packed: list[tuple[int, int]] = []
        room = capacity
        while size := shelf.largest(room):
            packed.append((size, shelf.take(size)))
            room -= size
        if room and shelf.count > 1:
            size, item = packed[-1]  # the smallest: sizes were taken in falling order
            if pair := shelf.best_two(room + size, size):
                packed.pop()
                packed += [(s, shelf.take(s)) for s in pair]
                shelf.give(size, item)
        bins.append([i for _, i in packed])
    return bins


def _packer(capacity: int, full: float, final: bool):
    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"]).reset_index(drop=True)
        bins = best_two_fit(frame["size"].tolist(), capacity)
        where, done = [0] * len(frame), [False] * len(frame)
        for n, items in enumerate(bins):
            enough = final or sum(frame["size"][i] for i in items) >= capacity * full
            for i in items:
                where[i], done[i] = n, enough
        return frame.assign(bin=where, done=done, bucket=key[0])

    return pack


def pack_documents(
    sized: DataFrame,
    capacity: int = CAPACITY,
    items_per_bucket: int = ITEMS_PER_BUCKET,
    full: float = FULL,
    rounds: int = 3,
) -> DataFrame:
    """(``container``, ``doc_id``, ``piece``, ``start``, ``size``) of all items.

    ``sized`` has ``doc_id`` and ``n_tokens``. Texts without tokens (null or
    empty) need no room and are left out. A text above ``capacity`` has as many
    full pieces as it fills, numbered from 0, each alone in its container, and
    its rest is an item like any other. Rows that repeat an id are items of
    their own. Packing is the same for the same rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rest = F.col("n_tokens") % capacity
    wholes = F.floor(F.col("n_tokens") / F.lit(capacity)).cast("int")
    base = sized.where("n_tokens > 0")
    whole = (
        base.where(wholes > 0)
        .select("doc_id", F.explode(F.sequence(F.lit(0), wholes - 1)).alias("piece"))
        .select(
            F.concat_ws("-", F.lit("w"), "doc_id", "piece").alias("container"),
            "doc_id",
            "piece",
            (F.col("piece") * capacity).alias("start"),
            F.lit(capacity).alias("size"),
        )
    )
    loose = cut_lineage(
        base.where(rest > 0).select(
            "doc_id", wholes.alias("piece"), (wholes * capacity).alias("start"), rest.cast("int").alias("size")
        )
    )
    out = whole
    for n in range(rounds):
        count = loose.count()
        if not count:
            break
        buckets = max(1, -(-count // items_per_bucket))
        final = n == rounds - 1 or buckets == 1
        schema = loose.select("doc_id", "piece", "start", "size").schema
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + ", bin int, done boolean, bucket int"
        spread = loose.withColumn("bucket", F.pmod(F.xxhash64(F.lit(n), "doc_id", "piece"), F.lit(buckets)).cast("int"))
        packed = cut_lineage(spread.groupBy("bucket").applyInPandas(_packer(capacity, full, final), ddl))
        out = out.unionByName(
            packed.where("done").select(
                F.concat_ws("-", F.lit(f"r{n}"), "bucket", "bin").alias("container"), "doc_id", "piece", "start", "size"
            )
        )
        if final:
            break
        loose = packed.where("not done").select("doc_id", "piece", "start", "size")
    return out


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the least number of containers possible, and the share in use."""
    return packed.agg(
        F.countDistinct("container").alias("containers"),
        F.count(F.lit(1)).alias("items"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"),
    ).select(
        "*",
        F.ceil(F.col("tokens") / F.lit(capacity)).alias("least_containers"),
        F.expr(f"try_divide(tokens, containers * {capacity})").alias("used"),
    )
