"""Training splits: by chance, by group, by stratum; and what they leak."""

from __future__ import annotations

import math
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from celltrail.functions.text import norm_label, uniform
from celltrail.operators.prompts import estimated_tokens
from celltrail.session import cut_lineage, salted_join

SPLITS = ("train", "validation", "test")
#: Texts of a stratum that one task deals.
TEXTS_PER_DEAL = 50_000


def _check(train: float, validation: float) -> None:
    if not 0 < train < 1 or validation < 0 or train + validation >= 1:
        raise ValueError("train must be positive, validation not negative, and both together under 1")


def number_rows(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in a total order.

    Rows are ranged and numbered within ranges; the ranges' sizes give the
    offsets, so no task sorts all rows.
    """
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = ranged.withColumn("_within", within).join(F.broadcast(before), "_part")  # one row a partition
    return numbered.withColumn("place", F.col("_within") + F.col("_before")).drop("_part", "_within", "_before")


def hash_order(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``place``: their number from 0 in the order of their hashes."""
    hashed = rows.withColumn("_u", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return number_rows(hashed, "_u", key).drop("_u")


def split_by_chance(rows: DataFrame, key: str, train: float = 0.8, validation: float = 0.1, seed: int = 13) -> DataFrame:
    """``rows`` with ``split``: exactly the floor of each share, the rest to test."""
    _check(train, validation)
    n = rows.count()
    first, second = int(n * train), int(n * train) + int(n * validation)
    split = F.when(F.col("place") < first, "train").when(F.col("place") < second, "validation").otherwise("test")
    return hash_order(rows, key, seed).withColumn("split", split).drop("place")


def deal_groups(sizes: list[tuple[str, int]], train: float, validation: float) -> dict[str, str]:
    """The rule of ``split_by_group``, group by group: each split first gets one of the smallest, then the largest go where most is lacking.

    Needs as many groups as there are splits with a share.
    """
    total = sum(n for _, n in sizes)
    target = {"train": total * train, "validation": total * validation, "test": total * (1.0 - train - validation)}
    active = [s for s in SPLITS if target[s] > 1e-9]
    if len(sizes) < len(active):
        raise ValueError(f"{len(sizes)} groups can't fill {len(active)} splits")
    left = sorted(sizes, key=lambda g: (g[1], g[0]))
    got, out = dict.fromkeys(SPLITS, 0), {}
    for split in sorted(active, key=lambda s: (target[s], SPLITS.index(s))):
        name, n = left.pop(0)
        out[name], got[split] = split, got[split] + n
    for name, n in reversed(left):
        split = max(active, key=lambda s: (target[s] - got[s], -SPLITS.index(s)))
        out[name], got[split] = split, got[split] + n
    return out


def deal_runs(counts: list[tuple[int, int]], train: float, validation: float) -> list[tuple[int, int, int, list[str]]]:
    """The dealing of ``deal_groups`` from the number of groups of each size.

    ``counts`` has (size, groups). Gives (size, start, end, splits): groups from
    ``start`` up to ``end``, numbered from 0 from the largest, take the splits in
    turn. Groups of one size go to the split that lacks most until it lacks no
    more than the next one, then to those two in turn, and so on, so the driver
    takes a few steps a size, not one a group.
    """
    groups = sum(m for _, m in counts)
    total = sum(n * m for n, m in counts)
    target = {"train": total * train, "validation": total * validation, "test": total * (1.0 - train - validation)}
    active = [s for s in SPLITS if target[s] > 1e-9]
    if groups < len(active):
        raise ValueError(f"{groups} groups can't fill {len(active)} splits")
    left = dict(sorted(counts))
    lack, at, firsts = {s: Fraction(target[s]) for s in active}, groups, []
    for split in sorted(active, key=lambda s: (target[s], SPLITS.index(s))):
        size = next(n for n, m in left.items() if m)
        left[size] -= 1
        lack[split] -= size
        firsts.append((size, at - 1, at, [split]))
        at -= 1
    place, runs = 0, []
    for size, many in sorted(left.items(), reverse=True):
        while many:
            order = sorted(active, key=lambda s: (-lack[s], SPLITS.index(s)))
            # These lack so nearly the same that they take turns until the next split lacks as much.
            turn = [s for s in order if lack[order[0]] - lack[s] < size]
            times, rest = many // len(turn), order[len(turn) :]
            if rest:
                times = min(times, max(1, (lack[order[0]] - lack[rest[0]]) // size))
            took = turn if times else turn[:many]
            times = max(times, 1)
            for s in took:
                lack[s] -= size * times
            runs.append((size, place, place + times * len(took), took))
            place, many = place + times * len(took), many - times * len(took)
    return runs + firsts


def group_key(columns: list[str]) -> Column:
    """One text for a row's group; a null value is ``__none__``."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("__none__")) for c in columns])


def split_by_group(rows: DataFrame, columns: list[str], train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """``rows`` with ``split``; rows of one group stay together.

    The rule is that of ``deal_groups`` at every size. The driver sees only how
    many groups each size has; groups are numbered from the largest and look up
    their split among the runs of their size.
    """
    _check(train, validation)
    keyed = rows.withColumn("_group", group_key(columns))
    sizes = cut_lineage(keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("n")))
    counts = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()  # distinct sizes: at most the root of twice the rows
    by_size: dict[int, list] = {}
    for size, start, end, names in deal_runs([(r["n"], r["m"]) for r in counts], train, validation):
        by_size.setdefault(size, []).append((start, end, names))
    schema = "n bigint, runs array<struct<start: bigint, end: bigint, names: array<string>>>"
    table = F.broadcast(rows.sparkSession.createDataFrame(list(by_size.items()), schema))  # one row a size
    mine = F.filter("runs", lambda r: (r["start"] <= F.col("place")) & (F.col("place") < r["end"]))[0]
    split = F.get(mine["names"], F.pmod(F.col("place") - mine["start"], F.size(mine["names"])).cast("int"))
    dealt = number_rows(sizes, F.desc("n"), F.desc("_group")).join(table, "n").select("_group", split.alias("split"))
    return salted_join(keyed, dealt, "_group", "inner").drop("_group")


def deal_stratum(sizes: list[tuple[str, int]], train: float, validation: float) -> list[tuple[str, str]]:
    """Splits of a stratum's groups of equal records, in their given order: one each if three, then by what lacks."""
    total = sum(n for _, n in sizes)
    target = {"train": total * train, "validation": total * validation, "test": total * (1.0 - train - validation)}
    got, out = dict.fromkeys(SPLITS, 0), []
    first = list(SPLITS) if len(sizes) >= 3 else ["train"]
    for i, (name, n) in enumerate(sizes):
        split = first[i] if i < len(first) else max(SPLITS, key=lambda s: (target[s] - got[s], -SPLITS.index(s)))
        got[split] += n
        out.append((name, split))
    return out


def split_by_stratum(rows: DataFrame, stratum: Column, text: Column, train: float = 0.8, validation: float = 0.1, seed: int = 13) -> DataFrame:
    """``rows`` with ``split``: each stratum in proportion, rows with one text together.

    Equal texts are collapsed by digest before a stratum is dealt, and a stratum
    deals (digest, count) pairs only; one with more than ``TEXTS_PER_DEAL`` texts
    is dealt in parts by hash, each in proportion.
    """
    _check(train, validation)
    keyed = rows.withColumn("_stratum", F.coalesce(stratum.cast("string"), F.lit("__none__"))).withColumn("_text", F.sha2(text, 256))
    sizes = cut_lineage(keyed.groupBy("_stratum", "_text").agg(F.count(F.lit(1)).alias("n")))
    parts = sizes.groupBy("_stratum").agg(F.ceil(F.count(F.lit(1)) / F.lit(TEXTS_PER_DEAL)).cast("int").alias("_parts"))
    sizes = salted_join(sizes, parts, "_stratum", "inner")
    sizes = sizes.withColumn("_part", F.pmod(F.xxhash64("_text"), F.col("_parts")).cast("int")).drop("_parts")

    def deal(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        from hashlib import md5

        order = sorted(zip(frame["_text"], frame["n"], strict=True), key=lambda g: md5(f"{seed}:{g[0]}".encode()).hexdigest())
        dealt = deal_stratum([(t, int(n)) for t, n in order], train, validation)
        return pd.DataFrame([(key[0], t, s) for t, s in dealt], columns=["_stratum", "_text", "split"])

    dealt = sizes.groupBy("_stratum", "_part").applyInPandas(deal, "_stratum string, _text string, split string")
    return keyed.join(dealt, ["_stratum", "_text"]).drop("_stratum", "_text")


def split_manifest(rows: DataFrame, stratum: Column) -> DataFrame:
    """(``split``, ``stratum``, ``n``) of all splits and strata, missing ones with none."""
    counted = rows.groupBy("split", stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    strata = counted.select("stratum").distinct()
    splits = F.explode(F.array(*[F.lit(s) for s in SPLITS]))
    grid = strata.select("stratum", splits.alias("split"))
    return grid.join(counted, ["split", "stratum"], "left").select("split", "stratum", F.coalesce("n", F.lit(0)).alias("n"))


def leaked_groups(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(``group``, ``train``, ``validation``, ``test``) of groups in more than one split."""
    keyed = rows.select(group_key(columns).alias("group"), "split")
    counts = keyed.groupBy("group").agg(
        F.count_distinct("split").alias("_n"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS]
    )
    return counts.where("_n > 1").drop("_n")


def duplicate_signatures(rows: DataFrame, text: Column) -> DataFrame:
    """(``signature``, ``n``, ``splits``) of texts that more than one split has."""
    keyed = rows.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("signature"), "split")
    counts = keyed.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("splits"))
    return counts.where("splits > 1")


def label_overlap(rows: DataFrame, label: Column) -> DataFrame:
    """(``split``, ``labels``, ``seen``, ``unseen``): distinct labels, and those training has or lacks."""
    pairs = rows.select("split", label.alias("label")).distinct()
    train = pairs.where("split = 'train'").select("label", F.lit(1).alias("known"))
    joined = pairs.join(train, "label", "left")
    return joined.groupBy("split").agg(
        F.count(F.lit(1)).alias("labels"), F.count("known").alias("seen"), F.count_if(F.col("known").isNull()).alias("unseen")
    )


def unseen_labels(rows: DataFrame, label: Column, k: int = 20) -> DataFrame:
    """(``split``, ``label``): the first ``k`` labels by name of each evaluation split that training lacks."""
    pairs = rows.select("split", label.alias("label")).where("label is not null").distinct()
    train = pairs.where("split = 'train'").select("label")
    lacking = pairs.where("split != 'train'").join(train, "label", "left_anti")
    first = F.row_number().over(Window.partitionBy("split").orderBy("label"))
    return lacking.withColumn("_n", first).where(F.col("_n") <= k).select("split", "label")


def labels_with(rows: DataFrame, label: str, least: int) -> DataFrame:
    """``rows`` of labels that at least so many rows have; rows without a label are dropped."""
    many = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") >= least) & F.col(label).isNotNull())
    return salted_join(rows, many.select(label), label, "inner")


def top_split_labels(rows: DataFrame, k: int = 10) -> DataFrame:
    """(``split``, ``place``, ``label``, ``n``): the commonest labels of each split, of equals the one seen first.

    ``rows`` have ``split``, ``cell_type`` and ``example_id``, the row order.
    """
    counted = rows.where("coalesce(cell_type, '') != ''").groupBy("split", F.col("cell_type").alias("label"))
    counted = counted.agg(F.count(F.lit(1)).alias("n"), F.min("example_id").alias("first"))
    order = Window.partitionBy("split").orderBy(F.desc("n"), "first")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("split", "place", "label", "n")


def record_formats(rows: DataFrame) -> DataFrame:
    """(``split``, ``format``, ``n``): chat if a record has messages, instruction if it has an instruction, else unknown."""
    chat = F.size("messages") > 0 if "messages" in rows.columns else F.lit(False)
    told = F.col("instruction").isNotNull() if "instruction" in rows.columns else F.lit(False)
    kind = F.when(chat, "chat").when(told, "instruction").otherwise("unknown")
    return rows.groupBy("split", kind.alias("format")).agg(F.count(F.lit(1)).alias("n"))


def split_summary(rows: DataFrame, text: Column, max_length: int = 2048) -> DataFrame:
    """One row a split and one for all: records, distinct values, coverage and lengths in estimated tokens.

    ``rows`` have ``split``, ``tissue``, ``cell_type``, ``source``,
    ``cell_ontology_id`` and ``markers``. The 95th percentile is by nearest rank.
    """
    sized = rows.select("split", "tissue", "cell_type", "source", "cell_ontology_id", "markers", estimated_tokens(text).alias("length"))
    return sized.rollup("split").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("tissue").alias("tissues"),
        F.count_distinct(norm_label(F.col("cell_type"))).alias("labels"),
        F.count_distinct("source").alias("sources"),
        F.round(F.coalesce(F.avg(F.col("cell_ontology_id").isNotNull().cast("double")), F.lit(0.0)), 4).alias("cl_coverage"),
        F.count_if(F.col("cell_type").isNull()).alias("missing_cell_type"),
        F.count_if(F.col("tissue").isNull()).alias("missing_tissue"),
        F.count_if(F.col("source").isNull()).alias("missing_source"),
        F.count_if(F.coalesce(F.size("markers"), F.lit(0)) < 1).alias("missing_markers"),
        F.min("length").alias("min_length"),
        F.round(F.avg("length"), 2).alias("mean_length"),
        F.expr("percentile_disc(0.95) within group (order by length)").alias("p95_length"),
        F.max("length").alias("max_length"),
        F.count_if(F.col("length") > max_length).alias("over_limit"),
    ).withColumn("split", F.coalesce("split", F.lit("total")))


def label_support(rows: DataFrame) -> DataFrame:
    """For each label its records by split, those with an id, the coverage and the ids."""
    ids = F.array_join(F.array_sort(F.collect_set("cell_ontology_id")), ";")
    return rows.groupBy(norm_label(F.col("cell_type")).alias("label")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS],
        F.count("cell_ontology_id").alias("with_cl_id"),
        F.round(F.avg(F.col("cell_ontology_id").isNotNull().cast("double")), 6).alias("coverage"),
        ids.alias("cl_ids"),
    )


def preflight_warnings(summary: list[dict], leaks: int, duplicates: int, unseen: int) -> list[str]:
    """What speaks against training, in words; ``summary`` has the rows of ``split_summary``."""
    by = {r["split"]: r for r in summary}
    out = [f"split {s} is empty" for s in SPLITS if not by.get(s, {}).get("records")]
    total = by.get("total", {})
    if total.get("cl_coverage", 1.0) < 0.8:
        out.append(f"only {total['cl_coverage']:.0%} of the records have an ontology id")
    if total.get("over_limit"):
        out.append(f"{total['over_limit']} records exceed the length limit")
    if total.get("missing_cell_type"):
        out.append(f"{total['missing_cell_type']} records have no cell type")
    if total.get("labels", 2) < 2:
        out.append("fewer than two labels")
    if leaks:
        out.append(f"{leaks} groups are in several splits")
    if duplicates:
        out.append(f"{duplicates} texts are in several splits")
    if unseen:
        out.append(f"{unseen} evaluation labels are not in training")
    if not math.isfinite(total.get("mean_length") or 0.0):
        out.append("lengths can't be told")
    return out
