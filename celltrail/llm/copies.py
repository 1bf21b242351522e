"""Duplicates hidden by formatting differences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltrail.llm.visible import visible
from celltrail.session import ROWS_PER_TASK, cut_lineage

_WORDS = re.compile(r"[^\W_]+|\+")
_LIST = re.compile(r"[\s,;|/]+")


def words(text: str | None) -> str:
    """The runs of letters and digits, and each plus sign, one space between."""
    return " ".join(_WORDS.findall(visible(text)))


def marker_words(text: str | None) -> str:
    """The set of list entries, each stripped to letters and digits, in order."""
    parts = {"".join(c for c in p if c.isalnum()) for p in _LIST.split(visible(text))}
    return " ".join(sorted(parts - {""}))


@F.pandas_udf(T.StringType())
def canonical_key(tissue: pd.Series, cell_type: pd.Series, markers: pd.Series) -> pd.Series:
    """One string that two records share if they differ in formatting only."""
    return pd.Series(
        [f"{words(t)}\n{words(c)}\n{marker_words(m)}" for t, c, m in zip(tissue, cell_type, markers, strict=True)]
    )


def keyed_records(records: DataFrame, id_column: str = "rec_id") -> DataFrame:
    """(id, key): the key is a 128-bit digest of the canonical text."""
    key = F.unhex(F.md5(canonical_key(F.col("tissue"), F.col("cell_type"), F.col("markers"))))
    return records.select(F.col(id_column).alias("_id"), key.alias("_key"))


def copy_groups(keyed: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(key, representative, copies) of all keys, and the hot keys with their salts.

    Keys are counted exactly with partial aggregation. Those beyond
    ``rows_per_task`` are salted and aggregated in two levels, the rest in one
    shuffle. The representative is the smallest id. A hot key has at least
    ``rows_per_task`` rows, so there are at most rows / ``rows_per_task``.
    """
    counts = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    hot = cut_lineage(
        counts.where(F.col("_n") > rows_per_task).select(
            "_key", F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_salts")
        )
    )
    agg = (F.min("_id").alias("representative"), F.count(F.lit(1)).alias("copies"))
    if hot.isEmpty():
        return keyed.groupBy("_key").agg(*agg), hot
    cold = keyed.join(hot, "_key", "left_anti").groupBy("_key").agg(*agg)
    salted = keyed.join(hot, "_key").withColumn("_salt", F.pmod(F.xxhash64("_id"), F.col("_salts")))
    first = salted.groupBy("_key", "_salt").agg(*agg)
    second = first.groupBy("_key").agg(F.min("representative").alias("representative"), F.sum("copies").alias("copies"))
    return cold.unionByName(second), hot


def find_copies(records: DataFrame, id_column: str = "rec_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each copy other than the smallest id of its group: (``rec_id``, ``copy_rec_id``).

    Null equals empty in every compared column; records empty in all three are
    copies of each other. Rows that repeat an id count as copies but give no
    pair. An empty table gives an empty result.
    """
    keyed = cut_lineage(keyed_records(records, id_column))
    groups, hot = copy_groups(keyed, rows_per_task)
    groups = groups.where("copies > 1").select("_key", "representative")
    if not hot.isEmpty():
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
        groups = groups.join(hot, "_key", "left").withColumn("_salt", salts).drop("_salts")
        keyed = keyed.join(hot, "_key", "left").withColumn(
            "_salt", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_salts")).cast("int"), F.lit(0))
        )
        joined = keyed.join(groups, ["_key", "_salt"])
    else:
        joined = keyed.join(groups, "_key")
    return (
        joined.where("_id != representative")
        .select(F.col("representative").alias("rec_id"), F.col("_id").alias("copy_rec_id"))
        .distinct()
    )


def collapse_copies(records: DataFrame, id_column: str = "rec_id", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """One record of each group, all its columns, with ``copies``: the rows of the group.

    Where several rows repeat the smallest id, any one of them stays.
    """
    keyed = cut_lineage(keyed_records(records, id_column))
    groups, _ = copy_groups(keyed, rows_per_task)
    count = "copies" if "copies" not in records.columns else "_copies"
    kept = groups.select(F.col("representative").alias(id_column), F.col("copies").alias(count))
    return records.dropDuplicates([id_column]).join(kept, id_column)
