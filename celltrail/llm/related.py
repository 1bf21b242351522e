"""Splits that keep related records together.

Records that share a key (an entry of their source, or tissue with cell type)
are related, and so are chains of them. Each record is a path over its own keys
in a graph of keys; components come from Borůvka rounds: every component takes
its smallest edge, pointers are doubled until they rest on roots, edges move to
the roots. The chosen edges are the spanning forest. All of it stays
distributed and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from celltrail.session import cut_lineage, salted_join

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Roots dealt in one stratum.
ROOTS_PER_STRATUM = 20_000


def plain(x: Column) -> Column:
    """Only letters and digits, without case; null if none is left."""
    return F.nullif(F.lower(F.regexp_replace(x, r"[^\p{L}\p{Nd}]", "")), F.lit(""))


def relation_keys(examples: DataFrame) -> Column:
    """Digests of a record's source entries and of its tissue with cell type, sorted."""
    sources = F.transform(
        F.filter(F.transform(F.split("source", ";"), plain), lambda s: s.isNotNull()),
        lambda s: F.xxhash64(F.lit("source"), s),
    )
    tissue, cell_type = plain(F.col("tissue")), plain(F.col("cell_type"))
    pair = F.when(
        tissue.isNotNull() & cell_type.isNotNull(), F.array(F.xxhash64(F.lit("kind"), tissue, cell_type))
    )
    none = F.array().cast("array<bigint>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(sources, none), F.coalesce(pair, none))))


def spanning_forest(edges: DataFrame, max_rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """Roots (``v``, ``root``) of all vertices with edges, and the forest's edges (``a``, ``b``).

    ``edges`` has ``a`` and ``b``. Loops and repeated edges are dropped. Edges
    are ordered by their ends, so the smallest edge of a component is unique
    and chosen edges can close no circle but two components choosing the same.
    """
    now = cut_lineage(
        edges.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
        .select(F.col("a").alias("u"), F.col("b").alias("w"), "a", "b")
    )
    roots = cut_lineage(now.select(F.col("a").alias("v")).union(now.select("b")).distinct().select("v", F.col("v").alias("root")))
    forest = now.select("a", "b").limit(0)
    for _ in range(max_rounds):
        if now.isEmpty():
            return roots, cut_lineage(forest.distinct())
        both = now.unionByName(now.select(F.col("w").alias("u"), F.col("u").alias("w"), "a", "b"))
        # (a, b) are original ends: the order is the same seen from either side.
        chosen = both.groupBy("u").agg(F.min(F.struct("a", "b", "w")).alias("e"))
        chosen = cut_lineage(chosen.select("u", F.col("e.w").alias("parent"), F.col("e.a").alias("a"), F.col("e.b").alias("b")))
        forest = forest.union(chosen.select("a", "b").distinct())
        # Of two that chose each other the smaller is the root.
        back = chosen.select(F.col("u").alias("parent"), F.col("parent").alias("grand"))
        parents = salted_join(chosen, back, "parent").select(
            "u", F.when((F.col("grand") == F.col("u")) & (F.col("u") < F.col("parent")), F.col("u")).otherwise(F.col("parent")).alias("parent")
        )
        parents = cut_lineage(parents)
        while True:
            up = parents.select(F.col("u").alias("parent"), F.col("parent").alias("grand"))
            jumped = cut_lineage(
                salted_join(parents, up, "parent", "inner").select("u", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
            )
            parents = jumped.select("u", "parent")
            if jumped.where("moved").isEmpty():
                break
        ends = parents.withColumnRenamed("parent", "to")
        roots = cut_lineage(
            salted_join(roots, ends.withColumnRenamed("u", "root"), "root").select("v", F.coalesce("to", "root").alias("root"))
        )
        moved = salted_join(now, ends, "u", "inner").drop("u").withColumnRenamed("to", "u")
        moved = salted_join(moved, ends.withColumnRenamed("u", "w"), "w", "inner").drop("w").withColumnRenamed("to", "w")
        now = cut_lineage(
            moved.where("u != w")
            .groupBy(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w"))
            .agg(F.min(F.struct("a", "b")).alias("e"))
            .select("u", "w", F.col("e.a").alias("a"), F.col("e.b").alias("b"))
        )
    raise RuntimeError(f"no spanning forest after {max_rounds} rounds")


def _keyed(examples: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Records with their keys, and the links between the keys of a record."""
    keyed = cut_lineage(examples.select(F.col(id_column).alias("example_id"), relation_keys(examples).alias("keys")).distinct())
    links = keyed.where(F.size("keys") > 1).select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", F.lit(2), F.size("keys"))).alias("b"))
    return keyed, links


def related_forest(examples: DataFrame, id_column: str = "example_id") -> DataFrame:
    """(``key_a``, ``key_b``, ``root``): the edges of the spanning forest over keys, which relate all that is related, and the root of each.

    Keys are the hashes of ``relation_keys``. A key alone has no edge.
    """
    roots, forest = spanning_forest(_keyed(examples, id_column)[1])
    joined = salted_join(forest, roots.withColumnRenamed("v", "a"), "a", "inner")
    return joined.select(F.col("a").alias("key_a"), F.col("b").alias("key_b"), "root")


def related_groups(examples: DataFrame, id_column: str = "example_id") -> DataFrame:
    """(``example_id``, ``group_id``): the smallest id among all records related to it.

    Null or blank sources, tissues and cell types relate nothing; a record
    without any key is its own group. Ids are taken as unique; repeated rows
    with one id give one row.
    """
    keyed, links = _keyed(examples, id_column)
    roots, _ = spanning_forest(links)  # the forest is in the shared folder; related_forest returns it
    lead = keyed.where(F.size("keys") > 0).select("example_id", F.col("keys")[0].alias("v"))
    # The smallest id of each key first, so that only keys meet the roots.
    smallest = lead.groupBy("v").agg(F.min("example_id").alias("least"))
    rooted = smallest.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("root"), "least")
    groups = rooted.groupBy("root").agg(F.min("least").alias("group_id"))
    of_key = cut_lineage(rooted.join(groups, "root").select("v", "group_id"))
    grouped = salted_join(lead, of_key, "v", "inner").select("example_id", "group_id")
    alone = keyed.where(F.size("keys") == 0).select("example_id", F.col("example_id").alias("group_id"))
    return grouped.unionByName(alone)


def assign_splits(groups: DataFrame, proportions: dict[str, float] | None = None, seed: int = 13) -> DataFrame:
    """(``group_id``, ``size``, ``split``): every group in one split, rows in proportion.

    Groups above a thousandth of all rows (at most a thousand of them) go one by
    one, largest first, to the split that lacks most rows. The others are
    stratified by size band and dealt systematically: their order in a stratum
    is by hash, and each split takes every so-many-th group from a start of its
    own. A split that large groups have overfilled gets none of the others.
    """
    want = proportions or PROPORTIONS
    if abs(sum(want.values()) - 1) > 1e-9 or min(want.values()) < 0:
        raise ValueError("proportions must be positive and add up to 1")
    sizes = cut_lineage(groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    names = list(want)
    got = dict.fromkeys(names, 0)
    large = sizes.where(F.col("size") > total / 1000)
    placed = []
    for row in sorted(large.collect(), key=lambda r: (-r["size"], r["group_id"])):  # at most a thousand
        name = max(names, key=lambda n: want[n] * total - got[n])
        got[name] += row["size"]
        placed.append((row["group_id"], row["size"], name))
    rest = max(total - sum(got.values()), 0)
    lack = {n: max(want[n] * total - got[n], 0) for n in names}
    scale = sum(lack.values()) or 1
    share = {n: lack[n] / scale for n in names} if rest else dict(want)
    small = sizes.where(F.col("size") <= total / 1000).withColumn("band", F.floor(F.log2("size")).cast("int"))
    per_band = small.groupBy("band").agg(F.count(F.lit(1)).alias("roots"))
    strata = F.greatest(F.lit(1), F.ceil(F.col("roots") / F.lit(ROOTS_PER_STRATUM))).cast("int")
    dealt = small.join(F.broadcast(per_band.select("band", strata.alias("strata"))), "band")  # one row a band, under 64
    order = F.xxhash64(F.lit(seed), F.col("group_id"))
    dealt = dealt.withColumn("stratum", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("group_id")), F.col("strata")))
    window = Window.partitionBy("band", "stratum").orderBy(order, "group_id")
    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("band"), F.col("stratum")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # The golden ratio's multiples spread every share evenly over any run of groups.
    place = (F.row_number().over(window) * F.lit(0.6180339887498949) + start) % F.lit(1.0)
    split, upto = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        upto -= share[names[names.index(name) + 1]]
        split = F.when(F.col("place") < F.lit(upto), name).otherwise(split)
    out = dealt.withColumn("place", place).select("group_id", "size", split.alias("split"))
    if not placed:
        return out
    schema = T.StructType([*sizes.schema.fields, T.StructField("split", T.StringType())])
    return out.unionByName(groups.sparkSession.createDataFrame(placed, schema))


def related_splits(examples: DataFrame, proportions: dict[str, float] | None = None, id_column: str = "example_id") -> DataFrame:
    """(``example_id``, ``group_id``, ``new_split``) of every record."""
    groups = cut_lineage(related_groups(examples, id_column))
    dealt = assign_splits(groups, proportions).select("group_id", F.col("split").alias("new_split"))
    return salted_join(groups, dealt, "group_id", "inner").select("example_id", "group_id", "new_split")

