"""Expression matrices in long form: (``cell_id``, ``gene``, ``value``), zeros left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from celltrail.session import cut_lineage


def unpivot_matrix(wide: DataFrame, gene: str) -> DataFrame:
    """A genes by cells table in long form, zeros and nulls left out."""
    cells = [c for c in wide.columns if c != gene]
    long = wide.unpivot([gene], cells, "cell_id", "value")
    return long.select("cell_id", F.col(gene).alias("gene"), F.col("value").cast("double").alias("value")).where("value != 0")


def transpose(entries: DataFrame, row: str = "row", column: str = "column") -> DataFrame:
    """Matrix entries with rows and columns changed over."""
    return entries.withColumnsRenamed({row: column, column: row})


def quality_filter(matrix: DataFrame, min_genes: int = 200, min_cells: int = 3) -> DataFrame:
    """Cells with enough genes, then genes in enough of those cells."""
    cells = matrix.where("value > 0").groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_genes)
    kept = matrix.join(cells.select("cell_id"), "cell_id", "left_semi")
    genes = kept.where("value > 0").groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cells)
    return kept.join(genes.select("gene"), "gene", "left_semi")


def normalize_total(matrix: DataFrame, target: float = 1e4) -> DataFrame:
    """Values scaled to one total a cell, then the log of one more; a cell without total keeps nothing."""
    total = matrix.groupBy("cell_id").agg(F.sum("value").alias("_total"))
    scaled = F.log1p(F.try_divide(F.col("value"), F.col("_total")) * target)
    return matrix.join(total, "cell_id").select("cell_id", "gene", scaled.alias("value")).where("value is not null")


def scale_genes(matrix: DataFrame, cells: DataFrame) -> DataFrame:
    """Each gene less its mean over all ``cells``, over its sample deviation; a constant gene is zero.

    Zeros left out of ``matrix`` count, and come back with their scaled value
    only where the matrix has an entry.
    """
    n = F.broadcast(cells.agg(F.count_distinct("cell_id").alias("_n")))  # one row
    stats = matrix.groupBy("gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q")).crossJoin(n)
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    variance = F.try_divide(F.col("_q") - F.col("_n") * mean * mean, F.col("_n") - 1)
    stats = stats.select("gene", mean.alias("_mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("_sd"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("_mean"), F.col("_sd")), F.lit(0.0))
    return matrix.join(stats, "gene").select("cell_id", "gene", z.alias("value"))


def normalize_and_scale(matrix: DataFrame, cells: DataFrame, target: float = 1e4) -> DataFrame:
    """Counts to scaled logs; a matrix with negative values passes as it is, without what isn't a number."""
    negative = matrix.where("value < 0").limit(1).count() > 0
    if negative:
        finite = F.when(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")), 0.0).otherwise(F.col("value"))
        return matrix.select("cell_id", "gene", finite.alias("value"))
    return scale_genes(normalize_total(matrix, target), cells)


def cluster_means(matrix: DataFrame, obs: DataFrame) -> DataFrame:
    """(``cluster``, ``gene``, ``mean``), zeros counted; genes that no cell of a cluster has are left out."""
    sizes = obs.groupBy("cluster").agg(F.count(F.lit(1)).alias("cells"))
    sums = matrix.join(obs.select("cell_id", "cluster"), "cell_id").groupBy("cluster", "gene").agg(F.sum("value").alias("s"))
    return sums.join(sizes, "cluster").select("cluster", "gene", (F.col("s") / F.col("cells")).alias("mean"))


def rank_genes(matrix: DataFrame, obs: DataFrame, method: str = "wilcoxon") -> DataFrame:
    """(``cluster``, ``gene``, ``score``, ``pval``, ``pval_adj``): each cluster against the rest, for each gene.

    Rank sums use mid-ranks; zeros left out of the matrix rank below, between or
    above its entries as their value says, from counts alone. p-values are two
    sided normal, adjusted over the genes of a cluster. ``t-test`` uses means and
    variances of unequal groups. Genes or clusters without variation score zero.
    """
    cells = matrix.join(obs.select("cell_id", "cluster"), "cell_id")
    sizes = obs.groupBy("cluster").agg(F.count(F.lit(1)).cast("double").alias("n1"))
    total = sizes.agg(F.sum("n1").alias("n"))
    if method == "wilcoxon":
        # Counts by value: one row for each gene, value and cluster.
        counts = cells.where("value != 0").groupBy("gene", "value", "cluster").agg(F.count(F.lit(1)).cast("double").alias("c"))
        by_value = counts.groupBy("gene", "value").agg(F.sum("c").alias("ties"))
        present = by_value.groupBy("gene").agg(F.sum("ties").alias("there"))
        zeros = present.crossJoin(total).select("gene", F.lit(0.0).alias("value"), (F.col("n") - F.col("there")).alias("ties"))
        levels = by_value.unionByName(zeros).where("ties > 0")
        below = Window.partitionBy("gene").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
        levels = levels.withColumn("rank", F.coalesce(F.sum("ties").over(below), F.lit(0.0)) + (F.col("ties") + 1) / 2)
        ties = levels.groupBy("gene").agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("tie"))
        zero_rank = levels.where("value = 0").select("gene", F.col("rank").alias("zero_rank"))
        sums = counts.join(levels.select("gene", "value", "rank"), ["gene", "value"]).groupBy("gene", "cluster").agg(
            F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("c")
        )
        grid = present.select("gene").crossJoin(sizes).crossJoin(total)  # genes by clusters
        joined = grid.join(sums, ["gene", "cluster"], "left").join(zero_rank, "gene", "left").join(ties, "gene")
        r = F.coalesce("r", F.lit(0.0)) + (F.col("n1") - F.coalesce("c", F.lit(0.0))) * F.coalesce("zero_rank", F.lit(0.0))
        n, n1 = F.col("n"), F.col("n1")
        variance = n1 * (n - n1) / 12 * ((n + 1) - F.coalesce(F.try_divide(F.col("tie"), n * (n - 1)), F.lit(0.0)))
        score = F.try_divide(r - n1 * (n + 1) / 2, F.sqrt(F.greatest(variance, F.lit(0.0))))
    elif method == "t-test":
        moments = [F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")]
        own = cells.groupBy("gene", "cluster").agg(*moments)
        everything = matrix.groupBy("gene").agg(F.sum("value").alias("sa"), F.sum(F.col("value") * F.col("value")).alias("qa"))
        grid = everything.crossJoin(sizes).crossJoin(total)
        joined = grid.join(own, ["gene", "cluster"], "left").na.fill(0.0, ["s", "q"])
        n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
        m1, m2 = F.col("s") / n1, F.try_divide(F.col("sa") - F.col("s"), n2)
        v1 = F.try_divide(F.col("q") - n1 * m1 * m1, n1 - 1)
        v2 = F.try_divide(F.col("qa") - F.col("q") - n2 * m2 * m2, n2 - 1)
        score = F.try_divide(m1 - m2, F.sqrt(F.greatest(v1 / n1 + v2 / n2, F.lit(0.0))))
    else:
        raise ValueError("method must be wilcoxon or t-test")
    scored = joined.select("cluster", "gene", F.coalesce(score, F.lit(0.0)).alias("score"))
    return adjusted(scored.withColumn("pval", two_sided(F.col("score"))))


def two_sided(z: Column) -> Column:
    """The normal two-sided p-value, by a rational approximation of the error function (within 2e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    series = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.least(F.lit(1.0), series * F.exp(-x * x))


def adjusted(tests: DataFrame) -> DataFrame:
    """``pval_adj``: the false discovery rate within a cluster (step-up)."""
    up = Window.partitionBy("cluster").orderBy("pval", "gene")
    n = F.count(F.lit(1)).over(Window.partitionBy("cluster"))
    raw = tests.withColumn("_adj", F.col("pval") * n / F.row_number().over(up))
    down = Window.partitionBy("cluster").orderBy(F.desc("pval"), F.desc("gene")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("pval_adj", F.least(F.lit(1.0), F.min("_adj").over(down))).drop("_adj")


def top_genes(ranked: DataFrame, n: int = 25) -> DataFrame:
    """(``cluster``, ``rank``, ``gene``, ``score``, ``pval_adj``): the first genes of each cluster; blank names are dropped."""
    order = Window.partitionBy("cluster").orderBy(F.desc("score"), "gene")
    named = ranked.where("trim(gene) != ''").withColumn("rank", F.row_number().over(order))
    return named.where(F.col("rank") <= n).select("cluster", "rank", "gene", "score", "pval_adj")


def majority_value(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """(``by``, ``value``, ``fraction``): the commonest value that isn't empty or ``nan``; of equals the one seen first."""
    text = F.trim(F.col(value).cast("string"))
    counted = rows.select(by, text.alias("value"), order).where("value != '' and lower(value) != 'nan'")
    counted = counted.groupBy(by, "value").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    window = Window.partitionBy(by)
    share = F.col("n") / F.sum("n").over(window)
    first = F.row_number().over(window.orderBy(F.desc("n"), "first"))
    return counted.withColumn("fraction", F.round(share, 6)).withColumn("_n", first).where("_n = 1").select(by, "value", "fraction")


def majority_by_name(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(``by``, ``value``): the commonest value; of equals the first by name."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "value"))
    return counted.withColumn("_n", first).where("_n = 1").select(by, "value")


def score_margins(scores: DataFrame, by: str) -> DataFrame:
    """(``by``, ``label``, ``best``, ``margin``): the best score's lead over the second, relative, within 0 and 1."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "label")
    ranked = scores.withColumn("_n", F.row_number().over(order)).withColumn("second", F.lead("score").over(order))
    second = F.coalesce("second", F.lit(0.0))
    margin = (F.col("score") - second) / (F.abs("score") + F.abs(second) + 1e-9)
    kept = ranked.where("_n = 1")
    return kept.select(by, "label", F.col("score").alias("best"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin)).alias("margin"))


def matrix_markers(matrix: DataFrame, obs: DataFrame, n_top: int = 25, min_genes: int = 0, min_cells: int = 0) -> DataFrame:
    """A marker record for each cluster: its first genes, majority label, id and tissue. ``obs`` may have ``cell_type``,
    ``cell_ontology_id`` and ``tissue``; a cluster without label is named after itself."""
    kept = quality_filter(matrix, min_genes, min_cells) if min_genes or min_cells else matrix
    top = top_genes(rank_genes(normalize_total(kept), obs), n_top)
    markers = top.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "gene"))).alias("g"))
    out = markers.select("cluster", F.transform("g", lambda x: F.upper(x["gene"])).alias("markers"))
    sizes = obs.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_cells"))
    out = out.join(sizes, "cluster")
    for column in ("cell_type", "cell_ontology_id", "tissue"):
        if column in obs.columns:
            mode = majority_value(obs, "cluster", column, "cell_id").withColumnsRenamed({"value": column, "fraction": f"{column}_fraction"})
            out = out.join(mode, "cluster", "left")
    if "cell_type" in out.columns:
        out = out.withColumn("cell_type", F.coalesce("cell_type", F.concat(F.lit("cluster "), F.col("cluster").cast("string"))))
    return out


def principal_components(matrix: DataFrame, genes: list[str], k: int) -> DataFrame:
    """(``cell_id``, ``components``): the cells' first components over a bounded list of genes."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    wide = matrix.where(F.col("gene").isin(genes)).groupBy("cell_id").pivot("gene", genes).sum("value").na.fill(0.0)
    vectors = VectorAssembler(inputCols=[f"`{g}`" if "." in g else g for g in genes], outputCol="_v").transform(wide)
    model = PCA(k=k, inputCol="_v", outputCol="_c").fit(vectors)
    return model.transform(vectors).select("cell_id", vector_to_array("_c").alias("components"))


def nearest_cells(cells: DataFrame, queries: DataFrame, k: int = 15, block: int = 2_000) -> DataFrame:
    """(``cell_id``, ``rank``, ``neighbour``, ``distance``): the ``k`` nearest other cells of each query, exactly.

    Both sides have ``cell_id`` and ``vector``, all of one length. Every cell is
    read against blocks of at most ``block`` queries, of which each task keeps
    the ``k`` nearest; equal distances go by id. Rows without a vector are left
    out; fewer than ``k`` cells give fewer rows.
    """
    spark = cells.sparkSession
    kind = cells.schema["cell_id"].dataType.simpleString()
    schema = f"cell_id {kind}, neighbour {kind}, distance double"
    asked = queries.where("vector is not null").select("cell_id", "vector")
    blocks = max(1, -(-asked.count() // block))
    numbered = cut_lineage(asked.withColumn("_block", F.pmod(F.xxhash64("cell_id"), F.lit(blocks)).cast("int")))
    found = None
    for number in range(blocks):
        some = numbered.where(F.col("_block") == number).collect()  # a block
        if not some:
            continue
        held = spark.sparkContext.broadcast(([r["cell_id"] for r in some], np.array([r["vector"] for r in some], float)))

        def nearest(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, points = held.value
            best: list[list[tuple]] = [[] for _ in ids]
            for frame in frames:
                for start in range(0, len(frame), 1000):
                    part = frame.iloc[start : start + 1000]
                    others, there = part["cell_id"].tolist(), np.array(part["vector"].tolist(), float)
                    for i, row in enumerate(_distances(points, there)):
                        near = np.argsort(row, kind="stable")[: k + 1] if len(row) <= k + 1 else np.flatnonzero(row <= np.partition(row, k)[k])
                        best[i] = sorted(best[i] + [(float(row[j]), others[j]) for j in near if others[j] != ids[i]])[:k]
            rows = [(ids[i], other, d) for i, pairs in enumerate(best) for d, other in pairs]
            yield pd.DataFrame(rows, columns=["cell_id", "neighbour", "distance"])

        part = cells.where("vector is not null").select("cell_id", "vector").mapInPandas(nearest, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("cell_id").orderBy("distance", "neighbour")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("cell_id", "rank", "neighbour", "distance")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of two sets of points, a few of the first at a time."""
    return np.concatenate([np.sqrt(((a[i : i + 64, None, :] - b[None, :, :]) ** 2).sum(axis=2)) for i in range(0, len(a), 64)])


def variable_genes(matrix: DataFrame, cells: DataFrame, n: int = 2000) -> DataFrame:
    """(``gene``, ``dispersion``): the genes whose variance exceeds their mean most, zeros counted."""
    size = F.broadcast(cells.agg(F.count_distinct("cell_id").alias("_n")))
    stats = matrix.groupBy("gene").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).crossJoin(size)
    mean = F.col("s") / F.col("_n")
    dispersion = F.coalesce(F.try_divide(F.try_divide(F.col("q") - F.col("_n") * mean * mean, F.col("_n") - 1), mean), F.lit(0.0))
    return stats.select("gene", dispersion.alias("dispersion")).orderBy(F.desc("dispersion"), "gene").limit(n)
