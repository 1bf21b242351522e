"""Queries over expression matrices: the embeddings as cells by genes, their labels as clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.operators import matrix as mx
from celltrail.session import table


def cells_by_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in long form: positive tenths of every vector's values as counts, zeros left out."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("pos", "x"))
    value = F.greatest(F.lit(0.0), F.floor(F.col("x").cast("double") * 10))
    return rows.select("cell_id", F.concat(F.lit("G"), F.col("pos").cast("string")).alias("gene"), value.cast("double").alias("value")).where("value > 0")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").alias("cluster"))


def quality_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = mx.quality_filter(cells_by_genes(spark, sf_dir), 8, 20)
    return kept.groupBy("gene").agg(F.count(F.lit(1)).alias("cells"))


def normalized_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.normalize_total(cells_by_genes(spark, sf_dir))
    return out.select("cell_id", "gene", F.round("value", 6).alias("value"))


def scaled_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.normalize_and_scale(cells_by_genes(spark, sf_dir), observations(spark, sf_dir))
    return out.select("cell_id", "gene", F.round("value", 6).alias("value"))


def cluster_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.cluster_means(cells_by_genes(spark, sf_dir), observations(spark, sf_dir))
    return out.select("cluster", "gene", F.round("mean", 6).alias("mean"))


def rank_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.rank_genes(cells_by_genes(spark, sf_dir), observations(spark, sf_dir))
    return out.select("cluster", "gene", F.round("score", 6).alias("score"), F.round("pval", 6).alias("pval"), F.round("pval_adj", 6).alias("pval_adj"))


def rank_genes_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.rank_genes(cells_by_genes(spark, sf_dir), observations(spark, sf_dir), "t-test")
    return out.select("cluster", "gene", F.round("score", 6).alias("score"))


def top_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.top_genes(mx.rank_genes(cells_by_genes(spark, sf_dir), observations(spark, sf_dir)), 5)
    return out.select("cluster", "rank", "gene", F.round("score", 6).alias("score"))


def matrix_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.matrix_markers(cells_by_genes(spark, sf_dir), observations(spark, sf_dir), 10)
    return out.select("cluster", F.array_join("markers", ",").alias("markers"), "n_cells")


def matrix_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table of order counts by status and priority, in long form."""
    orders = table(spark, sf_dir, "orders")
    wide = orders.groupBy(F.col("o_orderpriority").alias("gene")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return mx.unpivot_matrix(wide, "gene")


def majority_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.majority_value(table(spark, sf_dir, "marker_record"), "tissue", "cell_type", "rec_id")


def majority_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mx.majority_by_name(table(spark, sf_dir, "events"), "user_id", "event_type")


def score_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("label")).agg(F.sum("l_quantity").alias("score"))
    out = mx.score_margins(scores, "l_orderkey")
    return out.select("l_orderkey", "label", "best", F.round("margin", 6).alias("margin"))


def cells_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with orders, and those without, by nation."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key = customers.c_custkey == orders.o_custkey
    with_orders = customers.join(orders, key, "left_semi").withColumn("has", F.lit(True))
    without = customers.join(orders, key, "left_anti").withColumn("has", F.lit(False))
    return with_orders.unionByName(without).groupBy("c_nationkey", "has").agg(F.count(F.lit(1)).alias("n"))


def nearest_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest cells of every hundredth cell, against all cells."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vector"))
    out = mx.nearest_cells(cells, cells.where("cell_id % 100 = 0"), 10)
    return out.select("cell_id", "rank", "neighbour", F.round("distance", 6).alias("distance"))


def variable_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mx.variable_genes(cells_by_genes(spark, sf_dir), observations(spark, sf_dir), 20)
    return out.select("gene", F.round("dispersion", 6).alias("dispersion"))


QUERIES = {
    f.__name__: f
    for f in (
        quality_cells, normalized_totals, scaled_genes, cluster_mean, rank_genes, rank_genes_t, top_genes, matrix_markers, matrix_unpivot,
        majority_value, majority_alpha, score_margin, cells_semi_anti, variable_genes, nearest_cells,
    )
}

_M = """
    e as (select vec_id as cell_id, label as cluster, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
    mat as (select cell_id, cluster, 'G' || pos as gene, greatest(0.0, floor(x * 10)) as value from e where floor(x * 10) > 0)"""
_NORM = f"{_M.strip()}, nt as (select cell_id, gene, ln(1 + value / sum(value) over (partition by cell_id) * 1e4) as value from mat)"
_ALL = f"""{_M.strip()},
    grid as (select cell_id, cluster, 'G' || pos as gene, greatest(0.0, floor(x * 10)) as value from e),
    genes as (select distinct gene from mat)"""
_NGRID = f"""{_M.strip()},
    grid as (select cell_id, cluster, 'G' || pos as gene, case when x_ > 0 then ln(1 + x_ / sum(x_) over (partition by cell_id) * 1e4) else 0.0 end as value
             from (select cell_id, cluster, pos, greatest(0.0, floor(x * 10)) as x_ from e)),
    genes as (select distinct gene from mat)"""
_RANK = """{grid},
    r as (select gene, cluster, value, rank() over (partition by gene order by value) + (count(*) over (partition by gene, value) - 1) / 2.0 as rk,
                 count(*) over (partition by gene, value) as tie from grid where gene in (select gene from genes)),
    t as (select gene, count(*) as n, sum(tie * tie - 1.0) as ties from r group by 1),
    s as (select r.gene, r.cluster, sum(rk) as rs, count(*) as n1 from r group by 1, 2),
    z as (select cluster, gene, coalesce((rs - n1 * (n + 1) / 2.0) / nullif(sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))), 0), 0.0) as score from s join t using (gene))"""
_T = "(1 / (1 + 0.3275911 * x))"
_TESTS = f"""{_RANK.format(grid=_ALL)},
    p0 as (select *, abs(score) / sqrt(2.0) as x from z),
    p as (select cluster, gene, score, least(1.0, {_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-x * x)) as pval from p0),
    q as (select *, pval * count(*) over (partition by cluster) / row_number() over (partition by cluster order by pval, gene) as raw from p),
    adj as (select cluster, gene, score, pval, least(1.0, min(raw) over (partition by cluster order by pval desc, gene desc rows between unbounded preceding and current row)) as pval_adj from q)"""

ORACLES = {
    "quality_cells": f"""with {_M}, c as (select cell_id from mat group by 1 having count(*) >= 8)
        select gene, count(*) as cells from mat where cell_id in (select cell_id from c) group by 1 having count(*) >= 20""",
    "normalized_totals": f"with {_NORM} select cell_id, gene, round(value, 6) as value from nt",
    "scaled_genes": f"""with {_NORM}, n as (select count(*) as n from embeddings), s as (select gene, sum(value) as s, sum(value * value) as q from nt group by 1)
        select cell_id, gene, round(coalesce((value - s / n) / nullif(sqrt(greatest((q - n * (s / n) * (s / n)) / (n - 1), 0.0)), 0), 0.0), 6) as value
        from nt join s using (gene), n""",
    "cluster_mean": f"""with {_M}, c as (select label as cluster, count(*) as n from embeddings group by 1)
        select cluster, gene, round(sum(value) / any_value(n), 6) as mean from mat join c using (cluster) group by 1, 2""",
    "rank_genes_t": f"""with {_ALL}, a as (select gene, cluster, count(*) as n1, avg(value) as m1, var_samp(value) as v1, sum(value) as s, sum(value * value) as q from grid where gene in (select gene from genes) group by 1, 2),
        w as (select gene, sum(n1) as n, sum(s) as sa, sum(q) as qa from a group by 1),
        d as (select a.*, n - n1 as n2, (sa - s) / (n - n1) as m2, ((qa - q) - (n - n1) * power((sa - s) / (n - n1), 2)) / (n - n1 - 1) as v2 from a join w using (gene))
        select cluster, gene, round(coalesce((m1 - m2) / nullif(sqrt(v1 / n1 + v2 / n2), 0), 0.0), 6) as score from d""",
    "rank_genes": f"with {_TESTS} select cluster, gene, round(score, 6) as score, round(pval, 6) as pval, round(pval_adj, 6) as pval_adj from adj",
    "matrix_markers": f"""with {_RANK.format(grid=_NGRID)}, o as (select *, row_number() over (partition by cluster order by score desc, gene) as rank from z)
        select cluster, string_agg(upper(gene), ',' order by rank) as markers, (select count(*) from embeddings where label = cluster) as n_cells from o where rank <= 10 group by 1""",
    "top_genes": f"""with {_RANK.format(grid=_ALL)}, o as (select *, row_number() over (partition by cluster order by score desc, gene) as rank from z)
        select cluster, rank, gene, round(score, 6) as score from o where rank <= 5""",
    "matrix_unpivot": """select o_orderstatus as cell_id, o_orderpriority as gene, count(*)::double as value from orders where o_orderstatus in ('F', 'O', 'P') group by 1, 2""",
    "majority_value": """
        with c as (select tissue, trim(cell_type) as value, count(*) as n, min(rec_id) as f from marker_record where trim(cell_type) <> '' and lower(trim(cell_type)) <> 'nan' group by 1, 2),
        r as (select *, n / sum(n) over (partition by tissue) as s, row_number() over (partition by tissue order by n desc, f) as k from c)
        select tissue, value, round(s, 6) as fraction from r where k = 1""",
    "majority_alpha": """
        with c as (select user_id, event_type as value, count(*) as n from events where event_type is not null group by 1, 2)
        select user_id, value from (select *, row_number() over (partition by user_id order by n desc, value) as k from c) where k = 1""",
    "score_margin": """
        with s as (select l_orderkey, l_partkey as label, sum(l_quantity) as score from lineitem group by 1, 2),
        r as (select *, row_number() over w as k, coalesce(lead(score) over w, 0.0) as second from s window w as (partition by l_orderkey order by score desc, label))
        select l_orderkey, label, score as best, round(least(1.0, greatest(0.0, (score - second) / (abs(score) + abs(second) + 1e-9))), 6) as margin from r where k = 1""",
    "cells_semi_anti": """
        select c_nationkey, c_custkey in (select o_custkey from orders) as has, count(*) as n from customer group by 1, 2""",
    "nearest_cells": """
        with v as (select vec_id as id, embedding::double[] as e from embeddings),
        d as (select q.id as cell_id, v.id as neighbour, list_distance(q.e, v.e) as distance from v as q join v on q.id <> v.id where q.id % 100 = 0),
        r as (select *, row_number() over (partition by cell_id order by distance, neighbour) as rank from d)
        select cell_id, rank, neighbour, round(distance, 6) as distance from r where rank <= 10""",
    "variable_genes": f"""with {_M}, n as (select count(*) as n from embeddings), s as (select gene, sum(value) as s, sum(value * value) as q from mat group by 1)
        select gene, round((q - n * (s / n) * (s / n)) / (n - 1) / (s / n), 6) as dispersion from s, n order by (q - n * (s / n) * (s / n)) / (n - 1) / (s / n) desc, gene limit 20""",
}
