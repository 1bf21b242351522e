"""How good predictions are, in as few passes as the metrics allow.

Predictions have ``y_true`` and ``y_pred``, and may have ``true_cl_id``,
``pred_cl_id``, ``confidence``, ``runtime_seconds`` and ``cost_usd``. Labels are
compared normalized; null labels are the word None, as text.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltrail.functions.text import norm_label, uniform
from celltrail.session import ship_package

DIGITS = 6


def label(name: str) -> Column:
    return norm_label(F.coalesce(F.col(name), F.lit("None")))


def correct() -> Column:
    return (label("y_true") == label("y_pred")).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def confusion(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(``t``, ``p``, ``n``): predictions by true and predicted label; every further metric is of this size."""
    return predictions.groupBy(*(by or []), label("y_true").alias("t"), label("y_pred").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )


def label_f1(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of every label that is true somewhere."""
    keys = by or []
    cells = confusion(predictions, keys)
    true = cells.groupBy(*keys, F.col("t").alias("label")).agg(
        F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("n"))), F.lit(0)).alias("tp")
    )
    said = cells.groupBy(*keys, F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    joined = true.join(said, [*keys, "label"], "left").withColumn("said", F.coalesce("said", F.lit(0)))
    joined = joined.withColumn("precision", _share(F.col("tp"), F.col("said"))).withColumn("recall", _share(F.col("tp"), F.col("support")))
    f1 = _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return joined.select(*keys, "label", "support", "said", "tp", F.round("precision", DIGITS).alias("precision"), F.round("recall", DIGITS).alias("recall"), F.round(f1, DIGITS).alias("f1"), f1.alias("_f1"))


def macro_f1(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F1 over the labels that are true somewhere; labels only predicted cost the others precision alone."""
    keys = by or []
    mean = F.round(F.coalesce(F.avg("_f1"), F.lit(0.0)), DIGITS).alias("macro_f1")
    scored = label_f1(predictions, keys)
    return scored.groupBy(*keys).agg(mean) if keys else scored.agg(mean)


def _id(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def cl_accuracy() -> Column:
    """Share of right ids among rows with a true id; null without such rows or if nothing was predicted an id."""
    right = F.sum((_id("true_cl_id") == _id("pred_cl_id")).cast("int"))
    return F.when(F.count(_id("pred_cl_id")) > 0, F.try_divide(F.coalesce(right, F.lit(0)), F.count(_id("true_cl_id"))))


def clipped(name: str = "confidence") -> Column:
    """The confidence within 0 and 1; not-a-number is none."""
    x = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def calibration_bins(predictions: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Rows, accuracy and mean confidence of each bin of equal width."""
    keys = by or []
    rows = predictions.select(*keys, clipped().alias("c"), correct().alias("ok")).where("c is not null")
    at = F.least(F.lit(bins - 1), F.floor(F.col("c") * bins)).cast("int")
    return rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("ok").alias("accuracy"), F.avg("c").alias("confidence"))


def calibration_error(predictions: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Mean distance of accuracy and confidence over bins, weighted by their rows; null without confidences."""
    keys = by or []
    cells = calibration_bins(predictions, bins, keys)
    error = F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n"))
    error = F.round(error, DIGITS).alias("ece")
    return cells.groupBy(*keys).agg(error) if keys else cells.agg(error)


def evaluate(predictions: DataFrame, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """All metrics, one row for each of ``by`` (or one row)."""
    keys = by or []
    number = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in ("runtime_seconds", "cost_usd")}
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg(correct()), F.lit(0.0)), DIGITS).alias("accuracy"),
        F.round(cl_accuracy(), DIGITS).alias("cl_accuracy"),
        F.round(F.avg(number["runtime_seconds"]), 5).alias("mean_runtime"),
        F.round(F.sum(number["runtime_seconds"]), DIGITS).alias("total_runtime"),
        F.round(F.sum(number["cost_usd"]), DIGITS).alias("total_cost"),
        F.count_distinct(label("y_true")).alias("labels"),
    ]
    parts = (macro_f1(predictions, keys), calibration_error(predictions, bins, keys))
    if not keys:
        out = predictions.agg(*aggs)
        for part in parts:
            out = out.crossJoin(part)  # one row each
        return out
    out = predictions.groupBy(*keys).agg(*aggs)
    for part in parts:
        out = out.join(part, keys, "left")
    return out


def label_counts(predictions: DataFrame) -> DataFrame:
    """Rows of each true label."""
    return predictions.groupBy(label("y_true").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def top_labels(rows: DataFrame, name: Column, order: str, k: int = 10) -> DataFrame:
    """The ``k`` commonest values; of equally common ones those seen first."""
    counted = rows.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).drop("first")


def analyze_predictions(predictions: DataFrame) -> DataFrame:
    """One row of counts: errors, blanks, missing confidences, id coverage and matches."""
    blank = F.trim(F.coalesce("y_pred", F.lit(""))) == ""
    return predictions.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(correct() == 1).alias("correct"),
        F.count_if(correct() == 0).alias("wrong"),
        F.count_if(blank).alias("blank_predictions"),
        F.count_if(clipped().isNull()).alias("missing_confidence"),
        F.count(_id("true_cl_id")).alias("with_true_id"),
        F.count(_id("pred_cl_id")).alias("with_predicted_id"),
        F.count_if(_id("true_cl_id") == _id("pred_cl_id")).alias("matching_ids"),
    )


def top_confusions(predictions: DataFrame, k: int = 20) -> DataFrame:
    """The commonest pairs of true and other predicted label; ties by label."""
    cells = confusion(predictions).where("t != p")
    return cells.orderBy(F.desc("n"), "t", "p").limit(k)


def wrong_examples(predictions: DataFrame, order: str, k: int = 25) -> DataFrame:
    """The first ``k`` wrong predictions in row order."""
    return predictions.where(correct() == 0).orderBy(order).limit(k)


def confusion_pivot(predictions: DataFrame, labels: list[str]) -> DataFrame:
    """Predictions by true label, one column for each given predicted label."""
    rows = predictions.select(F.trim("y_true").alias("y_true"), F.trim("y_pred").alias("p"))
    return rows.groupBy("y_true").pivot("p", labels).count().na.fill(0)


def rerank_audit(predictions: DataFrame) -> DataFrame:
    """One row: how the choice among candidates did against the first and against the best of them.

    Rows without candidates are left out. Harmed: the first was right, the
    choice wrong; fixed the other way.
    """
    rows = predictions.where(F.size("candidates") > 0)
    hits = F.transform("candidates", lambda c: norm_label(c["cell_type"]) == norm_label(F.coalesce("y_true", F.lit("None"))))
    rows = rows.select(
        F.coalesce(F.get(hits, 0), F.lit(False)).cast("double").alias("first"),
        F.exists(hits, lambda h: F.coalesce(h, F.lit(False))).cast("double").alias("any"),
        correct().alias("chosen"),
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.coalesce(F.avg("first"), F.lit(0.0)), DIGITS).alias("top1_accuracy"),
        F.round(F.coalesce(F.avg("any"), F.lit(0.0)), DIGITS).alias("oracle_accuracy"),
        F.round(F.coalesce(F.avg("chosen"), F.lit(0.0)), DIGITS).alias("rerank_accuracy"),
        F.count_if(F.expr("first = 1 and chosen = 0")).alias("harmed"),
        F.count_if(F.expr("first = 0 and chosen = 1")).alias("fixed"),
    )


def _place_of(name: str) -> Column:
    """The rank of the first candidate with a label, or null."""
    return F.get(F.filter("candidates", lambda c: norm_label(c["cell_type"]) == label(name)), 0)["rank"]


def selected_ranks(predictions: DataFrame) -> DataFrame:
    """(``rank``, ``n``): where among the candidates the choice stood."""
    rank = F.coalesce(_place_of("y_pred").cast("string"), F.lit("not_in_candidates"))
    return predictions.where(F.size("candidates") > 0).groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))


def rerank_histograms(predictions: DataFrame) -> DataFrame:
    """(``kind``, ``value``, ``n``): selected ranks, sources of the selection, and numbers of candidates, in one pass."""
    rank = F.coalesce(_place_of("y_pred").cast("string"), F.lit("not_in_candidates"))
    source = F.coalesce(F.nullif(F.col("selection_source"), F.lit("")), F.lit("missing"))
    seen = [("selected_rank", rank), ("selection_source", source), ("candidates", F.size("candidates").cast("string"))]
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in seen]))
    return predictions.where(F.size("candidates") > 0).select(each.alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def harm_examples(predictions: DataFrame, order: str, k: int = 25) -> DataFrame:
    """The first ``k`` rows, in row order, whose first candidate was right and whose choice was wrong."""
    first = F.get("candidates", 0)
    right = norm_label(first["cell_type"]) == label("y_true")
    rows = predictions.where((F.size("candidates") > 0) & F.coalesce(right, F.lit(False)) & (correct() == 0))
    return rows.orderBy(order).limit(k).select(
        order, "y_true", "y_pred", "selection_source", first["cell_type"].alias("top_candidate"),
        first["cell_ontology_id"].alias("top_candidate_cl_id"), _place_of("y_pred").alias("selected_rank"),
    )


def mcnemar(a_only: int, b_only: int) -> float | None:
    """Two-sided exact p-value of a paired comparison's discordant counts; None without any.

    Twice the binomial's lower tail, as a regularized incomplete beta function by
    its continued fraction, so the cost doesn't grow with the counts.
    """
    n, k = int(a_only) + int(b_only), min(int(a_only), int(b_only))
    return None if n == 0 else min(1.0, 2 * _beta_half(n - k, k + 1))


def _beta_half(a: float, b: float) -> float:
    """The regularized incomplete beta function of (a, b) at one half."""
    if a + 1 < b:  # the fraction converges on this side of the mean only
        return 1.0 - _beta_half(b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) - (a + b) * math.log(2.0)) / a
    tiny, x = 1e-300, 0.5
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * out


@F.pandas_udf(T.DoubleType())
def mcnemar_column(a_only: pd.Series, b_only: pd.Series) -> pd.Series:
    """``mcnemar`` as a column; meant for a row a comparison."""
    return pd.Series([mcnemar(a, b) for a, b in zip(a_only, b_only, strict=True)], dtype="float64")


def paired_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: rows right in both, in one only, in neither, accuracies and macro-F1 with their differences, and the exact p-value.

    Rows meet by ``key``. A row that only one side has, or other true labels on
    the two sides, are an error.
    """
    ship_package(a.sparkSession)
    left = a.select(key, label("y_true").alias("t"), correct().alias("a"), F.lit(True).alias("_a"))
    right = b.select(key, label("y_true").alias("t2"), correct().alias("b"), F.lit(True).alias("_b"))
    rows = left.join(right, key, "full")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    checked = (
        F.when(~whole, F.raise_error(F.concat(F.lit("only one side has "), F.col(key).cast("string"))))
        .when(F.col("t") != F.col("t2"), F.raise_error(F.concat(F.lit("true labels differ at "), F.col(key).cast("string"))))
        .otherwise(F.col("a"))
    )
    rows = rows.select(checked.alias("a"), "b")
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.expr("a = 1 and b = 1")).alias("both"),
        F.count_if(F.expr("a = 1 and b = 0")).alias("a_only"),
        F.count_if(F.expr("a = 0 and b = 1")).alias("b_only"),
        F.count_if(F.expr("a = 0 and b = 0")).alias("neither"),
        F.round(F.coalesce(F.avg("a"), F.lit(0.0)), DIGITS).alias("accuracy_a"),
        F.round(F.coalesce(F.avg("b"), F.lit(0.0)), DIGITS).alias("accuracy_b"),
        F.round(F.coalesce(F.avg(F.col("a") - F.col("b")), F.lit(0.0)), DIGITS).alias("accuracy_delta"),
    )
    for side, rows in (("a", a), ("b", b)):
        counts = counts.crossJoin(macro_f1(rows).withColumnRenamed("macro_f1", f"macro_f1_{side}"))  # one row each
    counts = counts.withColumn("macro_f1_delta", F.round(F.col("macro_f1_a") - F.col("macro_f1_b"), DIGITS))
    return counts.withColumn("p_value", F.round(mcnemar_column(F.col("a_only"), F.col("b_only")), DIGITS))


def discordant_pairs(predictions: DataFrame, key: str, by: str) -> DataFrame:
    """(``a``, ``b``, ``n``, ``a_only``, ``b_only``, ``p_value``) of every two values of ``by``, over the rows that both have.

    ``predictions`` have one row for each ``key`` and ``by``; ``a`` < ``b``.
    There are as many values of ``by`` as methods, so rows meet few others.
    """
    ship_package(predictions.sparkSession)
    right = predictions.select(F.col(key), F.col(by).alias("b"), correct().alias("_b"))
    met = predictions.select(key, F.col(by).alias("a"), correct().alias("_a")).join(right, key).where("a < b")
    counts = met.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.expr("_a = 1 and _b = 0")).alias("a_only"), F.count_if(F.expr("_a = 0 and _b = 1")).alias("b_only")
    )
    return counts.withColumn("p_value", F.round(mcnemar_column(F.col("a_only"), F.col("b_only")), DIGITS))


# Chance of at most 0, 1, 2 ... events where one is expected.
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) for i in range(12)]


def _weighted(rows: DataFrame, key: str, resamples: int, seed: int) -> DataFrame:
    """``rows`` once for each resample that draws them, with ``times``: how often.

    How often a row is drawn is Poisson with mean one, from a hash of (seed,
    resample, key): resampling with replacement, each row by itself, so nothing
    is shuffled for it.
    """
    each = rows.withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    u = uniform(F.lit(seed), F.col("resample"), F.col(key))
    times = sum((u >= F.lit(c)).cast("int") for c in _POISSON)
    return each.withColumn("times", times).where("times > 0")


def bootstrap_deltas(a: DataFrame, b: DataFrame, key: str, resamples: int, seed: int = 13) -> DataFrame:
    """(``resample``, ``delta``): accuracy of a less b in each resample of their common rows."""
    rows = a.select(key, correct().alias("a")).join(b.select(key, correct().alias("b")), key)
    drawn = _weighted(rows.select(key, (F.col("a") - F.col("b")).alias("d")), key, resamples, seed)
    return drawn.groupBy("resample").agg(F.try_divide(F.sum(F.col("d") * F.col("times")), F.sum("times")).alias("delta"))


def bootstrap_f1_deltas(a: DataFrame, b: DataFrame, key: str, resamples: int, seed: int = 14) -> DataFrame:
    """(``resample``, ``delta``): macro-F1 of a less b in each resample of their common rows."""
    right = b.select(key, label("y_pred").alias("b"))
    rows = a.select(key, label("y_true").alias("t"), label("y_pred").alias("a")).join(right, key)
    drawn = _weighted(rows, key, resamples, seed)
    cells = drawn.groupBy("resample", "t", "a", "b").agg(F.sum("times").alias("n"))
    parts = F.explode(
        F.array(
            F.struct(F.col("t").alias("label"), F.lit(1).alias("true"), F.lit(0).alias("a"), F.lit(0).alias("b")),
            F.struct(F.col("a").alias("label"), F.lit(0).alias("true"), F.lit(1).alias("a"), F.lit(0).alias("b")),
            F.struct(F.col("b").alias("label"), F.lit(0).alias("true"), F.lit(0).alias("a"), F.lit(1).alias("b")),
        )
    )
    flat = cells.select("resample", "n", "t", F.col("a").alias("pa"), F.col("b").alias("pb"), parts.alias("x"))
    sums = flat.groupBy("resample", "x.label").agg(
        F.sum(F.col("n") * F.col("x.true")).alias("support"),
        F.sum(F.col("n") * F.col("x.a")).alias("said_a"),
        F.sum(F.col("n") * F.col("x.b")).alias("said_b"),
        F.sum(F.when((F.col("x.true") == 1) & (F.col("t") == F.col("pa")), F.col("n")).otherwise(0)).alias("tp_a"),
        F.sum(F.when((F.col("x.true") == 1) & (F.col("t") == F.col("pb")), F.col("n")).otherwise(0)).alias("tp_b"),
    )
    f1 = {s: _share(2.0 * F.col(f"tp_{s}"), F.col("support") + F.col(f"said_{s}")) for s in "ab"}
    return sums.where("support > 0").groupBy("resample").agg(F.avg(f1["a"] - f1["b"]).alias("delta"))


def bootstrap_interval(deltas: DataFrame) -> DataFrame:
    """One row: 2.5th and 97.5th percentile of the deltas, interpolated."""
    return deltas.agg(
        F.round(F.percentile("delta", F.lit(0.025)), DIGITS).alias("low"),
        F.round(F.percentile("delta", F.lit(0.975)), DIGITS).alias("high"),
    )
