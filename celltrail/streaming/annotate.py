"""Annotation of clusters as they arrive: a stream of queries against a fixed marker database."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrail.operators.annotators import annotate_by_overlap


def annotate_stream(queries: DataFrame, records: DataFrame, sink: Callable[[DataFrame, int], None]):
    """Starts a query that annotates each micro-batch and hands it to ``sink`` with its number.

    Batches are whole plans over the static database, so a batch run again after
    a failure gives the same rows; the sink should overwrite by batch number.
    """
    def each(batch: DataFrame, number: int) -> None:
        sink(annotate_by_overlap(batch, records), number)

    return queries.writeStream.foreachBatch(each)


def running_counts(predictions: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Predictions by window and method, with rows up to ``late`` behind; works on streams and tables."""
    return (
        predictions.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("window"), "method")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))
    )
