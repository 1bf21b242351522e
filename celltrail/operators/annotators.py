"""Annotators over query clusters, and the benchmark that runs them.

Queries are (``q_id``, ``tissue``, ``markers``). A language model is any function
from a list of prompts to a list of answers; it is made once a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrail.operators.parse import choose_candidate, parse_response
from celltrail.operators.prompts import SYSTEM_PROMPT, rerank_prompt, user_prompt
from celltrail.operators.similarity import (
    best_with_confidence,
    candidate_lists,
    rank_by_overlap,
    rank_by_signed_sets,
)
from celltrail.session import ship_package

Generate = Callable[[list[str]], list[str]]


def annotate_by_overlap(queries: DataFrame, records: DataFrame, tissues: DataFrame | None = None) -> DataFrame:
    """One prediction a query, by weighted overlap; ``tissues`` as in ``rank_by_overlap``."""
    return best_with_confidence(rank_by_overlap(queries, records, 2, tissues), queries, records)


def annotate_by_signed_sets(queries: DataFrame, records: DataFrame, negative_weight: float = 1.0) -> DataFrame:
    """One prediction a query, by positive and negative marker sets."""
    return best_with_confidence(rank_by_signed_sets(queries, records, 2, negative_weight), queries, records)


def generate_answers(prompts: DataFrame, make: Callable[[], Generate], batch: int = 32) -> DataFrame:
    """(``q_id``, ``answer``) of (``q_id``, ``prompt``); ``make`` loads the model, once a task."""
    kind = prompts.schema["q_id"].dataType.simpleString()
    ship_package(prompts.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()
        for frame in frames:
            texts = frame["prompt"].fillna("").tolist()
            answers = [a for i in range(0, len(texts), batch) for a in generate(texts[i : i + batch])]
            yield pd.DataFrame({"q_id": frame["q_id"], "answer": answers})

    return prompts.select("q_id", "prompt").mapInPandas(run, f"q_id {kind}, answer string")


def annotate_by_prompt(queries: DataFrame, make: Callable[[], Generate], system: str = SYSTEM_PROMPT) -> DataFrame:
    """One prediction a query, read from a model's answer."""
    asked = queries.select(
        "q_id", F.concat(F.lit(system + "\n\n"), user_prompt(F.col("tissue"), F.col("markers")), F.lit("\n\nAssistant:")).alias("prompt")
    )
    read = generate_answers(asked, make).withColumn("p", parse_response(F.col("answer")))
    return read.select("q_id", "p.*", F.col("answer").alias("raw_response"))


def annotate_by_rerank(queries: DataFrame, records: DataFrame, make: Callable[[], Generate], k: int = 5) -> DataFrame:
    """One prediction a query: a model chooses among the ``k`` best candidates.

    The confidence is the answer's, else the candidate's score; no candidates
    give ``Unknown``.
    """
    candidates = candidate_lists(rank_by_overlap(queries, records, k), queries, records)
    asked = queries.join(candidates, "q_id", "left")
    prompts = asked.where(F.size("candidates") > 0).select(
        "q_id", rerank_prompt(F.col("tissue"), F.col("markers"), F.col("candidates")).alias("prompt")
    )
    joined = asked.join(generate_answers(prompts, make), "q_id", "left")
    chosen = joined.withColumn("c", choose_candidate(F.col("answer"), F.col("candidates"))).withColumn("p", parse_response(F.col("answer")))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c.candidate.marker_score")))
    reason = F.coalesce("p.reasoning", F.concat(F.lit("Chosen from the candidates: "), F.col("c.candidate.cell_type")))
    return chosen.select(
        "q_id",
        F.coalesce("c.candidate.cell_type", F.lit("Unknown")).alias("cell_type"),
        F.col("c.candidate.cell_ontology_id").alias("cell_ontology_id"),
        F.coalesce("p.confidence", score, F.lit(0.0)).alias("confidence"),
        F.when(F.col("c.candidate").isNotNull(), reason).alias("reasoning"),
        F.col("c.selection_source").alias("selection_source"),
        F.col("answer").alias("raw_response"),
        "candidates",
    )


def cases(examples: DataFrame) -> DataFrame:
    """(``q_id``, ``tissue``, ``markers``, ``y_true``, ``true_cl_id``) of training records' metadata.

    A case without tissue, cell type or markers is an error.
    """
    m = F.col("metadata")
    missing = m["tissue"].isNull() | m["cell_type"].isNull() | (F.coalesce(F.size(m["markers"]), F.lit(0)) < 1)
    checked = F.when(missing, F.raise_error(F.concat(F.lit("incomplete case "), F.col("example_id").cast("string")))).otherwise(m["cell_type"])
    return examples.select(
        F.col("example_id").alias("q_id"), m["tissue"].alias("tissue"), m["markers"].alias("markers"),
        checked.alias("y_true"), m["cell_ontology_id"].alias("true_cl_id"),
    )


def run_benchmark(annotate: Callable[[DataFrame], DataFrame], queries: DataFrame) -> DataFrame:
    """Prediction records of all cases: what was true beside what was predicted."""
    predicted = annotate(queries.select("q_id", "tissue", "markers"))
    predicted = predicted.withColumnsRenamed({"cell_type": "y_pred", "cell_ontology_id": "pred_cl_id"})
    return queries.join(predicted, "q_id", "left")
