"""Answers of a language model as columns.

The patterns are fixed values: they say which lines of an answer are which
field. Java's ``d`` flag makes only the line feed end a line, ``U`` takes blanks
and letters as Unicode does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celltrail.functions.text import norm_cl_id, norm_label, squeeze, strip

# Fixed values.
_LEAD = r"^\s*(?:[-*]\s*)?(?:\*\*)?"
_AFTER = r"(?:\*\*)?\s*:\s*(?:\*\*)?\s*"
CELL_TYPE = rf"(?imdU){_LEAD}cell\s*type{_AFTER}(.+)$"
CL_ID = rf"(?imdU){_LEAD}(?:cell\s*ontology\s*id|cl\s*id){_AFTER}(CL[:_]\d+)"
CONFIDENCE = rf"(?imdU){_LEAD}confidence(?:\s*score)?{_AFTER}([01](?:\.\d+)?|\d{{1,3}}(?:\.\d+)?%)"
REASONING = rf"(?imsdU){_LEAD}(?:biological\s*)?reasoning{_AFTER}(.+)"
LABEL_FOR_ID = rf"(?imdU){_LEAD}cell\s*ontology\s*id{_AFTER}(?!CL[:_]\d+)(?!GO[:_]\d+)(.+)$"
LIKELY = r"(?isdU)\blikely\s+to\s+be\s+(?:a|an|the)?\s*(?:\*\*)?([A-Za-z][^*.\n]+?)(?:\*\*)?(?:[.;\n]|$)"
CANDIDATE = r"(?iU)candidate\s*:\s*(\d+)"
NOT_A_LABEL = r"(?iU)\b(given|provided|marker|predict|cell\s*type)\b"


def _found(text: Column, pattern: str) -> Column:
    """The first group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def cleaned(value: Column) -> Column:
    """Without bullets, marks, a leading article and outer punctuation; single spaces."""
    x = F.regexp_replace(strip(value), r"^(?:[-*](?U:\s)*)+", "")
    x = F.regexp_replace(F.regexp_replace(x, r"^(?U:\s)*[`*_]+", ""), r"[`*_]+(?U:\s)*$", "")
    x = F.regexp_replace(strip(x), r"(?iU)^(?:a|an|the)\s+", "")
    return squeeze(F.regexp_replace(x, r"^[ \t\r\n.;]+|[ \t\r\n.;]+$", ""))


def _confidence(text: Column) -> Column:
    raw = _found(text, CONFIDENCE)
    number = F.regexp_replace(raw, "%", "").cast("double")
    value = F.when(raw.endswith("%"), number / 100.0).otherwise(number)
    return F.when(value.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))


def parse_response(text: Column) -> Column:
    """STRUCT of cell_type, cell_ontology_id, confidence and reasoning; a null answer is an empty one.

    Without a cell type line the label is, in this order, what stands in place
    of an ontology id, what the cluster is said to be likely, or the first line
    unless it speaks of the question. ``10%`` reads as 1: the leading digit wins.
    """
    t = F.coalesce(text, F.lit(""))
    first = F.regexp_extract(F.regexp_replace(t, r"(?U)^\s+", ""), r"^([^\n\r]*)", 1)
    fallback = (
        F.when(t.rlike(LABEL_FOR_ID), cleaned(_found(t, LABEL_FOR_ID)))
        .when(t.rlike(LIKELY), cleaned(_found(t, LIKELY)))
        .when((first == "") | first.rlike(NOT_A_LABEL), "Unknown")
        .otherwise(cleaned(first))
    )
    return F.struct(
        F.when(t.rlike(CELL_TYPE), cleaned(_found(t, CELL_TYPE))).otherwise(fallback).alias("cell_type"),
        norm_cl_id(_found(t, CL_ID)).alias("cell_ontology_id"),
        _confidence(t).alias("confidence"),
        cleaned(_found(t, REASONING)).alias("reasoning"),
    )


def choose_candidate(text: Column, candidates: Column) -> Column:
    """STRUCT of the candidate an answer chooses and how: by number, by label, or the first for want of either.

    No candidates give nulls and ``no_candidates``.
    """
    number = _found(F.coalesce(text, F.lit("")), CANDIDATE).cast("int")
    label = norm_label(parse_response(text)["cell_type"])
    by_number = F.get(F.filter(candidates, lambda c: c["rank"] == number), 0)
    by_label = F.get(F.filter(candidates, lambda c: norm_label(c["cell_type"]) == label), 0)
    source = (
        F.when(F.coalesce(F.size(candidates), F.lit(0)) < 1, "no_candidates")
        .when(by_number.isNotNull(), "candidate_number")
        .when(by_label.isNotNull(), "cell_type_label")
        .otherwise("fallback_top_candidate")
    )
    return F.struct(F.coalesce(by_number, by_label, F.get(candidates, 0)).alias("candidate"), source.alias("selection_source"))


def reparse(predictions: DataFrame, raw: str = "raw_response") -> DataFrame:
    """Predictions read again from their stored answers; what they said before is kept in ``original_*``.

    Rows without an answer stay as they are.
    """
    read = predictions.withColumn("_p", parse_response(F.col(raw)))
    again = F.coalesce(F.length(F.col(raw)), F.lit(0)) > 0
    kept = read.withColumns({f"original_{c}": F.col(c) for c in ("y_pred", "pred_cl_id", "confidence")})
    return kept.withColumns(
        {
            "y_pred": F.when(again, F.col("_p.cell_type")).otherwise(F.col("y_pred")),
            "pred_cl_id": F.when(again, F.col("_p.cell_ontology_id")).otherwise(F.col("pred_cl_id")),
            "confidence": F.when(again, F.col("_p.confidence")).otherwise(F.col("confidence")),
            "reparsed": again,
        }
    ).drop("_p")
