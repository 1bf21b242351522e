"""Human curation of labels without an ontology id."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from celltrail.functions.text import norm_cl_id, norm_label
from celltrail.functions.variants import variants
from celltrail.session import ship_package, shuffle_width


def _letter_counts(texts: pd.Series) -> np.ndarray:
    """How often each of 64 classes of letters comes in each text."""
    known: dict[str, np.ndarray] = {}
    for t in texts.unique():
        known[t] = np.bincount([ord(c) & 63 for c in t], minlength=64).astype(np.int16)
    return np.stack([known[t] for t in texts]) if len(texts) else np.zeros((0, 64), np.int16)


@F.pandas_udf(T.DoubleType())
def ratio_bound(a: pd.Series, b: pd.Series) -> pd.Series:
    """What the matching ratio can't exceed: twice the letters that both have over both lengths."""
    common = np.minimum(_letter_counts(a), _letter_counts(b)).sum(axis=1)
    return pd.Series(2.0 * common / np.maximum(a.str.len().to_numpy() + b.str.len().to_numpy(), 1))


def _scored(frames: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Pairs that come by variant, the highest bound first, with their scores; those that ``k`` terms surely beat are left out."""
    now, best, least = None, {}, -1.0
    matcher = SequenceMatcher(None, "", "")
    for frame in frames:
        kept, scores = [], []
        for i, (q, c, cl_id, jaccard, bound) in enumerate(zip(*(frame[x] for x in ("q", "c", "cl_id", "jaccard", "bound")), strict=True)):
            if q != now:
                now, best, least = q, {}, -1.0
            if bound + 0.0006 < least:  # scores are rounded to three decimals
                continue
            matcher.set_seqs(q, c)
            score = round(0.65 * matcher.ratio() + 0.35 * jaccard, 3)
            if score < least:
                continue
            kept.append(i)
            scores.append(score)
            if score > best.get(cl_id, -1.0):
                best[cl_id] = score
                best = dict(sorted(best.items(), key=lambda x: -x[1])[:k])
                least = min(best.values()) if len(best) == k else -1.0
        yield frame.iloc[kept][["q", "cl_id", "term_name", "suggestion"]].assign(score=scores)


def fuzzy_candidates(labels: DataFrame, ontology: DataFrame, k: int = 5) -> DataFrame:
    """(``label``, ``rank``, ``cl_id``, ``term_name``, ``suggestion``, ``score``): the likeliest terms of each label.

    A label is tried in all its variants. Candidates of a variant share a word
    with it, or one text holds the other. Words meet in an equi-join;
    containment is found through the shorter text's first three characters (all
    of a shorter one's), which are among the longer one's pieces. The score is
    0.65 of the matching ratio and 0.35 of the words' Jaccard similarity, to
    three decimals; the best of a label's variants counts. Pairs are scored in
    the order of an upper bound, as far as they can be among the first ``k``.
    """
    spelt = labels.select("label").where("label is not null").distinct().select("label", F.explode(variants(F.col("label"))).alias("q"))
    query = spelt.select("q").distinct()
    listed = ontology.select(F.col("normalized_label").alias("c"), "label", "cl_id", "term_name").withColumnRenamed("label", "suggestion")
    listed = listed.where("c != '' and cl_id is not null")
    words_q = query.select("q", F.explode(F.array_distinct(F.split("q", " "))).alias("w"))
    words_c = listed.select("c", F.explode(F.array_distinct(F.split("c", " "))).alias("w"))
    by_word = words_q.join(words_c.distinct(), "w").drop("w")

    def pieces(c: str):
        at = F.sequence(F.lit(1), F.length(c))
        return F.explode(F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*[F.substring(F.col(c), i, F.lit(n)) for n in (1, 2, 3)])))))

    texts = listed.select("c").distinct()
    held = query.select("q", F.substring("q", 1, 3).alias("p")).join(texts.select("c", pieces("c").alias("p")), "p").where(F.contains("c", "q"))
    holds = query.select("q", pieces("q").alias("p")).join(texts.select("c", F.substring("c", 1, 3).alias("p")), "p").where(F.contains("q", "c"))
    pairs = by_word.unionByName(held.drop("p")).unionByName(holds.drop("p")).distinct()
    a, b = F.split("q", " "), F.split("c", " ")
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    ship_package(labels.sparkSession)
    bounded = pairs.withColumn("jaccard", jaccard).withColumn("bound", 0.65 * ratio_bound(F.col("q"), F.col("c")) + 0.35 * F.col("jaccard")).join(listed, "c")
    schema = "q string, cl_id string, term_name string, suggestion string, score double"
    met = bounded.repartition(max(shuffle_width(labels.sparkSession), labels.sparkSession.sparkContext.defaultParallelism), "q").sortWithinPartitions("q", F.desc("bound"))
    scored = met.mapInPandas(lambda frames: _scored(frames, k), schema)
    of_variant = Window.partitionBy("q", "cl_id").orderBy(F.desc("score"), "suggestion")
    scored = scored.withColumn("_n", F.row_number().over(of_variant)).where("_n = 1")
    # What k terms beat by one variant, they beat by the label's best; equal scores stay.
    ahead = F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))
    scored = spelt.join(scored.withColumn("_n", ahead).where(F.col("_n") <= k), "q")
    best = Window.partitionBy("label", "cl_id").orderBy(F.desc("score"), "suggestion")
    order = Window.partitionBy("label").orderBy(F.desc("score"), "term_name", "cl_id")
    ranked = scored.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("label", "rank", "cl_id", "term_name", "suggestion", "score")


def curation_template(unmapped: DataFrame, ontology: DataFrame, k: int = 5) -> DataFrame:
    """Rows for a human to accept: every unmapped label with its suggestions, or with one empty row."""
    found = fuzzy_candidates(unmapped.select(F.col("cell_type").alias("label")), ontology, k)
    joined = unmapped.join(found.withColumnRenamed("label", "cell_type"), "cell_type", "left")
    empty = F.lit(None).cast("string")
    return joined.select(
        "cell_type", "records", "tissues", "sources", F.coalesce("rank", F.lit(1)).alias("rank"),
        F.col("cl_id").alias("suggested_cl_id"), F.col("suggestion").alias("suggested_label"),
        F.col("term_name").alias("suggested_term_name"), F.col("score").alias("suggestion_score"),
        empty.alias("accepted_cl_id"), empty.alias("accepted_label"), empty.alias("notes"),
    )


def auto_accept(template: DataFrame, min_score: float = 0.8) -> DataFrame:
    """The template with the first suggestion of each open label accepted that scores and is the label by a variant.

    Rows of a label are in the order of ``rank``.
    """
    open_label = F.max(F.col("accepted_cl_id").isNotNull()).over(Window.partitionBy("cell_type")) == False  # noqa: E712
    names = F.array(norm_label(F.col("suggested_label")), norm_label(F.col("suggested_term_name")))
    fits = (
        F.col("suggested_cl_id").isNotNull()
        & (F.coalesce(F.col("suggestion_score").cast("double"), F.lit(0.0)) >= min_score)
        & F.arrays_overlap(variants(F.col("cell_type")), names)
    )
    marked = template.withColumn("_fit", F.coalesce(fits, F.lit(False)) & open_label)
    first = F.row_number().over(Window.partitionBy("cell_type", "_fit").orderBy("rank")) == 1
    marked = marked.withColumn("_take", F.col("_fit") & first)
    return marked.withColumn(
        "accepted_cl_id", F.when(F.col("_take"), F.col("suggested_cl_id")).otherwise(F.col("accepted_cl_id"))
    ).withColumn(
        "accepted_label", F.when(F.col("_take"), F.col("suggested_label")).otherwise(F.col("accepted_label"))
    ).drop("_fit", "_take")


def _said(decisions: DataFrame) -> DataFrame:
    """Decisions by normalized label: ``d_id``, ``d_rank``, ``d_label``, ``d_note``, blank ones null."""
    return decisions.select(
        norm_label(F.col("cell_type")).alias("_key"), norm_cl_id(F.col("cl_id").cast("string")).alias("d_id"), F.col("rank").cast("int").alias("d_rank"),
        F.nullif(F.col("accepted_label"), F.lit("")).alias("d_label"), F.nullif(F.col("notes"), F.lit("")).alias("d_note"), "pos",
    )


def decision_counts(template: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: decisions, those that accept a term of a label of the template, those that only note or say nothing, and those whose label it lacks."""
    there = template.select(norm_label(F.col("cell_type")).alias("_key"), F.lit(True).alias("_there")).distinct()
    joined = _said(decisions).join(there, "_key", "left")
    told = F.col("d_id").isNotNull() | F.col("d_rank").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(told & F.col("_there")).alias("accepted"),
        F.count_if(~told & F.col("_there")).alias("skipped"), F.count_if(F.col("_there").isNull()).alias("missing"),
    )


def apply_decisions(template: DataFrame, decisions: DataFrame, skip_missing: bool = True) -> DataFrame:
    """The template after decisions (``cell_type``, ``cl_id``, ``rank``, ``accepted_label``, ``notes``, ``pos``).

    Per label the last decision with an id, a rank or a note counts: one with
    neither id nor rank clears the acceptance. The accepted row is the
    suggestion with that id, else of that rank, else the first; other rows of
    the label are cleared. A note stays on the row it was written to. Labels
    that the template lacks are passed over, or an error.
    """
    key = norm_label(F.col("cell_type"))
    said = _said(decisions)
    if not skip_missing:
        lacking = said.join(template.select(key.alias("_key")).distinct(), "_key", "left_anti").select("_key").limit(1).collect()
        if lacking:
            raise ValueError(f"the template lacks {lacking[0][0]}")
    said = said.where("d_id is not null or d_rank is not null or d_note is not null")
    rows = template.withColumn("_key", key)
    pairs = rows.select("_key", "rank", "suggested_cl_id").join(said, "_key")
    review = F.col("d_id").isNull() & F.col("d_rank").isNull()
    hit = F.when(F.col("d_id").isNotNull(), F.col("suggested_cl_id").eqNullSafe(F.col("d_id"))).otherwise(F.col("rank").eqNullSafe(F.col("d_rank")))
    order = Window.partitionBy("_key", "pos").orderBy(F.when(hit & ~review, 0).otherwise(1), "rank")
    target = pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    last = target.groupBy("_key").agg(F.max_by(F.struct("rank", "d_id", "d_label", review.alias("clear")), "pos").alias("a"))
    notes = target.where("d_note is not null").groupBy("_key", "rank").agg(F.max_by("d_note", "pos").alias("_note"))
    joined = rows.join(last, "_key", "left").join(notes, ["_key", "rank"], "left")
    mine = (F.col("a.rank") == F.col("rank")) & ~F.col("a.clear")
    decided = F.col("a").isNotNull()
    new_id = F.when(decided, F.when(mine, F.coalesce("a.d_id", "suggested_cl_id"))).otherwise(F.col("accepted_cl_id"))
    new_label = F.when(decided, F.when(mine, F.coalesce("a.d_label", "suggested_label"))).otherwise(F.col("accepted_label"))
    return joined.withColumns(
        {"accepted_cl_id": new_id, "accepted_label": new_label, "notes": F.coalesce("_note", "notes")}
    ).drop("_key", "a", "_note")


def accept_suggestion(template: DataFrame, cell_type: str, cl_id: str | None = None, rank: int | None = None, label: str | None = None, notes: str | None = None) -> DataFrame:
    """The template after one decision; without an id the first rank counts."""
    spark = template.sparkSession
    one = [(cell_type, cl_id, rank if rank is not None or cl_id else 1, label, notes, 0)]
    return apply_decisions(template, spark.createDataFrame(one, "cell_type string, cl_id string, rank int, accepted_label string, notes string, pos int"), skip_missing=False)


def curation_priority(template: DataFrame, examples: DataFrame, include_accepted: bool = False) -> DataFrame:
    """Open labels by what they cost: a thousand for each test, a hundred for each validation, one for each training record."""
    counts = examples.groupBy(norm_label(F.col("cell_type")).alias("_key")).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")]
    )
    rows = template.groupBy("cell_type").agg(
        F.max("records").alias("records"),
        F.max(F.col("accepted_cl_id")).alias("accepted"),
        F.min_by("suggested_cl_id", "rank").alias("top_cl_id"),
        F.min_by("suggested_label", "rank").alias("top_label"),
    )
    if not include_accepted:
        rows = rows.where("accepted is null")
    joined = rows.withColumn("_key", norm_label(F.col("cell_type"))).join(counts, "_key", "left").na.fill(0, ["train", "validation", "test"])
    score = 1000 * F.col("test") + 100 * F.col("validation") + F.col("train")
    return joined.withColumn("priority", score).drop("_key", "accepted")
