"""Labels to ontology ids: label tables, ordered lookups, enrichment, harmonisation, gold labels.

Variants are computed once for each distinct label; lookups are left joins on
them whose first match by variant order wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from celltrail.functions.text import norm_cl_id, norm_label, norm_tissue, strip
from celltrail.functions.variants import variants
from celltrail.session import salted_join


def ontology_labels(terms: DataFrame, scopes: tuple[str, ...] = ("EXACT",), include_obsolete: bool = False) -> DataFrame:
    """(``label``, ``normalized_label``, ``cl_id``, ``term_name``, ``match_source``, ``pos``, ``ids``) of names and synonyms.

    ``ids`` counts the distinct ids of a normalized label. Labels that
    normalize to nothing are dropped.
    """
    kept = terms if include_obsolete else terms.where(~F.coalesce("is_obsolete", F.lit(False)))
    name = F.array(F.struct(F.col("name").alias("label"), F.lit("name").alias("match_source")))
    synonyms = F.transform(
        F.filter(F.coalesce("synonyms", F.array()), lambda s: s["scope"].isin(*scopes)),
        lambda s: F.struct(s["text"].alias("label"), F.concat(F.lit("synonym:"), s["scope"]).alias("match_source")),
    )
    rows = kept.select("cl_id", F.col("name").alias("term_name"), F.posexplode(F.concat(name, synonyms)).alias("pos", "x"))
    rows = rows.select(
        "x.label", norm_label(F.col("x.label")).alias("normalized_label"), "cl_id", "term_name", "x.match_source", "pos"
    ).where("normalized_label != ''")
    ids = rows.groupBy("normalized_label").agg(F.count_distinct("cl_id").cast("int").alias("ids"))
    return rows.join(ids, "normalized_label")


def ontology_label_map(terms: DataFrame, **options) -> DataFrame:
    """One row for each label with a single id: the name before synonyms, then the smallest id and first place."""
    labels = ontology_labels(terms, **options).where("ids = 1")
    first = Window.partitionBy("normalized_label").orderBy("cl_id", "pos")
    return labels.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "pos", "ids")


def ambiguous_labels(terms: DataFrame, **options) -> DataFrame:
    """All rows of labels with several ids."""
    return ontology_labels(terms, **options).where("ids > 1").drop("pos", "ids")


def last_wins(mapping: DataFrame, label: Column, normalized: Column, cl_id: Column, order: str = "rec_id") -> DataFrame:
    """(``key``, ``cl_id``): of rows with one key the last counts; a row gives its normalized label and its label."""
    keys = F.filter(F.array(norm_label(normalized), norm_label(label)), lambda k: k.isNotNull() & (k != ""))
    rows = mapping.select(F.posexplode(keys).alias("k", "key"), norm_cl_id(cl_id).alias("cl_id"), order).where("cl_id is not null")
    return rows.groupBy("key").agg(F.max_by("cl_id", F.struct(order, "k")).alias("cl_id"))


def first_match(labels: DataFrame, mapping: DataFrame, label: str = "label", use_variants: bool = True) -> DataFrame:
    """(label, ``cl_id``, ``matched``) of each distinct label: the id of its first listed variant, or nulls.

    ``mapping`` has ``key`` (unique) and ``cl_id``.
    """
    distinct = labels.select(F.col(label).alias("label")).where("label is not null").distinct()
    forms = variants(F.col("label")) if use_variants else F.array(norm_label(F.col("label")))
    tried = distinct.select("label", F.posexplode(forms).alias("place", "key")).join(mapping.select("key", "cl_id"), "key")
    found = tried.groupBy("label").agg(
        F.min_by("cl_id", "place").alias("cl_id"), F.min_by("key", "place").alias("matched")
    )
    return distinct.join(found, "label", "left")


def enrich_cl_ids(records: DataFrame, mapping: DataFrame, overwrite: bool = False, use_variants: bool = True) -> DataFrame:
    """Records with ids from their labels, and ``outcome``: preserved, mapped, overwritten, unchanged or unmapped.

    An id that is there is kept unless ``overwrite``. Labels that are null map
    to nothing. A hot label is salted.
    """
    found = first_match(records, mapping, "cell_type", use_variants)
    joined = salted_join(
        records, found.select(F.col("label").alias("cell_type"), F.col("cl_id").alias("_found"), "matched"), "cell_type"
    )
    has = F.col("cell_ontology_id").isNotNull()
    new = F.col("_found").isNotNull()
    outcome = (
        F.when(has & ~F.lit(overwrite), "preserved")
        .when(~new, F.when(has, "preserved").otherwise("unmapped"))
        .when(~has, "mapped")
        .when(F.col("cell_ontology_id") == F.col("_found"), "unchanged")
        .otherwise("overwritten")
    )
    joined = joined.withColumn("outcome", outcome)
    chosen = F.when(F.col("outcome").isin("mapped", "overwritten"), F.col("_found")).otherwise(F.col("cell_ontology_id"))
    return joined.withColumn("cell_ontology_id", chosen).drop("_found")


def conflict_checked(rows: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """(key, value): fails where one key has two values."""
    grouped = rows.groupBy(key).agg(F.min(value).alias(value), F.count_distinct(value).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"{what} conflicts for "), F.col(key)))).otherwise(F.col(value))
    return grouped.select(key, checked.alias(value))


def apply_curation(records: DataFrame, curation: DataFrame, overwrite: bool = False) -> DataFrame:
    """Records with the accepted ids of curation rows (``cell_type``, ``accepted_cl_id``), and ``outcome``.

    Two accepted ids for one normalized label are an error. Blank ids accept nothing.
    """
    accepted = curation.select(
        norm_label(F.col("cell_type")).alias("_key"), norm_cl_id(F.col("accepted_cl_id")).alias("_accepted")
    ).where("_accepted is not null and _key != ''")
    accepted = conflict_checked(accepted, "_key", "_accepted", "curation")
    joined = salted_join(records.withColumn("_key", norm_label(F.col("cell_type"))), accepted, "_key")
    has, new = F.col("cell_ontology_id").isNotNull(), F.col("_accepted").isNotNull()
    outcome = F.when(~new, "untouched").when(has & ~F.lit(overwrite), "preserved").otherwise("applied")
    joined = joined.withColumn("outcome", outcome)
    chosen = F.when(F.col("outcome") == "applied", F.col("_accepted")).otherwise(F.col("cell_ontology_id"))
    return joined.withColumn("cell_ontology_id", chosen).drop("_key", "_accepted")


def label_ids(records: DataFrame) -> DataFrame:
    """(``key``, ``ids``, ``n``): the distinct ids that records give each variant of their label."""
    listed = records.where("cell_type is not null and cell_ontology_id is not null").select("cell_type", "cell_ontology_id").distinct()
    forms = listed.select(F.explode(variants(F.col("cell_type"))).alias("key"), "cell_ontology_id").distinct()
    return forms.groupBy("key").agg(
        F.min("cell_ontology_id").alias("cl_id"), F.count(F.lit(1)).cast("int").alias("n")
    )


def unambiguous_ids(records: DataFrame) -> DataFrame:
    """(``key``, ``cl_id``) of normalized labels that records give exactly one id."""
    rows = records.where("cell_ontology_id is not null").select(norm_label(F.col("cell_type")).alias("key"), "cell_ontology_id")
    grouped = rows.where("key != ''").groupBy("key").agg(
        F.min("cell_ontology_id").alias("cl_id"), F.max("cell_ontology_id").alias("_max")
    )
    return grouped.where("cl_id = _max").drop("_max")


def map_prediction_ids(predictions: DataFrame, records: DataFrame, overwrite: bool = False) -> DataFrame:
    """Predictions with ids from the labels of ``records``, and ``mapping``: preserved, mapped, ambiguous or unmapped.

    The first variant that records list decides; with several ids it is ambiguous.
    """
    known = label_ids(records)
    distinct = predictions.select(F.col("y_pred").alias("label")).where("label is not null").distinct()
    tried = distinct.select("label", F.posexplode(variants(F.col("label"))).alias("place", "key")).join(known, "key")
    found = tried.groupBy("label").agg(F.min_by(F.struct("cl_id", "n"), "place").alias("_f"))
    joined = salted_join(predictions, found.withColumnRenamed("label", "y_pred"), "y_pred")
    has = F.col("pred_cl_id").isNotNull()
    mapping = (
        F.when(has & ~F.lit(overwrite), "preserved")
        .when(F.col("_f.n") == 1, "mapped")
        .when(F.col("_f.n") > 1, "ambiguous")
        .otherwise("unmapped")
    )
    joined = joined.withColumn("mapping", mapping)
    chosen = F.when(F.col("mapping") == "mapped", F.col("_f.cl_id")).otherwise(F.col("pred_cl_id"))
    return joined.withColumn("pred_cl_id", chosen).drop("_f")


def harmonization_map(rows: DataFrame, order: str = "rec_id") -> DataFrame:
    """(``key``, ``target``, ``target_cl_id``) of every variant of predicted labels; two targets for one are an error."""
    listed = rows.select(
        strip(F.col("predicted_label")).alias("label"), strip(F.col("harmonized_label")).alias("target"),
        norm_cl_id(F.col("harmonized_cl_id")).alias("target_cl_id"), order,
    ).where("label != '' and target != ''")
    forms = listed.select(F.explode(variants(F.col("label"))).alias("key"), "target", "target_cl_id", order)
    grouped = forms.groupBy("key").agg(
        F.max_by(F.struct("target", "target_cl_id"), order).alias("e"),
        F.count_distinct(norm_label(F.col("target"))).alias("n"),
    )
    target = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("targets conflict for "), F.col("key")))).otherwise(F.col("e.target"))
    return grouped.select("key", target.alias("target"), F.col("e.target_cl_id").alias("target_cl_id"))


def harmonize(predictions: DataFrame, mapping: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Predictions under harmonized labels; ids come from the map, else from ``ids`` (``key``, ``cl_id``), else stay."""
    distinct = predictions.select(F.col("y_pred").alias("label")).where("label is not null").distinct()
    tried = distinct.select("label", F.posexplode(variants(F.col("label"))).alias("place", "key")).join(mapping, "key")
    found = tried.groupBy("label").agg(F.min_by(F.struct("target", "target_cl_id"), "place").alias("_f"))
    joined = salted_join(predictions, found.withColumnRenamed("label", "y_pred"), "y_pred")
    joined = joined.withColumn("original_y_pred", F.col("y_pred")).withColumn("_hit", F.col("_f").isNotNull())
    joined = joined.withColumn("y_pred", F.coalesce("_f.target", "y_pred")).withColumn("_key", norm_label(F.col("y_pred")))
    if ids is not None:
        joined = salted_join(joined, ids.select(F.col("key").alias("_key"), F.col("cl_id").alias("_cl")), "_key")
    else:
        joined = joined.withColumn("_cl", F.lit(None).cast("string"))
    new = F.when(F.col("_hit"), F.coalesce("_f.target_cl_id", "_cl", "pred_cl_id")).otherwise(F.col("pred_cl_id"))
    return joined.withColumn("pred_cl_id", new).withColumnRenamed("_hit", "harmonized").drop("_f", "_key", "_cl")


def sync_gold(predictions: DataFrame, gold: DataFrame, allow_mismatch: bool = False, key: str = "rec_id") -> DataFrame:
    """Predictions with the gold ids of the row at the same place, ``original_true_cl_id``, ``mismatch`` and ``change``.

    Both sides carry their place in ``key``; predictions have ``y_true``,
    ``tissue``, ``markers`` and ``true_cl_id``, the gold ``cell_type``,
    ``tissue``, ``markers`` and ``cell_ontology_id``. ``mismatch`` lists what
    differs: the label, a tissue or marker list that the gold gives. A place
    that only one side has is an error, and so is a mismatch unless allowed.
    ``change`` is filled, cleared, changed or none.
    """
    right = gold.select(
        F.col(key), F.col("cell_type").alias("_label"), F.col("tissue").alias("_tissue"), F.col("markers").alias("_markers"),
        norm_cl_id(F.col("cell_ontology_id")).alias("_gold"), F.lit(True).alias("_there"),
    )
    joined = predictions.withColumn("_here", F.lit(True)).join(right, key, "full")
    blank = F.lit("")
    none = F.array().cast("array<string>")
    differs = {
        "cell_type": ~norm_label(F.coalesce("y_true", blank)).eqNullSafe(norm_label(F.coalesce("_label", blank))),
        "tissue": (F.coalesce("_tissue", blank) != "") & ~F.col("tissue").eqNullSafe(F.col("_tissue")),
        "markers": F.col("_markers").isNotNull() & ~F.coalesce("markers", none).eqNullSafe(F.col("_markers")),
    }
    reasons = F.array_join(F.array_compact(F.array(*[F.when(d, name) for name, d in differs.items()])), ",")
    place = F.col(key).cast("string")
    lone = F.col("_here").isNull() | F.col("_there").isNull()
    checked = F.when(lone, F.raise_error(F.concat(F.lit("only one side has row "), place)))
    if not allow_mismatch:
        checked = checked.when(reasons != "", F.raise_error(F.concat(F.lit("rows differ at "), place, F.lit(": "), reasons)))
    before = norm_cl_id(F.col("true_cl_id"))
    change = (
        F.when(before.eqNullSafe(F.col("_gold")), "none")
        .when(F.col("_gold").isNull(), "cleared")
        .when(before.isNull(), "filled")
        .otherwise("changed")
    )
    joined = joined.withColumns({"mismatch": checked.otherwise(reasons), "change": change, "original_true_cl_id": before})
    return joined.withColumn("true_cl_id", F.col("_gold")).drop("_label", "_tissue", "_markers", "_gold", "_there", "_here")


def sync_counts(synced: DataFrame) -> DataFrame:
    """One row of counts of ``sync_gold``; changed ones include those filled and cleared."""
    return synced.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("change") != "none").alias("changed"),
        F.count_if(F.col("change") == "filled").alias("filled"),
        F.count_if(F.col("change") == "cleared").alias("cleared"),
        F.count_if(F.col("mismatch") != "").alias("mismatches"),
        F.count("original_true_cl_id").alias("before_with_id"),
        F.count("true_cl_id").alias("after_with_id"),
    )


def unmapped_groups(records: DataFrame) -> DataFrame:
    """(``cell_type``, ``records``, ``tissues``, ``sources``) of labels without id; members sorted, joined with ``; ``."""
    def joined(c: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))), "; ")

    return records.where("cell_ontology_id is null and cell_type is not null").groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("records"), joined("tissue").alias("tissues"), joined("source").alias("sources")
    )


def mapped_labels(rows: DataFrame, label: str, names: dict[str, str], unmapped: str = "drop") -> DataFrame:
    """``rows`` with ``mapped_label`` from a fixed list of names; others are dropped, kept as null, or an error."""
    if unmapped not in ("drop", "keep", "error"):
        raise ValueError("unmapped must be drop, keep or error")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = table[F.col(label)]
    if unmapped == "error":
        message = F.concat(F.lit("no name for "), F.coalesce(F.col(label), F.lit("null")))
        return rows.withColumn("mapped_label", F.when(found.isNull(), F.raise_error(message)).otherwise(found))
    named = rows.withColumn("mapped_label", found)
    return named.where("mapped_label is not null") if unmapped == "drop" else named


def label_map_summary(terms: DataFrame, **options) -> DataFrame:
    """One row: rows, labels, labels with several ids, and ids of a label table."""
    rows = ontology_labels(terms, **options)
    return rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("normalized_label").alias("labels"),
        F.count_distinct(F.when(F.col("ids") > 1, F.col("normalized_label"))).alias("ambiguous_labels"),
        F.count_distinct("cl_id").alias("ids"),
    )
