"""Queries that link labels to ontology ids, and curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.functions.text import norm_cl_id, norm_label
from celltrail.functions.variants import variants
from celltrail.operators import curation as cur
from celltrail.operators import linking as lk
from celltrail.plans import sql
from celltrail.plans.markers import database
from celltrail.session import table
from celltrail.sources.tables import parse_obo as parse_stanzas


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prediction table under the names that the operators use; one row a delivery."""
    rows = table(spark, sf_dir, "annotation_prediction")
    return rows.select(
        "pred_id", "example_id", "method", "y_true", F.col("cell_type").alias("y_pred"),
        norm_cl_id(F.col("true_cl_id")).alias("true_cl_id"), norm_cl_id(F.col("cell_ontology_id")).alias("pred_cl_id"),
        "confidence", "runtime_seconds", "cost_usd", "reasoning", "raw_response", "run_at", "arrived_at",
    )


def parse_obo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms written as OBO stanzas and parsed again."""
    terms = table(spark, sf_dir, "cell_ontology_term")
    lines = F.transform(F.coalesce("synonyms", F.array()), lambda s: F.concat(F.lit('synonym: "'), s["text"], F.lit('" '), s["scope"], F.lit(" []")))
    stanza = F.concat_ws(
        "\n", F.lit("[Term]"), F.concat(F.lit("id: "), "cl_id"), F.lit("name: an older name"), F.concat(F.lit("name: "), "name"), F.array_join(lines, "\n"),
        F.when(F.col("is_obsolete"), "is_obsolete: true"),
    )
    other = terms.select(F.concat(F.lit("[Typedef]\nid: "), "cl_id", F.lit("\nname: "), "name").alias("value"))
    read = parse_stanzas(terms.select(stanza.alias("value")).unionByName(other))
    told = F.transform("synonyms", lambda s: F.concat(s["text"], F.lit("/"), s["scope"]))
    return read.select("cl_id", "name", F.array_join(told, "|").alias("synonyms"), "is_obsolete")


def ontology_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.ontology_label_map(table(spark, sf_dir, "cell_ontology_term"))


def ontology_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of several terms, all scopes of synonyms and obsolete terms included."""
    scopes = ("EXACT", "RELATED", "NARROW", "BROAD")
    return lk.ambiguous_labels(table(spark, sf_dir, "cell_ontology_term"), scopes=scopes, include_obsolete=True)


def label_map_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "marker_record")
    return lk.last_wins(rows, F.col("cell_type"), F.lower("cell_type"), F.col("cell_ontology_id"))


def label_variant_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All variants of all labels."""
    labels = table(spark, sf_dir, "marker_record").select("cell_type").where("cell_type is not null").distinct()
    return labels.select("cell_type", F.posexplode(variants(F.col("cell_type"))).alias("place", "variant"))


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ontology_label_map(spark, sf_dir).select(F.col("normalized_label").alias("key"), "cl_id")


def map_label_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "marker_record").select(F.col("cell_type").alias("label"))
    return lk.first_match(labels, _mapping(spark, sf_dir), use_variants=False)


def map_label_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "marker_record").select(F.col("cell_type").alias("label"))
    return lk.first_match(labels, _mapping(spark, sf_dir))


def enrich_cl_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    out = lk.enrich_cl_ids(db, _mapping(spark, sf_dir), use_variants=False)
    return out.select("rec_id", "cell_type", "cell_ontology_id", "outcome")


def enrich_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lk.enrich_cl_ids(database(spark, sf_dir), _mapping(spark, sf_dir), overwrite=True)
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("cell_ontology_id").alias("with_id"))


def unambiguous_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.unambiguous_ids(database(spark, sf_dir))


def map_pred_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lk.map_prediction_ids(predictions(spark, sf_dir), database(spark, sf_dir))
    return out.select("pred_id", "arrived_at", "pred_cl_id", "mapping")


def _harmonizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synonyms as predicted labels, their term's name as the label to use."""
    terms = table(spark, sf_dir, "cell_ontology_term")
    rows = terms.select(
        F.explode("synonyms").alias("s"), F.col("name").alias("harmonized_label"), F.col("cl_id").alias("harmonized_cl_id")
    ).where("s.scope = 'EXACT'")
    return rows.select(F.col("s.text").alias("predicted_label"), "harmonized_label", "harmonized_cl_id", F.col("harmonized_cl_id").alias("rec_id"))


def harmonize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.harmonization_map(_harmonizer(spark, sf_dir))


def harmonize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lk.unambiguous_ids(database(spark, sf_dir))
    out = lk.harmonize(predictions(spark, sf_dir), lk.harmonization_map(_harmonizer(spark, sf_dir)), ids)
    return out.select("pred_id", "arrived_at", "y_pred", "original_y_pred", "pred_cl_id", "harmonized")


def _synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples as predictions, synced row by row with their own metadata."""
    examples = table(spark, sf_dir, "annotation_example")
    said = examples.select(
        F.col("example_id").alias("rec_id"), F.col("cell_type").alias("y_true"), "tissue", "markers", F.col("cell_ontology_id").alias("true_cl_id")
    )
    gold = examples.select(
        F.col("example_id").alias("rec_id"), "metadata.cell_type", "metadata.tissue", "metadata.markers", "metadata.cell_ontology_id"
    )
    return lk.sync_gold(said, gold, allow_mismatch=True)


def sync_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synced(spark, sf_dir).select("rec_id", "true_cl_id", "original_true_cl_id", "mismatch", "change")


def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.sync_counts(_synced(spark, sf_dir))


def unmapped_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.unmapped_groups(database(spark, sf_dir))


def fuzzy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = database(spark, sf_dir).where("cell_ontology_id is null").select(F.col("cell_type").alias("label"))
    return cur.fuzzy_candidates(labels, ontology_label_map(spark, sf_dir))


def _template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cur.curation_template(unmapped_groups(spark, sf_dir), ontology_label_map(spark, sf_dir))


def curation_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _template(spark, sf_dir)


def auto_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cur.auto_accept(_template(spark, sf_dir)).where("accepted_cl_id is not null").select("cell_type", "rank", "accepted_cl_id", "accepted_label")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every label, by the record's own id where another record has one."""
    rows = table(spark, sf_dir, "marker_record").where("cell_type is not null")
    one = rows.groupBy("cell_type").agg(F.min(norm_cl_id(F.col("cell_ontology_id"))).alias("cl_id"), F.min("rec_id").alias("pos"))
    return one.select("cell_type", "cl_id", F.when(F.col("cl_id").isNull(), 1).alias("rank"), F.lit(None).cast("string").alias("accepted_label"), F.lit("seen").alias("notes"), "pos")


def apply_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cur.apply_decisions(_template(spark, sf_dir), _decisions(spark, sf_dir))
    return out.select("cell_type", "rank", "accepted_cl_id", "accepted_label", "notes")


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What decisions on all labels do to a template of the unmapped ones."""
    return cur.decision_counts(unmapped_groups(spark, sf_dir), _decisions(spark, sf_dir))


def mapping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by what became of their id, for each method."""
    out = lk.map_prediction_ids(predictions(spark, sf_dir), database(spark, sf_dir))
    return out.groupBy("method", "mapping").agg(F.count(F.lit(1)).alias("n"), F.count("pred_cl_id").alias("with_id"))


def apply_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lk.unambiguous_ids(database(spark, sf_dir)).select(F.col("key").alias("cell_type"), F.col("cl_id").alias("accepted_cl_id"))
    return lk.apply_curation(database(spark, sf_dir), ids).select("rec_id", "cell_ontology_id", "outcome")


def curation_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unmapped labels with the id that other records give them as suggestion; labels accepted by variant are left out."""
    db = database(spark, sf_dir)
    known = lk.unambiguous_ids(db).select("key", F.col("cl_id").alias("suggested_cl_id"))
    groups = unmapped_groups(spark, sf_dir).withColumn("key", norm_label(F.col("cell_type"))).join(known, "key", "left")
    listed = lk.first_match(groups, _mapping(spark, sf_dir), "cell_type").select(F.col("label").alias("cell_type"), F.col("cl_id").alias("accepted_cl_id"))
    template = groups.join(listed, "cell_type", "left").select(
        "cell_type", "records", F.lit(1).alias("rank"), "suggested_cl_id", F.col("key").alias("suggested_label"), "accepted_cl_id"
    )
    out = cur.curation_priority(template, table(spark, sf_dir, "annotation_example"))
    return out.select("cell_type", "records", "train", "validation", "test", "priority", "top_cl_id", "top_label")


def labels_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir)
    same = norm_label(F.col("y_true")) == norm_label(F.col("y_pred"))
    return rows.groupBy("method").agg(F.count_if(same).alias("matching"), F.count(F.lit(1)).alias("n"))


def ontology_map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.label_map_summary(table(spark, sf_dir, "cell_ontology_term"))


# Names of order states.
ORDER_STATES = {"F": "filled", "O": "open"}


def case_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed list of names; rows without one are dropped."""
    rows = lk.mapped_labels(table(spark, sf_dir, "orders"), "o_orderstatus", ORDER_STATES)
    return rows.groupBy("mapped_label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        parse_obo, ontology_map_summary, case_label_map, ontology_label_map, ontology_ambiguous, label_map_last_wins, label_variant_list, map_label_exact, map_label_variant,
        enrich_cl_ids, enrich_counts, unambiguous_map, map_pred_ids, harmonize_map, harmonize_labels, sync_gold, sync_counts, unmapped_groups,
        fuzzy_candidates, curation_template, auto_accept, apply_decisions, decision_counts, mapping_counts, apply_curation, curation_priority, labels_match,
    )
}


def _labels(scopes: str, obsolete: str) -> str:
    return f"""
    lab as (
        select name as label, cl_id, name as term_name, 'name' as match_source, 0 as pos from cell_ontology_term where {obsolete}
        union all
        select s.text, cl_id, name, 'synonym:' || s.scope, p from (
            select cl_id, name, unnest(k) as s, generate_subscripts(k, 1) as p
            from (select *, list_filter(synonyms, lambda s: s.scope in ({scopes})) as k from cell_ontology_term where {obsolete}))
    ), n as (select *, {sql.label('label')} as normalized_label from lab),
    c as (select *, (select count(distinct b.cl_id) from n b where b.normalized_label = n.normalized_label) as ids from n where normalized_label <> '')"""


_MAP = f"""{_labels("'EXACT'", "not coalesce(is_obsolete, false)").strip()},
    onto as (select * from (select *, row_number() over (partition by normalized_label order by cl_id, pos) as r from c where ids = 1) where r = 1)"""
_UNAMBIGUOUS = f"""
    ua as (select {sql.label('cell_type')} as key, min(cl) as cl_id from db where cl is not null and {sql.label('cell_type')} <> ''
           group by 1 having count(distinct cl) = 1)"""

_LABEL_VARIANTS = sql.variants("select cell_type as label from marker_record").strip()
_PREDICTED = sql.variants("select cell_type as label from annotation_prediction").strip()
_HARMONIZER = f"""hr as (select {sql.strip('s.text')} as label, {sql.strip('name')} as target, {sql.cl_id('cl_id')} as target_cl_id, cl_id as o
           from (select name, cl_id, unnest(synonyms) as s from cell_ontology_term) where s.scope = 'EXACT'),
    {sql.variants("select label from hr where label <> ''", "hv").strip()},
    h as (select variant as key, arg_max(target, o) as target, arg_max(target_cl_id, o) as target_cl_id from hv join hr using (label) where target <> '' group by 1)"""
_SYNC = f"""s0 as (select example_id as rec_id, {sql.cl_id('metadata.cell_ontology_id')} as true_cl_id, {sql.cl_id('cell_ontology_id')} as original_true_cl_id,
        concat_ws(',', case when {sql.label("coalesce(cell_type, '')")} <> {sql.label("coalesce(metadata.cell_type, '')")} then 'cell_type' end,
            case when coalesce(metadata.tissue, '') <> '' and tissue is distinct from metadata.tissue then 'tissue' end,
            case when metadata.markers is not null and coalesce(markers, []) is distinct from metadata.markers then 'markers' end) as mismatch
        from annotation_example),
    s as (select *, case when original_true_cl_id is not distinct from true_cl_id then 'none' when true_cl_id is null then 'cleared'
                         when original_true_cl_id is null then 'filled' else 'changed' end as change from s0)"""
_MAPPED = f"""
        with {sql.DB}, {sql.variants("select cell_type as label from db where cl is not null", "k").strip()}, {_PREDICTED},
        ids as (select variant, min(cl) as cl, count(distinct cl) as n from k join db on label = cell_type where cl is not null group by 1),
        f as (select label, arg_min(struct_pack(cl := cl, n := n), place) as f from v join ids using (variant) group by 1),
        mp as (select method, pred_id, arrived_at, coalesce(p.cl, case when f.n = 1 then f.cl end) as pred_cl_id,
               case when p.cl is not null then 'preserved' when f.n = 1 then 'mapped' when f.n > 1 then 'ambiguous' else 'unmapped' end as mapping
        from (select *, {sql.cl_id('cell_ontology_id')} as cl from annotation_prediction) p left join f on cell_type = label)"""

ORACLES = {
    "ontology_label_map": f"with {_MAP} select label, normalized_label, cl_id, term_name, match_source from onto",
    "ontology_map_summary": f"""with {_MAP}
        select count(*) as rows, count(distinct normalized_label) as labels, count(distinct case when ids > 1 then normalized_label end) as ambiguous_labels,
               count(distinct cl_id) as ids from c""",
    "parse_obo": """select cl_id, name, coalesce(array_to_string(list_transform(synonyms, lambda s: s.text || '/' || s.scope), '|'), '') as synonyms,
        coalesce(is_obsolete, false) as is_obsolete from cell_ontology_term""",
    "case_label_map": """select case o_orderstatus when 'F' then 'filled' when 'O' then 'open' end as mapped_label, count(*) as n
        from orders where o_orderstatus in ('F', 'O') group by 1""",
    "ontology_ambiguous": f"""with {_labels("'EXACT', 'RELATED', 'NARROW', 'BROAD'", "true").strip()}
        select label, normalized_label, cl_id, term_name, match_source from c where ids > 1""",
    "label_map_last_wins": f"""
        with k as (
            select rec_id, {sql.cl_id('cell_ontology_id')} as cl_id, unnest([{sql.label('lower(cell_type)')}, {sql.label('cell_type')}]) as key, unnest([0, 1]) as p
            from marker_record)
        select key, arg_max(cl_id, rec_id * 2 + p) as cl_id from k where key <> '' and cl_id is not null group by 1""",
    "map_label_exact": f"""
        with {_MAP}, l as (select distinct cell_type as label, {sql.label('cell_type')} as key from marker_record where cell_type is not null)
        select l.label, onto.cl_id, onto.normalized_label as matched from l left join onto on l.key = onto.normalized_label""",
    "enrich_cl_ids": f"""
        with {sql.DB}, {_MAP}
        select rec_id, cell_type, coalesce(cl, cl_id) as cell_ontology_id,
               case when cl is not null then 'preserved' when cl_id is null then 'unmapped' else 'mapped' end as outcome
        from db left join onto on {sql.label('cell_type')} = normalized_label""",
    "unambiguous_map": f"with {sql.DB}, {_UNAMBIGUOUS.strip()} select key, cl_id from ua",
    "label_variant_list": f"with {_LABEL_VARIANTS} select label as cell_type, place, variant from v",
    "map_label_variant": f"""
        with {_MAP}, {_LABEL_VARIANTS}, f as (select v.label, arg_min(cl_id, place) as cl_id, arg_min(variant, place) as matched from v join onto on variant = normalized_label group by 1)
        select vl.label, cl_id, matched from vl left join f using (label)""",
    "enrich_counts": f"""
        with {sql.DB}, {_MAP}, {_LABEL_VARIANTS}, f as (select v.label, arg_min(cl_id, place) as cl_id from v join onto on variant = normalized_label group by 1),
        o as (select cl, cl_id, case when cl_id is null then case when cl is null then 'unmapped' else 'preserved' end
                     when cl is null then 'mapped' when cl = cl_id then 'unchanged' else 'overwritten' end as outcome from db left join f on cell_type = label)
        select outcome, count(*) as n, count(coalesce(cl_id, cl)) as with_id from o group by 1""",
    "map_pred_ids": f"{_MAPPED} select pred_id, arrived_at, pred_cl_id, mapping from mp",
    "mapping_counts": f"{_MAPPED} select method, mapping, count(*) as n, count(pred_cl_id) as with_id from mp group by 1, 2",
    "decision_counts": f"""
        with {sql.DB}, u as (select distinct {sql.label('cell_type')} as k from db where cl is null and cell_type is not null),
        d as (select cell_type, {sql.label('cell_type')} as k from marker_record where cell_type is not null group by 1)
        select count(*) as decisions, count(u.k) as accepted, 0 as skipped, count(*) - count(u.k) as missing from d left join u using (k)""",
    "harmonize_map": f"with {_HARMONIZER} select key, target, target_cl_id from h",
    "harmonize_labels": f"""
        with {sql.DB}, {_UNAMBIGUOUS.strip()}, {_HARMONIZER}, {_PREDICTED},
        f as (select label, arg_min(struct_pack(t := target, c := target_cl_id), place) as f from v join h on variant = key group by 1)
        select pred_id, arrived_at, coalesce(f.t, cell_type) as y_pred, cell_type as original_y_pred,
               case when f is not null then coalesce(f.c, ua.cl_id, p.cl) else p.cl end as pred_cl_id, f is not null as harmonized
        from (select *, {sql.cl_id('cell_ontology_id')} as cl from annotation_prediction) p left join f on cell_type = label
        left join ua on ua.key = {sql.label('coalesce(f.t, cell_type)')}""",
    "sync_gold": f"with {_SYNC} select rec_id, true_cl_id, original_true_cl_id, mismatch, change from s",
    "sync_counts": f"""
        with {_SYNC} select count(*) as records, count(*) filter (change <> 'none') as changed, count(*) filter (change = 'filled') as filled,
               count(*) filter (change = 'cleared') as cleared, count(*) filter (mismatch <> '') as mismatches,
               count(original_true_cl_id) as before_with_id, count(true_cl_id) as after_with_id from s""",
    "unmapped_groups": f"""
        with {sql.DB} select cell_type, count(*) as records, coalesce(string_agg(distinct nullif(tissue, ''), '; ' order by nullif(tissue, '')), '') as tissues,
               coalesce(string_agg(distinct nullif(source, ''), '; ' order by nullif(source, '')), '') as sources
        from db where cl is null and cell_type is not null group by 1""",
    "apply_curation": f"""
        with {sql.DB}, {_UNAMBIGUOUS.strip()}
        select rec_id, coalesce(cl, cl_id) as cell_ontology_id,
               case when cl_id is null then 'untouched' when cl is not null then 'preserved' else 'applied' end as outcome
        from db left join ua on {sql.label('cell_type')} = key""",
    "curation_priority": f"""
        with {sql.DB}, {_MAP}, {_UNAMBIGUOUS.strip()}, u as (select cell_type, count(*) as records from db where cl is null and cell_type is not null group by 1),
        {sql.variants("select cell_type as label from db where cl is null").strip()}, acc as (select distinct v.label from v join onto on variant = normalized_label),
        x as (select {sql.label('cell_type')} as k, count(*) filter (split = 'train') as train, count(*) filter (split = 'validation') as validation,
                     count(*) filter (split = 'test') as test from annotation_example group by 1)
        select u.cell_type, records, coalesce(train, 0) as train, coalesce(validation, 0) as validation, coalesce(test, 0) as test,
               1000 * coalesce(test, 0) + 100 * coalesce(validation, 0) + coalesce(train, 0) as priority, ua.cl_id as top_cl_id, {sql.label('u.cell_type')} as top_label
        from u left join x on {sql.label('u.cell_type')} = k left join ua on {sql.label('u.cell_type')} = ua.key where u.cell_type not in (select label from acc)""",
    "labels_match": f"""
        select method, count(*) filter ({sql.label('y_true')} = {sql.label('cell_type')}) as matching, count(*) as n from annotation_prediction group by 1""",
}
