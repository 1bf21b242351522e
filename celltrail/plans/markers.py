"""Queries over marker tables and set-similarity ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.functions.text import norm_cl_id, norm_gene_list, norm_label, norm_tissue
from celltrail.operators.annotators import annotate_by_overlap, annotate_by_signed_sets
from celltrail.operators.markers import (
    marker_records,
    merge_marker_records,
    normalize_marker_table,
    species_matches,
    summarize_markers,
)
from celltrail.operators.parse_errors import split_marker_lines
from celltrail.operators.similarity import candidate_lists, marker_weights, rank_by_overlap, rank_by_signed_sets
from celltrail.operators.splits import number_rows
from celltrail.plans import sql
from celltrail.plans.data_quality import LINES
from celltrail.session import table


def database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marker records of the tables, normalised."""
    return marker_records(table(spark, sf_dir, "marker_record"))


def clusters(spark: SparkSession, sf_dir: str, *also: str) -> DataFrame:
    """The examples' clusters as queries; ``also`` are further columns."""
    examples = table(spark, sf_dir, "annotation_example")
    markers = norm_gene_list(F.array_join(F.coalesce("metadata.markers", "markers"), ","))
    return examples.select(F.col("example_id").alias("q_id"), F.coalesce("tissue", F.lit("")).alias("tissue"), markers.alias("markers"), *also)


def scan_marker_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    return db.select("rec_id", "tissue", "cell_type", "cell_ontology_id", F.array_join("markers", ",").alias("markers"), F.size("markers").alias("n_markers"))


def norm_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "marker_record").select(norm_label(F.col("cell_type")).alias("label"), norm_tissue(F.col("tissue")).alias("tissue"))
    return rows.groupBy("label", "tissue").agg(F.count(F.lit(1)).alias("n"))


def norm_cl_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "marker_record").select(norm_cl_id(F.col("cell_ontology_id")).alias("cl_id"))
    return rows.groupBy("cl_id").agg(F.count(F.lit(1)).alias("n"))


def species_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "marker_record").withColumn("species", F.element_at("metadata", "species"))
    return rows.where(species_matches(F.col("species"), "Human")).groupBy("species").agg(F.count(F.lit(1)).alias("n"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_marker_lines(table(spark, sf_dir, "cellmarker_raw"))[0]


def normalize_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-gene-per-row lines to marker records."""
    lines = _lines(spark, sf_dir).withColumn("note", F.coalesce(F.col("PMID").cast("string"), F.col("evidence")))
    out = normalize_marker_table(
        lines, "tissueType", "cellName", marker="geneSymbol", cl_id="CellOntologyID", evidence="note",
        species_column="speciesType", species="Human", default_source="cellmarker", min_markers=2, order="line_id",
    )
    return out.select("tissue", "cell_type", "cell_ontology_id", "source", "species", F.array_join("markers", ",").alias("markers"), "evidence")


def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker lists in one cell to marker records."""
    rows = table(spark, sf_dir, "marker_record").withColumn("species", F.element_at("metadata", "species"))
    out = normalize_marker_table(
        rows, "tissue", "cell_type", markers="markers", cl_id="cell_ontology_id", source="source", evidence="evidence",
        species_column="species", default_source="marker_record", min_markers=2,
    )
    return out.select("tissue", "cell_type", "cell_ontology_id", "source", "species", F.array_join("markers", ",").alias("markers"), "evidence")


def _merged_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge_marker_records(database(spark, sf_dir), min_markers=2)
    keys = {"t": F.lower("tissue"), "c": F.lower("cell_type"), "i": F.coalesce("cell_ontology_id", F.lit("")), "tissue": F.col("tissue"), "cell_type": F.col("cell_type")}
    order = [F.coalesce(k, F.lit("")) for k in keys.values()]
    return number_rows(merged, *order)


def merged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records in their final order, by tissue, cell type and id, as numbers."""
    return _merged_in_order(spark, sf_dir).select("place", "tissue", "cell_type", "cell_ontology_id")


def merge_marker_dbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge_marker_records(database(spark, sf_dir), min_markers=2)
    return out.select("tissue", "cell_type", "cell_ontology_id", F.array_join("markers", ",").alias("markers"), "source", "evidence")


def summarize_marker_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize_markers(database(spark, sf_dir))


def marker_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = marker_weights(database(spark, sf_dir))
    return weights.select("marker", "records", F.round("weight", 9).alias("weight"))


def marker_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five likeliest records of every example's cluster, by weighted Jaccard similarity."""
    return rank_by_overlap(clusters(spark, sf_dir), database(spark, sf_dir), 5)


def sctype_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_by_signed_sets(clusters(spark, sf_dir), database(spark, sf_dir), 5)


def overlap_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_by_overlap(clusters(spark, sf_dir), database(spark, sf_dir))


def sctype_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate_by_signed_sets(clusters(spark, sf_dir), database(spark, sf_dir))


def overlap_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate lists, their overlaps as text."""
    queries, db = clusters(spark, sf_dir), database(spark, sf_dir)
    lists = candidate_lists(rank_by_overlap(queries, db, 3), queries, db)
    one = lists.select("q_id", F.explode("candidates").alias("c"))
    return one.select("q_id", "c.rank", "c.cell_type", F.array_join("c.overlap", ",").alias("overlap"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_marker_db, norm_labels, norm_cl_ids, species_filter, normalize_markers, normalize_records, merge_marker_dbs, merged_order,
        summarize_marker_db, marker_idf, marker_overlap_topk, sctype_topk, overlap_confidence, sctype_confidence, overlap_candidates,
    )
}

_CLUSTERS = f"""
    raw_q as (
        select example_id as q_id, lower(trim(coalesce(tissue, ''))) as tkey,
               list_transform(list_filter(coalesce(metadata.markers, markers), lambda x: x is not null), lambda x: {sql.gene('x')}) as l
        from annotation_example
    ), q as (
        select distinct q_id, case when tkey in (select lower(trim(tissue)) from db) then tkey else '*' end as tkey, unnest(l) as m from raw_q
    ), qs as (select * from q where m <> '')"""

_NEGATIVE = f"coalesce(metadata['negative_markers'], '')"

_RANKED = f"""
    dbk as (
        select rec_id, lower(trim(tissue)) as tkey, coalesce({sql.label('cell_type')}, '') as lk, coalesce(cl, '') as ck, list_distinct(m) as m,
               list_distinct(list_filter(list_transform(regexp_split_to_array({_NEGATIVE}, '(?:{sql.WS}|[,;|/])+'), lambda x: {sql.gene('x')}), lambda x: x <> '')) as neg
        from db
    ), held as (
        select * from dbk where tkey is not null and tkey in (select tkey from qs)
        union all select * replace ('*' as tkey) from dbk where '*' in (select tkey from qs)
    )"""

_PICK = """
    once as (select *, row_number() over (partition by q_id, lk, ck order by {order}) as n from scored),
    first as (select * from once where n = 1),
    ranked as (select *, row_number() over (partition by q_id order by {order}) as rank from first)"""

_SCORED = f"""
    w as (select m, 1.0 / count(*) as w from (select rec_id, unnest(list_distinct(m)) as m from db) group by m),
    {_RANKED.strip()},
    qw as (select q_id, any_value(tkey) as tkey, sum(coalesce(w.w, 1.0)) as qw from qs left join w using (m) group by q_id),
    rx as (select tkey, rec_id, lk, ck, unnest(m) as m from held),
    rw as (select tkey, rec_id, sum(w.w) as rw from rx join w using (m) group by all),
    pairs as (select q_id, tkey, rec_id, sum(w.w) as o, count(*) as common from qs join rx using (tkey, m) join w using (m) group by all),
    scored as (
        select qw.q_id, h.rec_id, h.lk, h.ck, coalesce(round(o / (qw + rw - o), 9), 0.0) as score, coalesce(common, 0) as common
        from qw join held h using (tkey) left join rw using (tkey, rec_id) left join pairs using (q_id, tkey, rec_id)
    ),
    {_PICK.format(order="score desc, common desc, lk desc, rec_id").strip()}"""

_SIGNED = f"""
    {_RANKED.strip()},
    w as (select m, 1.0 / count(*) as w from (select rec_id, unnest(m) as m from dbk union all select rec_id, unnest(neg) from dbk) group by m),
    sides as (select tkey, rec_id, unnest(m) as m, 1 as sign from held union all select tkey, rec_id, unnest(neg), -1 from held),
    pairs as (
        select q_id, tkey, rec_id, coalesce(sum(w.w) filter (sign > 0), 0.0) as p, coalesce(sum(w.w) filter (sign < 0), 0.0) as n,
               count(*) filter (sign > 0) as positive, count(*) filter (sign < 0) as negative
        from qs join sides using (tkey, m) join w using (m) group by all
    ),
    scored as (
        select a.q_id, h.rec_id, h.lk, h.ck, coalesce(positive, 0) as positive, coalesce(negative, 0) as negative,
               coalesce(round(p / sqrt(greatest(len(h.m), 1)) - n / sqrt(greatest(len(h.neg), 1)), 9), 0.0) as score
        from (select distinct q_id, tkey from qs) a join held h using (tkey) left join pairs using (q_id, tkey, rec_id)
    ),
    {_PICK.format(order="score desc, positive desc, negative, lk desc, rec_id").strip()}"""

_BEST = f"""
    best as (select q_id, max(case when rank = 1 then score end) as best, max(case when rank = 1 then rec_id end) as rec_id,
                    coalesce(max(case when rank = 2 then score end), 0.0) as second from ranked where rank <= 2 group by 1)
    select raw_q.q_id, case when best > 0 then db.cell_type else 'Unknown' end as cell_type, case when best > 0 then db.cl end as cell_ontology_id,
           coalesce(best, 0.0) as score,
           case when best > 0 then round(least(1.0, greatest(0.0, best + greatest(0.0, best - second))), 9) else 0.0 end as confidence
    from raw_q left join best using (q_id) left join db using (rec_id)"""

_GROUPED = """
    seen as (select {keys}, m, min(struct_pack(o := ord, i := p)) as f from flat where m <> '' group by all),
    ev as (select {keys}, e, min(ord) as f from rows where e is not null group by all),
    evs as (select {keys}, string_agg(e, ' | ' order by f) as evidence from ev group by all),
    ms as (select {keys}, list(m order by f) as m from seen group by all)"""

ORACLES = {
    "scan_marker_db": f"""with {sql.DB} select rec_id, tissue, cell_type, cl as cell_ontology_id, array_to_string(m, ',') as markers, len(m) as n_markers from db""",
    "norm_labels": f"select {sql.label('cell_type')} as label, {sql.tissue('tissue')} as tissue, count(*) as n from marker_record group by 1, 2",
    "norm_cl_ids": f"select {sql.cl_id('cell_ontology_id')} as cl_id, count(*) as n from marker_record group by 1",
    "species_filter": """
        select species, count(*) as n from (select metadata['species'] as species from marker_record)
        where regexp_replace(lower(species), '[^a-z0-9]+', '', 'g') = 'human'
           or len(list_intersect(list_transform(regexp_split_to_array(species, '[^A-Za-z0-9]+'), lambda t: lower(t)),
                                 ['human', 'homo', 'homosapiens', 'hs', 'hsapiens'])) > 0
        group by 1""",
    "normalize_records": f"""
        with {sql.DB}, rows as (
            select d.rec_id as ord, nullif({sql.strip('r.tissue')}, '') as tissue, nullif({sql.strip('r.cell_type')}, '') as cell_type, d.cl,
                   coalesce(nullif({sql.strip('r.source')}, ''), 'marker_record') as source, nullif({sql.strip("r.metadata['species']")}, '') as species,
                   nullif({sql.strip('r.evidence')}, '') as e, d.m
            from marker_record r join db d using (rec_id)
            where nullif({sql.strip('r.tissue')}, '') is not null and nullif({sql.strip('r.cell_type')}, '') is not null and len(d.m) > 0
        ), flat as (select * exclude (m, e), unnest(m) as m, generate_subscripts(m, 1) as p from rows),
        {_GROUPED.format(keys="tissue, cell_type, cl, source, species").strip()}
        select {sql.tissue('ms.tissue')} as tissue, ms.cell_type, ms.cl as cell_ontology_id, ms.source, ms.species, array_to_string(m, ',') as markers, evidence
        from ms left join evs on ms.tissue = evs.tissue and ms.cell_type = evs.cell_type and ms.cl is not distinct from evs.cl
             and ms.source = evs.source and ms.species is not distinct from evs.species
        where len(m) >= 2""",
    "normalize_markers": f"""
        with {LINES}, rows as (
            select line_id as ord, nullif({sql.strip('c1')}, '') as tissue, nullif({sql.strip('c2')}, '') as cell_type, {sql.cl_id('c3')} as cl, 'cellmarker' as source,
                   nullif({sql.strip('c5')}, '') as species, nullif(c6, '') as e, {sql.gene('c4')} as m
            from loaded where coalesce(c1, '') <> '' and coalesce(c2, '') <> '' and coalesce(c4, '') <> ''
              and (regexp_replace(lower(c5), '[^a-z0-9]+', '', 'g') = 'human' or len(list_intersect(list_transform(regexp_split_to_array(c5, '[^A-Za-z0-9]+'), lambda t: lower(t)),
                   ['human', 'homo', 'homosapiens', 'hs', 'hsapiens'])) > 0)
        ), flat as (select * exclude (e), 0 as p from rows),
        {_GROUPED.format(keys="tissue, cell_type, cl, source, species").strip()}
        select {sql.tissue('ms.tissue')} as tissue, ms.cell_type, ms.cl as cell_ontology_id, ms.source, ms.species, array_to_string(m, ',') as markers, evidence
        from ms left join evs on ms.tissue = evs.tissue and ms.cell_type = evs.cell_type and ms.cl is not distinct from evs.cl
             and ms.source = evs.source and ms.species is not distinct from evs.species
        where len(m) >= 2""",
    "merge_marker_dbs": f"""
        with {sql.DB}, rows as (
            select rec_id as ord, tissue, cell_type, cl, nullif({sql.strip('source')}, '') as s, nullif({sql.strip('evidence')}, '') as e, m from db
        ), flat as (select * exclude (m, e, s), unnest(m) as m, generate_subscripts(m, 1) as p from rows),
        {_GROUPED.format(keys="tissue, cell_type, cl").strip()},
        ss as (select tissue, cell_type, cl, string_agg(s, '; ' order by f) as source from
               (select tissue, cell_type, cl, s, min(ord) as f from rows where s is not null group by all) group by all)
        select ms.tissue, ms.cell_type, ms.cl as cell_ontology_id, array_to_string(m, ',') as markers, source, evidence
        from ms left join evs on ms.tissue is not distinct from evs.tissue and ms.cell_type is not distinct from evs.cell_type and ms.cl is not distinct from evs.cl
                left join ss on ms.tissue is not distinct from ss.tissue and ms.cell_type is not distinct from ss.cell_type and ms.cl is not distinct from ss.cl
        where len(m) >= 2""",
    "merged_order": f"""
        with {sql.DB}, k as (select d.tissue, d.cell_type, d.cl, count(distinct x) as n from (select tissue, cell_type, cl, unnest(m) as x from db) d group by 1, 2, 3 having count(distinct x) >= 2)
        select row_number() over (order by coalesce(lower(tissue), ''), coalesce(lower(cell_type), ''), coalesce(cl, ''), coalesce(tissue, ''), coalesce(cell_type, '')) - 1 as place,
               tissue, cell_type, cl as cell_ontology_id from k""",
    "summarize_marker_db": f"""
        with {sql.DB} select count(*) as records, count(distinct tissue) as tissues, count(distinct cell_type) as cell_types,
               count(cl) as records_with_cl_id, round(avg(len(m)), 6) as mean_markers,
               (select count(distinct x) from (select unnest(m) as x from db)) as unique_markers from db""",
    "marker_idf": f"""
        with {sql.DB} select m as marker, count(*) as records, round(1.0 / count(*), 9) as weight from (select unnest(m) as m from db) group by 1""",
    "marker_overlap_topk": f"""with {sql.DB}, {_CLUSTERS.strip()}, {_SCORED.strip()}
        select q_id, rank, rec_id, score, common from ranked where rank <= 5""",
    "sctype_topk": f"""with {sql.DB}, {_CLUSTERS.strip()}, {_SIGNED.strip()}
        select q_id, rank, rec_id, score, positive, negative from ranked where rank <= 5""",
    "overlap_confidence": f"""with {sql.DB}, {_CLUSTERS.strip()}, {_SCORED.strip()}, {_BEST.strip()}""",
    "sctype_confidence": f"""with {sql.DB}, {_CLUSTERS.strip()}, {_SIGNED.strip()}, {_BEST.strip()}""",
    "overlap_candidates": f"""with {sql.DB}, {_CLUSTERS.strip()}, {_SCORED.strip()}
        select r.q_id, r.rank, d.cell_type, coalesce((select string_agg(m, ',' order by m) from qs where qs.q_id = r.q_id and list_contains(d.m, qs.m)), '') as overlap
        from ranked r join db d using (rec_id) where r.rank <= 3""",
}
