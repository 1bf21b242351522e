"""Queries of the operators for training data, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.functions.text import norm_label
from celltrail.llm.copies import collapse_copies, find_copies
from celltrail.llm.label_map import list_forms, map_labels, map_rows
from celltrail.llm.leaks import exact_leaks, find_leaks
from celltrail.llm.overlap import overlap_counts, overlap_members, overlap_pairs, overlap_sets
from celltrail.llm.packing import pack_documents, packing_report, token_counts
from celltrail.llm.related import related_forest, related_groups, related_splits
from celltrail.llm.responses import defective, flag_responses
from celltrail.llm.subjects import corpus_shares, document_subjects
from celltrail.plans import sql
from celltrail.session import cut_lineage, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a training and an evaluation record with similar marker sets."""
    return overlap_pairs(table(spark, sf_dir, "annotation_example"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping evaluation records by split and source."""
    return overlap_counts(table(spark, sf_dir, "annotation_example"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each overlapping record with its marker set and the number of similar sets across."""
    return overlap_members(table(spark, sf_dir, "annotation_example"))


def p2_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar marker sets of evaluation and training with their numbers of records."""
    return overlap_sets(table(spark, sf_dir, "annotation_example"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record that is not the smallest of its group of related ones."""
    groups = related_groups(table(spark, sf_dir, "annotation_example"))
    return groups.where("example_id != group_id").select("group_id", "example_id").distinct()


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its new split."""
    return related_splits(table(spark, sf_dir, "annotation_example"))


def p3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the spanning forest."""
    return related_forest(table(spark, sf_dir, "annotation_example"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each copy other than the smallest of its group."""
    return find_copies(table(spark, sf_dir, "marker_record"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each group with its number of copies."""
    kept = collapse_copies(table(spark, sf_dir, "marker_record"))
    return kept.select("rec_id", "tissue", "cell_type", "markers", "copies")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each defective response with its defect."""
    return defective(table(spark, sf_dir, "annotation_prediction"), table(spark, sf_dir, "annotation_example"))


def p5_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered response with all defects that apply."""
    flagged = flag_responses(table(spark, sf_dir, "annotation_prediction"), table(spark, sf_dir, "annotation_example"))
    return flagged.select("pred_id", "arrived_at", F.array_join("defects", ",").alias("defects"), "defect")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "marker_record")
    predictions = table(spark, sf_dir, "annotation_prediction")
    return records.select(
        F.lit("marker_record").alias("src"), F.col("rec_id").alias("row_id"), F.col("cell_type").alias("label")
    ).unionByName(
        predictions.select(
            F.lit("annotation_prediction").alias("src"), F.col("pred_id").alias("row_id"), F.col("cell_type").alias("label")
        )
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose label is not a term's name, with the term meant or ``unmatched``."""
    return map_rows(_labels(spark, sf_dir), table(spark, sf_dir, "cell_ontology_term"))


def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct label with term, score, edits and the form it was matched by."""
    return map_labels(_labels(spark, sf_dir), table(spark, sf_dir, "cell_ontology_term"))


def p7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``p7_found`` says of rows whose label is one term's form but for case, hyphens and blanks."""
    labels, terms = _labels(spark, sf_dir), table(spark, sf_dir, "cell_ontology_term")
    forms = list_forms(terms).groupBy(norm_label(F.col("form")).alias("_key")).agg(F.count_distinct("cl_id").alias("_ids")).where("_ids = 1")
    alike = labels.select("src", "row_id", norm_label(F.col("label")).alias("_key")).join(forms.select("_key"), "_key", "left_semi")
    return map_rows(labels, terms).join(alike.select("src", "row_id").distinct(), ["src", "row_id"], "left_semi")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a long one, with its container of 1,024 tokens."""
    sizes = cut_lineage(token_counts(table(spark, sf_dir, "documents")))
    return pack_documents(sizes)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing_report(p8_packed(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the items they share twelve consecutive words with."""
    return exact_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and items with passages within one word edit."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and the subjects that a quarter of their sentences deal with."""
    return document_subjects(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_subject"), table(spark, sf_dir, "subject_area")
    )


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's shares by subject."""
    return corpus_shares(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_subject"), table(spark, sf_dir, "subject_area")
    )


QUERIES = {
    f.__name__: f
    for f in (
        p2_found, p2_counts, p2_members, p2_sets, p3_found, p3_forest, p3_splits, p4_found, p4_collapsed, p5_found, p5_flags, p7_found, p7_labels, p7_exact,
        p8_packed, p8_report, p9_found, p9_near, p10_found, p10_shares,
    )
}

_PLAIN = r"nullif(lower(regexp_replace({0}, '[^\p{{L}}\p{{Nd}}]', '', 'g')), '')"

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")
_HIDDEN = r"[\x00-\x08\x0e-\x1f\x7f\x{ad}\x{34f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{fe00}-\x{fe0f}\x{feff}]"


def _visible(x: str) -> str:
    """Lower case without invisible signs; DuckDB has no NFKC, so of its mappings only wide letters and blanks."""
    return f"lower(translate(regexp_replace(coalesce({x}, ''), '{_HIDDEN}', '', 'g'), '{_WIDE}' || chr(12288) || chr(160), '{_NARROW}' || '  '))"


def _words(x: str) -> str:
    return f"array_to_string(regexp_extract_all({_visible(x)}, '[\\p{{L}}\\p{{N}}]+|\\+'), ' ')"


_COPIES = f"""k as (select rec_id, tissue, cell_type, markers, {_words('tissue')} || chr(10) || {_words('cell_type')} || chr(10) || array_to_string(list_sort(list_distinct(list_filter(
            list_transform(regexp_split_to_array({_visible('markers')}, '[\\s,;|/]+'), lambda p: regexp_replace(p, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda p: p <> ''))), ' ') as key
        from marker_record), g as (select key, min(rec_id) as least, count(*) as copies from k group by 1)"""

_SETS = r"""
        with a as (
            select example_id, split, source, list_sort(list_distinct(list_filter(list_transform(case
                when len(metadata.original_markers) > 0 then metadata.original_markers
                when len(markers) > 0 then markers
                else regexp_split_to_array(trim(regexp_replace(regexp_replace(prompt,
                    '(?is)^.*(\bmarkers?\s*[:=]|\bgenes?\s*(->|[:=])|\bexpress(es|ing)?\s*:?\s|->|:)\s*', ''),
                    '(?s)[.?!](\s+\pL.*)?\s*$', '')), '[\s,;|/]+') end,
                lambda m: upper(regexp_replace(m, '^\s+|\s+$', '', 'g'))), lambda m: m is not null and m <> ''))) as s
            from annotation_example
        ), e as (select * from a where split in ('validation', 'test') and len(s) > 0),
        t as (select * from a where split = 'train' and len(s) > 0)"""
_SIMILAR = """least(len(e.s), len(t.s)) >= 0.7 * greatest(len(e.s), len(t.s)) - 1e-9
          and len(list_intersect(e.s, t.s)) >= 0.7 * (len(e.s) + len(t.s) - len(list_intersect(e.s, t.s))) - 1e-9"""

_NAMED = """named as (select s, min(example_id) as rep, count(*) filter (split <> 'train') as l, count(*) filter (split = 'train') as r
        from a where split in ('train', 'validation', 'test') and len(s) > 0 group by 1),
    prs as (select x.s as l, y.s as r, x.rep as rep_l, y.rep as rep_r, len(list_intersect(x.s, y.s)) as common,
                   len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)) as union_size, x.l as left_records, y.r as right_records
            from named x, named y where x.l > 0 and y.r > 0 and least(len(x.s), len(y.s)) >= 0.7 * greatest(len(x.s), len(y.s)) - 1e-9
              and len(list_intersect(x.s, y.s)) >= 0.7 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) - 1e-9)"""

ORACLES = {
    "p2_found": _SETS + """
        select distinct least(e.example_id, t.example_id) as example_id_1, greatest(e.example_id, t.example_id) as example_id_2 from e, t where """ + _SIMILAR,
    "p2_counts": _SETS + f""", h as (select distinct e.example_id from e, t where {_SIMILAR}), x as (select example_id from e where s in (select s from t)),
        k as (select example_id, split, unnest(case when len(l) > 0 then l else ['none'] end) as source from (
            select example_id, split, list_distinct(list_filter(list_transform(string_split(source, ';'), lambda v: {_PLAIN.format("v")}), lambda v: v is not null)) as l from e))
        select split, source, count(*) as records, count(h.example_id) as overlapping, count(x.example_id) as exact
        from k left join h using (example_id) left join x using (example_id) group by 1, 2""",
    "p2_sets": _SETS + f""", {_NAMED} select rep_l as left_id, rep_r as right_id, common, union_size, left_records, right_records from prs""",
    "p2_members": _SETS + f""", {_NAMED}, o as (select l, false as tr, count(*) as others from prs group by 1 union all select r, true, count(*) from prs group by 1)
        select example_id, split, named.rep as set_id, others from a join named using (s) join o on o.l = a.s and o.tr = (split = 'train') where split in ('train', 'validation', 'test')""",
    "p7_exact": f"""
        with f as (select cl_id, name as form from cell_ontology_term where not coalesce(is_obsolete, false) union
                   select cl_id, s.text from (select cl_id, unnest(synonyms) as s from cell_ontology_term where not coalesce(is_obsolete, false)) where upper(s.scope) = 'EXACT'),
        k as (select {sql.label('form')} as key, min(cl_id) as cl_id from f where trim(form) <> '' group by 1 having count(distinct cl_id) = 1),
        r as (select 'marker_record' as src, rec_id as row_id, cell_type from marker_record union select 'annotation_prediction', pred_id, cell_type from annotation_prediction)
        select distinct src, row_id, cl_id from r join k on {sql.label('cell_type')} = key
        where cell_type not in (select name from cell_ontology_term where not coalesce(is_obsolete, false))""",
    "p3_found": rf"""
        with recursive k as (
            select example_id, 's' || {_PLAIN.format("x")} as key
            from (select example_id, unnest(string_split(source, ';')) as x from annotation_example)
            union
            select example_id, 'k' || {_PLAIN.format("tissue")} || '/' || {_PLAIN.format("cell_type")} from annotation_example
        ), links as (
            select distinct a.example_id as x, m.least as y
            from k a join (select key, min(example_id) as least from k where key is not null group by key) m using (key)
            where a.key is not null
        ), pairs as (select x, y from links union select y, x from links),
        reach as (
            select x, y from pairs
            union
            select r.x, b.y from reach r join pairs b on r.y = b.x
        ), least as (select x as example_id, min(y) as group_id from reach group by x)
        select group_id, example_id from least where group_id < example_id
    """,
    "p4_found": f"with {_COPIES} select least as rec_id, rec_id as copy_rec_id from k join g using (key) where rec_id <> least",
    "p4_collapsed": f"with {_COPIES} select rec_id, tissue, cell_type, markers, copies from k join g using (key) where rec_id = least",
    "p9_found": r"""
        with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
        i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item),
        dg as (select doc_id, array_to_string(w[s : s + 11], ' ') as g from (select *, unnest(range(1, len(w) - 10)) as s from d)),
        ig as (select item_id, array_to_string(w[s : s + 11], ' ') as g from (select *, unnest(range(1, len(w) - 10)) as s from i))
        select distinct doc_id, item_id from dg join ig using (g)
    """,
    # One word edit: a word of the passage left out, one inside put for another, or one put in between.
    "p9_near": r"""
        with d as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
        i as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from eval_item where text is not null),
        iw as (select item_id, s, w[s : s + 11] as p from (select *, unnest(range(1, len(w) - 10)) as s from i)),
        ds as (select doc_id, w, unnest(range(1, len(w) + 1)) as s from d),
        iv as (
            select item_id, s, 'p' as kind, array_to_string(p, ' ') as g from iw
            union all select item_id, s, 'd', array_to_string(p[1 : k - 1] || p[k + 1 : 12], ' ') from iw, range(1, 13) r(k)
            union all select item_id, s, 's' || k, array_to_string(p[1 : k - 1] || p[k + 1 : 12], ' ') from iw, range(2, 12) r(k)),
        dv as (
            select doc_id, 'p' as kind, 0 as distance, array_to_string(w[s : s + 11], ' ') as g from ds where s + 11 <= len(w)
            union all select doc_id, 'd', 1, array_to_string(w[s : s + 10], ' ') from ds where s + 10 <= len(w)
            union all select doc_id, 's' || k, 1, array_to_string(w[s : s + k - 2] || w[s + k : s + 11], ' ') from ds, range(2, 12) r(k) where s + 11 <= len(w)
            union all select doc_id, 'p', 1, array_to_string(w[s : s + k - 2] || w[s + k : s + 12], ' ') from ds, range(2, 13) r(k) where s + 12 <= len(w)),
        m as (select doc_id, item_id, s, min(distance) as distance from dv join iv using (kind, g) group by 1, 2, 3)
        select doc_id, item_id, min(distance) as distance, count(*) as passages, count(*) filter (distance = 0) as exact from m group by 1, 2
    """,
}
