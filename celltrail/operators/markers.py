"""Marker tables: normalise, merge, summarise.

Ordered-distinct aggregates carry the ordinal of each first appearance, so that
results don't depend on how rows are spread. Inputs need ``rec_id``, the order
of the rows in their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celltrail.functions.text import norm_cl_id, norm_gene_list, norm_tissue, strip

# Spellings of two species in marker databases.
SPECIES = {
    "human": ("human", "homo", "homosapiens", "hs", "hsapiens"),
    "mouse": ("mouse", "mus", "musmusculus", "mm", "mmusculus"),
}
#: Columns that may hold negative markers; the first that isn't empty counts.
NEGATIVE_COLUMNS = (
    "negative_markers", "negative_marker_genes", "negative_marker", "negative_genes",
    "neg_markers", "neg_marker_genes", "minus_markers", "exclude_markers",
)


def _blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x.cast("string")), F.lit(""))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def species_matches(value: Column, requested: str | None) -> Column:
    """Whether a cell names the species; it may name several. None requested: all. Null: no."""
    if not requested:
        return F.lit(True)
    wanted = "".join(c for c in requested.lower() if c.isascii() and c.isalnum())
    family = next((f for f in SPECIES.values() if wanted in f), (wanted,))
    tokens = F.transform(F.split(value, "[^A-Za-z0-9]+"), lambda t: F.lower(t))
    named = (_plain(value) == wanted) | F.arrays_overlap(tokens, F.array(*[F.lit(f) for f in family]))
    return F.coalesce(named, F.lit(False))


def ordered_distinct(df: DataFrame, keys: list[str], order: str, lists: dict[str, str]) -> DataFrame:
    """For each key the distinct members of array columns in order of first appearance.

    ``lists`` maps result names to array columns; ``order`` is the row order.
    Null and empty members are dropped. Two-level aggregation: members first,
    then groups, so a hot key is spread by its members.
    """

    def tag(name: str, column: str) -> Column:
        members = F.coalesce(F.col(column), F.array().cast("array<string>"))
        return F.transform(members, lambda m, i: F.struct(F.lit(name).alias("list"), i.alias("at"), m.alias("member")))

    tagged = [tag(n, c) for n, c in lists.items()]
    flat = df.select(*keys, order, F.explode_outer(F.concat(*tagged)).alias("x"))
    first = flat.groupBy(*keys, "x.list", "x.member").agg(F.min(F.struct(order, F.col("x.at").alias("at"))).alias("first"))
    real = F.col("member").isNotNull() & (F.col("member") != "")
    collected = [
        F.transform(
            F.array_sort(F.collect_list(F.when(real & (F.col("list") == n), F.struct("first", "member")))), lambda z: z["member"]
        ).alias(n)
        for n in lists
    ]
    return first.groupBy(*keys).agg(*collected)


def marker_records(df: DataFrame) -> DataFrame:
    """The marker record's own normalisation; the cell type stays as it is. Nulls stay null, null markers are none."""
    return df.select(
        "rec_id",
        norm_tissue(F.col("tissue")).alias("tissue"),
        "cell_type",
        norm_cl_id(F.col("cell_ontology_id")).alias("cell_ontology_id"),
        norm_gene_list(F.col("markers")).alias("markers"),
        "source",
        "evidence",
        "metadata",
    )


def negative_markers(metadata: Column) -> Column:
    """Markers that speak against the type, from the first metadata column that has any."""
    found = F.coalesce(*[F.nullif(F.element_at(metadata, c), F.lit("")) for c in NEGATIVE_COLUMNS])
    return norm_gene_list(found)


def normalize_marker_table(
    df: DataFrame,
    tissue: str,
    cell_type: str,
    marker: str | None = None,
    markers: str | None = None,
    cl_id: str | None = None,
    source: str | None = None,
    evidence: str | None = None,
    species_column: str | None = None,
    source_name: str | None = None,
    default_source: str = "table",
    species: str | None = None,
    min_markers: int = 1,
    order: str = "rec_id",
) -> DataFrame:
    """One record for each stripped (tissue, cell type, ontology id, source, species) of any table.

    Rows without tissue, cell type or markers are skipped; so are other species
    than ``species``. Both marker columns count. Markers and evidence keep the
    order of first appearance; records under ``min_markers`` are dropped.
    """
    def of(name: str | None) -> Column:
        return _blank_to_null(F.col(name)) if name else F.lit(None).cast("string")

    both = F.concat(norm_gene_list(of(marker)), norm_gene_list(of(markers)))
    rows = df.select(
        F.col(order).alias("_order"),
        of(tissue).alias("tissue"),
        of(cell_type).alias("cell_type"),
        norm_cl_id(of(cl_id)).alias("cell_ontology_id"),
        F.coalesce(F.lit(source_name), of(source), F.lit(default_source)).alias("source"),
        of(species_column).alias("species"),
        both.alias("_markers"),
        F.array(of(evidence)).alias("_evidence"),
    ).where("tissue is not null and cell_type is not null and size(_markers) > 0")
    if species and species_column:
        rows = rows.where(species_matches(F.col("species"), species))
    keys = ["tissue", "cell_type", "cell_ontology_id", "source", "species"]
    grouped = ordered_distinct(rows, keys, "_order", {"markers": "_markers", "evidence": "_evidence"})
    return grouped.where(F.size("markers") >= min_markers).select(
        norm_tissue(F.col("tissue")).alias("tissue"), "cell_type", "cell_ontology_id", "source", "species", "markers",
        F.nullif(F.array_join("evidence", " | "), F.lit("")).alias("evidence"),
    )


def merge_marker_records(records: DataFrame, min_markers: int = 1, order: str = "rec_id") -> DataFrame:
    """One record for each (tissue, cell type, ontology id) over all sources, members in order."""
    rows = records.select(
        order, "tissue", "cell_type", "cell_ontology_id", "markers",
        F.array(_blank_to_null(F.col("source"))).alias("_source"), F.array(_blank_to_null(F.col("evidence"))).alias("_evidence"),
    )
    lists = {"markers": "markers", "sources": "_source", "evidence": "_evidence"}
    grouped = ordered_distinct(rows, ["tissue", "cell_type", "cell_ontology_id"], order, lists)
    return grouped.where(F.size("markers") >= min_markers).select(
        "tissue", "cell_type", "cell_ontology_id", "markers",
        F.nullif(F.array_join("sources", "; "), F.lit("")).alias("source"),
        F.nullif(F.array_join("evidence", " | "), F.lit("")).alias("evidence"),
    )


def summarize_markers(records: DataFrame) -> DataFrame:
    """One row: records, distinct tissues, cell types and markers, records with an id, mean markers."""
    distinct = records.select(F.explode("markers").alias("m")).agg(F.count_distinct("m").alias("unique_markers"))
    main = records.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("tissue").alias("tissues"),
        F.count_distinct("cell_type").alias("cell_types"),
        F.count("cell_ontology_id").alias("records_with_cl_id"),
        F.coalesce(F.round(F.avg(F.size("markers")), 6), F.lit(0.0)).alias("mean_markers"),
    )
    return main.crossJoin(distinct)  # one row each
