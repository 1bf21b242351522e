"""Queries of the general data-quality operators: rows that fail to parse, schemas that drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from celltrail.operators.parse_errors import read_marker_lines, split_marker_lines
from celltrail.operators.schema_drift import schema_changes, unified_records
from celltrail.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that cannot be used, with the reason."""
    lines = table(spark, sf_dir, "cellmarker_raw").select("line_id", "raw_line")
    return read_marker_lines(lines).where("reason is not null").select("line_id", "reason")


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable lines as a typed table."""
    return split_marker_lines(table(spark, sf_dir, "cellmarker_raw"))[0]


def p1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other lines with reason and cheapest edits."""
    return split_marker_lines(table(spark, sf_dir, "cellmarker_raw"))[1]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of fields from each feed's file before."""
    changes = schema_changes(table(spark, sf_dir, "source_record"))
    return changes.select("file_id", "change", "old_field", "new_field").distinct()


def p6_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all feeds in one table."""
    return unified_records(table(spark, sf_dir, "source_record"), table(spark, sf_dir, "marker_table_config"))


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_rejected, p6_found, p6_unified)}

_FIELD = r"""(?:"(?:[^"]|"")*"|[^",\r\n]*)"""
_CELLS = rf"regexp_extract_all(body, '(?:^|,)({_FIELD})', 1)"
_MONTHS = "jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?"


def _cell(i: int) -> str:
    inner = f"case when c[{i}] like '\"%' then replace(substr(c[{i}], 2, length(c[{i}]) - 2), '\"\"', '\"') else c[{i}] end"
    return rf"regexp_replace({inner}, '^[\s\x{{a0}}\x{{feff}}]+|[\s\x{{a0}}\x{{feff}}]+$', '', 'g')"


LINES = rf"""a as (
            select line_id, file_name, received_at, regexp_replace(coalesce(raw_line, ''), '[\r\n]+$', '') as body from cellmarker_raw
        ), b as (
            select *, regexp_full_match(body, '{_FIELD}((,|\r\n|\r|\n){_FIELD})*') as quoted_well,
                   regexp_full_match(body, '{_FIELD}(,{_FIELD})*') as one_record, {_CELLS} as c
            from a
        ), d as (
            select *, {_cell(1)} as tissue, {_cell(5)} as species, {_cell(6)} as pmid, {_cell(2)} as name, {_cell(3)} as cl, {_cell(4)} as gene from b
        ), e as (
            select *, case
                when not quoted_well then 'quoting'
                when not one_record or len(c) <> 6 then 'column_count'
                when not regexp_matches(name, '\pL')
                  or lower(name) in ('null', 'nan', 'none', 'na', 'n/a', '#n/a', '#name?', '#ref!', '#value!', '#div/0!',
                                     '#num!', '#null!', '#spill!', '#calc!', '#field!', '#blocked!', '#connect!',
                                     '#unknown!', '#getting_data')
                  or regexp_matches(name, '(?i)^err:\d+$')
                  or regexp_matches(name, '[\x{{fffd}}\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]') then 'invalid_value'
                when not regexp_matches(cl, '(?i)^(CL[:_][0-9]{{7}})?$') then 'invalid_value'
                when not regexp_matches(gene, '^\pL[\pL0-9.\-]*$') or lower(gene) in ('null', 'nan', 'none', 'na', 'n/a')
                  or regexp_matches(gene, '(?i)^({_MONTHS})[-.][0-9]{{1,4}}([-.][0-9]{{1,4}})?$') then 'invalid_value'
                end as reason
            from d
        ),
        loaded as (
            select line_id, file_name, received_at, nullif(tissue, '') as c1, nullif(name, '') as c2, nullif(replace(upper(cl), '_', ':'), '') as c3,
                   nullif(gene, '') as c4, nullif(species, '') as c5, nullif(pmid, '') as c6
            from e where reason is null
        )"""

ORACLES = {
    "p1_found": f"with {LINES} select line_id, reason from e where reason is not null",
    "p1_loaded": rf"""
        with {LINES} select line_id, file_name, received_at, c1 as "tissueType", c2 as "cellName", c3 as "CellOntologyID", c4 as "geneSymbol", c5 as "speciesType",
               case when regexp_matches(c6, '^[0-9]{{1,18}}$') then c6::bigint end as "PMID", case when not regexp_matches(c6, '^[0-9]{{1,18}}$') then c6 end as evidence
        from loaded""",
}
