"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as Unicode knows them; Java's own \s is ASCII only.
BLANK = r"(?U)\s"


def strip(x: Column) -> Column:
    """Without outer blanks of any kind."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of blanks become one space, outer ones go."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def norm_gene(x: Column) -> Column:
    """Gene symbol: no outer blanks or quotes, no spaces, upper case."""
    return F.upper(F.replace(F.btrim(strip(x), F.lit("\"'`")), F.lit(" "), F.lit("")))


def norm_gene_list(x: Column) -> Column:
    """Marker list of a cell as distinct symbols in first-seen order; null is empty."""
    parts = F.split(F.coalesce(x, F.lit("")), r"(?U)[,;|/\s]+")
    return F.array_distinct(F.filter(F.transform(parts, norm_gene), lambda m: m != ""))


def norm_label(x: Column) -> Column:
    """Cell label: underscore and hyphen are spaces, lower case, single spaces; ``+`` stays."""
    return squeeze(F.lower(F.translate(x, "_-", "  ")))


def norm_tissue(x: Column) -> Column:
    """Tissue: single spaces, case kept."""
    return squeeze(x)


def norm_cl_id(x: Column) -> Column:
    """Ontology id in upper case with a colon; blank is null."""
    return F.nullif(F.regexp_replace(F.upper(strip(x)), "^CL_", "CL:"), F.lit(""))


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that depends on nothing but ``parts``; the same in any engine with md5."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
