"""Rows that fail to parse: minimum-cost error parse of delimited lines.

Each line is read by a parser whose steps may also delete or insert a quote
sign or a field separator at a cost. Lines whose cheapest parse costs nothing
are split as they stand; for the others the cheapest edit operations are the
reason. Quote edits outrank separator edits: the parser first minimises the
number of quote edits needed with the separators left as they are, and only a
line that needs none is charged for its separators.

Costs depend only on the order of quote signs, separators, line breaks and
other text, so a line is first reduced to that shape and the dynamic program
runs once for each distinct shape a worker meets.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from celltrail.session import ship_package

FIELDS = ("tissueType", "cellName", "CellOntologyID", "geneSymbol", "speciesType", "PMID")
# Words and signs that stand for a missing or broken cell.
NULL_WORDS = ("null", "nan", "none", "na", "n/a")
SHEET_ERRORS = (
    "#n/a", "#name?", "#ref!", "#value!", "#div/0!", "#num!", "#null!",
    "#spill!", "#calc!", "#field!", "#blocked!", "#connect!", "#unknown!", "#getting_data",
)
MONTHS = (
    "jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july",
    "aug", "august", "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december",
)

_PARSED = "quote_edits int, separator_edits int, edits array<string>, cells array<string>"
_SHAPE = re.compile(r'"|,|\r\n|\r|\n|[^",\r\n]+')
_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_CELL = re.compile(rf"(?:^|,)({_FIELD})")
_CLEAN = re.compile(rf"{_FIELD}(?:,{_FIELD})*")
_END = re.compile(r"[\r\n]+\Z")

# Parser positions: at the start of a field, in bare text, in quotes, after the closing quote.
_START, _BARE, _QUOTED, _CLOSED = range(4)
_FAR = 10**6


def _moves(kind: str, at: int) -> list[tuple[int, bool]]:
    """Where a sign leads from a position without an edit, and whether it ends a field."""
    if at == _QUOTED:
        return [(_CLOSED if kind == '"' else _QUOTED, False)]
    if kind == ",":
        return [(_START, True)]
    if kind == '"':
        return {_START: [(_QUOTED, False)], _CLOSED: [(_QUOTED, False)]}.get(at, [])
    if kind == "t":
        return {_START: [(_BARE, False)], _BARE: [(_BARE, False)]}.get(at, [])
    return []  # a line break outside quotes


@lru_cache(maxsize=200_000)
def cheapest_edits(shape: str, fields: int) -> tuple[int, int, tuple[str, ...]]:
    """Quote edits, separator edits and the edits of the cheapest parse of ``shape``.

    ``shape`` has ``"``, ``,``, ``n`` (line break) and ``t`` (other text). The
    first number is the least count of quote edits with separators as they
    are, over any number of fields, so that no separator put beside a quote
    sign excuses it. The rest belongs to the cheapest way, by edits of either
    kind, to get exactly ``fields`` fields; places count signs of the shape.
    """
    # Least quote edits, separators untouched, any number of fields.
    best = {_START: 0}
    for kind in shape:
        best = _close(best)
        step: dict[int, int] = {}
        for at, cost in best.items():
            for to, _ in _moves("," if kind == "n" and at != _QUOTED else kind, at):
                step[to] = min(step.get(to, _FAR), cost)
            if kind == '"':
                step[at] = min(step.get(at, _FAR), cost + 1)
        best = step
    best = _close(best)
    quote_edits = min((c for at, c in best.items() if at != _QUOTED), default=_FAR)

    # Cheapest parse to exactly that many fields; states carry the field count and the way, as edits linked to the ones before.
    state: dict[tuple[int, int], tuple[int, tuple | None]] = {(_START, 1): (0, None)}

    def offer(to: dict, key: tuple[int, int], cost: int, way: tuple | None) -> None:
        if key[1] <= fields and (key not in to or cost < to[key][0]):
            to[key] = (cost, way)

    def free_edits(now: dict, place: int) -> None:
        for (at, n), (cost, way) in sorted(now.items(), key=lambda x: x[1][0]):
            if at in (_START, _CLOSED):
                offer(now, (_QUOTED, n), cost + 1, (way, "insert quote at", place))
            if at == _QUOTED:
                offer(now, (_CLOSED, n), cost + 1, (way, "insert quote at", place))
        for m in range(1, fields):
            for at in (_START, _BARE, _CLOSED):
                if (at, m) in now:
                    cost, way = now[at, m]
                    offer(now, (_START, m + 1), cost + 1, (way, "insert separator at", place))

    for place, kind in enumerate(shape):
        free_edits(state, place)
        after: dict = {}
        for (at, n), (cost, way) in state.items():
            for to, ends in _moves(kind, at):
                offer(after, (to, n + ends), cost, way)
            if kind == '"':
                offer(after, (at, n), cost + 1, (way, "delete quote at", place))
            elif kind in ",n" and at != _QUOTED:
                offer(after, (at, n), cost + 1, (way, "delete separator at", place))
            elif kind == "t" and at == _CLOSED:
                offer(after, (_CLOSED, n), cost + 1, (way, "delete quote before", place))
        state = after
    free_edits(state, len(shape))
    ended = [v for (at, n), v in state.items() if n == fields and at != _QUOTED]
    cost, way = min(ended, default=(_FAR, None), key=lambda x: x[0])
    edits: list[str] = []
    while way:
        way, what, place = way
        edits.append(f"{what} {place}")
    return quote_edits, (0 if quote_edits else cost), tuple(reversed(edits)) if cost < _FAR else ("no parse",)


def _close(best: dict[int, int]) -> dict[int, int]:
    """``best`` with inserted quote signs."""
    best = dict(best)
    for at in (_START, _CLOSED):
        if at in best:
            best[_QUOTED] = min(best.get(_QUOTED, _FAR), best[at] + 1)
    if _QUOTED in best:
        best[_CLOSED] = min(best.get(_CLOSED, _FAR), best[_QUOTED] + 1)
    return best


def parse_line(line: str | None, fields: int) -> tuple[int, int, list[str], list[str] | None]:
    """Quote edits, separator edits, the edits, and the cells if no edit is needed."""
    body = _END.sub("", line or "")
    if _CLEAN.fullmatch(body):
        cells = _CELL.findall(body)
        if len(cells) == fields:  # the zero-cost path
            return 0, 0, [], [c[1:-1].replace('""', '"') if c[:1] == '"' else c for c in cells]
    shape = "".join(x if x in '",' else "n" if x[0] in "\r\n" else "t" for x in _SHAPE.findall(body))
    quotes, separators, way = cheapest_edits(shape, fields)
    return quotes, separators, list(way), None


def parse_lines(df: DataFrame, line: str = "raw_line", fields: int = len(FIELDS)) -> DataFrame:
    """``df`` with ``parsed``: the edits each line needs, and its cells if it needs none."""

    ship_package(df.sparkSession)

    @F.pandas_udf(_PARSED)
    def parsed(lines: pd.Series) -> pd.DataFrame:
        out = [parse_line(x, fields) for x in lines]
        return pd.DataFrame(out, columns=["quote_edits", "separator_edits", "edits", "cells"])

    # Not deterministic by name only: filters on the result must not run the parser a second time.
    return df.withColumn("parsed", parsed.asNondeterministic()(F.col(line)))


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s ﻿]+|[\s ﻿]+$", "")


def bad_cell_name(x: Column) -> Column:
    """No letter, a word for nothing, a spreadsheet error, or broken signs."""
    v = _trim(x)
    return (
        ~v.rlike(r"\p{L}")
        | F.lower(v).isin(*NULL_WORDS, *SHEET_ERRORS)
        | v.rlike(r"(?i)^err:\d+$")
        | v.rlike(r"[�\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]")
    )


def bad_ontology_id(x: Column) -> Column:
    """Neither empty nor CL, ``:`` or ``_``, seven digits."""
    return ~_trim(x).rlike(r"(?i)^(CL[:_][0-9]{7})?$")


def bad_gene_symbol(x: Column) -> Column:
    """Not a letter followed by letters, digits, dots or hyphens; or a word for nothing; or a date."""
    v = _trim(x)
    months = "|".join(MONTHS)
    return (
        ~v.rlike(r"^\p{L}[\p{L}0-9.\-]*$")
        | F.lower(v).isin(*NULL_WORDS)
        | v.rlike(rf"(?i)^({months})[-.][0-9]{{1,4}}([-.][0-9]{{1,4}})?$")
    )


def read_marker_lines(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """Every line with its reason (null if usable), its edits and its typed cells.

    A null or blank line has one empty field and so the reason ``column_count``.
    A line break after the last field is dropped; one inside quotes is part of
    the cell; one elsewhere separates records, so the line has not six fields.
    Columns of ``df`` pass through; repeated lines are each judged.
    """
    read = parse_lines(df, line).withColumn(
        "_cells", F.coalesce("parsed.cells", F.array(*[F.lit("") for _ in FIELDS]))
    )
    invalid = bad_cell_name(F.col("_cells")[1]) | bad_ontology_id(F.col("_cells")[2]) | bad_gene_symbol(F.col("_cells")[3])
    reason = (
        F.when(F.col("parsed.quote_edits") > 0, "quoting")
        .when(F.col("parsed.separator_edits") > 0, "column_count")
        .when(invalid, "invalid_value")
    )
    return read.withColumn("reason", reason)


def split_marker_lines(df: DataFrame, line: str = "raw_line") -> tuple[DataFrame, DataFrame]:
    """The usable lines as a typed table, and the others with reason and edits."""
    read = read_marker_lines(df, line)
    kept = [c for c in df.columns if c not in FIELDS and c != line]
    cell = {name: _trim(F.col("_cells")[i]) for i, name in enumerate(FIELDS)}
    cell["CellOntologyID"] = F.nullif(F.regexp_replace(F.upper(cell["CellOntologyID"]), "_", ":"), F.lit(""))
    good = read.where(F.col("reason").isNull()).select(
        *kept,
        *[F.nullif(c, F.lit("")).alias(n) for n, c in cell.items() if n != "PMID"],
        F.when(cell["PMID"].rlike("^[0-9]{1,18}$"), cell["PMID"]).cast("bigint").alias("PMID"),
        F.when(~cell["PMID"].rlike("^[0-9]{1,18}$"), F.nullif(cell["PMID"], F.lit(""))).alias("evidence"),
    )
    bad = read.where(F.col("reason").isNotNull()).select(
        *kept, F.col(line), "reason", F.array_join("parsed.edits", "; ").alias("edits")
    )
    return good, bad

