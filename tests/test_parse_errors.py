import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from celltrail.operators.parse_errors import parse_line, read_marker_lines, split_marker_lines

FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'


def rule(line):
    """RFC 4180 by regular expressions: what is wrong with a line's structure."""
    body = re.sub(r"[\r\n]+\Z", "", line)
    if not re.fullmatch(rf"{FIELD}(?:(?:,|\r\n|\r|\n){FIELD})*", body):
        return "quoting"
    if not re.fullmatch(rf"{FIELD}(?:,{FIELD})*", body) or len(re.findall(rf"(?:^|,)({FIELD})", body)) != 6:
        return "column_count"
    return None


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='a",\n\r ', max_size=16))
def test_agrees_with_the_rule(line):
    quotes, separators, edits, cells = parse_line(line, 6)
    assert ("quoting" if quotes else "column_count" if separators else None) == rule(line)
    assert (cells is not None) == (rule(line) is None)
    assert bool(edits) == (cells is None)


@pytest.mark.parametrize(
    ("line", "quotes", "separators"),
    [
        ("a,b,c,d,e,f", 0, 0),
        ('"a,b",c,d,e,f,"g""h"', 0, 0),
        ("a,b,c,d,e", 0, 1),
        ("a,b,c,d,e,f,g,h", 0, 2),
        ('a,"b,c,d,e,f', 1, 0),
        ('a,b"x,c,d,e,f', 1, 0),
        ("a,b,c,d,e,f\r\n", 0, 0),
    ],
)
def test_costs(line, quotes, separators):
    assert parse_line(line, 6)[:2] == (quotes, separators)


def test_edges(spark):
    good = ["Lung,T cell,CL:0000084,CD3E,Human,123", 'Lung,"T\ncell, old",cl_0000084,cd3e,Human,note', "Lung,T cell,,MARCH1,,"]
    bad = {
        None: "column_count", "": "column_count", "\r": "column_count", "a,b\nc,d,e,f,g": "column_count",
        'Lung,"T" cell,,CD3E,,': "quoting", "Lung,n/a,,CD3E,,": "invalid_value", "Lung,#REF!,,CD3E,,": "invalid_value",
        "Lung,12.5,,CD3E,,": "invalid_value", "Lung,T\x07cell,,CD3E,,": "invalid_value", "Lung,T�cell,,CD3E,,": "invalid_value",
        "Lung,T cell,CL:84,CD3E,,": "invalid_value", "Lung,T cell,,Mar-01,,": "invalid_value", "Lung,T cell,,null,,": "invalid_value",
        "Lung,T cell,,1-Dec,,": "invalid_value", "Lung,T cell,,,,": "invalid_value",
    }
    rows = [(i, x, "kept") for i, x in enumerate([*good, *bad, "x" * 200_000, ",".join(['"' + "y" * 50_000 + '"'] * 6)])]
    df = spark.createDataFrame(rows, "line_id bigint, raw_line string, geneSymbol string")
    got = {r.raw_line: r.reason for r in read_marker_lines(df).select("raw_line", "reason").collect()}
    assert all(got[g] is None for g in good)
    assert {b: got[b] for b in bad} == bad
    loaded, rejected = split_marker_lines(df)
    assert loaded.count() == 3 and rejected.count() == len(rows) - 3
    row = loaded.where("line_id = 1").first()
    assert (row.cellName, row.CellOntologyID, row.PMID, row.evidence) == ("T\ncell, old", "CL:0000084", None, "note")
    assert split_marker_lines(df.limit(0))[0].count() == 0


def test_repeated_lines_are_each_judged(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, "a,b")], "line_id bigint, raw_line string")
    assert read_marker_lines(df).where(F.col("reason") == "column_count").count() == 2
