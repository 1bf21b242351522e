import itertools
import json
import random

from celltrail.operators.schema_drift import assign, schema_changes, unified_records

SCHEMA = "row_id bigint, feed string, file_id bigint, file_no int, row_no int, payload string"
TISSUES = ["Lung", "Liver", "Skin", "Spleen", "Bone marrow"]


def rows(*files):
    """Rows of one feed; a file is a function from row number to a payload."""
    out = []
    for no, make in enumerate(files, 1):
        out += [(no * 100 + i, "f", no * 10, no, i, json.dumps(p) if isinstance(p := make(i), dict) else p) for i in range(20)]
    return out


def changes(spark, data):
    return {(r.file_id, r.change, r.old_field, r.new_field) for r in schema_changes(spark.createDataFrame(data, SCHEMA)).collect()}


def test_each_kind_of_change(spark):
    data = rows(
        lambda i: {"gene": f"XAB{i}", "organ": TISSUES[i % 5], "pmid": 90000000 + i},
        lambda i: {"symbol x": f"XAB{i + 3}", "organ": TISSUES[i % 5], "pmid": str(90000000 + i)},
        lambda i: {"symbol x": [f"XAB{i}"], "site": TISSUES[i % 4], "score": 0.1 * (i % 9) + 0.05},
    )
    assert changes(spark, data) == {
        (20, "renamed", "gene", "symbol x"), (20, "retyped", "pmid", "pmid"),
        (30, "retyped", "symbol x", "symbol x"), (30, "renamed", "organ", "site"), (30, "removed", "pmid", ""), (30, "added", "", "score"),
    }


def test_edges(spark):
    data = rows(
        lambda i: {"a": None if i else "x y", "b": 1},
        lambda i: "not json" if i == 0 else "[1]" if i == 1 else None if i == 2 else {"a": "x y"},
        lambda i: {"a": None},
    )
    assert changes(spark, data) == {(20, "removed", "b", "")}
    df = spark.createDataFrame(data, SCHEMA)
    assert unified_records(df).count() == 60
    assert schema_changes(df.limit(0)).count() == 0
    assert unified_records(df).where("unread = 'not json'").count() == 1


def test_hot_files_are_salted(spark):
    data = rows(
        lambda i: {"gene": f"XAB{i}", "organ": TISSUES[i % 5], "n": i},
        lambda i: {"marker": f"XAB{i}", "site": TISSUES[i % 5], "n": str(i + 10)},
    )
    df = spark.createDataFrame(data, SCHEMA)
    by = [{(r.change, r.old_field, r.new_field) for r in schema_changes(df, rows_per_task=n).collect()} for n in (3, 10**6)]
    assert by[0] == by[1] == {("renamed", "gene", "marker"), ("renamed", "organ", "site"), ("retyped", "n", "n")}


def test_unified_follows_renames(spark):
    data = rows(
        lambda i: {"gene": f"XAB{i}", "thing": TISSUES[i % 5]},
        lambda i: {"geneSymbol": [f"XAB{i}"], "other thing": TISSUES[i % 5]},
    )
    configs = spark.createDataFrame([("f", "gene", None, None, "thing", None)], "feed string, marker_column string, cell_type_column string, cl_id_column string, tissue_column string, species_column string")
    out = unified_records(spark.createDataFrame(data, SCHEMA), configs).collect()
    assert all(r.marker == f"XAB{r.row_no}" and r.tissue == TISSUES[r.row_no % 5] and not r.other for r in out)


def test_assignment_is_best():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.random() for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in enumerate(assign(w)) if j >= 0)
        if n <= m:
            best = max(sum(w[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            best = max(sum(w[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(got - best) < 1e-9
