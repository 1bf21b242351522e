"""Every query for training data that SQL can say, on the smallest tables against its SQL; the others run."""

import glob
import os

import duckdb
import pytest

from celltrail.llm.queries import ORACLES, QUERIES
from test_queries import DATA, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def count(con, text):
    return con.execute(text).fetchone()[0]


def test_splits_hold_every_record_once(spark, con):
    got = QUERIES["p3_splits"](spark, DATA).collect()
    assert len(got) == len({r.example_id for r in got}) == count(con, "select count(*) from annotation_example")
    assert len({r.group_id for r in got}) == len({(r.group_id, r.new_split) for r in got})
    forest = QUERIES["p3_forest"](spark, DATA).collect()
    assert len({r.key_a for r in forest} | {r.key_b for r in forest}) - len(forest) == len({r.root for r in forest})


def test_flags_and_found_agree(spark, con):
    flags = QUERIES["p5_flags"](spark, DATA).collect()
    assert len(flags) == count(con, "select count(*) from annotation_prediction")
    found = {tuple(r) for r in QUERIES["p5_found"](spark, DATA).collect()}
    assert found == {(r.pred_id, r.defect) for r in flags if r.defect}
    nothing = {r[0] for r in con.execute("select pred_id from annotation_prediction where raw_response is null").fetchall()}
    assert nothing <= {p for p, d in found if d == "empty"}


def test_every_label_is_mapped_once(spark, con):
    got = QUERIES["p7_labels"](spark, DATA).collect()
    labels = "select cell_type from marker_record union select cell_type from annotation_prediction"
    assert len(got) == len({r.label for r in got}) == count(con, f"select count(*) from ({labels}) where cell_type is not null")
    found = {(r.src, r.row_id): r.cl_id for r in QUERIES["p7_found"](spark, DATA).collect()}
    by = {r.label: r.cl_id for r in got}
    for src, row, label in con.execute("select 'marker_record', rec_id, cell_type from marker_record").fetchall():
        assert (src, row) not in found or found[src, row] == by[label]


def test_containers(spark, con):
    packed = QUERIES["p8_packed"](spark, DATA).collect()
    room = {}
    for r in packed:
        room[r.container] = room.get(r.container, 0) + r.size
    assert max(room.values()) <= 1024
    report = QUERIES["p8_report"](spark, DATA).first()
    assert report.containers == len(room) and {r.doc_id for r in packed} <= {r[0] for r in con.execute("select doc_id from documents").fetchall()}


def test_shares_are_of_all_sentences(spark, con):
    shares = QUERIES["p10_shares"](spark, DATA).collect()
    assert abs(sum(r.share for r in shares) - 1) < 1e-9 and "none" in {r.subject for r in shares}
    found = {tuple(r) for r in QUERIES["p10_found"](spark, DATA).collect()}
    assert {s for _, s in found} <= {r.subject for r in shares} - {"none"}
