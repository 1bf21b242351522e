import pytest
from pyspark.sql import functions as F

from celltrail.cli import main, parser
from celltrail.operators import matrix
from celltrail.session import ensure_checkpoint_dir
from celltrail.sources import sinks
from celltrail.sources import tables as src

CSV = """﻿tissue,CellType,markers,source,negative_markers
Blood,T cell,"CD3D, CD3E",a,MS4A1
Lung,"Alveolar, type 2",SFTPC;SFTPB,,
"""
OBO = """format-version: 1.2

[Term]
id: CL:0000001
name: first cell
synonym: "old cell" EXACT []
synonym: "near cell" RELATED [x]

[Term]
id: GO:1
name: not a cell

[Term]
id: CL:0000002
name: second cell
is_obsolete: true

[Typedef]
id: part_of
"""


def test_marker_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text(CSV)
    rows = src.read_marker_records(spark, str(tmp_path / "m.csv")).orderBy("rec_id").collect()
    assert [(r.cell_type, r.markers) for r in rows] == [("T cell", ["CD3D", "CD3E"]), ("Alveolar, type 2", ["SFTPC", "SFTPB"])]
    assert rows[0].metadata == {"negative_markers": "MS4A1"} and rows[1].source is None
    (tmp_path / "bad.csv").write_text("tissue,cell_type,markers\nLung,,A\n")
    with pytest.raises(Exception, match="no cell_type"):
        src.read_marker_records(spark, str(tmp_path / "bad.csv")).collect()


@pytest.mark.parametrize("line", ["Lung,B cell,CD19,extra", "Lung,B cell,CD19,", 'Lung,"B, cell",CD19,x,y,z'])
def test_surplus_cells_fail_the_load(spark, tmp_path, line):
    (tmp_path / "m.csv").write_text(f"tissue,cell_type,markers\nLung,T cell,CD3D\n{line}\n")
    with pytest.raises(Exception, match="more cells than headers"):
        src.read_marker_records(spark, str(tmp_path / "m.csv")).collect()


def test_blanks_of_any_kind_are_stripped(spark, tmp_path):
    (tmp_path / "m.csv").write_text('tissue,cell_type,markers,source\n"\tLung\u00a0",\u00a0T cell\u2003,"CD3D,\u00a0CD3E"\nSkin,"a\nb",X,\u00a0\n')
    rows = src.read_marker_records(spark, str(tmp_path / "m.csv")).orderBy("rec_id").collect()
    assert [(r.tissue, r.cell_type, r.markers, r.source) for r in rows] == [("Lung", "T cell", ["CD3D", "CD3E"], None), ("Skin", "a\nb", ["X"], None)]


def test_matrix_market_header_comes_first(spark, tmp_path):
    entries = spark.createDataFrame([(i % 7 + 1, i + 1, float(i)) for i in range(50)], "row int, column int, value double").repartition(4)
    sinks.coordinate_text(entries, 7, 50, 50).write.text(str(tmp_path / "m"))
    parts = sorted((tmp_path / "m").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines[:2] == ["%%MatrixMarket matrix coordinate real general", "7 50 50"] and len(lines) == 52 and len(parts) == 5


def test_shared_folder_is_needed_off_this_machine():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Cluster)


def test_ontology_file(spark, tmp_path):
    (tmp_path / "x.obo").write_text(OBO)
    got = {r.cl_id: r for r in src.read_obo(spark, str(tmp_path / "x.obo")).collect()}
    assert set(got) == {"CL:0000001", "CL:0000002"} and got["CL:0000002"].is_obsolete
    assert [(s.text, s.scope) for s in got["CL:0000001"].synonyms] == [("old cell", "EXACT"), ("near cell", "RELATED")]


def test_predictions(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"y_true": "a", "y_pred": null}\n\n{"y_true": "b", "y_pred": "b", "confidence": 0.5}\n')
    assert [r.y_pred for r in src.read_predictions(spark, str(tmp_path / "p.jsonl")).orderBy("rec_id").collect()] == ["None", "b"]
    (tmp_path / "q.jsonl").write_text('{"y_true": "a"}\n')
    with pytest.raises(Exception, match="lacks"):
        src.read_predictions(spark, str(tmp_path / "q.jsonl")).collect()


def test_headers():
    assert src.resolve_column(["Official Gene Symbol", "x"], "marker") == "Official Gene Symbol"
    with pytest.raises(ValueError, match="no column"):
        src.resolve_column(["a"], "tissue", "organ")


def test_matrix(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 5\n2 1 1\n2 2 2\n")
    (tmp_path / "g.tsv").write_text("A\nB\n")
    (tmp_path / "c.tsv").write_text("c1\nc2\n")
    long = src.read_matrix_market(spark, *(str(tmp_path / n) for n in ("m.mtx", "g.tsv", "c.tsv")))
    assert {(r.cell_id, r.gene, r.value) for r in long.collect()} == {("c1", "A", 5.0), ("c1", "B", 1.0), ("c2", "B", 2.0)}
    obs = spark.createDataFrame([("c1", "x"), ("c2", "y")], "cell_id string, cluster string")
    ranked = matrix.rank_genes(long, obs)
    assert ranked.count() == 4 and ranked.where("pval_adj < pval").count() == 0
    means = {(r.cluster, r.gene): r["mean"] for r in matrix.cluster_means(long, obs).collect()}
    assert means == {("x", "A"): 5.0, ("x", "B"): 1.0, ("y", "B"): 2.0}


def test_majority_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(i, 1, v) for i, v in enumerate(["B cell", "", None, "T cell", "B cell", "nan"])], "rec_id int, c int, v string")
    r = matrix.majority_value(rows, "c", "v", "rec_id").first()
    assert (r.value, r.fraction) == ("B cell", round(2 / 3, 6))


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("Lung", "a, b", None, ["X", "Y"], None, "e")], "tissue string, cell_type string, cell_ontology_id string, markers array<string>, source string, evidence string")
    sinks.write_marker_records(rows, str(tmp_path / "out"), one_file=True)
    back = src.read_marker_records(spark, str(next((tmp_path / "out").glob("*.csv")))).first()
    assert (back.cell_type, back.markers, back.cell_ontology_id) == ("a, b", ["X", "Y"], None)
    assert sinks.markdown_table([{"a": None, "b": 0.5}], ["a", "b"]).endswith("| NA | 0.5000 |")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import celltrail.cli as cli

    monkeypatch.setattr(cli, "local_session", lambda: spark)
    (tmp_path / "m.csv").write_text(CSV)
    assert main(["validate-marker-db", "--input", str(tmp_path / "m.csv")]) == 0
    assert '"records": 2' in capsys.readouterr().out
    assert main(["annotate", "--tissue", "Blood", "--markers", "cd3d", "--marker-db", str(tmp_path / "m.csv")]) == 0
    assert "T cell" in capsys.readouterr().out
    assert main(["build-dataset", "--input", str(tmp_path / "m.csv"), "--output", str(tmp_path / "d"), "--examples", "20"]) == 0
    assert src.read_jsonl(spark, str(tmp_path / "d")).count() == 40
    assert main(["split", "--input", str(tmp_path / "d"), "--output", str(tmp_path / "s")]) == 0
    assert main(["preflight-finetune", "--input", str(tmp_path / "s")]) == 0
    assert "warnings" in capsys.readouterr().out
    assert main(["benchmark-marker-overlap", "--input", str(tmp_path / "d"), "--marker-db", str(tmp_path / "m.csv"), "--output", str(tmp_path / "b")]) == 0
    assert main(["evaluate", "--input", str(tmp_path / "b")]) == 0
    assert '"accuracy": 1.0' in capsys.readouterr().out
    assert main(["sync-prediction-gold-ontology", "--input", str(tmp_path / "b"), "--gold", str(tmp_path / "d"), "--output", str(tmp_path / "g"), "--allow-mismatch"]) == 0
    assert main(["evaluate", "--input", str(tmp_path / "none")]) == 1
    assert len(parser()._subparsers._group_actions[0].choices) >= 30


def test_stream(spark, tmp_path):
    from celltrail.streaming.annotate import annotate_stream

    db = src.read_marker_records(spark, _write(tmp_path, CSV))
    queries = spark.createDataFrame([(1, "Blood", ["CD3D"])], "q_id bigint, tissue string, markers array<string>")
    queries.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).parquet(str(tmp_path / "in"))
    got = []
    q = annotate_stream(stream, db, lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.cell_type for r in got] == ["T cell"]


def _write(folder, text):
    (folder / "s.csv").write_text(text)
    return str(folder / "s.csv")


def test_field_paths(spark):
    df = spark.createDataFrame([(1,)], "a int").withColumn("metadata", F.struct(F.lit(2).alias("b")))
    assert df.select(src.field_column(df.schema, "b")).first()[0] == 2
    with pytest.raises(ValueError, match="no field"):
        src.field_column(df.schema, "c.d")
