import math
import random
from collections import Counter
from fractions import Fraction
from random import Random

import pytest
from pyspark.sql import functions as F

from celltrail.functions.text import norm_cl_id, norm_gene_list, norm_label
from celltrail.functions.variants import variants
from celltrail.operators import augment, curation, linking, markers, matrix, metrics, splits
from celltrail.operators.annotators import annotate_by_overlap, annotate_by_prompt, annotate_by_rerank, annotate_by_signed_sets
from celltrail.operators.parse import choose_candidate, parse_response
from celltrail.operators.similarity import rank_by_overlap, rank_by_signed_sets
from celltrail.plans import all_queries
from celltrail.session import salted_join

DB = "rec_id bigint, tissue string, cell_type string, cell_ontology_id string, markers array<string>, source string, evidence string, metadata map<string,string>"
RECORDS = [
    (1, "Blood", "T cell", "CL:0000084", ["CD3D", "CD3E", "IL7R"], "a", "1", {}),
    (2, "Blood", "B cell", "CL:0000236", ["MS4A1", "CD79A"], "b", None, {"negative_markers": "CD3D"}),
    (3, "Lung", "Alveolar cell", None, ["SFTPC", "SFTPB", "CD3D"], "a", "", {}),
]
QUERIES = "q_id bigint, tissue string, markers array<string>"


def db(spark, rows=RECORDS):
    return spark.createDataFrame(rows, DB)


def test_normalisation(spark):
    df = spark.createDataFrame([(" cd3d ;'il7r'|CD3D\xa0x y", "CD4+  T-cell_s", " cl_0000084 "), (None, None, ""), ("", " ", None)], "m string, l string, c string")
    got = df.select(norm_gene_list(F.col("m")).alias("m"), norm_label(F.col("l")).alias("l"), norm_cl_id(F.col("c")).alias("c")).collect()
    assert got[0] == (["CD3D", "IL7R", "X", "Y"], "cd4+ t cell s", "CL:0000084")
    assert got[1] == ([], None, None) and got[2] == ([], "", None)


def test_variants(spark):
    labels = ["B cells naive", "Microglia", "DC", None, " ", "CD4+ T-cells", "T memory (CD8+) cells", "t cell", "Gamma (PP) cells", "class"]
    got = {r.l: r.v for r in spark.createDataFrame([(x,) for x in labels], "l string").select("l", variants(F.col("l")).alias("v")).collect()}
    assert got["B cells naive"] == ["b cells naive", "naive b cell"] and got["Microglia"] == ["microglia", "microglial cell"]
    assert got["DC"] == ["dc", "dendritic cells", "dendritic cell"] and got[None] == got[" "] == [] and got["class"] == ["class"]
    assert got["CD4+ T-cells"] == ["cd4+ t cells", "cd4 t cells", "cd4+ t cell", "cd4 t cell"] and got["t cell"] == ["t cell"]
    assert got["T memory (CD8+) cells"] == [
        "t memory (cd8+) cells", "t memory cells", "t memory (cd8 ) cells", "t memory (cd8+) cell", "memory (cd8+) t cell", "t memory cell", "memory t cell",
        "t memory (cd8 ) cell", "memory (cd8 ) t cell",
    ]
    assert got["Gamma (PP) cells"] == ["gamma (pp) cells", "gamma cells", "gamma (pp) cell", "gamma cell", "pancreatic pp cell"]


def test_species(spark):
    df = spark.createDataFrame([("Mm Hs",), ("Mm",), ("Homo sapiens",), (None,)], "s string")
    assert [r[0] for r in df.select(markers.species_matches(F.col("s"), "Human")).collect()] == [True, False, True, False]


def test_ingest_keeps_order(spark):
    rows = [(1, "PBMC", "T", "IL7R", "123"), (2, "PBMC", "T", "CD3D", "456"), (3, "PBMC", "T", "IL7R", "123"), (4, None, "T", "X", "1"), (5, "PBMC", "B", "MS4A1", None)]
    df = spark.createDataFrame(rows, "rec_id bigint, tissue string, cell string, gene string, note string")
    out = markers.normalize_marker_table(df, "tissue", "cell", marker="gene", evidence="note", min_markers=2).collect()
    assert [(r.markers, r.evidence) for r in out] == [(["IL7R", "CD3D"], "123 | 456")]


def test_ranking(spark):
    queries = spark.createDataFrame([(1, "blood", ["CD3D", "IL7R"]), (2, "Brain", ["SFTPC"]), (3, "Blood", []), (4, "Blood", ["ZZZ"])], QUERIES)
    top = {(r.q_id, r.rank): r for r in rank_by_overlap(queries, db(spark), 2).collect()}
    assert top[1, 1].rec_id == 1 and top[1, 2].rec_id == 2 and top[1, 2].score == 0
    assert math.isclose(top[1, 1].score, 1.5 / 2.5) and top[2, 1].rec_id == 3
    best = {r.q_id: r for r in annotate_by_overlap(queries, db(spark)).collect()}
    assert best[1].cell_type == "T cell" and best[3].cell_type == "Unknown" and best[4].cell_type == "Unknown"
    signed = {r.q_id: r for r in annotate_by_signed_sets(queries, db(spark)).collect()}
    assert signed[1].cell_type == "T cell" and signed[4].confidence == 0
    assert rank_by_overlap(queries.limit(0), db(spark)).count() == 0
    assert rank_by_overlap(queries, db(spark).limit(0)).count() == 0


def test_records_that_share_nothing_beat_negative_ones(spark):
    # The last ten labels of Blood hold X negatively; label 11 has a second record that shares nothing.
    rows = [(i, "Blood", f"label {i:02d}", None, ["A"], "a", None, {"negative_markers": "X"} if i >= 10 else {}) for i in range(20)]
    rows.append((30, "Blood", "label 11", None, ["A"], "a", None, {}))
    queries = spark.createDataFrame([(1, "Blood", ["X"]), (2, "Blood", ["Y"]), (3, "Liver", ["X", "A"])], QUERIES)
    got = {}
    for r in rank_by_signed_sets(queries, db(spark, rows), 4).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append((r.rec_id, r.score, r.negative))
    assert got[1] == [(30, 0.0, 0), (9, 0.0, 0), (8, 0.0, 0), (7, 0.0, 0)]
    assert [r[0] for r in got[2]] == [19, 18, 17, 16]
    assert [r[0] for r in got[3]] == [30, 9, 8, 7]
    full = [r.rec_id for r in rank_by_signed_sets(queries.where("q_id = 1"), db(spark, rows), 25).orderBy("rank").collect()]
    assert full == [30, *range(9, -1, -1), 19, 18, 17, 16, 15, 14, 13, 12, 10]


def test_hot_markers_meet_in_parts(spark, monkeypatch):
    rng = Random(4)
    rows = [(i, rng.choice(["Blood", "Lung"]), f"label {i % 9}", None, rng.sample(["A", "B", "C", "D", "E"], 3), "a", None, {"negative_markers": "E"} if i % 4 == 0 else {}) for i in range(80)]
    queries = spark.createDataFrame([(i, rng.choice(["Blood", "Liver"]), rng.sample(["A", "B", "C", "E", "Z"], 2)) for i in range(20)], QUERIES)
    whole = [sorted(map(tuple, f(queries, db(spark, rows), 4).collect())) for f in (rank_by_overlap, rank_by_signed_sets)]
    monkeypatch.setattr("celltrail.operators.similarity.RECORDS_PER_PART", 7)
    assert whole == [sorted(map(tuple, f(queries, db(spark, rows), 4).collect())) for f in (rank_by_overlap, rank_by_signed_sets)]


def test_ranking_is_the_same_in_small_blocks(spark, monkeypatch):
    rng = Random(5)
    rows = [(i, rng.choice(["Blood", "Lung", None]), f"label {i % 9}", None, rng.sample(["A", "B", "C", "D", "E"], 3), "a", None, {"negative_markers": "E"} if i % 4 == 0 else {}) for i in range(60)]
    queries = spark.createDataFrame([(i, rng.choice(["Blood", "Liver", None]), rng.sample(["A", "B", "C", "E", "Z"], 2)) for i in range(20)], QUERIES)
    whole = [sorted(map(tuple, f(queries, db(spark, rows), 4).collect())) for f in (rank_by_overlap, rank_by_signed_sets)]
    for name, value in (("RECORDS_PER_PART", 7), ("QUERIES_PER_PART", 3), ("VOCABULARY", 2), ("TISSUES", 1), ("PAIRS", 9), ("CELLS", 30)):
        monkeypatch.setattr(f"celltrail.operators.similarity.{name}", value)
    assert whole == [sorted(map(tuple, f(queries, db(spark, rows), 4).collect())) for f in (rank_by_overlap, rank_by_signed_sets)] and whole[0]


def shuffled(spark, df) -> int:
    """Bytes that a query writes for shuffles."""
    context = spark.sparkContext._jsc.sc()

    def total():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = total()
    df().collect()
    return total() - before


def test_pairs_that_share_a_marker_are_no_rows(spark):
    # 300 queries and 600 records of one tissue all share a marker: 180,000 pairs.
    rows = [(i, "Blood", f"label {i}", None, ["A", f"M{i}"], "a", None, {}) for i in range(600)]
    queries = spark.createDataFrame([(i, "Blood", ["A", f"M{2 * i}"]) for i in range(300)], QUERIES)
    for f in (rank_by_overlap, rank_by_signed_sets):
        assert shuffled(spark, lambda f=f: f(queries, db(spark, rows), 2)) < 500_000


@pytest.fixture(scope="module")
def one_tissue(spark, tmp_path_factory):
    """The smallest tables four times over, in one tissue, where every cluster shares a marker with every record."""
    folder, src = tmp_path_factory.mktemp("one_tissue"), "/root/testdata/sf0.001"
    for name, keys in (("annotation_example", ["example_id"]), ("marker_record", ["rec_id"]), ("annotation_prediction", ["pred_id", "example_id"])):
        rows = spark.read.parquet(f"{src}/{name}.parquet").crossJoin(spark.range(4).withColumnRenamed("id", "_c"))
        rows = rows.withColumns({k: F.col(k) + 1_000_000 * F.col("_c") for k in keys}).drop("_c")
        if "tissue" in rows.columns:
            marker = F.concat(F.lit("M"), F.col(keys[0]).cast("string"))
            both = F.concat_ws(",", F.lit("A"), marker) if name == "marker_record" else F.array(F.lit("A"), marker)
            rows = rows.withColumns({"tissue": F.lit("Blood"), "markers": both})
            rows = rows.withColumn("metadata", F.col("metadata").withField("markers", F.col("markers"))) if name == "annotation_example" else rows
        rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    "name",
    [
        "marker_overlap_topk",
        "overlap_confidence",
        "rerank_prompts",
        "sctype_topk",
        "rerank_audit",
        "rerank_ranks",
        "overlap_candidates",
        "sctype_confidence",
        "choose_candidates",
        "harm_examples",
        "rerank_histograms",
    ],
)
def test_queries_that_rank_shuffle_no_pairs(spark, one_tissue, name):
    assert shuffled(spark, lambda: all_queries()[name](spark, one_tissue)) < 1_000_000


def test_model_annotators(spark):
    queries = spark.createDataFrame([(1, "Blood", ["CD3D"]), (2, "Blood", [])], QUERIES)

    def make():
        return lambda prompts: ["Candidate: 2\nCell type: made up\nConfidence: 0.7" for _ in prompts]

    out = {r.q_id: r for r in annotate_by_rerank(queries, db(spark), make).collect()}
    assert (out[1].cell_type, out[1].confidence, out[1].selection_source) == ("B cell", 0.7, "candidate_number")
    assert (out[2].cell_type, out[2].selection_source) == ("Unknown", "no_candidates")
    assert {r.cell_type for r in annotate_by_prompt(queries, make).collect()} == {"made up"}


@pytest.mark.parametrize(
    ("text", "cell_type", "cl_id", "confidence"),
    [
        ("Cell type: T cell\nCell Ontology ID: CL_0000084\nConfidence: 0.85", "T cell", "CL:0000084", 0.85),
        ("- **Cell type:** a B cell.\n- **CL ID:** CL:0000236\n- **Confidence score:** 95%", "B cell", "CL:0000236", 0.95),
        ("Cell Ontology ID: plasma cell\nConfidence: 10%", "plasma cell", None, 1.0),
        ("The cluster is likely to be a naive T cell. More.", "naive T cell", None, None),
        ("Given the markers", "Unknown", None, None), ("", "Unknown", None, None), (None, "Unknown", None, None),
    ],
)
def test_responses(spark, text, cell_type, cl_id, confidence):
    r = spark.createDataFrame([(text,)], "t string").select(parse_response(F.col("t")).alias("p")).first().p
    assert (r.cell_type, r.cell_ontology_id, r.confidence) == (cell_type, cl_id, confidence)


def test_choice(spark):
    schema = "t string, c array<struct<rank:int,cell_type:string>>"
    rows = [("candidate: 2", [(1, "a"), (2, "b")]), ("Cell type: B", [(1, "a"), (2, "b")]), ("zzz", [(1, "a")]), (None, [])]
    got = spark.createDataFrame(rows, schema).select(choose_candidate(F.col("t"), F.col("c")).alias("x")).collect()
    assert [(r.x.candidate and r.x.candidate.rank, r.x.selection_source) for r in got] == [
        (2, "candidate_number"), (2, "cell_type_label"), (1, "fallback_top_candidate"), (None, "no_candidates"),
    ]


def test_mcnemar_large():
    # Against sums of exact fractions, and without cost in the counts.
    for a, b in ((5, 9), (30, 31), (0, 40), (120, 80), (499, 520)):
        tail = sum(math.comb(a + b, i) for i in range(min(a, b) + 1))
        assert metrics.mcnemar(a, b) == pytest.approx(min(1.0, float(Fraction(2 * tail, 2 ** (a + b)))), rel=1e-10)
    assert metrics.mcnemar(10**9, 10**9) == pytest.approx(1.0, abs=1e-4) and 0 <= metrics.mcnemar(10**9, 2 * 10**9) < 1e-12


def test_paired_rows_must_meet(spark):
    schema = "k bigint, y_true string, y_pred string"
    a = spark.createDataFrame([(1, "x", "x"), (2, "y", "x"), (3, "y", "y")], schema)
    b = spark.createDataFrame([(1, "X ", "y"), (2, "y", "y"), (3, "y", "y")], schema)
    r = metrics.paired_counts(a, b, "k").first()
    assert (r.n, r.both, r.a_only, r.b_only, r.neither, r.p_value) == (3, 1, 1, 1, 0, 1.0)
    assert (r.macro_f1_a, r.macro_f1_b) == (pytest.approx(2 / 3, abs=1e-6), pytest.approx(0.4, abs=1e-6)) and r.macro_f1_delta == pytest.approx(0.266667)
    for other in (b.where("k < 3"), b.withColumn("y_true", F.lit("z"))):
        with pytest.raises(Exception, match="only one side|true labels differ"):
            metrics.paired_counts(a, other, "k").collect()


def test_noise_from_the_database(spark):
    records = db(spark)
    out = augment.generate_examples(records, 40, 1, 2, noise_rate=1.0).collect()
    all_markers = {m for r in RECORDS for m in r[4]}
    own = {r[0]: set(r[4]) for r in RECORDS}
    for r in out:
        noise = set(r.markers) - own[r.rec_id]
        assert 1 <= len(noise) <= 2 and noise <= all_markers and len(r.markers) == len(set(r.markers))
    given = augment.generate_examples(records, 40, 1, 2, noise_rate=1.0, noise_markers=["Z1", "Z2"]).collect()
    assert all(len({"Z1", "Z2"} & set(r.markers)) == 1 for r in given)
    plain = augment.generate_examples(records, 5, 1, 2, noise_rate=0.0).collect()
    assert all(set(r.markers) <= own[r.rec_id] for r in plain)


def test_draws_reach_the_whole_pool(spark):
    pool = spark.createDataFrame([(f"M{i:04d}", i) for i in range(700)], "marker string, place bigint")
    barred = spark.createDataFrame([("rare", f"M{i:04d}") for i in range(697)], "label_key string, marker string")
    askers = spark.createDataFrame([("1", ["M0698"], 5, "rare"), ("2", None, 3, None), ("3", [], 0, "x")], "k string, own array<string>, wanted int, label_key string")
    got = {r.k: r.drawn for r in augment.draw_markers(askers, pool, 7, barred, draws=2).collect()}
    assert set(got["1"]) == {"M0697", "M0699"} and len(set(got["2"])) == 3 and got["3"] == []
    assert [r.drawn for r in augment.draw_markers(askers, pool.limit(0), 7).collect()] == [[]] * 3


def test_sync_gold(spark):
    said = spark.createDataFrame([(0, "T cell", "Lung", ["A"], "cl_1"), (1, "x", "Skin", ["B"], None), (2, "y", None, None, "CL:3")], "rec_id bigint, y_true string, tissue string, markers array<string>, true_cl_id string")
    gold = spark.createDataFrame([(0, "t-cell", "Lung", ["A"], "CL:1"), (1, "y", "Lung", ["C"], "CL:2"), (2, "Y", "", None, None)], "rec_id bigint, cell_type string, tissue string, markers array<string>, cell_ontology_id string")
    got = {r.rec_id: (r.mismatch, r.change, r.original_true_cl_id, r.true_cl_id) for r in linking.sync_gold(said, gold, True).collect()}
    assert got == {0: ("", "none", "CL:1", "CL:1"), 1: ("cell_type,tissue,markers", "filled", None, "CL:2"), 2: ("", "cleared", "CL:3", None)}
    with pytest.raises(Exception, match="rows differ at 1"):
        linking.sync_gold(said, gold).collect()
    with pytest.raises(Exception, match="only one side has row 2"):
        linking.sync_gold(said, gold.where("rec_id < 2"), True).collect()


def test_mcnemar():
    assert metrics.mcnemar(3, 0) == pytest.approx(0.25) and metrics.mcnemar(2, 2) == 1.0 and metrics.mcnemar(0, 0) is None


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "y_true string, y_pred string, true_cl_id string, pred_cl_id string, confidence double, runtime_seconds double, cost_usd double")
    r = metrics.evaluate(empty).first()
    assert (r.n, r.accuracy, r.macro_f1, r.ece, r.cl_accuracy) == (0, 0.0, 0.0, None, None)


def test_conflicts_fail(spark):
    rows = spark.createDataFrame([("T-cell", "CL:1"), ("t cell", "CL:2")], "cell_type string, accepted_cl_id string")
    with pytest.raises(Exception, match="conflicts"):
        linking.apply_curation(db(spark), rows).collect()


def test_curation(spark):
    terms = spark.createDataFrame([("CL:1", "memory cell", [("recall cell", "EXACT")], False), ("CL:2", "plasma cell", [], True)], "cl_id string, name string, synonyms array<struct<text:string,scope:string>>, is_obsolete boolean")
    onto = linking.ontology_label_map(terms)
    assert {r.normalized_label for r in onto.collect()} == {"memory cell", "recall cell"}
    unmapped = spark.createDataFrame([("Memory cells", 2, "Lung", "a"), ("qqq", 1, "Lung", "a")], "cell_type string, records bigint, tissues string, sources string")
    template = curation.curation_template(unmapped, onto)
    got = {r.cell_type: r for r in template.collect()}
    assert got["Memory cells"].suggested_cl_id == "CL:1" and got["qqq"].suggested_cl_id is None and got["qqq"].rank == 1
    accepted = {r.cell_type: r.accepted_cl_id for r in curation.auto_accept(template, 0.7).collect()}
    assert accepted == {"Memory cells": "CL:1", "qqq": None}
    decided = curation.accept_suggestion(template, "QQQ", "CL:0000009", notes="why").where("cell_type = 'qqq'").first()
    assert (decided.accepted_cl_id, decided.notes) == ("CL:0000009", "why")
    with pytest.raises(ValueError, match="lacks nowhere"):
        curation.accept_suggestion(template, "Nowhere", "CL:0000009")
    said = spark.createDataFrame([("QQQ", None, None, None, "look", 0), ("nowhere", "CL:1", None, None, None, 1), ("memory cells", None, 1, None, None, 2)], "cell_type string, cl_id string, rank int, accepted_label string, notes string, pos int")
    assert tuple(curation.decision_counts(template, said).first()) == (3, 1, 1, 1)
    after = {r.cell_type: (r.accepted_cl_id, r.notes) for r in curation.apply_decisions(template, said).collect()}
    assert after == {"qqq": (None, "look"), "Memory cells": ("CL:1", None)}


def test_neighbours(spark):
    rng = Random(2)
    points = {i: [rng.random() for _ in range(4)] for i in range(150)} | {200: [0.0] * 4, 201: [0.0] * 4}
    cells = spark.createDataFrame([*points.items(), (300, None)], "cell_id bigint, vector array<double>").repartition(3)
    queries = cells.where("cell_id % 3 = 0 or cell_id > 199")
    for block in (7, 1000):
        got = {(r.cell_id, r.rank): r.neighbour for r in matrix.nearest_cells(cells, queries, 5, block).collect()}
        for q in [*range(0, 150, 3), 200, 201]:
            near = sorted((sum((a - b) ** 2 for a, b in zip(points[q], v, strict=True)), i) for i, v in points.items() if i != q)[:5]
            assert [got[q, r] for r in range(1, 6)] == [i for _, i in near]
    assert matrix.nearest_cells(cells, queries.limit(0), 5).count() == 0 and matrix.nearest_cells(cells.where("cell_id < 2"), queries.where("cell_id = 0")).count() == 1


def test_suggestions_try_every_variant(spark):
    onto = spark.createDataFrame(
        [("natural killer cell", "natural killer cell", "CL:1", "natural killer cell"), ("zhavabran cell", "zhavabran cell", "CL:2", "zhavabran cell"),
         ("giatiskack fibre", "giatiskack fibre", "CL:3", "giatiskack fibre"), ("cdc", "cDC", "CL:4", "conventional")],
        "normalized_label string, label string, cl_id string, term_name string",
    )
    labels = spark.createDataFrame([("NK cells",), ("Zhavabran cells",), ("Giatiskack fibre (cluster 30)",), ("DC",), (None,)], "label string")
    top = {r.label: (r.cl_id, r.score) for r in curation.fuzzy_candidates(labels, onto).where("rank = 1").collect()}
    assert top["NK cells"] == ("CL:1", 1.0) and top["Zhavabran cells"] == ("CL:2", 1.0) and top["Giatiskack fibre (cluster 30)"] == ("CL:3", 1.0)
    assert curation.fuzzy_candidates(labels, onto).where("label = 'DC' and cl_id = 'CL:4'").count() == 1
    unmapped = labels.where("label is not null").select(F.col("label").alias("cell_type"), F.lit(1).alias("records"), F.lit("").alias("tissues"), F.lit("").alias("sources"))
    accepted = curation.auto_accept(curation.curation_template(unmapped, onto)).where("accepted_cl_id is not null")
    assert {r.cell_type: r.accepted_cl_id for r in accepted.collect()} == {"NK cells": "CL:1", "Zhavabran cells": "CL:2", "Giatiskack fibre (cluster 30)": "CL:3"}


def test_splits(spark):
    rows = spark.range(1000).select(F.col("id").alias("example_id"), (F.col("id") % 7).cast("string").alias("g"), F.concat(F.lit("t"), F.col("id") % 300).alias("text"))
    by = splits.split_by_chance(rows, "example_id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in by} == {"train": 800, "validation": 100, "test": 100}
    grouped = splits.split_by_group(rows, ["g"])
    assert splits.leaked_groups(grouped, ["g"]).count() == 0 and grouped.select("split").distinct().count() == 3
    strat = splits.split_by_stratum(rows, F.col("g"), F.col("text"))
    assert strat.count() == 1000 and splits.duplicate_signatures(strat, F.concat("g", "text")).count() == 0
    assert strat.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n < 3").count() == 0
    parts = splits.split_by_stratum(rows, F.lit("all"), F.col("text"))
    assert parts.count() == 1000 and splits.duplicate_signatures(parts, F.col("text")).count() == 0
    with pytest.raises(ValueError, match="fill"):
        splits.deal_groups([("a", 3)], 0.8, 0.1)


def test_runs_deal_as_groups_do():
    for seed in range(300):
        draw = random.Random(seed)
        sizes = [(f"g{i}", draw.choice([1, 1, 1, 2, 3, draw.randint(1, 60)])) for i in range(draw.randint(3, 120))]
        shares = draw.choice([(0.8, 0.1), (0.5, 0.3), (0.34, 0.33), (0.9, 0.0)])
        order = [g for g, _ in sorted(sizes, key=lambda g: (g[1], g[0]), reverse=True)]
        got = {order[i]: names[(i - a) % len(names)] for _, a, b, names in splits.deal_runs(list(Counter(n for _, n in sizes).items()), *shares) for i in range(a, b)}
        assert got == splits.deal_groups(sizes, *shares)


def test_hot_group_among_many(spark):
    rows = spark.range(151_000).select("id", F.when(F.col("id") % 3 == 0, "hot7").otherwise(F.concat(F.lit("g"), F.col("id"))).alias("g"))
    out = splits.split_by_group(rows, ["g"])
    sizes = [(r.g, r.n) for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()]
    got = {(r.g, r.split) for r in out.select("g", "split").distinct().collect()}
    assert len(sizes) > 100_000 and got == set(splits.deal_groups(sizes, 0.8, 0.1).items())
    shares = {r.split: r["count"] / 151_000 for r in out.groupBy("split").count().collect()}
    assert ("hot7", "train") in got and all(abs(shares[s] - x) < 1e-4 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


def test_perturbation(spark):
    rows = spark.createDataFrame([(1, "T cell", ["CD3D", "CD3E", "IL7R"]), (2, "B cell", []), (3, None, None)], "example_id bigint, cell_type string, markers array<string>")
    out = {r.example_id: r for r in augment.perturb_markers(rows, db(spark), 1.0, 1, min_markers=1).collect()}
    assert out[1].dropped == 2 and len(out[1].markers) == 2 and not set(out[1].added) & {"CD3D", "CD3E", "IL7R"}
    assert len(out[2].markers) == 1 and len(out[3].markers) == 1
    same = augment.perturb_markers(rows, db(spark), 0.0, 0).where("example_id = 1").first()
    assert sorted(same.markers) == ["CD3D", "CD3E", "IL7R"]


def test_salted_join(spark):
    left = spark.range(500).select(F.col("id"), F.when(F.col("id") < 400, "hot").when(F.col("id") < 450, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    right = spark.createDataFrame([("hot", 1), ("k410", 2)], "k string, v int")
    for limit in (50, 10_000):
        got = salted_join(left, right, "k", rows_per_task=limit)
        assert got.count() == 500 and got.agg(F.sum("v")).first()[0] == 402
        assert salted_join(left, right, "k", "inner", limit).count() == 401


def test_draws_from_a_held_pool_meet_in_hashes(spark, monkeypatch):
    rng = Random(3)
    names = [f"MARKER{i:05d}" for i in range(3000)]
    pool = spark.createDataFrame([(m, i) for i, m in enumerate(names)], "marker string, place bigint")
    barred = spark.createDataFrame([("hot", m) for m in names[:2990]] + [("x", m) for m in names[::7]], "label_key string, marker string")
    rows = [(str(i), rng.sample(names, 20), i % 6 - 1, rng.choice(["x", "x", "y", None])) for i in range(1000)] + [(f"h{i}", names[i:i + 5], 8, "hot") for i in range(30)]
    askers = spark.createDataFrame(rows, "k string, own array<string>, wanted int, label_key string")
    got = lambda: augment.draw_markers(askers, pool, 7, barred)
    sent, held = shuffled(spark, got), {r.k: r.drawn for r in got().collect()}
    monkeypatch.setattr(augment, "POOL", 0)
    assert held == {r.k: r.drawn for r in got().collect()} and len(held) == 1030
    assert set(held["h0"]) < set(names[2990:]) and len(held["h0"]) == 8
    assert sent < 400_000 < shuffled(spark, got)
