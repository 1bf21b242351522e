"""Queries that evaluate predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.functions.text import norm_label
from celltrail.operators import metrics as me
from celltrail.operators.annotators import annotate_by_overlap, candidate_lists
from celltrail.operators.augment import perturb_levels
from celltrail.operators.parse import choose_candidate, reparse
from celltrail.operators.similarity import best_with_confidence, rank_by_overlap
from celltrail.plans import sql
from celltrail.plans.linking import predictions
from celltrail.plans.markers import _BEST, _CLUSTERS, _SCORED, clusters, database
from celltrail.session import table


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).agg(F.round(F.avg(me.correct()), 6).alias("accuracy"))


def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.macro_f1(predictions(spark, sf_dir))


def label_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.label_f1(predictions(spark, sf_dir)).drop("_f1")


def cl_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).groupBy("method").agg(F.round(me.cl_accuracy(), 6).alias("cl_accuracy"))


def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.calibration_error(predictions(spark, sf_dir), by=["method"])


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = me.calibration_bins(predictions(spark, sf_dir))
    return bins.select("bin", "n", F.round("accuracy", 6).alias("accuracy"), F.round("confidence", 6).alias("confidence"))


def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.evaluate(predictions(spark, sf_dir))


def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of all methods in one job."""
    return me.evaluate(predictions(spark, sf_dir), by=["method"])


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.label_counts(predictions(spark, sf_dir))


def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.top_labels(predictions(spark, sf_dir), me.label("y_pred"), "pred_id", 10)


def analyze_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.analyze_predictions(predictions(spark, sf_dir))


def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.top_confusions(predictions(spark, sf_dir))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.confusion(predictions(spark, sf_dir))


def wrong_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("at", F.struct("pred_id", "arrived_at"))
    return me.wrong_examples(rows, "at").select("pred_id", "arrived_at", "y_true", "y_pred")


def _experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiment names with the paths of their files: methods, and what the sources of examples are called."""
    methods = predictions(spark, sf_dir).select("method", F.concat(F.lit("runs/"), "method", F.lit(".jsonl")).alias("path"))
    told = table(spark, sf_dir, "annotation_example").select(F.lower("tissue").alias("method"), F.concat(F.lit("runs/deepseek-"), F.lower("source")).alias("path"))
    return methods.unionByName(told)


def infer_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Method names read from experiment names and paths, first rule first."""
    rows = _experiments(spark, sf_dir)
    return rows.groupBy(method_of(F.col("method"), F.col("path")).alias("kind"), "method").agg(F.count(F.lit(1)).alias("n"))


# What the name or path of an experiment says of its method; the first row with a word found counts,
# and what it names may depend on a second word.
METHOD_WORDS = (
    (("sctype-style", "sctype_style"), "scType-style", ()),
    (("sctype_harmonized", "sctype.harmonized"), "scType harmonized", ()),
    (("sctype",), "scType", ()),
    (("singler",), "SingleR", ()),
    (("rerank",), "LoRA rerank", ()),
    (("prompt",), "Prompt-only LLM", (("qwen", "Prompt-only Qwen"), ("llama", "Prompt-only Llama"), ("deepseek", "Prompt-only DeepSeek"))),
    (("lora",), "LoRA", ()),
    (("marker", "overlap"), "marker-overlap", ()),
)


def method_of(name: Column, path: Column | None = None) -> Column:
    text = F.lower(F.concat_ws(" ", name, path if path is not None else F.lit("")))
    out = F
    for words, kind, families in METHOD_WORDS:
        named = F.lit(kind)
        for word, family in reversed(families):
            named = F.when(text.contains(word), family).otherwise(named)
        found = F.lit(False)
        for word in words:
            found = found | text.contains(word)
        out = out.when(found, named)
    return out.otherwise("unknown")


def reparse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many predictions change when their answers are read again."""
    out = reparse(predictions(spark, sf_dir))
    return out.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("reparsed").alias("reparsed"),
        F.count_if(~norm_label(F.col("y_pred")).eqNullSafe(norm_label(F.col("original_y_pred")))).alias("changed_labels"),
        F.count_if(~F.col("pred_cl_id").eqNullSafe(F.col("original_pred_cl_id"))).alias("changed_ids"),
    )


def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the overlap annotator on all examples."""
    predicted = annotate_by_overlap(clusters(spark, sf_dir), database(spark, sf_dir))
    truth = table(spark, sf_dir, "annotation_example").select(F.col("example_id").alias("q_id"), "split", F.col("cell_type").alias("y_true"), F.col("cell_ontology_id").alias("true_cl_id"))
    rows = truth.join(predicted.withColumnsRenamed({"cell_type": "y_pred", "cell_ontology_id": "pred_cl_id"}), "q_id")
    none = F.lit(None).cast("double")
    return me.evaluate(rows.withColumns({"runtime_seconds": none, "cost_usd": none}), by=["split"])


def rerank_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice among the three best candidates, by hash, against the first and the best."""
    queries, db = clusters(spark, sf_dir), database(spark, sf_dir)
    lists = candidate_lists(rank_by_overlap(queries, db, 3), queries, db)
    truth = table(spark, sf_dir, "annotation_example").select(F.col("example_id").alias("q_id"), F.col("cell_type").alias("y_true"))
    rows = lists.join(truth, "q_id")
    pick = F.pmod(F.col("q_id"), F.size("candidates").cast("bigint")).cast("int")
    return me.rerank_audit(rows.withColumn("y_pred", F.get("candidates", pick)["cell_type"]))


def rerank_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where among the three best candidates the true label stands."""
    queries, db = clusters(spark, sf_dir), database(spark, sf_dir)
    lists = candidate_lists(rank_by_overlap(queries, db, 3), queries, db)
    truth = table(spark, sf_dir, "annotation_example").select(F.col("example_id").alias("q_id"), F.col("cell_type").alias("y_pred"))
    return me.selected_ranks(lists.join(truth, "q_id"))


#: Drop rates and added markers of the noise grid.
NOISE = ((0.0, 0), (0.5, 3), (0.75, 5), (0.9, 8))


def noise_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of the overlap annotator as markers are dropped and others added, all levels in one job."""
    db = database(spark, sf_dir)
    rows = clusters(spark, sf_dir, "cell_type").withColumnRenamed("q_id", "example_id")
    noisy = perturb_levels(rows, db, NOISE, keep=("tissue",))
    q_id = (F.col("example_id") * len(NOISE) + F.col("level")).alias("q_id")
    # What takes no noise shall not draw it once more.
    each = F.explode(F.sequence(F.lit(0), F.lit(len(NOISE) - 1))).alias("level")
    asked = table(spark, sf_dir, "annotation_example").select("example_id", F.coalesce("tissue", F.lit("")).alias("tissue"), F.col("cell_type").alias("y_true"), each)
    asked = asked.select(q_id, "tissue", "level", "y_true")
    ranked = rank_by_overlap(noisy.select(q_id, "tissue", "markers"), db, 2, asked)
    scored = best_with_confidence(ranked, asked, db, ("level", "y_true")).withColumnRenamed("cell_type", "y_pred")
    levels = F.create_map(*[F.lit(x) for i, (drop, _) in enumerate(NOISE) for x in (i, drop)])
    by = scored.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(me.correct()), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return by.withColumn("drop_rate", levels[F.col("level")])


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each method and example: its first delivery, under the example's one true label."""
    rows = predictions(spark, sf_dir)
    truth = rows.groupBy("example_id").agg(F.min("y_true").alias("y_true"))
    first = F.min_by(F.struct("y_pred"), F.struct("pred_id", "arrived_at"))
    return rows.groupBy("method", "example_id").agg(first.alias("r")).select("method", "example_id", "r.y_pred").join(truth, "example_id")


#: The two methods compared, over the examples that both answered.
COMPARED = ("lora_adapter", "lora_rerank")


#: The comparisons of the table.
COMPARISONS = (COMPARED, ("lora_adapter", "prompt_only"), ("lora_adapter", "marker_overlap"), ("lora_rerank", "marker_overlap"), ("marker_overlap", "sctype_style"))


def _methods(spark: SparkSession, sf_dir: str, compared: tuple[str, str] = COMPARED) -> tuple[DataFrame, DataFrame]:
    rows = _answers(spark, sf_dir)
    a, b = (rows.where(F.col("method") == m) for m in compared)
    return a.join(b.select("example_id"), "example_id", "left_semi"), b.join(a.select("example_id"), "example_id", "left_semi")


def paired_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _methods(spark, sf_dir)
    return me.paired_counts(a, b, "example_id")


def paired_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparisons, a row each."""
    parts = [
        me.paired_counts(*_methods(spark, sf_dir, pair), "example_id").withColumns({"method_a": F.lit(pair[0]), "method_b": F.lit(pair[1])})
        for pair in COMPARISONS
    ]
    return reduce(DataFrame.unionByName, parts)


#: As many as published comparisons draw.
RESAMPLES = 500


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _methods(spark, sf_dir)
    return me.bootstrap_interval(me.bootstrap_deltas(a, b, "example_id", RESAMPLES))


def bootstrap_f1_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _methods(spark, sf_dir)
    return me.bootstrap_interval(me.bootstrap_f1_deltas(a, b, "example_id", RESAMPLES))


def mcnemar_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact p-values of every two methods over the examples that both answered."""
    return me.discordant_pairs(_answers(spark, sf_dir), "example_id", "method")


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every example's three best candidates and what stored answers choose of them; unanswered ones choose by hash."""
    queries, db = clusters(spark, sf_dir), database(spark, sf_dir)
    lists = candidate_lists(rank_by_overlap(queries, db, 3), queries, db).withColumnRenamed("q_id", "example_id")
    truth = table(spark, sf_dir, "annotation_example").select("example_id", F.col("cell_type").alias("y_true"))
    answers = predictions(spark, sf_dir).groupBy("example_id").agg(F.min_by("raw_response", F.struct("pred_id", "arrived_at")).alias("raw"))
    rows = truth.join(lists, "example_id").join(answers, "example_id", "left")
    chosen = choose_candidate(F.col("raw"), F.col("candidates"))
    pick = F.get("candidates", F.pmod(F.col("example_id"), F.size("candidates").cast("bigint")).cast("int"))["cell_type"]
    none = F.col("raw").isNull()
    return rows.withColumn("_c", chosen).select(
        "example_id", "y_true", "candidates", F.when(none, pick).otherwise(F.col("_c.candidate.cell_type")).alias("y_pred"),
        F.when(~none, F.col("_c.selection_source")).alias("selection_source"),
    )


def rerank_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.rerank_histograms(_reranked(spark, sf_dir))


def harm_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return me.harm_examples(_reranked(spark, sf_dir), "example_id")


QUERIES = {
    f.__name__: f
    for f in (
        accuracy, macro_f1, label_f1, cl_accuracy, ece, calibration, evaluate, experiment_summary, label_counts, top_labels,
        analyze_predictions, top_confusions, confusion_matrix, wrong_examples, infer_method, reparse_counts, benchmark_overlap,
        rerank_audit, rerank_ranks, rerank_histograms, harm_examples, noise_grid, paired_counts, paired_table, bootstrap_ci, bootstrap_f1_ci, mcnemar_values,
    )
}

_F1 = """
    cells as (select {k} t, p, count(*) as n from pr group by all),
    tr as (select {k} t as label, sum(n) as support, coalesce(sum(n) filter (t = p), 0) as tp from cells group by all),
    sd as (select {k} p as label, sum(n) as said from cells group by all),
    f as (select {kt} tr.label, support, coalesce(said, 0) as said, tp, coalesce(tp / nullif(said, 0), 0.0) as pc, tp / support as rc
          from tr left join sd on tr.label = sd.label {on}),
    g as (select *, coalesce(2 * pc * rc / nullif(pc + rc, 0), 0.0) as f1 from f)"""
_ONE = _F1.format(k="", kt="", on="").strip()
_BY = _F1.format(k="method,", kt="tr.method,", on="and tr.method = sd.method").strip()
_BINS = "(select method, least(9, cast(floor(conf * 10) as int)) as bin, case when t = p then 1.0 else 0.0 end as ok, conf from pr where conf is not null)"
_COLS = """count(*) as n, round(avg(case when t = p then 1.0 else 0.0 end), 6) as accuracy,
    round(case when count(pc) > 0 then count(*) filter (tc = pc) / nullif(count(tc), 0) end, 6) as cl_accuracy,
    round(avg(runtime), 5) as mean_runtime, round(sum(runtime), 6) as total_runtime, round(sum(cost), 6) as total_cost, count(distinct t) as labels"""
_ANSWERS = f"""
    tr_ as (select example_id, min(y_true) as y from annotation_prediction group by 1),
    ans as (select method, example_id, {sql.label("coalesce(y, 'None')")} as t, {sql.label("coalesce(f.y, 'None')")} as p from (
                select method, example_id, arg_min(struct_pack(y := cell_type), struct_pack(p := pred_id, a := arrived_at)) as f from annotation_prediction group by 1, 2)
            join tr_ using (example_id))""".replace("coalesce(y, 'None')", "coalesce(tr_.y, 'None')")


def _pairs(compared: tuple[str, str]) -> str:
    return f"""{_ANSWERS},
    pair as (select example_id, x.t, x.p as pa, y.p as pb, (x.t = x.p)::int as a, (y.t = y.p)::int as b from (select * from ans where method = '{compared[0]}') x
             join (select * from ans where method = '{compared[1]}') y using (example_id))"""


_PAIRS = _pairs(COMPARED)
_P = "least(1.0, 2 * (select sum(exp(lgamma(a_only + b_only + 1.0) - lgamma(i + 1.0) - lgamma(a_only + b_only - i + 1.0) - (a_only + b_only) * ln(2.0))) from range(0, 100000) x(i) where i <= least(a_only, b_only)))"


def _f1_of(side: str) -> str:
    return f"""(select avg(coalesce(2.0 * tp / nullif(n + said, 0), 0.0)) from (
        select l.t, count(*) as n, count(*) filter (l.t = l.p{side}) as tp, (select count(*) from pair q where q.p{side} = l.t) as said from pair l group by 1))"""


def _paired(compared: tuple[str, str]) -> str:
    return f"""with {_pairs(compared).strip()}, c as (select count(*) as n, count(*) filter (a = 1 and b = 1) as "both", count(*) filter (a = 1 and b = 0) as a_only,
        count(*) filter (a = 0 and b = 1) as b_only, count(*) filter (a = 0 and b = 0) as neither, round(avg(a), 6) as accuracy_a, round(avg(b), 6) as accuracy_b,
        round(avg(a - b), 6) as accuracy_delta, round({_f1_of('a')}, 6) as macro_f1_a, round({_f1_of('b')}, 6) as macro_f1_b from pair)
        select *, round(macro_f1_a - macro_f1_b, 6) as macro_f1_delta, round(case when a_only + b_only > 0 then {_P} end, 6) as p_value from c"""


_RERANKED = f"""
    c as (select q_id, rank, d.cell_type as name, d.cl, lk, count(*) over (partition by q_id) as k from ranked r join db d using (rec_id) where rank <= 3),
    raws as (select example_id, arg_min(struct_pack(r := raw_response), struct_pack(p := pred_id, a := arrived_at)).r as raw from annotation_prediction group by 1),
    told as (select e.example_id, e.cell_type as y_true, {sql.label("coalesce(e.cell_type, 'None')")} as t, raw, {sql.label(sql.parsed("raw")["cell_type"])} as said,
                    try_cast(nullif(regexp_extract(coalesce(raw, ''), '(?i)candidate{sql.WS}*:{sql.WS}*(\\d+)', 1), '') as int) as number
             from annotation_example e left join raws using (example_id)),
    pickd as (select example_id, any_value(k) as k, max(case when rank = number then rank end) as bn, min(case when lk = said then rank end) as bl, any_value(raw) as raw
              from told join c on q_id = example_id group by 1),
    rr as (select *, case when raw is null then example_id % k + 1 else coalesce(bn, bl, 1) end as at,
                  case when raw is null then null when bn is not null then 'candidate_number' when bl is not null then 'cell_type_label' else 'fallback_top_candidate' end as src from pickd),
    chosen as (select rr.example_id, rr.k, rr.src, c.name as y_pred, c.lk as pl from rr join c on c.q_id = rr.example_id and c.rank = rr.at),
    placed as (select chosen.*, (select min(rank) from c where c.q_id = chosen.example_id and c.lk = {sql.label("coalesce(chosen.y_pred, 'None')")}) as pos from chosen)"""
_POISSON = " + ".join(f"({{u}} >= {c!r})::int" for c in me._POISSON)

_TOP = f"with {sql.DB}, {_CLUSTERS.strip()}, {_SCORED.strip()}"
_TRUE = sql.label("coalesce(e.cell_type, 'None')")

ORACLES = {
    "rerank_audit": f"""{_TOP},
        c as (select q_id, rank, count(*) over (partition by q_id) as k, {sql.label("coalesce(d.cell_type, '')")} as l, {_TRUE} as t
              from ranked r join db d using (rec_id) join annotation_example e on e.example_id = q_id where rank <= 3),
        o as (select q_id, max(case when rank = 1 and l = t then 1 else 0 end) as f, max(case when l = t then 1 else 0 end) as a,
                     max(case when rank = q_id % k + 1 and l = t then 1 else 0 end) as s from c group by 1)
        select count(*) as n, round(avg(f), 6) as top1_accuracy, round(avg(a), 6) as oracle_accuracy, round(avg(s), 6) as rerank_accuracy,
               count(*) filter (f = 1 and s = 0) as harmed, count(*) filter (f = 0 and s = 1) as fixed from o""",
    "rerank_ranks": f"""{_TOP},
        c as (select q_id, rank, {sql.label("d.cell_type")} as l, {_TRUE} as t
              from ranked r join db d using (rec_id) join annotation_example e on e.example_id = q_id where rank <= 3),
        o as (select q_id, min(case when l = t then rank end) as r from c group by 1)
        select coalesce(r::varchar, 'not_in_candidates') as rank, count(*) as n from o group by 1""",
    "benchmark_overlap": f"""{_TOP}, said as ({_BEST.replace("best as (", "with best as (", 1).strip()}),
        pr as (select e.split as method, {sql.label("coalesce(e.cell_type, 'None')")} as t, {sql.label("coalesce(s.cell_type, 'None')")} as p,
                      nullif(e.cell_ontology_id, '') as tc, nullif(s.cell_ontology_id, '') as pc, s.confidence as conf,
                      null::double as runtime, null::double as cost from said s join annotation_example e on e.example_id = s.q_id),
        {_BY}, b as (select method, bin, count(*) as n, avg(ok) as a, avg(conf) as c from {_BINS} group by 1, 2),
        m as (select method, {_COLS} from pr group by 1), mf as (select method, round(coalesce(avg(f1), 0.0), 6) as macro_f1 from g group by 1),
        x as (select method, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b group by 1)
        select method as split, * exclude (method) from m left join mf using (method) left join x using (method)""",
    "accuracy": f"with {sql.PREDICTIONS} select round(avg(case when t = p then 1.0 else 0.0 end), 6) as accuracy from pr",
    "macro_f1": f"with {sql.PREDICTIONS}, {_ONE} select round(coalesce(avg(f1), 0.0), 6) as macro_f1 from g",
    "label_f1": f"with {sql.PREDICTIONS}, {_ONE} select label, support, said, tp, round(pc, 6) as precision, round(rc, 6) as recall, round(f1, 6) as f1 from g",
    "cl_accuracy": f"with {sql.PREDICTIONS} select method, round(case when count(pc) > 0 then count(*) filter (tc = pc) / nullif(count(tc), 0) end, 6) as cl_accuracy from pr group by 1",
    "ece": f"""with {sql.PREDICTIONS}, b as (select method, bin, count(*) as n, avg(ok) as a, avg(conf) as c from {_BINS} group by 1, 2)
        select method, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b group by 1""",
    "calibration": f"with {sql.PREDICTIONS} select bin, count(*) as n, round(avg(ok), 6) as accuracy, round(avg(conf), 6) as confidence from {_BINS} group by 1",
    "evaluate": f"""with {sql.PREDICTIONS}, {_ONE}, b as (select bin, count(*) as n, avg(ok) as a, avg(conf) as c from {_BINS} group by 1)
        select {_COLS}, (select round(coalesce(avg(f1), 0.0), 6) from g) as macro_f1, (select round(sum(n * abs(a - c)) / sum(n), 6) from b) as ece from pr""",
    "experiment_summary": f"""with {sql.PREDICTIONS}, {_BY}, b as (select method, bin, count(*) as n, avg(ok) as a, avg(conf) as c from {_BINS} group by 1, 2),
        m as (select method, {_COLS} from pr group by 1), mf as (select method, round(coalesce(avg(f1), 0.0), 6) as macro_f1 from g group by 1),
        e as (select method, round(sum(n * abs(a - c)) / sum(n), 6) as ece from b group by 1)
        select * from m left join mf using (method) left join e using (method)""",
    "label_counts": f"with {sql.PREDICTIONS} select t as label, count(*) as n from pr group by 1",
    "top_labels": f"with {sql.PREDICTIONS} select p as label, count(*) as n from pr group by 1 order by n desc, min(pred_id) limit 10",
    "analyze_predictions": f"""with {sql.PREDICTIONS} select count(*) as n, count(*) filter (t = p) as correct, count(*) filter (t <> p) as wrong,
        count(*) filter (trim(coalesce(cell_type, '')) = '') as blank_predictions, count(*) filter (conf is null) as missing_confidence,
        count(tc) as with_true_id, count(pc) as with_predicted_id, count(*) filter (tc = pc) as matching_ids from pr""",
    "top_confusions": f"with {sql.PREDICTIONS} select t, p, count(*) as n from pr where t <> p group by 1, 2 order by n desc, t, p limit 20",
    "confusion_matrix": f"with {sql.PREDICTIONS} select t, p, count(*) as n from pr group by 1, 2",
    "wrong_examples": f"with {sql.PREDICTIONS} select pred_id, arrived_at, y_true, cell_type as y_pred from pr where t <> p order by pred_id, arrived_at limit 25",
    "noise_grid": f"""
        with {sql.DB}, levels(level, drop_rate, added) as (values {", ".join(f"({i}, {d}::double, {a})" for i, (d, a) in enumerate(NOISE))}),
        base as (select example_id, cell_type, lower(trim(coalesce(tissue, ''))) as tkey, coalesce(l, []) as m from annotation_example left join (
            select example_id, list(m order by f) as l from (select example_id, m, min(i) as f from (
                select example_id, unnest(g) as m, generate_subscripts(g, 1) as i from (
                    select example_id, list_transform(list_filter(coalesce(metadata.markers, markers), lambda x: x is not null), lambda x: {sql.gene('x')}) as g from annotation_example))
                where m <> '' group by 1, 2) group by 1) using (example_id)),
        {sql.draws(f"select example_id::varchar as k, m as own, {max(a for _, a in NOISE)} as wanted, {sql.label('cell_type')} as label_key from base", "23",
                   "not exists (select 1 from lm where lm.label_key = tries.label_key and lm.m = voc.m)").strip()},
        u as (select example_id, m, {sql.uniform('23', 'example_id', 'm')} as u from (select example_id, unnest(m) as m from base)),
        kept as (select example_id, level, m from (select *, count(*) filter (u >= drop_rate) over (partition by example_id, level) as n,
                        row_number() over (partition by example_id, level order by u desc, m desc) as r from u, levels) where u >= drop_rate or (n < 1 and r = 1)),
        mixed as (select example_id, level, m from kept union select k::bigint, level, m from drawn, levels where r <= added),
        raw_q as (select b.example_id * {len(NOISE)} + level as q_id, tkey, coalesce(l, []) as l, level, b.example_id from base b cross join levels
                  left join (select example_id, level, list(m) as l from mixed group by 1, 2) o using (example_id, level)),
        {_CLUSTERS[_CLUSTERS.index("q as (\n        select distinct"):].strip()}, {_SCORED.strip()},
        said as ({_BEST.replace("best as (", "with best as (", 1).strip()})
        select level, count(*) as n, round(avg(case when {_TRUE} = {sql.label("coalesce(s.cell_type, 'None')")} then 1.0 else 0.0 end), 6) as accuracy,
               round(avg(s.confidence), 6) as confidence, any_value(drop_rate) as drop_rate
        from said s join raw_q using (q_id) join levels using (level) join annotation_example e on e.example_id = raw_q.example_id group by 1""",
    "infer_method": """
        with x as (select method, 'runs/' || method || '.jsonl' as path from annotation_prediction union all
                   select lower(tissue), 'runs/deepseek-' || lower(source) from annotation_example), t as (select method, lower(concat_ws(' ', method, path)) as s from x)
        select case """ + " ".join(
        "when " + " or ".join(f"contains(s, '{w}')" for w in words) + " then "
        + ("case " + " ".join(f"when contains(s, '{w}') then '{k}'" for w, k in families) + f" else '{kind}' end" if families else f"'{kind}'")
        for words, kind, families in METHOD_WORDS
    ) + " else 'unknown' end as kind, method, count(*) as n from t group by 1, 2",
    "reparse_counts": f"""
        with r as (select method, coalesce(length(raw_response), 0) > 0 as again, cell_type, {sql.cl_id('cell_ontology_id')} as cl,
                          {sql.parsed("raw_response")["cell_type"]} as new, {sql.parsed("raw_response")["cell_ontology_id"]} as ncl from annotation_prediction)
        select method, count(*) as n, count(*) filter (again) as reparsed,
               count(*) filter (again and {sql.label('new')} is distinct from {sql.label('cell_type')}) as changed_labels,
               count(*) filter (again and ncl is distinct from cl) as changed_ids from r group by 1""",
    "rerank_histograms": f"""{_TOP}, {_RERANKED.strip()}
        select 'selected_rank' as kind, coalesce(pos::varchar, 'not_in_candidates') as value, count(*) as n from placed group by 2
        union all select 'selection_source', coalesce(src, 'missing'), count(*) from placed group by 2
        union all select 'candidates', k::varchar, count(*) from placed group by 2""",
    "harm_examples": f"""{_TOP}, {_RERANKED.strip()}
        select p.example_id, t.y_true, p.y_pred, p.src as selection_source, f.name as top_candidate, f.cl as top_candidate_cl_id, p.pos as selected_rank
        from placed p join told t using (example_id) join c f on f.q_id = p.example_id and f.rank = 1
        where f.lk = t.t and {sql.label("coalesce(p.y_pred, 'None')")} <> t.t order by 1 limit 25""",
    "paired_counts": _paired(COMPARED),
    "paired_table": " union all by name ".join(f"select *, '{a}' as method_a, '{b}' as method_b from ({_paired((a, b))})" for a, b in COMPARISONS),
    "bootstrap_ci": f"""with {_PAIRS.strip()}, w as (select b_.i as resample, a - b as d, {_POISSON.format(u=sql.uniform("13", "b_.i", "example_id"))} as w from pair, range({RESAMPLES}) b_(i)),
        s as (select resample, sum(d * w) / sum(w) as delta from w where w > 0 group by 1)
        select round(quantile_cont(delta, 0.025), 6) as low, round(quantile_cont(delta, 0.975), 6) as high from s""",
    "bootstrap_f1_ci": f"""with {_PAIRS.strip()}, w0 as (select b_.i as r, t, pa, pb, {_POISSON.format(u=sql.uniform("14", "b_.i", "example_id"))} as w from pair, range({RESAMPLES}) b_(i)),
        w as (select * from w0 where w > 0), tl as (select r, t as l, sum(w) as n, sum(w) filter (pa = t) as ta, sum(w) filter (pb = t) as tb from w group by 1, 2),
        sa as (select r, pa as l, sum(w) as n from w group by 1, 2), sb as (select r, pb as l, sum(w) as n from w group by 1, 2),
        d as (select tl.r, avg(coalesce(2.0 * coalesce(ta, 0) / nullif(tl.n + coalesce(sa.n, 0), 0), 0.0) - coalesce(2.0 * coalesce(tb, 0) / nullif(tl.n + coalesce(sb.n, 0), 0), 0.0)) as delta
              from tl left join sa on sa.r = tl.r and sa.l = tl.l left join sb on sb.r = tl.r and sb.l = tl.l group by 1)
        select round(quantile_cont(delta, 0.025), 6) as low, round(quantile_cont(delta, 0.975), 6) as high from d""",
    "mcnemar_values": f"""with {_ANSWERS.strip()}, c as (select x.method as a, y.method as b, count(*) as n, count(*) filter (x.t = x.p and y.t <> y.p) as a_only,
               count(*) filter (x.t <> x.p and y.t = y.p) as b_only from ans x join ans y using (example_id) where x.method < y.method group by 1, 2)
        select a, b, n, a_only, b_only, round(case when a_only + b_only > 0 then {_P} end, 6) as p_value from c""",
}
