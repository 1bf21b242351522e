"""Command line over the operators: files in, files out."""

from __future__ import annotations

import argparse
import gzip
import importlib
import importlib.metadata
import json
import os
import platform
import shutil
import sys
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.functions.text import norm_cl_id, norm_label
from celltrail.operators import annotators, augment, curation, linking, markers, metrics, splits
from celltrail.operators import matrix as mx
from celltrail.operators.parse import reparse
from celltrail.operators.prompts import to_training_records, training_text
from celltrail.session import local_session
from celltrail.sources import sinks
from celltrail.sources import tables as src


def _json(df: DataFrame) -> None:
    for row in df.limit(1000).collect():
        print(json.dumps(row.asDict(recursive=True), default=str))


def _records(spark: SparkSession, path: str) -> DataFrame:
    return src.read_marker_records(spark, path)


def _mapping(spark: SparkSession, path: str) -> DataFrame:
    rows = src.read_label_map(spark, path)
    return linking.last_wins(rows, F.col("label"), F.col("normalized_label"), F.col("cl_id"))


def _training(spark: SparkSession, path: str) -> DataFrame:
    """Training records with their metadata's fields beside them."""
    rows = src.with_row_order(src.read_jsonl(spark, path), "example_id")
    fields = [F.col(f"metadata.{c}").alias(c) for c in ("tissue", "cell_type", "cell_ontology_id", "source", "markers")]
    return rows.select("*", *fields)


def build_dataset(spark: SparkSession, a: argparse.Namespace) -> None:
    made = augment.generate_examples(_records(spark, a.input), a.examples, a.min_markers, a.max_markers, seed=a.seed)
    meta = F.struct("tissue", "cell_type", "cell_ontology_id", "markers", "source", "augmentation_index")
    sinks.write_jsonl(to_training_records(made.withColumn("metadata", meta), a.form), a.output)


def normalize_markers(spark: SparkSession, a: argparse.Namespace) -> None:
    df = src.with_row_order(src.read_delimited(spark, a.input, a.delimiter))
    heads = [c for c in df.columns if c != "rec_id"]
    of = {m: src.resolve_column(heads, m) for m in src.TABLE_ALIASES}
    out = markers.normalize_marker_table(
        df, of["tissue"], of["cell_type"], of["marker"], of["markers"], of["cell_ontology_id"], of["source"], of["evidence"],
        of["species"], a.source_name, Path(a.input).stem, a.species, a.min_markers,
    )
    sinks.write_marker_records(out, a.output, one_file=True)


def merge_marker_dbs(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [_records(spark, p).withColumn("rec_id", F.struct(F.lit(i), "rec_id")) for i, p in enumerate(a.input)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    sinks.write_marker_records(markers.merge_marker_records(both, a.min_markers), a.output, one_file=True)


def validate_marker_db(spark: SparkSession, a: argparse.Namespace) -> None:
    _json(markers.summarize_markers(_records(spark, a.input)))


def build_ontology_map(spark: SparkSession, a: argparse.Namespace) -> None:
    terms = src.read_obo(spark, a.input)
    sinks.write_report(linking.ontology_label_map(terms).orderBy("normalized_label", "cl_id"), a.output)
    if a.ambiguous:
        sinks.write_report(linking.ambiguous_labels(terms).orderBy("normalized_label", "cl_id"), a.ambiguous)


def map_marker_db(spark: SparkSession, a: argparse.Namespace) -> None:
    out = linking.enrich_cl_ids(_records(spark, a.input), _mapping(spark, a.map), a.overwrite)
    sinks.write_marker_records(out, a.output, one_file=True)
    _json(out.groupBy("outcome").count())


def propose_curation(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = src.read_label_map(spark, a.map)
    listed = rows.select("label", norm_label(F.coalesce("normalized_label", "label")).alias("normalized_label"), norm_cl_id(F.col("cl_id")).alias("cl_id"), F.col("label").alias("term_name"))
    sinks.write_report(curation.curation_template(linking.unmapped_groups(_records(spark, a.input)), listed, a.suggestions), a.output)


def _template(spark: SparkSession, path: str) -> DataFrame:
    return src.read_delimited(spark, path, ",").withColumn("rank", F.col("rank").cast("int"))


def auto_accept(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_report(curation.auto_accept(_template(spark, a.input), a.min_score), a.output)


def accept(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_report(curation.accept_suggestion(_template(spark, a.input), a.cell_type, a.cl_id, a.rank, a.label, a.notes), a.output)


def accept_decisions(spark: SparkSession, a: argparse.Namespace) -> None:
    said = src.with_row_order(src.read_delimited(spark, a.decisions, ","), "pos")
    template = _template(spark, a.input)
    sinks.write_report(curation.apply_decisions(template, said, a.skip_missing), a.output)
    _json(curation.decision_counts(template, said))


def prioritize(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [_training(spark, f"{a.splits}/split={s}").withColumn("split", F.lit(s)) for s in splits.SPLITS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sinks.write_report(curation.curation_priority(_template(spark, a.input), rows).orderBy(F.desc("priority"), "cell_type"), a.output)


def apply_curation(spark: SparkSession, a: argparse.Namespace) -> None:
    out = linking.apply_curation(_records(spark, a.input), _template(spark, a.curation), a.overwrite)
    sinks.write_marker_records(out, a.output, one_file=True)


def split(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _training(spark, a.input)
    if a.group_by:
        out = splits.split_by_group(rows, a.group_by, a.train, a.validation)
    elif a.stratify_by:
        out = splits.split_by_stratum(rows, src.field_column(rows.schema, a.stratify_by), training_text(F.col("messages")), a.train, a.validation, a.seed)
    else:
        out = splits.split_by_chance(rows, "example_id", a.train, a.validation, a.seed)
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    sinks.write_splits(out.select("messages", "metadata", "split"), a.output, counts)


def perturb(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _training(spark, a.input)
    done = augment.perturb_markers(rows, _records(spark, a.marker_db), a.drop_rate, a.add_noise, a.min_markers, a.seed)
    out = augment.rewrite_perturbed(rows.withColumn("prompt", F.lit("")), done, a.drop_rate, a.add_noise)
    message = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.col("prompt")).otherwise(m["content"]).alias("content")))
    sinks.write_jsonl(out.select(message.alias("messages"), "metadata"), a.output)


def annotate(spark: SparkSession, a: argparse.Namespace) -> None:
    one = spark.createDataFrame([(1, a.tissue, [m.strip().upper() for m in a.markers.split(",")])], "q_id int, tissue string, markers array<string>")
    _json(annotators.annotate_by_overlap(one, _records(spark, a.marker_db)))


def benchmark(spark: SparkSession, a: argparse.Namespace) -> None:
    db = _records(spark, a.marker_db)
    how = {"overlap": annotators.annotate_by_overlap, "signed": annotators.annotate_by_signed_sets}[a.method]
    out = annotators.run_benchmark(lambda q: how(q, db), annotators.cases(_training(spark, a.input)))
    sinks.write_jsonl(out, a.output)


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    _json(metrics.evaluate(src.read_predictions(spark, a.input), a.bins))


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = src.read_predictions(spark, a.input)
    _json(metrics.analyze_predictions(rows))
    if a.output:
        text = metrics.wrong_examples(rows, "rec_id", a.examples).select("rec_id", "tissue", "y_true", "y_pred", "true_cl_id", "pred_cl_id", "confidence")
        sinks.write_report(text, a.output)


def analyze_rerank(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = src.read_predictions(spark, a.input)
    _json(metrics.rerank_audit(rows))
    _json(metrics.rerank_histograms(rows).orderBy("kind", "value"))
    if a.harmed:
        sinks.write_report(metrics.harm_examples(rows, "rec_id", a.examples), a.harmed)


def map_predictions(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_jsonl(linking.map_prediction_ids(src.read_predictions(spark, a.input), _records(spark, a.marker_db), a.overwrite), a.output)


def harmonize(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = src.with_row_order(src.read_delimited(spark, a.map))
    ids = linking.unambiguous_ids(_records(spark, a.marker_db)) if a.marker_db else None
    sinks.write_jsonl(linking.harmonize(src.read_predictions(spark, a.input), linking.harmonization_map(rows), ids), a.output)


def reparse_predictions(spark: SparkSession, a: argparse.Namespace) -> None:
    sinks.write_jsonl(reparse(src.read_predictions(spark, a.input)), a.output)


def sync_gold(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = src.numbered(src.read_predictions(spark, a.input), "rec_id")
    gold = src.numbered(_training(spark, a.gold), "example_id").drop("rec_id").withColumnRenamed("place", "rec_id")
    out = linking.sync_gold(rows.drop("rec_id").withColumnRenamed("place", "rec_id"), gold, a.allow_mismatch)
    sinks.write_jsonl(out, a.output)
    _json(linking.sync_counts(out))


def benchmark_model(spark: SparkSession, a: argparse.Namespace) -> None:
    module, _, name = a.model.partition(":")
    make = getattr(importlib.import_module(module), name)
    cases = annotators.cases(_training(spark, a.input))
    if a.marker_db:
        db = _records(spark, a.marker_db)
        out = annotators.run_benchmark(lambda q: annotators.annotate_by_rerank(q, db, make, a.top_k), cases)
    else:
        out = annotators.run_benchmark(lambda q: annotators.annotate_by_prompt(q, make), cases)
    sinks.write_jsonl(out, a.output)


def download(spark: SparkSession, a: argparse.Namespace) -> None:
    with urllib.request.urlopen(a.input, timeout=60) as answer:
        data = answer.read()
    Path(a.output).write_bytes(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def _matrix(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(a.input), spark.read.parquet(a.obs).withColumnRenamed(a.cluster, "cluster")


def extract_markers(spark: SparkSession, a: argparse.Namespace) -> None:
    matrix, obs = _matrix(spark, a)
    sinks.write_report(mx.top_genes(mx.rank_genes(matrix, obs, a.method), a.top).orderBy("cluster", "rank"), a.output)


def prepare_matrix(spark: SparkSession, a: argparse.Namespace) -> None:
    matrix, obs = _matrix(spark, a)
    out = mx.matrix_markers(matrix, obs, a.top, a.min_genes, a.min_cells)
    sinks.write_report(out.withColumn("markers", F.array_join("markers", ", ")), a.output)


def summarize(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [src.read_predictions(spark, path).withColumn("experiment", F.lit(name)) for name, path in (x.split("=", 1) for x in a.input)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    rows = [r.asDict() for r in metrics.evaluate(both, by=["experiment"]).orderBy("experiment").collect()]
    text = sinks.markdown_table(rows, list(rows[0]) if rows else ["experiment"]) + "\n"
    if a.preflight:
        told = sinks.preflight_rows(dict(x.split("=", 1) for x in a.preflight))
        text += "\n" + sinks.markdown_table(told, list(told[0])) + "\n"
    Path(a.output).write_text(text)


def environment() -> dict:
    """Versions of what training needs, null where it is missing, and what this machine has."""
    versions = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy", "torch", "transformers", "peft"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    free = shutil.disk_usage(".").free
    memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") if hasattr(os, "sysconf") else None
    hardware = {"cpus": os.cpu_count(), "memory_gb": memory and round(memory / 1e9, 1), "free_disk_gb": round(free / 1e9, 1), "gpu_tool": shutil.which("nvidia-smi")}
    return {"python": platform.python_version(), "dependencies": versions, "hardware": hardware}


def preflight(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [_training(spark, f"{a.input}/split={s}").withColumn("split", F.lit(s)) for s in splits.SPLITS]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    text = training_text(F.col("messages"))
    summary = [r.asDict() for r in splits.split_summary(rows, text, a.max_length).collect()]
    leaks = splits.leaked_groups(rows, a.group_by).count() if a.group_by else 0
    duplicates = splits.duplicate_signatures(rows, text).count()
    unseen = splits.label_overlap(rows, norm_label(F.col("cell_type"))).agg(F.coalesce(F.sum("unseen"), F.lit(0))).first()[0]
    warnings = splits.preflight_warnings(summary, leaks, duplicates, unseen)
    print(json.dumps({"splits": summary, "warnings": warnings, **environment()}, default=str))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="celltrail")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, run, *required: str, output: bool = True) -> argparse.ArgumentParser:
        v = verbs.add_parser(name)
        v.set_defaults(run=run)
        for r in ("input", *required, *(("output",) if output else ())):
            v.add_argument(f"--{r}", required=True)
        return v

    v = verb("build-dataset", build_dataset)
    v.add_argument("--examples", type=int, default=16)
    v.add_argument("--min-markers", type=int, default=3)
    v.add_argument("--max-markers", type=int, default=8)
    v.add_argument("--seed", type=int, default=13)
    v.add_argument("--form", choices=["chat", "instruction"], default="chat")
    v = verb("normalize-markers", normalize_markers)
    for name in ("--delimiter", "--source-name", "--species"):
        v.add_argument(name)
    v.add_argument("--min-markers", type=int, default=1)
    v = verbs.add_parser("merge-marker-dbs")
    v.set_defaults(run=merge_marker_dbs)
    v.add_argument("--input", nargs="+", required=True)
    v.add_argument("--output", required=True)
    v.add_argument("--min-markers", type=int, default=1)
    verb("validate-marker-db", validate_marker_db, output=False)
    verb("build-ontology-map", build_ontology_map).add_argument("--ambiguous")
    verb("map-marker-db-ontology", map_marker_db, "map").add_argument("--overwrite", action="store_true")
    verb("propose-ontology-curation", propose_curation, "map").add_argument("--suggestions", type=int, default=5)
    verb("auto-accept-ontology-curation", auto_accept).add_argument("--min-score", type=float, default=0.8)
    v = verb("accept-ontology-suggestion", accept, "cell-type")
    v.add_argument("--rank", type=int)
    for name in ("--cl-id", "--label", "--notes"):
        v.add_argument(name)
    verb("accept-ontology-decisions", accept_decisions, "decisions").add_argument("--skip-missing", action="store_true")
    verb("prioritize-ontology-curation", prioritize, "splits")
    verb("apply-ontology-curation", apply_curation, "curation").add_argument("--overwrite", action="store_true")
    for name in ("split", "split-grouped", "split-stratified"):
        v = verb(name, split)
        v.add_argument("--train", type=float, default=0.8)
        v.add_argument("--validation", type=float, default=0.1)
        v.add_argument("--seed", type=int, default=13)
        v.add_argument("--group-by", nargs="+", required=name == "split-grouped")
        v.add_argument("--stratify-by", required=name == "split-stratified")
    v = verb("perturb-markers", perturb, "marker-db")
    v.add_argument("--drop-rate", type=float, default=0.5)
    v.add_argument("--add-noise", type=int, default=3)
    v.add_argument("--min-markers", type=int, default=1)
    v.add_argument("--seed", type=int, default=23)
    v = verbs.add_parser("annotate")
    v.set_defaults(run=annotate)
    for name in ("--tissue", "--markers", "--marker-db"):
        v.add_argument(name, required=True)
    verb("benchmark-marker-overlap", benchmark, "marker-db").set_defaults(method="overlap")
    verb("benchmark-sctype-style", benchmark, "marker-db").set_defaults(method="signed")
    for name in ("benchmark-prompt", "benchmark-lora", "benchmark-lora-rerank"):
        v = verb(name, benchmark_model)
        v.add_argument("--model", required=True, help="module:function that makes a function from prompts to answers")
        v.add_argument("--marker-db", required=name.endswith("rerank"))
        v.add_argument("--top-k", type=int, default=5)
    for name in ("download-panglaodb-markers", "download-cell-ontology"):
        verb(name, download)
    verb("sync-prediction-gold-ontology", sync_gold, "gold").add_argument("--allow-mismatch", action="store_true")
    for name, run in (("extract-markers", extract_markers), ("prepare-matrix-benchmark", prepare_matrix)):
        v = verb(name, run, "obs")
        v.add_argument("--cluster", default="cluster")
        v.add_argument("--top", type=int, default=25)
        v.add_argument("--method", choices=["wilcoxon", "t-test"], default="wilcoxon")
        v.add_argument("--min-genes", type=int, default=0)
        v.add_argument("--min-cells", type=int, default=0)
    verb("evaluate", evaluate, output=False).add_argument("--bins", type=int, default=10)
    v = verb("analyze-predictions", analyze, output=False)
    v.add_argument("--output")
    v.add_argument("--examples", type=int, default=25)
    v = verb("analyze-rerank-predictions", analyze_rerank, output=False)
    v.add_argument("--harmed")
    v.add_argument("--examples", type=int, default=25)
    verb("map-prediction-ontology", map_predictions, "marker-db").add_argument("--overwrite", action="store_true")
    verb("harmonize-prediction-labels", harmonize, "map").add_argument("--marker-db")
    verb("reparse-predictions", reparse_predictions)
    v = verbs.add_parser("summarize-experiments")
    v.set_defaults(run=summarize)
    v.add_argument("--input", nargs="+", required=True, help="name=path")
    v.add_argument("--preflight", nargs="+", help="name=path")
    v.add_argument("--output", required=True)
    v = verb("preflight-finetune", preflight, output=False)
    v.add_argument("--group-by", nargs="+")
    v.add_argument("--max-length", type=int, default=2048)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(local_session(), args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
