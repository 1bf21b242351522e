"""Readers of marker tables, training records, predictions, label maps, ontologies and matrices."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from celltrail.functions.text import norm_cl_id, norm_gene_list, norm_tissue, strip
from celltrail.session import quoted

# Header spellings that marker files use.
RECORD_ALIASES = {
    "tissue": ("tissue", "organ", "dataset_tissue"),
    "cell_type": ("cell_type", "celltype", "label", "annotation"),
    "markers": ("markers", "positive_markers", "cluster_markers", "marker_genes"),
    "cell_ontology_id": ("cell_ontology_id", "cl_id", "ontology_id", "cellontology_id"),
    "source": ("source", "database", "reference"),
    "evidence": ("evidence", "description", "note"),
}
TABLE_ALIASES = {
    "tissue": ("tissue", "tissuetype", "tissuename", "organ", "organname", "datasettissue", "uberonlabel"),
    "cell_type": ("celltype", "cellname", "cell", "annotation", "cellannotation", "celltypeannotation"),
    "cell_ontology_id": ("cellontologyid", "clid", "ontologyid"),
    "marker": ("marker", "cellmarker", "gene", "genesymbol", "officialgenesymbol", "markergene"),
    "markers": ("markers", "markergenes", "positivemarkers", "clustermarkers"),
    "source": ("source", "database", "resource", "reference"),
    "evidence": ("evidence", "description", "note", "pmid", "pubmedid", "publication", "reference"),
    "species": ("species", "specie", "speciestype", "organism"),
}

MESSAGES = "messages array<struct<role:string,content:string>>"
METADATA = (
    "metadata struct<tissue:string,cell_type:string,cell_ontology_id:string,markers:array<string>,source:string,"
    "augmentation_index:int,original_markers:array<string>,perturbation:struct<drop_rate:double,add_noise_markers:int,"
    "dropped_markers:int,added_markers:array<string>>>"
)
TRAINING_SCHEMA = f"{MESSAGES}, instruction string, input string, output string, {METADATA}"
CANDIDATES = (
    "candidates array<struct<rank:int,cell_type:string,cell_ontology_id:string,marker_score:double,"
    "overlap:array<string>,record_markers:array<string>>>"
)
PREDICTION_SCHEMA = (
    "tissue string, markers array<string>, y_true string, y_pred string, true_cl_id string, pred_cl_id string, "
    "confidence double, runtime_seconds double, cost_usd double, reasoning string, raw_response string, "
    f"selection_source string, {CANDIDATES}"
)


def plain_header(name: str) -> str:
    """A header in lower case without anything but letters and digits."""
    return re.sub(r"[^a-z0-9]+", "", name.strip().lower())


def resolve_column(headers: list[str], meaning: str, explicit: str | None = None) -> str | None:
    """The header of a meaning: the one named (which must be there), else the first alias found."""
    by_plain = {plain_header(h): h for h in headers}
    if explicit:
        if plain_header(explicit) not in by_plain:
            raise ValueError(f"no column {explicit}; there are {', '.join(headers)}")
        return by_plain[plain_header(explicit)]
    return next((by_plain[a] for a in TABLE_ALIASES[meaning] if a in by_plain), None)


def sniff_delimiter(spark: SparkSession, path: str, explicit: str | None = None) -> str:
    """The delimiter of a text file: as told, by ending, or from its first 4,096 characters."""
    if explicit:
        return "\t" if explicit.lower() in ("tab", "\\t") else explicit
    if re.search(r"\.(tsv|tab|txt)(\.gz)?$", path, re.I):
        return "\t"
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(40).collect())[:4096]
    try:
        return csv.Sniffer().sniff(head, delimiters=",\t;").delimiter
    except csv.Error:
        return ","


def with_row_order(df: DataFrame, name: str = "rec_id") -> DataFrame:
    """Rows numbered by file and place; ids rise within a file, with gaps between partitions."""
    return df.withColumn(name, F.monotonically_increasing_id())


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Rows with their number from 0 in the order of ``with_row_order``, without sorting all in one task."""
    parts = rows.withColumn("_part", F.shiftright(F.col(order), 33)).withColumn("_at", F.col(order).bitwiseAND((1 << 33) - 1))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    placed = parts.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_rank") + F.col("_before")).drop("_part", "_at", "_rank", "_before")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, multi_line: bool = True) -> DataFrame:
    """A delimited file with headers, all text; blank cells are null, cells are stripped of blanks of any kind.

    No header is an error, and so is a row with more cells than the header has;
    missing cells are null. Without ``multi_line`` large files are split, but
    then no cell may hold a line break.
    """
    sep = sniff_delimiter(spark, path, delimiter)
    reader = spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8", ignoreLeadingWhiteSpace=False)
    names = [c.lstrip("\ufeff") for c in reader.csv(path).columns]
    if not names:
        raise ValueError(f"{path} has no header")
    # A cell beyond the header shows in a column of its own; blank, it only makes the row as long as the columns.
    columns = [T.StructField(f"_c{i}", T.StringType()) for i in range(len(names) + 1)]
    schema = T.StructType([*columns, T.StructField("_short", T.StringType())])
    rows = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord="_short", enforceSchema=True).schema(schema).csv(path)
    surplus = F.col(f"_c{len(names)}").isNotNull() | F.col("_short").isNull()
    message = F.concat(F.lit(f"{path}: more cells than headers in the row that begins with "), F.coalesce("_c0", F.lit("an empty cell")))
    first = F.when(surplus, F.raise_error(message)).otherwise(F.col("_c0"))
    cells = [first, *[F.col(f"_c{i}") for i in range(1, len(names))]]
    return rows.select(*[F.nullif(strip(c), F.lit("")).alias(n) for c, n in zip(cells, names, strict=True)])


def _first_present(columns: list[str], names: tuple[str, ...]) -> Column:
    """The first of some columns, by any case, that isn't empty."""
    there = {c.lower(): c for c in columns}
    found = [F.nullif(quoted(there[n]), F.lit("")) for n in names if n in there]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_marker_records(spark: SparkSession, path: str) -> DataFrame:
    """A marker file as records; columns without a meaning go to ``metadata``.

    A row without tissue, cell type or markers fails the load with its place,
    as does a row with more cells than the header.
    """
    df = with_row_order(read_delimited(spark, path, ","))
    text = [c for c in df.columns if c != "rec_id"]
    known = {a for names in RECORD_ALIASES.values() for a in names}
    rest = [c for c in text if c.lower() not in known]
    of = {meaning: _first_present(text, names) for meaning, names in RECORD_ALIASES.items()}

    def needed(meaning: str) -> Column:
        place = F.concat(F.lit(f"{path}: no {meaning} in row "), F.col("rec_id").cast("string"))
        return F.when(of[meaning].isNull(), F.raise_error(place)).otherwise(of[meaning])

    pairs = [x for c in rest for x in (F.lit(c), quoted(c))]
    metadata = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return df.select(
        "rec_id", norm_tissue(needed("tissue")).alias("tissue"), needed("cell_type").alias("cell_type"),
        norm_cl_id(of["cell_ontology_id"]).alias("cell_ontology_id"), norm_gene_list(needed("markers")).alias("markers"),
        of["source"].alias("source"), of["evidence"].alias("evidence"), metadata.alias("metadata"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str = TRAINING_SCHEMA) -> DataFrame:
    """JSON lines of a schema; blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction records in file order; ``y_true`` and ``y_pred`` must be there, their nulls are the word None."""
    lines = with_row_order(spark.read.text(path).where("trim(value) != ''"))
    keys = F.json_object_keys("value")
    lacking = ~(F.array_contains(keys, "y_true") & F.array_contains(keys, "y_pred"))
    parsed = F.from_json("value", PREDICTION_SCHEMA, {"mode": "FAILFAST"})
    checked = F.when(F.coalesce(lacking, F.lit(True)), F.raise_error(F.lit("a prediction lacks y_true or y_pred"))).otherwise(parsed)
    rows = lines.select("rec_id", checked.alias("p")).select("rec_id", "p.*")
    return rows.withColumns({c: F.coalesce(c, F.lit("None")) for c in ("y_true", "y_pred")})


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """(``rec_id``, ``label``, ``normalized_label``, ``cl_id``) of a label map under any of its headers."""
    df = with_row_order(read_delimited(spark, path))
    text = [c for c in df.columns if c != "rec_id"]
    return df.select(
        "rec_id",
        _first_present(text, ("label", "cell_type", "name")).alias("label"),
        _first_present(text, ("normalized_label",)).alias("normalized_label"),
        _first_present(text, ("cl_id", "cell_ontology_id", "id")).alias("cl_id"),
    )


def parse_obo(stanzas: DataFrame, text: str = "value") -> DataFrame:
    """(``cl_id``, ``name``, ``synonyms``, ``is_obsolete``) of OBO stanzas, one text each.

    Only terms with a cell ontology id and a name; of a repeated line the last
    counts. Headers and other stanzas are passed over.
    """
    body = F.concat(F.lit("\n"), F.regexp_replace(F.col(text), "\r", ""), F.lit("\n"))
    kept = stanzas.select(body.alias("_b")).where(F.col("_b").rlike(r"(?m)^\s*\[?Term\]\s*$"))

    def last(tag: str) -> Column:
        return F.element_at(F.regexp_extract_all("_b", F.lit(rf"(?m)^[ \t]*{tag}:[ \t]*(.*?)[ \t]*$"), F.lit(1)), -1)

    synonym = r'(?m)^[ \t]*synonym:[ \t]*"((?:[^"\\]|\\.)*)"[ \t]+([A-Z]+)'
    texts, scopes = (F.regexp_extract_all("_b", F.lit(synonym), F.lit(i)) for i in (1, 2))
    pairs = F.transform(F.arrays_zip(texts.alias("text"), scopes.alias("scope")), lambda z: F.struct(z["text"].alias("text"), z["scope"].alias("scope")))
    some = kept.where(F.col("_b").rlike(r"(?m)^[ \t]*id:[ \t]*CL:") & F.col("_b").rlike(r"(?m)^[ \t]*name:[ \t]*\S"))
    return some.select(
        last("id").alias("cl_id"), last("name").alias("name"), pairs.alias("synonyms"),
        F.col("_b").rlike(r"(?m)^[ \t]*is_obsolete:[ \t]*true").alias("is_obsolete"),
    ).where("cl_id like 'CL:%'")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """An OBO file's terms; the file is split at stanzas, so its size doesn't matter."""
    return parse_obo(spark.read.text(path, lineSep="\n["))


def read_matrix_market(spark: SparkSession, matrix: str, genes: str, cells: str) -> DataFrame:
    """A MatrixMarket triple with its name files in long form; of repeated genes the first stays."""
    lines = spark.read.text(matrix).where("not value like '\\%%' and trim(value) != ''")
    parts = F.split(F.trim("value"), r"\s+")
    entries = with_row_order(lines.select(parts.alias("p")), "_at")
    first = entries.agg(F.min("_at").alias("_first"))  # the size line
    entries = entries.crossJoin(F.broadcast(first)).where("_at > _first")
    entries = entries.select(F.col("p")[0].cast("bigint").alias("i"), F.col("p")[1].cast("bigint").alias("j"), F.col("p")[2].cast("double").alias("value"))

    def names(path: str, index: str, name: str) -> DataFrame:
        rows = numbered(with_row_order(spark.read.text(path), "_row"), "_row")
        return rows.select((F.col("place") + 1).cast("bigint").alias(index), F.split("value", "\t")[0].alias(name))

    gene_names = names(genes, "i", "gene")
    keep = gene_names.groupBy("gene").agg(F.min("i").alias("i"))
    return entries.join(keep, "i").join(names(cells, "j", "cell_id"), "j").select("cell_id", "gene", "value")


def read_wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A genes by cells table (tab separated, perhaps compressed) in long form."""
    from celltrail.operators.matrix import unpivot_matrix

    wide = spark.read.csv(path, header=True, sep="\t")
    return unpivot_matrix(wide, wide.columns[0])


def field_column(schema: T.StructType, path: str) -> Column:
    """A dotted field path as a column: as it stands, else within metadata, else its last part; else an error."""
    def there(parts: list[str]) -> bool:
        at = schema
        for p in parts:
            if not isinstance(at, T.StructType) or p not in at.names:
                return False
            at = at[p].dataType
        return True

    for parts in (path.split("."), ["metadata", *path.split(".")], path.split(".")[-1:]):
        if there(parts):
            return F.col(".".join(f"`{p}`" for p in parts))
    raise ValueError(f"no field {path}")
