"""Writers: marker tables, training records, predictions, splits and small reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marker_rows(records: DataFrame) -> DataFrame:
    """Marker records as text cells in the standard columns; nulls are empty."""
    text = ["tissue", "cell_type", "cell_ontology_id"]
    return records.select(
        *[F.coalesce(c, F.lit("")).alias(c) for c in text],
        F.array_join("markers", ", ").alias("markers"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("source", "evidence")],
    )


def write_marker_records(records: DataFrame, path: str, one_file: bool = False) -> None:
    """The standard marker table as CSV. ``one_file`` is for small tables that people read."""
    rows = marker_rows(records)
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_jsonl(rows: DataFrame, path: str) -> None:
    """JSON lines, null fields kept."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_splits(rows: DataFrame, path: str, manifest: dict | None = None) -> None:
    """JSON lines in a folder for each split, and the manifest beside them."""
    rows.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(path)
    if manifest is not None:
        text = rows.sparkSession.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}_manifest")


def write_report(rows: DataFrame, path: str) -> None:
    """A small table in one CSV file."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True)


def format_value(value: object) -> str:
    """None as NA, floats to four decimals, lists joined with ``; `` or none."""
    if value is None:
        return "NA"
    if isinstance(value, float):
        return f"{value:.4f}"
    if isinstance(value, (list, tuple)):
        return "; ".join(map(str, value)) or "none"
    return str(value)


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """Rows of a small collected result as a Markdown table."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    lines += ["| " + " | ".join(format_value(r.get(c)).replace("|", "\\|") for c in columns) + " |" for r in rows]
    return "\n".join(lines)


def preflight_rows(reports: dict[str, str]) -> list[dict]:
    """A row for each named preflight report (a JSON file): records, coverage, longest text and warnings."""
    out = []
    for name, path in reports.items():
        told = json.loads(Path(path).read_text(encoding="utf-8"))
        total = next((r for r in told.get("splits", []) if r.get("split") == "total"), {})
        out.append({"name": name, **{c: total.get(c) for c in ("records", "labels", "cl_coverage", "max_length")}, "warnings": told.get("warnings", [])})
    return out


def coordinate_text(entries: DataFrame, rows: int, columns: int, count: int) -> DataFrame:
    """Matrix entries (``row``, ``column``, ``value``) as MatrixMarket lines.

    The header is the first partition, so the first of the files that are
    written; entries stay in theirs, unsorted, as the format allows.
    """
    head = entries.sparkSession.createDataFrame(
        [(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{rows} {columns} {count}")], "at int, value string"
    )
    body = entries.select(F.lit(2).alias("at"), F.concat_ws(" ", "row", "column", F.col("value").cast("string")).alias("value"))
    return head.coalesce(1).sortWithinPartitions("at").unionByName(body).select("value")
