"""Schemas that drift between files.

Fields are profiled per file by JSON type, by the shapes of their values and by
a sketch of the words they hold. Between a file and the one before it in its
feed, fields that went are matched with fields that came by a bipartite
assignment of greatest similarity of profiles and names: those are renames. The
rest are additions and removals; fields with one name whose type changed are
retyped. Chains of renames give every field a column of one common table.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from celltrail.session import ROWS_PER_TASK, cut_lineage, salted_join

#: Words kept of a field in a file: those with the smallest hashes.
SKETCH = 128
#: Similarity above which a field that came is one that went.
SAME = 0.5

def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


# Texts that stand for yes or no.
_FLAGS = {"true", "false", "yes", "no", "y", "n", "0", "1"}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_ID = re.compile(r"cl[:_]?(\d+)\Z", re.I)
_REAL = re.compile(r"[+-]?\d*\.\d+(?:e[+-]?\d+)?\Z", re.I)
_WHOLE = re.compile(r"[+-]?\d{1,3}(?:,\d{3})+\Z|[+-]?\d+\Z")
_CODE = re.compile(r"[^\W\d_](?:[^\W_]|[.\-])*\d(?:[^\W_]|[.\-])*\Z")
_WORD = re.compile(r"[^\W_]+")


@lru_cache(maxsize=100_000)
def shape(text: str) -> str:
    """What kind of sign string a value is."""
    if text.lower() in _FLAGS:
        return "flag"
    if _DATE.match(text):
        return "date"
    if found := _ID.match(text):
        return f"digits{len(found[1])}"
    if _REAL.match(text):
        return "real"
    if _WHOLE.match(text):
        digits = sum(c.isdigit() for c in text)
        return "count" if digits <= 5 else f"digits{digits}"
    return "symbol" if _CODE.match(text) else "words"


def json_type(value: object) -> str | None:
    """The JSON type of a parsed value; None of null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    return {str: "string", list: "array"}.get(type(value), "object")


class FieldProfile:
    """Counts of types and shapes, and of the words with the smallest hashes."""

    def __init__(self) -> None:
        self.types: Counter = Counter()
        self.shapes: Counter = Counter()
        self.words: Counter = Counter()
        self.bound = 1 << 32

    def add(self, value: object) -> None:
        kind = json_type(value)
        if kind is None:
            return
        self.types[kind] += 1
        if kind == "array":
            parts = [str(v).strip() for v in value]
        else:
            text = json.dumps(value) if kind in ("object", "boolean") else str(value)
            parts = [x.strip() for x in text.split(";")]
        how = "list" if len(parts) > 1 else "one"
        for part in parts:
            if part:
                what = shape(part)
                self.shapes[f"{how}:{what}"] += 1
                if what == "words":
                    for word in set(_WORD.findall(part.lower())):
                        if crc32(word.encode()) < self.bound:
                            self.words[word] += 1
        if len(self.words) > 4 * SKETCH:
            self.cut()

    def cut(self) -> None:
        """Only the words with the smallest hashes; what is dropped can't come back, so counts stay whole."""
        if len(self.words) > SKETCH:
            kept = sorted(self.words, key=lambda w: (crc32(w.encode()), w))[:SKETCH]
            self.words = Counter({w: self.words[w] for w in kept})
            self.bound = crc32(kept[-1].encode()) + 1

    def row(self) -> tuple:
        self.cut()
        return tuple([{"name": k, "count": n} for k, n in c.items()] for c in (self.types, self.shapes, self.words))


_COUNTS = "array<struct<name:string,count:bigint>>"
_PROFILE = f"feed string, file_no int, salt int, field string, types {_COUNTS}, shapes {_COUNTS}, words {_COUNTS}"


def _profile_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Profiles of files whose rows come one after another."""
    names = ["feed", "file_no", "salt", "field", "types", "shapes", "words"]
    now, fields, out = None, {}, []
    for frame in frames:
        for feed, file_no, salt, payload in zip(frame["feed"], frame["file_no"], frame["salt"], frame["payload"], strict=True):
            if (feed, file_no, salt) != now:
                out += [(*now, name, *p.row()) for name, p in fields.items()]
                now, fields = (feed, file_no, salt), {}
            try:
                parsed = json.loads(payload) if payload else None
            except ValueError:
                parsed = None
            if isinstance(parsed, dict):
                for name, value in parsed.items():
                    if name not in fields:
                        fields[name] = FieldProfile()
                    fields[name].add(value)
        if len(out) > 2000:
            yield pd.DataFrame(out, columns=names)
            out = []
    out += [(*now, name, *p.row()) for name, p in fields.items()]
    yield pd.DataFrame(out, columns=names)


def profiles(records: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(``feed``, ``file_no``, ``field``, ``types``, ``shapes``, ``words``): counts as arrays of (name, count).

    The rows of a file meet once, those of a file with more than
    ``rows_per_task`` rows in several tasks whose profiles are then merged. All
    rows are read; only the list of words is a sketch. Payloads that are no
    JSON objects have no fields; a field that is null is there, without type.
    """
    rows = records.select("feed", "file_no", "payload", "row_id")
    counts = rows.groupBy("feed", "file_no").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_task)
    hot = cut_lineage(counts.select("feed", "file_no", F.ceil(F.col("n") / F.lit(rows_per_task)).cast("int").alias("salts")))
    some = not hot.isEmpty()
    if some:
        salted = rows.join(hot, ["feed", "file_no"], "left")
        rows = salted.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row_id", "payload"), F.col("salts")).cast("int"), F.lit(0)))
    else:
        rows = rows.withColumn("salt", F.lit(0))
    keys = ["feed", "file_no", "salt"]
    met = rows.select(*keys, "payload").repartition(*keys).sortWithinPartitions(*keys)
    found = met.mapInPandas(_profile_rows, _PROFILE)
    if not some:
        return found.drop("salt")
    whole = cut_lineage(found)
    cold = whole.join(hot, ["feed", "file_no"], "left_anti").drop("salt")
    parts = whole.join(hot.drop("salts"), ["feed", "file_no"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = FieldProfile()
        # At most as many rows as the file has salts. The part with the smallest bound keeps SKETCH words below it, so
        # the SKETCH smallest of all are below every part's bound and counted whole.
        for r in frame.itertuples():
            for into, cell in ((total.types, r.types), (total.shapes, r.shapes), (total.words, r.words)):
                into.update({x["name"]: int(x["count"]) for x in cell})
        return pd.DataFrame([(*key, *total.row())], columns=["feed", "file_no", "field", "types", "shapes", "words"])

    schema = _PROFILE.replace("salt int, ", "")
    return cold.unionByName(parts.groupBy("feed", "file_no", "field").applyInPandas(merge, schema))


def name_profiles(found: DataFrame) -> DataFrame:
    """(``field``, ``all_shapes``, ``all_words``): what fields of a name hold in all files; the same sketch."""
    def summed(column: str) -> DataFrame:
        flat = found.select("field", F.explode(column).alias("x")).groupBy("field", F.col("x.name").alias("name"))
        return flat.agg(F.sum("x.count").alias("count"))

    both = F.struct("name", "count")
    shapes = summed("shapes").groupBy("field").agg(F.collect_list(both).alias("all_shapes"))
    first = Window.partitionBy("field").orderBy(F.crc32(F.encode("name", "utf-8")), "name")
    words = summed("words").withColumn("place", F.row_number().over(first)).where(F.col("place") <= SKETCH)
    return shapes.join(words.groupBy("field").agg(F.collect_list(both).alias("all_words")), "field", "left")


def _cosine(a: dict[str, float], b: dict[str, float]) -> float:
    dot = sum(v * b[k] for k, v in a.items() if k in b)
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if dot else 0.0


def _pairs(names: list[str]) -> Counter:
    count: Counter = Counter()
    for name in names:
        padded = f" {plain_name(name)} "
        count.update(padded[i : i + 2] for i in range(len(padded) - 1))
    return count


def _as_counts(cell) -> dict[str, float]:
    return {} if cell is None else {x["name"]: float(x["count"]) for x in cell if x}


def _likeness(old: dict, new: dict, shapes: str, words: str) -> float | None:
    """How far two profiles agree: in shapes and, as far as values are words, in words. None without values."""
    if not old[shapes] or not new[shapes]:
        return None
    worded = sum(v for k, v in new[shapes].items() if k.endswith("words")) / sum(new[shapes].values())
    common = _cosine(old[words], new[words])
    return _cosine(old[shapes], new[shapes]) * ((1 - worded) + worded * min(1.0, 0.15 + 1.4 * common))


def similarity(old: dict, new: dict) -> float:
    """How far two fields may be one, from 0 to 1.

    What the two files hold counts, or what fields of these names hold in all
    files. A name that is spelled alike adds.
    """
    here = _likeness(old, new, "shapes", "words")
    everywhere = _likeness(old, new, "all_shapes", "all_words")
    base = 0.3 if here is None else here  # no values to compare
    if everywhere is not None:
        base = max(base, 0.95 * everywhere if here is None or here > 0.1 else 0.0)
    spelled = _cosine(_pairs([old["field"]]), _pairs([new["field"]]))
    return max(0.0, min(1.0, 0.85 * base + 0.25 * spelled))


def assign(weights: list[list[float]]) -> list[int]:
    """For each row the column given to it, of greatest total weight; the matrix may have any shape.

    Shortest augmenting paths with potentials (Hungarian method).
    """
    rows, columns = len(weights), len(weights[0]) if weights else 0
    n = max(rows, columns)
    cost = [[-weights[i][j] if i < rows and j < columns else 0.0 for j in range(n)] for i in range(n)]
    u, v, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], at = i, 0
        least, way, done = [math.inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while match[at]:
            done[at] = True
            row, delta, to = match[at], math.inf, 0
            for j in range(1, n + 1):
                if not done[j]:
                    slack = cost[row - 1][j - 1] - u[row] - v[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, at
                    if least[j] < delta:
                        delta, to = least[j], j
            for j in range(n + 1):
                if done[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            at = to
        while at:
            match[at] = match[way[at]]
            at = way[at]
    out = [-1] * rows
    for j in range(1, columns + 1):
        if match[j] <= rows and match[j]:
            out[match[j] - 1] = j - 1
    return out


def match_fields(gone: list[dict], come: list[dict]) -> list[tuple[str, str, str, float]]:
    """(change, old field, new field, score) of the profiles of fields that went and came."""
    gone, come = (sorted(side, key=lambda p: p["field"]) for side in (gone, come))
    out, taken = [], set()
    if gone and come:
        score = [[similarity(g, c) for c in come] for g in gone]
        kept = [[s if s >= SAME else 0.0 for s in row] for row in score]
        for i, j in enumerate(assign(kept)):
            if j >= 0 and kept[i][j]:
                out.append(("renamed", gone[i]["field"], come[j]["field"], score[i][j]))
                taken.update((("old", i), ("new", j)))
    out += [("removed", g["field"], "", 0.0) for i, g in enumerate(gone) if ("old", i) not in taken]
    out += [("added", "", c["field"], 0.0) for j, c in enumerate(come) if ("new", j) not in taken]
    return out


def _main_type() -> Column:
    """The type of most non-null values; of equals the first by name."""
    ranked = F.array_sort(F.transform("types", lambda t: F.struct((-t["count"]).alias("n"), t["name"].alias("name"))))
    return F.get(ranked, 0)["name"]


def _match_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Changes of pairs of files whose fields come one after another."""
    names = ["feed", "file_no", "change", "old_field", "new_field", "score"]
    columns = ("shapes", "words", "all_shapes", "all_words")
    now, sides, out = None, {"old": [], "new": []}, []
    for frame in frames:
        for r in frame.itertuples():
            if (r.feed, r.pair) != now:
                out += [(*now, *c) for c in match_fields(sides["old"], sides["new"])] if now else []
                now, sides = (r.feed, r.pair), {"old": [], "new": []}
            sides[r.side].append({"field": r.field} | {c: _as_counts(getattr(r, c)) for c in columns})
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    out += [(*now, *c) for c in match_fields(sides["old"], sides["new"])] if now else []
    yield pd.DataFrame(out, columns=names)


def schema_changes(records: DataFrame, rows_per_task: int = ROWS_PER_TASK, found: DataFrame | None = None) -> DataFrame:
    """(``feed``, ``file_id``, ``file_no``, ``change``, ``old_field``, ``new_field``, ``score``).

    Changes of each file from the file of the feed before it by ``file_no``,
    whenever it arrived. A field is in a file if any row has it, null or not; a
    field without values in one of two files is not retyped. Rows that are no
    JSON objects have no fields; a file of none but such rows has lost them all.
    ``found`` are the profiles if they are there already.
    """
    files = records.groupBy("feed", "file_no").agg(F.min("file_id").alias("file_id"))
    order = Window.partitionBy("feed").orderBy("file_no")
    files = cut_lineage(files.select("*", F.lag("file_no").over(order).alias("before"), F.lead("file_no").over(order).alias("after")))
    found = cut_lineage(profiles(records, rows_per_task)) if found is None else found
    here = found.join(files.select("feed", "file_no", "before", "after"), ["feed", "file_no"])
    old = here.where("after is not null").select("feed", F.col("after").alias("pair"), "field", "shapes", "words", _main_type().alias("was"))
    new = here.where("before is not null").select("feed", F.col("file_no").alias("pair"), "field", "shapes", "words", _main_type().alias("now"))
    both = old.select("feed", "pair", "field", "was").join(new.select("feed", "pair", "field", "now"), ["feed", "pair", "field"])
    retyped = both.where("was != now").select(
        "feed", F.col("pair").alias("file_no"), F.lit("retyped").alias("change"), F.col("field").alias("old_field"),
        F.col("field").alias("new_field"), F.lit(1.0).alias("score"),
    )
    at = ["feed", "pair", "field"]
    gone = old.join(new.select(*at), at, "left_anti").select(*at, "shapes", "words", F.lit("old").alias("side"))
    come = new.join(old.select(*at), at, "left_anti").select(*at, "shapes", "words", F.lit("new").alias("side"))
    moved = gone.unionByName(come).join(name_profiles(found), "field", "left")
    matched = moved.repartition("feed", "pair").sortWithinPartitions("feed", "pair").mapInPandas(
        _match_rows, "feed string, file_no int, change string, old_field string, new_field string, score double"
    )
    changes = retyped.unionByName(matched)
    return changes.join(files.select("feed", "file_no", "file_id"), ["feed", "file_no"]).select(
        "feed", "file_id", "file_no", "change", "old_field", "new_field", "score"
    )


#: Columns of the common table, and the configuration's columns that name them.
COLUMNS = {"marker": "marker_column", "cell_type": "cell_type_column", "cl_id": "cl_id_column", "tissue": "tissue_column", "species": "species_column"}


def told_names(configs: DataFrame) -> DataFrame:
    """(``plain``, ``told``): the column that most feeds' configurations mean by a name, whatever its case and signs."""
    pairs = F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.lit(m).alias("told")) for m, c in COLUMNS.items()]))
    named = configs.select(pairs.alias("x")).select(_plain("x.name").alias("plain"), "x.told").where("plain != ''")
    counted = named.groupBy("plain", "told").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("plain").agg(F.min_by("told", F.struct(-F.col("n"), F.col("told"))).alias("told"))


def _plain(column: str) -> Column:
    return F.regexp_replace(F.lower(column), "[^a-z0-9]+", "")


def field_lineage(fields: DataFrame, changes: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """(``feed``, ``file_no``, ``field``, ``column``): the common column of each field of each file.

    ``fields`` are (``feed``, ``file_no``, ``field``), as profiles have them.
    Renames are followed through a feed's files in order. The column is the one
    that the feed's configuration gives to any name the field ever had, else
    the one that other feeds' configurations give to such a name, else its first
    name. A feed's files are one small row a field, followed in one task.
    """
    renames = changes.where("change = 'renamed'").select(
        "feed", "file_no", F.col("new_field").alias("field"), F.col("old_field")
    )
    found = fields.select("feed", "file_no", "field").join(renames, ["feed", "file_no", "field"], "left").withColumn("plain", _plain("field"))
    meanings = COLUMNS
    if configs is not None:
        said = configs.select("feed", *[F.col(c).alias(f"_{m}") for m, c in meanings.items()]).dropDuplicates(["feed"])
        found = found.join(said, "feed", "left").join(told_names(configs), "plain", "left")
    else:
        found = found.select("*", *[F.lit(None).cast("string").alias(x) for x in (*(f"_{m}" for m in meanings), "told")])

    def follow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        said = {frame[f"_{m}"].iloc[0]: m for m in meanings if isinstance(frame[f"_{m}"].iloc[0], str)}
        current: dict[str, int] = {}
        names: list[list[str]] = []
        told = {f: t for f, t in zip(frame["field"], frame["told"], strict=True) if isinstance(t, str)}
        out = []
        for file_no, rows in frame.sort_values(["file_no", "field"]).groupby("file_no"):
            now = {}
            for r in rows.itertuples():
                chain = current.get(r.old_field if isinstance(r.old_field, str) else r.field)
                if chain is None:
                    # A field that comes back under a name it had takes up its chain.
                    chain = next((i for i, n in enumerate(names) if r.field in n and i not in current.values()), None)
                if chain is None:
                    chain = len(names)
                    names.append([])
                if r.field not in names[chain]:
                    names[chain].append(r.field)
                now[r.field] = chain
                out.append((file_no, r.field, chain))
            current = now
        column = []
        for n in names:
            meant = next((said[x] for x in n if x in said), None) or next((told[x] for x in n if x in told), None)
            column.append(meant or n[0])
        rows = [(key[0], int(no), field, column[chain]) for no, field, chain in out]
        return pd.DataFrame(rows, columns=["feed", "file_no", "field", "column"])

    return found.groupBy("feed").applyInPandas(follow, "feed string, file_no int, field string, column string")


def unified_records(records: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """All rows in one table: marker, cell type, ontology id, tissue, species, and the rest as a map.

    Values are text; members of an array are joined with ``; ``. Two fields of a
    row that mean one column are joined likewise. Payloads that are no JSON
    object keep their row, with null columns and the text in ``unread``.
    """
    found = cut_lineage(profiles(records))
    lineage = cut_lineage(field_lineage(found, schema_changes(records, found=found), configs))
    of_file = lineage.groupBy("feed", "file_no").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("_columns")
    ).withColumn("_file", F.xxhash64("feed", "file_no")).drop("feed", "file_no")
    parsed = F.from_json("payload", "map<string,string>")
    rows = records.withColumn("_file", F.xxhash64("feed", "file_no"))
    joined = salted_join(rows, of_file, "_file").withColumn("_values", parsed)
    clean = F.transform_values(
        "_values",
        lambda k, v: F.when(v.rlike(r"^\s*\["), F.array_join(F.from_json(v, "array<string>"), "; ")).otherwise(v),
    )
    entries = F.transform(
        F.filter(F.map_entries(clean), lambda e: e["value"].isNotNull()),
        lambda e: F.struct(F.coalesce(F.element_at("_columns", e["key"]), e["key"]).alias("c"), e["value"].alias("v")),
    )
    joined = joined.withColumn("_entries", entries)

    def of(name: str) -> Column:
        return F.nullif(F.array_join(F.transform(F.filter("_entries", lambda e: e["c"] == name), lambda e: e["v"]), "; "), F.lit(""))

    main = ["marker", "cell_type", "cl_id", "tissue", "species"]
    rest = F.array_sort(F.transform(F.filter("_entries", lambda e: ~e["c"].isin(main)), lambda e: F.concat(e["c"], F.lit("="), e["v"])))
    cl_id = F.regexp_replace(F.upper(of("cl_id")), "_", ":")
    return joined.select(
        "row_id", "feed", "file_id", "file_no", "row_no",
        of("marker").alias("marker"), of("cell_type").alias("cell_type"),
        F.when(cl_id.rlike(r"^\d+$"), F.concat(F.lit("CL:"), F.lpad(cl_id, 7, "0"))).otherwise(cl_id).alias("cl_id"),
        of("tissue").alias("tissue"), of("species").alias("species"),
        rest.alias("other"), F.when(F.col("_values").isNull(), F.col("payload")).alias("unread"),
    )
