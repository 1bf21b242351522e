"""Training examples from marker records, and their perturbation.

All draws are hashes of (seed, record, index, marker), so they don't depend on
the order or the place of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from celltrail.functions.text import norm_label, uniform
from celltrail.operators.prompts import assistant_response, reasoning, user_prompt
from celltrail.operators.splits import number_rows
from celltrail.session import cut_lineage

CONFIDENCE = 0.9
#: Markers of a pool that every task may hold; of more, places are joined.
POOL = 2_000_000
#: Askers that may be broadcast.
FEW = 100_000
#: Places that a task tries at once.
CELLS = 4_000_000


def by_hash(markers: Column, *parts: Column | str | int) -> Column:
    """An array in the order of its members' hashes."""
    keyed = F.transform(markers, lambda m: F.struct(uniform(*parts, m).alias("u"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda x: x["m"])


def vocabulary(records: DataFrame) -> DataFrame:
    """(``marker``, ``place``): all markers of the database, numbered from 0 by name."""
    return number_rows(records.select(F.explode("markers").alias("marker")).distinct(), "marker")


def label_pairs(records: DataFrame) -> DataFrame:
    """(``label_key``, ``marker``): all markers of a label, whatever the record; some repeatedly."""
    return records.select(norm_label(F.col("cell_type")).alias("label_key"), F.explode("markers").alias("marker"))


def _prime_from(n: int) -> int:
    """The first prime number from ``n`` on."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def draw_markers(
    askers: DataFrame, pool: DataFrame, seed: int, barred: DataFrame | None = None, draws: int = 32
) -> DataFrame:
    """(``k``, ``drawn``): for each asker the markers of the pool that come first in an order of its own.

    ``askers``: ``k`` (text), ``own`` (markers it must not get), ``wanted`` (how
    many), ``label_key``. ``pool`` is a ``vocabulary``, ``barred`` are
    ``label_pairs`` that must not come. The order runs through all places of the
    pool by a step that depends on ``k``; places are read ``draws`` at first and
    more only by those that have too few. Every task holds a pool of up to
    ``POOL`` markers, places of a larger one are joined. Where the pool has less
    than wanted, all that fit come.
    """
    pool = cut_lineage(pool)
    size = pool.count()
    prime = _prime_from(size)
    if 0 < size <= POOL:
        return _drawn_from_held(askers, pool, prime, seed, barred, draws)
    start = F.floor(uniform(seed, F.col("k"), "start") * prime).cast("bigint")
    step = 1 + F.floor(uniform(seed, F.col("k"), "step") * (prime - 1)).cast("bigint")
    still = cut_lineage(askers.select("k", "own", "wanted", "label_key", start.alias("_a"), step.alias("_b")).where("wanted > 0"))
    found, low = None, 0
    while size and low < prime:
        high = min(prime, low + draws)
        tried = still.select("*", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("j"))
        tried = tried.withColumn("place", (F.col("_a") + F.col("j") * F.col("_b")) % prime).join(pool, "place")
        tried = tried.where(~F.array_contains(F.coalesce("own", F.array().cast("array<string>")), F.col("marker")))
        if barred is not None:
            tried = tried.join(barred, ["label_key", "marker"], "left_anti")
        new = cut_lineage(tried.select("k", "j", "marker"))
        found = new if found is None else found.unionByName(new)
        many = found.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
        still = cut_lineage(still.join(many, "k", "left").where(F.coalesce("_n", F.lit(0)) < F.col("wanted")).drop("_n"))
        if still.isEmpty():
            break
        low, draws = high, draws * 8
    if found is None:
        return askers.select("k", F.array().cast("array<string>").alias("drawn"))
    listed = found.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("j", "marker"))).alias("_l"))
    joined = askers.select("k", "wanted").join(listed, "k", "left")
    names = F.transform(F.coalesce("_l", F.array().cast("array<struct<j:int,marker:string>>")), lambda x: x["marker"])
    return joined.select("k", F.slice(names, F.lit(1), F.greatest("wanted", F.lit(0))).alias("drawn"))


def _offers(known, prime: int, high: int, spare: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each asker the first ``wanted`` and ``spare`` markers that it lacks among its first ``high`` places, and whether these are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place = known.value[0]
        order = np.argsort(by_place)
        codes = by_place[order]
        for whole in batches:
            for begin in range(0, whole.num_rows, max(1, CELLS // high)):
                batch = whole.slice(begin, max(1, CELLS // high))
                first, step, most = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_a", "_b", "wanted"))
                most = most + spare
                place = (first[:, None] + np.arange(high) * step[:, None]) % prime
                own, row = pc.list_flatten(batch["own"]).to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch["own"]).to_numpy(zero_copy_only=False))
                at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
                held = codes[at] == own
                fits = (place < len(codes)) & ~np.isin(place + np.arange(batch.num_rows)[:, None] * prime, order[at[held]] + row[held] * prime)
                nth = np.cumsum(fits, axis=1)
                every = (nth[:, -1] <= most) & (high == prime)
                fits &= nth <= most[:, None]
                ends = np.concatenate([[0], np.cumsum(fits.sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(by_place[place[fits]]))
                out = [batch["k"], batch["label_key"], batch["wanted"], lists, pa.array(every)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _named(known, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Markers instead of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place, names = known.value
        order = np.argsort(by_place)
        codes = by_place[order]
        for batch in batches:
            at = order[np.searchsorted(codes, pc.list_flatten(batch["codes"]).to_numpy(zero_copy_only=False))]
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(batch["codes"]).to_numpy(zero_copy_only=False))]).astype(np.int32)
            out = [batch["k"], pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(at)))]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _drawn_from_held(askers: DataFrame, pool: DataFrame, prime: int, seed: int, barred: DataFrame | None, draws: int) -> DataFrame:
    """``draw_markers`` from a pool that every task holds: only hashes of markers that may fit meet those that are barred."""
    spark = askers.sparkSession
    rows = pool.orderBy("place").select("marker", F.xxhash64("marker").alias("code")).toArrow()  # bounded
    known = spark.sparkContext.broadcast((rows["code"].to_numpy(), rows["marker"].combine_chunks()))
    none = F.array().cast("array<bigint>")
    start = F.floor(uniform(seed, F.col("k"), "start") * prime).cast("bigint")
    step = 1 + F.floor(uniform(seed, F.col("k"), "step") * (prime - 1)).cast("bigint")
    own = F.transform(F.filter(F.coalesce("own", F.array().cast("array<string>")), lambda m: m.isNotNull()), lambda m: F.xxhash64(m))
    still = askers.where("wanted > 0").select("k", own.alias("own"), F.col("wanted").cast("int").alias("wanted"), "label_key", start.alias("_a"), step.alias("_b"))
    lists = None
    if barred is not None:
        lists = cut_lineage(barred.groupBy("label_key").agg(F.collect_set(F.xxhash64("marker")).alias("_barred")))
    ddl, asked = "k string, label_key string, wanted int, codes array<bigint>, every boolean", still
    found, spare = None, 4
    while True:
        high = min(prime, draws)
        offered = asked.mapInArrow(_offers(known, prime, high, spare, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
        if lists is not None:
            offered = offered.join(lists, "label_key", "left").withColumn(
                "codes", F.filter("codes", lambda c: ~F.array_contains(F.coalesce("_barred", none), c))
            )
        offered = offered.select("k", "wanted", F.slice("codes", F.lit(1), F.col("wanted")).alias("codes"), "every")
        full = F.col("every") | (F.size("codes") >= F.col("wanted"))
        offered = cut_lineage(offered)
        new = offered.where(full).select("k", "codes")
        found = new if found is None else found.unionByName(new)
        lack = offered.where(~full).select("k").distinct()
        count = lack.count()
        if not count:
            break
        asked = still.join(F.broadcast(lack) if count <= FEW else lack, "k", "left_semi")
        draws, spare = draws * 8, spare * 8 if high < prime else prime
    names = "k string, drawn array<string>"
    drawn = found.mapInArrow(_named(known, to_arrow_schema(StructType.fromDDL(names))), names)
    rest = askers.where("coalesce(wanted, 0) <= 0").select("k", F.array().cast("array<string>").alias("drawn"))
    return drawn.unionByName(rest)


def generate_examples(
    records: DataFrame,
    examples_per_record: int = 16,
    min_markers: int = 3,
    max_markers: int = 8,
    noise_rate: float = 0.15,
    noise_markers: list[str] | None = None,
    seed: int = 13,
) -> DataFrame:
    """(``rec_id``, ``augmentation_index``, ``tissue``, ``cell_type``, ``markers``, ``prompt``, ``response``).

    Each example has a hash-drawn number of markers of its record, from
    ``min_markers`` to ``max_markers`` as far as the record has so many; at
    ``noise_rate`` one or two of ``noise_markers`` are added, or of all markers
    that the record lacks if none are given. Records without markers give none.
    """
    lines = records.where(F.size("markers") > 0).withColumn(
        "augmentation_index", F.explode(F.sequence(F.lit(0), F.lit(examples_per_record - 1)))
    )
    at = (F.lit(seed), F.col("rec_id"), F.col("augmentation_index"))
    high = F.least(F.lit(max_markers), F.size("markers"))
    low = F.least(F.lit(min_markers), high)
    k = low + F.floor(uniform(*at, "size") * (high - low + 1)).cast("int")
    chosen = F.slice(by_hash(F.col("markers"), *at), 1, k)
    noisy = uniform(*at, "noisy") < noise_rate
    if noise_rate > 0:
        if noise_markers:
            most, noise = (1 if len(noise_markers) < 3 else 2), by_hash(F.array(*[F.lit(m) for m in noise_markers]), *at, "noise")
            extra = F.lit(1) + F.floor(uniform(*at, "extra") * most).cast("int")
            noise = F.when(noisy, F.slice(noise, F.lit(1), extra))
        else:
            pool = vocabulary(records)
            extra = F.lit(1) + F.floor(uniform(*at, "extra") * 2).cast("int")
            key = F.concat_ws(":", F.col("rec_id").cast("string"), F.col("augmentation_index").cast("string"))
            lines = lines.withColumn("k", key)
            asked = lines.where(noisy).select("k", F.col("markers").alias("own"), extra.alias("wanted"), F.lit(None).cast("string").alias("label_key"))
            lines = lines.join(draw_markers(asked, pool, seed), "k", "left")
            noise = F.col("drawn")
        # Noise may repeat a marker only where it was given.
        chosen = F.concat(chosen, F.coalesce(noise, F.array().cast("array<string>")))
    chosen = by_hash(chosen, *at, "order")
    reason = reasoning(F.col("cell_type"), F.col("markers"), F.col("evidence"))
    return lines.withColumn("markers", chosen).select(
        "rec_id", "augmentation_index", "tissue", "cell_type", "cell_ontology_id", "source", "markers",
        user_prompt(F.col("tissue"), F.col("markers")).alias("prompt"),
        assistant_response(F.col("cell_type"), reason, F.col("cell_ontology_id"), F.lit(CONFIDENCE)).alias("response"),
    )


def distractors(examples: DataFrame, records: DataFrame, per_example: int, seed: int) -> DataFrame:
    """(``example_id``, ``added``): markers of the database that neither the example nor its label has."""
    asked = examples.select(
        F.col("example_id").cast("string").alias("k"), F.col("markers").alias("own"), F.lit(per_example).alias("wanted"),
        norm_label(F.col("cell_type")).alias("label_key"), "example_id",
    )
    drawn = draw_markers(asked, vocabulary(records), seed, label_pairs(records))
    kind = examples.schema["example_id"].dataType.simpleString()
    if kind in ("string", "int", "bigint"):
        return drawn.select(F.col("k").cast(kind).alias("example_id"), F.col("drawn").alias("added"))
    return asked.select("example_id", "k").join(drawn, "k").select("example_id", F.col("drawn").alias("added"))


def perturb_levels(
    examples: DataFrame, records: DataFrame, levels: tuple[tuple[float, int], ...], min_markers: int = 1, seed: int = 23, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``perturb_markers`` at several (drop rate, added markers), told by ``level``; markers are drawn once for all.

    A higher level drops all that a lower one drops, and adds all that it adds.
    Columns to ``keep`` come along.
    """
    if any(not 0 <= drop <= 1 or add < 0 for drop, add in levels):
        raise ValueError("drop_rate must lie within 0 and 1, add_noise above 0")
    most = max(add for _, add in levels)
    none = F.array().cast("array<string>")
    rows = examples.withColumn("markers", F.coalesce("markers", none))
    if most:
        rows = rows.join(distractors(examples, records, most, seed), "example_id", "left")
    else:
        rows = rows.withColumn("added", none)
    at = (F.lit(seed), F.col("example_id"))
    grid = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(float(d)).alias("drop"), F.lit(a).alias("add")) for i, (d, a) in enumerate(levels)])
    rows = rows.withColumn("x", F.explode(grid)).select("example_id", *keep, "markers", "x.level", "x.drop", F.slice("added", F.lit(1), F.col("x.add")).alias("added"))
    stays = F.filter("markers", lambda m: uniform(*at, m) >= F.col("drop"))
    floor = F.slice(F.reverse(by_hash(F.col("markers"), *at)), 1, min_markers)
    rows = rows.withColumn("kept", F.when(F.size(stays) >= min_markers, stays).otherwise(floor))
    return rows.select(
        "example_id",
        *keep,
        "level",
        by_hash(F.array_distinct(F.concat("kept", F.coalesce("added", none))), *at, "order").alias("markers"),
        F.col("markers").alias("original_markers"),
        (F.size("markers") - F.size("kept")).alias("dropped"),
        F.coalesce("added", none).alias("added"),
    )


def perturb_markers(
    examples: DataFrame, records: DataFrame, drop_rate: float, add_noise: int, min_markers: int = 1, seed: int = 23
) -> DataFrame:
    """(``example_id``, ``markers``, ``original_markers``, ``dropped``, ``added``): markers dropped at a rate, others added.

    ``examples``: ``example_id``, ``cell_type``, ``markers``. At least
    ``min_markers`` of the own ones stay: those with the greatest hashes. The
    result is in hash order. Examples without markers only get added ones.
    """
    return perturb_levels(examples, records, ((drop_rate, add_noise),), min_markers, seed).drop("level")


def rewrite_perturbed(examples: DataFrame, perturbed: DataFrame, drop_rate: float, add_noise: int) -> DataFrame:
    """Examples with perturbed markers in prompt and metadata; what was done is noted there."""
    new = perturbed.select("example_id", F.col("markers").alias("_new"), "original_markers", "dropped", "added")
    joined = examples.join(new, "example_id")
    note = F.struct(
        F.lit(float(drop_rate)).alias("drop_rate"), F.lit(add_noise).alias("add_noise_markers"),
        F.col("dropped").alias("dropped_markers"), F.col("added").alias("added_markers"),
    )
    metadata = F.col("metadata").withField("markers", F.col("_new")).withField("original_markers", F.col("original_markers"))
    return joined.withColumn("metadata", metadata.withField("perturbation", note)).withColumn(
        "prompt", user_prompt(F.col("metadata.tissue"), F.col("_new"))
    ).drop("_new", "original_markers", "dropped", "added", "markers").withColumn("markers", F.col("metadata.markers"))
