"""Marker sets against a marker database: scored set-similarity joins with top-k.

Pairs of queries and records that share a marker are many more than either, so
they are never rows: queries and records of a tissue meet in blocks of bounded
size, and a block's task reads an inverted index of its records, keeps the pairs
of a few queries at a time and returns each query's best. Records that share no
marker fill up a query's list where it is short. A query whose tissue the
database lacks is ranked against all records.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from celltrail.functions.text import norm_label
from celltrail.operators.markers import negative_markers
from celltrail.session import cut_lineage, ship_package

#: Stands for all tissues.
ANY = "*"
#: Decimals of a score that count.
DIGITS = 9
#: Records and queries that meet in one block.
RECORDS_PER_PART, QUERIES_PER_PART = 100_000, 100_000
#: Markers whose numbers of records every task may hold, 16 bytes each; more are joined.
VOCABULARY = 2_000_000
#: Tissues that may be broadcast.
TISSUES = 10_000
#: Pairs of queries and records in a task's memory at once, and cells of its table of sums.
PAIRS, CELLS = 1_000_000, 4_000_000


def marker_weights(records: DataFrame, with_negative: bool = False) -> DataFrame:
    """(``marker``, ``records``, ``weight``): one over the number of records that hold the marker."""
    held = F.array_distinct("markers")
    if with_negative:
        held = F.concat(held, F.array_distinct("negatives"))
    return (
        records.select(F.explode(held).alias("marker"))
        .groupBy("marker")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("weight", 1.0 / F.col("records"))
    )


def _tissue(x: Column) -> Column:
    return F.lower(F.trim(x))


def _labelled(records: DataFrame) -> DataFrame:
    return records.withColumn("label_key", F.coalesce(norm_label(F.col("cell_type")), F.lit(""))).withColumn(
        "cl_key", F.coalesce("cell_ontology_id", F.lit(""))
    )


def _codes(markers: str) -> Column:
    """Hashes of the distinct markers, 64 bits each."""
    return F.transform(F.coalesce(F.array_distinct(F.filter(markers, lambda m: m.isNotNull())), F.array().cast("array<string>")), lambda m: F.xxhash64(m))


def _numbered(rows: DataFrame, key: str, codes: str, numbers: DataFrame) -> DataFrame:
    """``rows`` with the numbers of records of its ``codes`` in ``codes_n``, 0 where no record holds one."""
    flat = rows.select(key, F.posexplode(codes).alias("_p", "code")).join(numbers, "code", "left")
    one = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("records", F.lit(0)).alias("n")))).alias("_l"))
    none = F.array().cast("array<bigint>")
    return rows.join(one.select(key, F.col("_l.n").alias(f"{codes}_n")), key, "left").withColumn(f"{codes}_n", F.coalesce(f"{codes}_n", none))


def _in_blocks(queries: DataFrame, records: DataFrame, tissues: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Queries and records with the block in which they meet; whether the records of any tissue fill more than one.

    Each query meets each block of its tissue's records once. ``tissues`` has
    the ``tissue`` of every query.
    """
    of_q = tissues.groupBy(_tissue(F.col("tissue")).alias("tkey")).agg(F.count(F.lit(1)).alias("q"))
    of_r = records.groupBy(_tissue(F.col("tissue")).alias("tkey")).agg(F.count(F.lit(1)).alias("r"))
    sizes = cut_lineage(of_q.join(of_r, "tkey", "full"))
    other = (F.col("r").isNull() & F.col("q").isNotNull()) | (F.col("tkey") == ANY)
    count = sizes.agg(
        F.coalesce(F.sum("r"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(other, F.col("q"))), F.lit(0)).alias("others"),
        F.coalesce(F.max(F.when(F.col("q").isNotNull(), F.col("r"))), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("tissues"),
    ).first()
    blocks = lambda n, most: F.ceil(n / F.lit(float(most))).cast("int")
    met = sizes.where((F.col("tkey") != ANY) & F.col("q").isNotNull() & F.col("r").isNotNull())
    met = met.select("tkey", blocks(F.col("q"), QUERIES_PER_PART).alias("_qs"), blocks(F.col("r"), RECORDS_PER_PART).alias("_rs"))
    met = F.broadcast(met) if count["tissues"] <= TISSUES else met
    all_qs, all_rs = max(1, -(-count["others"] // QUERIES_PER_PART)), max(1, -(-count["records"] // RECORDS_PER_PART))
    asked = queries.withColumn("tkey", _tissue(F.col("tissue"))).drop("tissue").join(met, "tkey", "left")
    lacking = F.col("_rs").isNull()
    asked = asked.withColumn("tkey", F.when(lacking, ANY).otherwise(F.col("tkey")))
    asked = asked.withColumn("_qs", F.coalesce("_qs", F.lit(all_qs))).withColumn("_rs", F.coalesce("_rs", F.lit(all_rs)))
    held = records.withColumn("tkey", _tissue(F.col("tissue"))).drop("tissue").join(met, "tkey")
    if count["others"]:
        every = records.withColumn("tkey", F.lit(ANY)).drop("tissue").withColumn("_qs", F.lit(all_qs)).withColumn("_rs", F.lit(all_rs))
        held = held.unionByName(every)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.withColumn("_qb", F.pmod(F.xxhash64("q_id"), F.col("_qs")).cast("int")).withColumn("_rb", each("_rs"))
    held = held.withColumn("_rb", F.pmod(F.xxhash64("rec_id"), F.col("_rs")).cast("int")).withColumn("_qb", each("_qs"))
    several = count["most"] > RECORDS_PER_PART or bool(count["others"]) and all_rs > 1
    return asked.drop("_qs", "_rs"), held.drop("_qs", "_rs"), several


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the row of each."""
    lists = pa.chunked_array([c for c in table[name].chunks if len(c)], table[name].type).combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return pc.list_flatten(lists).to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)


def _rounded(score: np.ndarray) -> np.ndarray:
    """Halves go away from zero."""
    scale = 10.0**DIGITS
    return np.sign(score) * np.floor(np.abs(score) * scale + 0.5) / scale + 0.0


def _best_of_block(k: int, known, negative_weight: float | None, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The first ``k`` distinct (label, id) of each query among a block's records; of signed sets with ``negative_weight``."""
    signed = negative_weight is not None
    # Labels share so many places by number: the k-th highest of the places' best scores is no more than the k-th best label's.
    places = 1 << (16 * k - 1).bit_length()

    def run(queries: pa.Table, records: pa.Table) -> pa.Table:
        if not queries.num_rows or not records.num_rows:
            return schema.empty_table()
        numbers = known.value if known is not None else None

        def weights(table: pa.Table, name: str, codes: np.ndarray) -> np.ndarray:
            if numbers is None:
                n = _lists(table, f"{name}_n")[0]
            elif len(numbers[0]):
                at = np.minimum(np.searchsorted(numbers[0], codes), len(numbers[0]) - 1)
                n = np.where(numbers[0][at] == codes, numbers[1][at], 0)
            else:
                n = np.zeros(len(codes))
            return 1.0 / np.maximum(n, 1)

        # In the order of records that share nothing, which is that of ties.
        records = records.take(pc.sort_indices(records, sort_keys=[("label_key", "descending"), ("rec_id", "ascending")]))
        size = records.num_rows
        names = pc.binary_join_element_wise(records["label_key"].cast("string"), records["cl_key"].cast("string"), "\x00")
        label = pc.dictionary_encode(names.combine_chunks()).indices.to_numpy().astype(np.int64)
        labels = int(label.max()) + 1
        place = label % places
        codes, holder = _lists(records, "codes")
        weight = weights(records, "codes", codes)
        sign = np.ones(len(codes), np.int8)
        if signed:
            codes_n, holder_n = _lists(records, "codes_neg")
            weight_n = weights(records, "codes_neg", codes_n)
            roots = [np.sqrt(np.maximum(records[c].to_numpy(), 1)) for c in ("np", "nn")]
            share = np.concatenate([weight / roots[0][holder], -negative_weight * weight_n / roots[1][holder_n]])
            sign = np.concatenate([sign, -np.ones(len(codes_n), np.int8)])
            codes, holder, weight = (np.concatenate(x) for x in ((codes, codes_n), (holder, holder_n), (weight, weight_n)))
        else:
            share, r_weight = weight, np.bincount(holder, weight, size)
        # The inverted index: each marker's records side by side.
        index, code = np.unique(codes, return_inverse=True)
        by = np.argsort(code, kind="stable")
        holder, weight, share, sign = holder[by], weight[by], share[by], sign[by]
        held = np.bincount(code, minlength=len(index))
        starts = np.cumsum(held) - held

        asked, asker = _lists(queries, "codes")
        n_queries = queries.num_rows
        q_weight = None if signed else np.bincount(asker, weights(queries, "codes", asked), n_queries)
        at = np.minimum(np.searchsorted(index, asked), max(len(index) - 1, 0))
        hit = index[at] == asked if len(index) else np.zeros(len(asked), bool)
        asker, at = asker[hit], at[hit]
        upto = np.cumsum(np.bincount(asker, held[at], n_queries))
        many = max(1, CELLS // size)
        sums = np.zeros(min(many, n_queries) * size)
        first_of_label = np.sort(np.unique(label, return_index=True)[1])[:k]
        found: list[list[np.ndarray]] = []
        begin = 0
        while begin < n_queries:
            done = upto[begin - 1] if begin else 0
            end = min(begin + many, max(begin + 1, int(np.searchsorted(upto, done + PAIRS, "right"))), n_queries)
            a, b = np.searchsorted(asker, [begin, end])
            n = held[at[a:b]]
            entry = np.arange(n.sum()) + np.repeat(starts[at[a:b]] - (np.cumsum(n) - n), n)
            q = np.repeat(asker[a:b] - begin, n)
            rec = holder[entry]
            key = q * size + rec
            np.add.at(sums, key, share[entry])
            score = sums[key]
            sums[key] = 0.0
            if not signed:
                score = score / (q_weight[begin:end][q] + r_weight[rec] - score)
            # What is below k other labels for certain goes; what rounding might make equal stays.
            best = np.zeros((end - begin) * places)
            np.maximum.at(best, q * places + place[rec], score)
            least = np.partition(best.reshape(-1, places), places - k, axis=1)[:, places - k]
            slack = 2 * 10.0**-DIGITS
            keep = score >= np.where(least > slack, least - slack, -np.inf)[q]
            entry = entry[keep]
            pair, of = np.unique(key[keep], return_inverse=True)
            q, rec = pair // size, pair % size
            plus = sign[entry] > 0
            sides = [np.bincount(of[m], weight[entry][m], len(pair)) for m in (plus, ~plus)] + [np.bincount(of[m], minlength=len(pair)) for m in (plus, ~plus)]
            if signed:
                score = sides[0] / roots[0][rec] - negative_weight * sides[1] / roots[1][rec]
            else:
                score = sides[0] / (q_weight[begin:end][q] + r_weight[rec] - sides[0])
            score = _rounded(score)
            # Where fewer than k labels are above records that share nothing, the first of these come in.
            ahead = (score > 0) | ((score == 0) & (sides[2] > 0))
            own = np.bincount(np.unique(q[ahead] * labels + label[rec[ahead]]) // labels, minlength=end - begin)
            short = np.flatnonzero(own < k)
            if len(short):
                if signed:
                    fills = [_free(rec[slice(*np.searchsorted(q, [x, x + 1]))], label, k) for x in short]
                else:
                    fills = [first_of_label] * len(short)
                more = sum(map(len, fills))
                q, rec = np.concatenate([q, np.repeat(short, [*map(len, fills)])]), np.concatenate([rec, *fills])
                score = np.concatenate([score, np.zeros(more)])
                sides = [np.concatenate([x, np.zeros(more, x.dtype)]) for x in sides]
            order = np.lexsort((rec, sides[3], -sides[2], -score, q))
            once = np.sort(np.unique((q * labels + label[rec])[order], return_index=True)[1])
            order = order[once]
            of_query = q[order]
            rank = np.arange(len(order)) - np.searchsorted(of_query, of_query) + 1
            order, rank = order[rank <= k], rank[rank <= k]
            found.append([q[order] + begin, rec[order], rank, *[x[order] for x in sides]])
            begin = end
        q, rec, rank, *sides = (np.concatenate(x) for x in zip(*found, strict=True))
        of_rec = records.take(rec)
        values = {"q_id": queries["q_id"].take(q), "rank": rank, **{c: of_rec[c] for c in ("rec_id", "label_key", "cl_key")}}
        if signed:
            values |= {"p": sides[0], "n": sides[1], "np": of_rec["np"], "nn": of_rec["nn"], "positive": sides[2], "negative": sides[3]}
        else:
            values |= {"o": sides[0], "common": sides[2], "q_weight": q_weight[q], "r_weight": r_weight[rec]}
        columns = [values[f.name] if isinstance(values[f.name], pa.ChunkedArray) else pa.array(values[f.name]) for f in schema]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _free(scored: np.ndarray, label: np.ndarray, k: int) -> np.ndarray:
    """Of the first ``k`` labels with records that aren't scored, the first such record each."""
    upto = 256
    while True:
        free = np.setdiff1d(np.arange(min(upto, len(label))), scored, assume_unique=True)
        first = np.sort(np.unique(label[free], return_index=True)[1])[:k]
        if len(first) == k or upto >= len(label):
            return free[first]
        upto *= 8


def _ranked(queries: DataFrame, records: DataFrame, weights: DataFrame, k: int, tissues: DataFrame, negative_weight: float | None, columns: str) -> tuple[DataFrame, bool]:
    """The first ``k`` of each query in each block, and whether a query meets several blocks."""
    spark = queries.sparkSession
    ship_package(spark)
    numbers = cut_lineage(weights.select(F.xxhash64("marker").alias("code"), "records"))
    known = None
    if numbers.count() <= VOCABULARY:
        rows = numbers.orderBy("code").toArrow()  # bounded
        known = spark.sparkContext.broadcast((rows["code"].to_numpy(), rows["records"].to_numpy()))
    else:
        queries = _numbered(queries, "q_id", "codes", numbers)
        for c in ("codes", "codes_neg") if negative_weight is not None else ("codes",):
            records = _numbered(records, "rec_id", c, numbers)
    asked, held, several = _in_blocks(queries, records, tissues)
    ids = f"q_id {queries.schema['q_id'].dataType.simpleString()}, rank int, rec_id {records.schema['rec_id'].dataType.simpleString()}"
    ddl = f"{ids}, label_key string, cl_key string, {columns}"
    run = _best_of_block(k, known, negative_weight, to_arrow_schema(StructType.fromDDL(ddl)))
    block = ["tkey", "_qb", "_rb"]
    return asked.groupBy(*block).cogroup(held.groupBy(*block)).applyInArrow(run, ddl), several


def _merged(ranked: DataFrame, several: bool, order: list, k: int) -> DataFrame:
    """The blocks' best of a query together."""
    if not several:
        return ranked
    best = Window.partitionBy("q_id", "label_key", "cl_key").orderBy(*order)
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(*order))
    # One shuffle serves both.
    first = ranked.repartition("q_id").withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return first.withColumn("rank", rank).where(F.col("rank") <= k)


def rank_by_overlap(queries: DataFrame, records: DataFrame, k: int = 5, tissues: DataFrame | None = None) -> DataFrame:
    """(``q_id``, ``rank``, ``rec_id``, ``score``, ``common``) of the ``k`` likeliest cell types of each query.

    ``queries``: ``q_id``, ``tissue``, ``markers``. ``records``: ``rec_id``,
    ``tissue``, ``cell_type``, ``cell_ontology_id``, ``markers``. The score is
    the weighted Jaccard similarity, markers weighing one over the number of
    records that hold them. Ties go by common markers, then the later label,
    then the earlier record; each (label, id) comes once. Queries without
    markers have no candidates; of repeated ``q_id`` one row should be given.
    ``tissues`` may hold the queries' ``tissue`` where that is read for less
    than the queries.
    """
    tissues = queries if tissues is None else tissues
    asked = queries.where(F.size("markers") > 0).select("q_id", "tissue", _codes("markers").alias("codes"))
    held = _labelled(records).select("rec_id", "tissue", "label_key", "cl_key", _codes("markers").alias("codes"))
    columns = "o double, common int, q_weight double, r_weight double"
    found, several = _ranked(asked, held, marker_weights(records), k, tissues.select("tissue"), None, columns)
    score = F.when(F.col("common") > 0, F.round(F.col("o") / (F.col("q_weight") + F.col("r_weight") - F.col("o")), DIGITS)).otherwise(0.0)
    order = [F.desc("score"), F.desc("common"), F.desc("label_key"), "rec_id"]
    return _merged(found.withColumn("score", score), several, order, k).select("q_id", "rank", "rec_id", "score", "common")


def rank_by_signed_sets(queries: DataFrame, records: DataFrame, k: int = 5, negative_weight: float = 1.0) -> DataFrame:
    """(``q_id``, ``rank``, ``rec_id``, ``score``, ``positive``, ``negative``): positive less negative marker sets.

    Each side sums the weights of its common markers over the root of its size.
    Ties go by more positive, then fewer negative markers, then the later label,
    then the earlier record. Records need ``metadata`` for negative markers.
    """
    if negative_weight < 0:
        raise ValueError("negative_weight must not be negative")
    records = _labelled(records).withColumn("negatives", negative_markers(F.col("metadata"))).drop("metadata")
    asked = queries.where(F.size("markers") > 0).select("q_id", "tissue", _codes("markers").alias("codes"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    held = records.select(
        "rec_id", "tissue", "label_key", "cl_key", _codes("markers").alias("codes"), _codes("negatives").alias("codes_neg"), size("markers").alias("np"), size("negatives").alias("nn")
    )
    columns = "p double, n double, np int, nn int, positive int, negative int"
    found, several = _ranked(asked, held, marker_weights(records, with_negative=True), k, queries.select("tissue"), float(negative_weight), columns)
    score = F.col("p") / F.sqrt(F.greatest("np", F.lit(1))) - F.lit(float(negative_weight)) * F.col("n") / F.sqrt(F.greatest("nn", F.lit(1)))
    order = [F.desc("score"), F.desc("positive"), "negative", F.desc("label_key"), "rec_id"]
    top = _merged(found.withColumn("score", F.round(score, DIGITS)), several, order, k)
    return top.select("q_id", "rank", "rec_id", "score", "positive", "negative")


def best_with_confidence(ranked: DataFrame, queries: DataFrame, records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(``q_id``, ``cell_type``, ``cell_ontology_id``, ``score``, ``confidence``), one row a query.

    Confidence is the best score plus its lead on the second, within 0 and 1. A
    query without markers, or whose best score isn't above zero, is ``Unknown``
    with no confidence. Columns of the queries to ``keep`` come along.
    """
    by = ranked.where("rank <= 2").groupBy("q_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("rec_id"))).alias("rec_id"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    names = records.select("rec_id", "cell_type", "cell_ontology_id")
    joined = queries.select("q_id", *keep).join(by, "q_id", "left").join(names, "rec_id", "left")
    hit = F.col("best") > 0
    lead = F.col("best") + F.greatest(F.lit(0.0), F.col("best") - F.col("second"))
    return joined.select(
        "q_id",
        *keep,
        F.when(hit, F.col("cell_type")).otherwise("Unknown").alias("cell_type"),
        F.when(hit, F.col("cell_ontology_id")).alias("cell_ontology_id"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
        F.when(hit, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), lead)), DIGITS)).otherwise(0.0).alias("confidence"),
    )


def candidate_lists(ranked: DataFrame, queries: DataFrame, records: DataFrame) -> DataFrame:
    """(``q_id``, ``candidates``): rank, cell type, id, score, common and all markers of each candidate."""
    held = records.select("rec_id", "cell_type", "cell_ontology_id", F.col("markers").alias("record_markers"))
    asked = queries.select("q_id", "markers")
    one = ranked.join(held, "rec_id").join(asked, "q_id")
    candidate = F.struct(
        F.col("rank").cast("int").alias("rank"), "cell_type", "cell_ontology_id", F.col("score").alias("marker_score"),
        F.array_sort(F.array_intersect(F.array_distinct("markers"), "record_markers")).alias("overlap"), "record_markers",
    )
    return one.groupBy("q_id").agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
