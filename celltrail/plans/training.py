"""Queries that build, perturb, split and audit training records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.functions.text import norm_gene_list, norm_label, uniform
from celltrail.operators import augment, splits
from celltrail.operators import prompts as pr
from celltrail.operators.annotators import cases
from celltrail.operators.parse import choose_candidate, parse_response
from celltrail.operators.similarity import candidate_lists, rank_by_overlap
from celltrail.plans import sql
from celltrail.plans.markers import _CLUSTERS, _SCORED, clusters, database
from celltrail.session import salted_join, table
from celltrail.sources import tables as src


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "annotation_example")


def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    return db.select("rec_id", pr.user_prompt(F.col("tissue"), F.col("markers")).alias("prompt"))


def build_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    reason = pr.reasoning(F.col("cell_type"), F.col("markers"), F.col("evidence"))
    text = pr.assistant_response(F.col("cell_type"), reason, F.col("cell_ontology_id"), F.lit(0.9))
    return db.select("rec_id", text.alias("response"))


def to_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).withColumn("messages", pr.chat_messages(F.col("prompt"), F.col("response"), "system"))
    one = rows.select("example_id", F.posexplode("messages").alias("pos", "m"))
    return one.select("example_id", "pos", "m.role", "m.content")


def to_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    made = pr.to_training_records(rows, "instruction", "system")
    return made.select("instruction", "input", "output", F.col("metadata.augmentation_index").alias("augmentation_index"))


def _text():
    return pr.training_text(pr.chat_messages(F.coalesce("prompt", F.lit("")), F.coalesce("response", F.lit("")), "system"))


def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = _text()
    return examples(spark, sf_dir).select("example_id", F.sha2(text, 256).alias("signature"), pr.estimated_tokens(text).alias("tokens"))


def parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "annotation_prediction").select("pred_id", "arrived_at", parse_response(F.col("raw_response")).alias("p"))
    return rows.select("pred_id", "arrived_at", "p.*")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``example_id``, ``candidates``): the three likeliest types of every example's cluster."""
    queries, db = clusters(spark, sf_dir), database(spark, sf_dir)
    return candidate_lists(rank_by_overlap(queries, db, 3), queries, db).withColumnRenamed("q_id", "example_id")


def choose_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which candidate of its example each stored answer chooses, and how."""
    rows = table(spark, sf_dir, "annotation_prediction").select("pred_id", "arrived_at", "example_id", "raw_response")
    joined = salted_join(rows, _candidates(spark, sf_dir), "example_id")
    chosen = joined.select("pred_id", "arrived_at", choose_candidate(F.col("raw_response"), F.col("candidates")).alias("c"))
    return chosen.select("pred_id", "arrived_at", F.col("c.candidate.rank").alias("rank"), "c.selection_source")


def rerank_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that offers each cluster its candidates."""
    asked = clusters(spark, sf_dir).withColumnRenamed("q_id", "example_id").join(_candidates(spark, sf_dir), "example_id")
    return asked.select("example_id", pr.rerank_prompt(F.col("tissue"), F.col("markers"), F.col("candidates"), "system").alias("prompt"))


def extract_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a benchmark asks and expects of each record; records that lack a field are left out before."""
    rows = examples(spark, sf_dir).where("metadata.tissue is not null and metadata.cell_type is not null and size(metadata.markers) > 0")
    return cases(rows).select(F.col("q_id").alias("example_id"), "tissue", F.array_join("markers", ",").alias("markers"), "y_true", "true_cl_id")


def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as JSON lines and parsed again by the readers' schema."""
    rows = examples(spark, sf_dir)
    messages = pr.chat_messages(F.col("prompt"), F.col("response"), "system")
    lines = rows.select("example_id", F.to_json(F.struct(messages.alias("messages"), "metadata")).alias("line"))
    read = lines.select("example_id", F.from_json("line", src.TRAINING_SCHEMA, {"mode": "FAILFAST"}).alias("r"))
    return read.select(
        "example_id", F.get("r.messages", 1)["content"].alias("question"), F.get("r.messages", 2)["content"].alias("answer"),
        "r.metadata.cell_type", F.array_join("r.metadata.markers", ",").alias("markers"), "r.metadata.augmentation_index",
    )


def generate_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = augment.generate_examples(database(spark, sf_dir))
    return out.select("rec_id", "augmentation_index", F.array_join("markers", ",").alias("markers"), F.length("prompt").alias("prompt_length"))


def perturb_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).select("example_id", "cell_type", norm_gene_list(F.array_join("metadata.markers", ",")).alias("markers"))
    out = augment.perturb_markers(rows, database(spark, sf_dir), 0.5, 3)
    return out.select("example_id", F.array_join(F.array_sort("markers"), ",").alias("markers"), "dropped", F.array_join(F.array_sort("added"), ",").alias("added"))


def perturb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the perturbation did, in numbers."""
    out = perturb_markers(spark, sf_dir)
    many = F.size(F.filter(F.split("added", ","), lambda m: m != ""))
    return out.agg(F.count(F.lit(1)).alias("records"), F.sum("dropped").alias("dropped"), F.sum(many).alias("added"), F.count_if(F.col("markers") == "").alias("empty"))


def split_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_chance(examples(spark, sf_dir).select("example_id"), "example_id")


def split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_group(examples(spark, sf_dir).select("example_id", "tissue", "source"), ["tissue", "source"]).select("example_id", F.col("split").alias("new_split"))


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).select("example_id", "cell_type", "prompt", "response")
    out = splits.split_by_stratum(rows, norm_label(F.col("cell_type")), _text())
    return out.select("example_id", F.col("split").alias("new_split"))


def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_manifest(examples(spark, sf_dir), norm_label(F.col("cell_type")))


def leaked_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir)
    return splits.leaked_groups(rows, ["tissue", "cell_type"]).select(F.md5("group").alias("group"), "train", "validation", "test")


def dup_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.duplicate_signatures(examples(spark, sf_dir), F.col("response"))


def label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_overlap(examples(spark, sf_dir), norm_label(F.col("cell_type")))


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_summary(examples(spark, sf_dir), _text(), 200)


def unseen_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.unseen_labels(examples(spark, sf_dir), norm_label(F.col("cell_type")))


def labels_with_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of labels that twenty or more records have."""
    return splits.labels_with(examples(spark, sf_dir).select("example_id", "cell_type"), "cell_type", 20)


def top_split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.top_split_labels(examples(spark, sf_dir))


def record_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as chats where they have an answer, else as bare instructions."""
    rows = examples(spark, sf_dir)
    chat = F.when(F.col("response").isNotNull(), pr.chat_messages(F.col("prompt"), F.col("response"), "system"))
    return splits.record_formats(rows.withColumn("messages", chat).withColumn("instruction", F.col("prompt")))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against training on the examples, a row a warning."""
    rows = examples(spark, sf_dir)
    summary = [r.asDict() for r in splits.split_summary(rows, _text(), 200).collect()]  # one row a split
    leaks = splits.leaked_groups(rows, ["tissue", "cell_type"]).count()
    duplicates = splits.duplicate_signatures(rows, F.col("response")).count()
    unseen = splits.label_overlap(rows, norm_label(F.col("cell_type"))).where("split != 'train'").agg(F.coalesce(F.sum("unseen"), F.lit(0))).first()[0]
    said = splits.preflight_warnings(summary, leaks, duplicates, unseen)
    return spark.createDataFrame([(w,) for w in said], "warning string")


def label_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.label_support(examples(spark, sf_dir))


def group_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = examples(spark, sf_dir).select(splits.group_key(["tissue"]).alias("group"))
    return rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"))


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stateless sample of lines: a tenth of them by hash."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", uniform(13, F.col("l_orderkey"), F.col("l_linenumber")).alias("u"))
    return rows.where("u < 0.1").select("l_orderkey", "l_linenumber")


QUERIES = {
    f.__name__: f
    for f in (
        rerank_prompts, extract_cases, scan_jsonl, unseen_labels, labels_with_many, top_split_labels, record_formats, preflight,
        build_prompt, build_response, to_chat, to_instruction, record_text, parse_responses, choose_candidates, generate_examples,
        perturb_markers, perturb_counts, split_random, split_grouped, split_stratified, split_manifest, leaked_groups, dup_signatures, label_overlap,
        split_summary, label_support, group_keys, hash_sample,
    )
}

_TEXT = "'system: system' || chr(10) || 'user: ' || coalesce(prompt, '') || chr(10) || 'assistant: ' || coalesce(response, '')"
_LEN = f"cast(ceil(length({_TEXT}) / 4.0) as int)"
_U = sql.uniform("13", "rec_id", "i", "m")
_TOP = f"with {sql.DB}, {_CLUSTERS.strip()}, {_SCORED.strip()}"
_ASK = (
    "\n\nWhich of the numbered types fits the markers best? Answer with one of them, copied from its line, and with nothing that isn''t listed, in five lines headed"
    "\nCandidate:\nCell type:\nCell Ontology ID:\nConfidence:\nReasoning:"
)
_EXAMPLE_MARKERS = f"""x as (select example_id, cell_type, coalesce(m, []) as m from annotation_example left join (
        select example_id, list(m order by p) as m from (select example_id, {sql.gene('r')} as m, min(p) as p from (
            select example_id, unnest(l) as r, generate_subscripts(l, 1) as p
            from (select example_id, regexp_split_to_array(array_to_string(metadata.markers, ','), '(?:{sql.WS}|[,;|/])+') as l from annotation_example)) where {sql.gene('r')} <> '' group by 1, 2)
        group by 1) using (example_id))"""
_PERTURBED = f"""
        with {sql.DB}, {_EXAMPLE_MARKERS},
        {sql.draws(f"select example_id::varchar as k, m as own, 3 as wanted, {sql.label('cell_type')} as label_key from x", "23",
                   "not exists (select 1 from lm where lm.label_key = tries.label_key and lm.m = voc.m)").strip()},
        u as (select example_id, m, {sql.uniform('23', 'example_id', 'm')} as u from (select example_id, unnest(m) as m from x)),
        s as (select example_id, list(m) filter (u >= 0.5) as stays, arg_max(m, struct_pack(u := u, m := m)) as best, count(*) as n from u group by 1),
        kept as (select example_id, case when len(coalesce(stays, [])) >= 1 then stays else [best] end as kept, n from s),
        a as (select k::bigint as example_id, list(m) as added from drawn group by 1)
        select x.example_id, coalesce(array_to_string(list_sort(list_distinct(coalesce(kept, []) || coalesce(added, []))), ','), '') as markers,
               coalesce(n - len(kept), 0) as dropped, coalesce(array_to_string(list_sort(added), ','), '') as added
        from x left join kept using (example_id) left join a using (example_id)"""

ORACLES = {
    "build_prompt": f"with {sql.DB} select rec_id, 'Tissue: ' || tissue || chr(10) || chr(10) || 'Cluster markers:' || chr(10) || array_to_string(m, ', ') as prompt from db",
    "build_response": f"""
        with {sql.DB}, r as (select *, array_to_string(m[1:3], ', ') as s from db)
        select rec_id, concat_ws(chr(10), 'Cell type: ' || cell_type, 'Cell Ontology ID: ' || cl, 'Confidence: 0.90', '',
               'Reasoning: ' || case when nullif(evidence, '') is not null then s || ' support ' || cell_type || '. ' || trim(evidence)
               else s || ' are established marker genes supporting ' || cell_type || '.' end) as response from r""",
    "to_chat": """
        select example_id, 0 as pos, 'system' as role, 'system' as content from annotation_example
        union all select example_id, 1, 'user', prompt from annotation_example union all select example_id, 2, 'assistant', response from annotation_example""",
    "to_instruction": "select 'system' as instruction, prompt as input, response as output, metadata.augmentation_index as augmentation_index from annotation_example",
    "record_text": f"select example_id, sha256({_TEXT}) as signature, {_LEN} as tokens from annotation_example",
    "generate_examples": f"""
        with {sql.DB}, l as (select rec_id, tissue, m, unnest(range(16)) as i from db where len(m) > 0),
        k as (select *, least(8, len(m)) as hi, least(3, least(8, len(m))) as lo from l),
        z as (select *, lo + cast(floor({sql.uniform('13', 'rec_id', 'i', "'size'")} * (hi - lo + 1)) as int) as n from k),
        {sql.draws(f"""select rec_id || ':' || i as k, m as own, 1 + floor({sql.uniform('13', 'rec_id', 'i', "'extra'")} * 2)::int as wanted, null::varchar as label_key
                       from z where {sql.uniform('13', 'rec_id', 'i', "'noisy'")} < 0.15""", "13").strip()},
        e as (select rec_id, i, n, m, row_number() over (partition by rec_id, i order by {_U}, m) as r from (select rec_id, i, n, unnest(m) as m from z)),
        c as (select rec_id, i, m from e where r <= n union all
              select string_split(k, ':')[1]::bigint, string_split(k, ':')[2]::bigint, m from drawn),
        g as (select rec_id, i, list(m order by {sql.uniform('13', 'rec_id', 'i', "'order'", 'm')}, m) as m from c group by 1, 2)
        select g.rec_id, g.i as augmentation_index, array_to_string(g.m, ',') as markers,
               length('Tissue: ' || z.tissue || '..Cluster markers:.' || array_to_string(g.m, ', ')) as prompt_length from g join z on g.rec_id = z.rec_id and g.i = z.i""",
    "perturb_markers": _PERTURBED,
    "perturb_counts": f"select count(*) as records, sum(dropped) as dropped, sum(case when added = '' then 0 else len(string_split(added, ',')) end) as added, count(*) filter (markers = '') as empty from ({_PERTURBED})",
    "parse_responses": "select pred_id, arrived_at, " + ", ".join(f"{v} as {k}" for k, v in sql.parsed("raw_response").items()) + " from annotation_prediction",
    "choose_candidates": f"""{_TOP}, a as (select pred_id, arrived_at, example_id, raw_response, {sql.label(sql.parsed("raw_response")["cell_type"])} as said,
                                try_cast(nullif(regexp_extract(coalesce(raw_response, ''), '(?i)candidate\\s*:\\s*(\\d+)', 1), '') as int) as number from annotation_prediction),
        c as (select q_id, rank, lk from ranked where rank <= 3),
        j as (select pred_id, arrived_at, count(rank) as n, max(case when rank = number then rank end) as by_number, min(case when lk = said then rank end) as by_label, min(rank) as first
              from a left join c on q_id = example_id group by 1, 2)
        select pred_id, arrived_at, coalesce(by_number, by_label, first) as rank,
               case when n < 1 then 'no_candidates' when by_number is not null then 'candidate_number' when by_label is not null then 'cell_type_label'
                    else 'fallback_top_candidate' end as selection_source from j""",
    "rerank_prompts": f"""{_TOP}, c as (select r.q_id, r.rank, d.cell_type, d.cl, r.score, coalesce((select string_agg(m, ', ' order by m) from qs where qs.q_id = r.q_id and list_contains(d.m, qs.m)), '') as o
              from ranked r join db d using (rec_id) where r.rank <= 3),
        p as (select q_id, string_agg(rank || '. ' || cell_type || ' | CL ID: ' || coalesce(nullif(cl, ''), 'NA') || ' | marker score: ' || format('{{:.4f}}', score)
              || ' | overlap: ' || case when o <> '' then o else 'none' end, chr(10) order by rank) as l from c group by 1),
        k as (select q_id, list(m order by f) as m from (select q_id, m, min(i) as f from (select q_id, unnest(l) as m, generate_subscripts(l, 1) as i from raw_q) where m <> '' group by 1, 2) group by 1)
        select e.example_id, 'system' || chr(10) || chr(10) || 'Tissue: ' || coalesce(e.tissue, '') || chr(10) || chr(10) || 'Cluster markers:' || chr(10) || array_to_string(k.m, ', ')
               || chr(10) || chr(10) || 'Candidate cell types:' || chr(10) || l || '{_ASK}' as prompt
        from p join k using (q_id) join annotation_example e on e.example_id = q_id""",
    "extract_cases": """select example_id, metadata.tissue as tissue, array_to_string(metadata.markers, ',') as markers, metadata.cell_type as y_true, metadata.cell_ontology_id as true_cl_id
        from annotation_example where metadata.tissue is not null and metadata.cell_type is not null and len(metadata.markers) > 0""",
    "scan_jsonl": """select example_id, prompt as question, response as answer, metadata.cell_type as cell_type, array_to_string(metadata.markers, ',') as markers,
        metadata.augmentation_index as augmentation_index from annotation_example""",
    "unseen_labels": f"""
        with p as (select distinct split, {sql.label('cell_type')} as label from annotation_example where cell_type is not null),
        u as (select *, row_number() over (partition by split order by label) as r from p where split <> 'train' and label not in (select label from p where split = 'train'))
        select split, label from u where r <= 20""",
    "labels_with_many": "select example_id, cell_type from annotation_example where cell_type in (select cell_type from annotation_example group by 1 having count(*) >= 20)",
    "top_split_labels": """
        with c as (select split, cell_type as label, count(*) as n, min(example_id) as f from annotation_example where coalesce(cell_type, '') <> '' group by 1, 2)
        select split, place, label, n from (select *, row_number() over (partition by split order by n desc, f) as place from c) where place <= 10""",
    "record_formats": """select split, case when response is not null then 'chat' when prompt is not null then 'instruction' else 'unknown' end as format, count(*) as n
        from annotation_example group by 1, 2""",
    "split_grouped": """
        with recursive k as (select example_id, coalesce(tissue, '__none__') || chr(31) || coalesce(source, '__none__') as g from annotation_example),
        s as (select g, count(*) as n, row_number() over (order by count(*), g) as r from k group by 1),
        t as (select sum(n) * 0.8::double as train, sum(n) * 0.1::double as validation, sum(n) * (1.0::double - 0.8::double - 0.1::double) as test from s),
        o as (select g, n, r as i from s where r <= 3 union all select g, n, 3 + row_number() over (order by n desc, g desc) from s where r > 3),
        d as (
            select 3::bigint as i, null::varchar as g, null::varchar as split, train - c.n as train, validation - b.n as validation, test - a.n as test
            from t, (select n from o where i = 1) a, (select n from o where i = 2) b, (select n from o where i = 3) c
            union all
            select o.i, o.g, case when train >= validation and train >= test then 'train' when validation >= test then 'validation' else 'test' end,
                   train - case when train >= validation and train >= test then n else 0 end,
                   validation - case when not (train >= validation and train >= test) and validation >= test then n else 0 end,
                   test - case when not (train >= validation and train >= test) and not validation >= test then n else 0 end
            from d join o on o.i = d.i + 1
        ), f as (select g, split from d where g is not null union all select g, case i when 1 then 'test' when 2 then 'validation' else 'train' end from o where i <= 3)
        select example_id, split as new_split from k join f using (g)""",
    "split_stratified": f"""
        with recursive k as (select example_id, coalesce({sql.label('cell_type')}, '__none__') as st, sha256({_TEXT}) as tx from annotation_example),
        s as (select st, tx, count(*) as n, row_number() over (partition by st order by md5('13:' || tx)) as i, count(*) over (partition by st) as many from k group by 1, 2),
        t as (select st, sum(n) * 0.8::double as train, sum(n) * 0.1::double as validation, sum(n) * (1.0::double - 0.8::double - 0.1::double) as test from s group by 1),
        d as (
            select st, 0::bigint as i, null::varchar as tx, null::varchar as split, train, validation, test from t
            union all
            select st, i, tx, w, train - case w when 'train' then n else 0 end, validation - case w when 'validation' then n else 0 end, test - case w when 'test' then n else 0 end
            from (select d.st, s.i, s.tx, n, train, validation, test,
                         case when s.many >= 3 and s.i <= 3 then case s.i when 1 then 'train' when 2 then 'validation' else 'test' end
                              when s.many < 3 and s.i = 1 then 'train'
                              when train >= validation and train >= test then 'train' when validation >= test then 'validation' else 'test' end as w
                  from d join s on s.st = d.st and s.i = d.i + 1)
        )
        select example_id, split as new_split from k join d using (st, tx)""",
    "split_random": """
        with r as (select example_id, row_number() over (order by md5('13:' || example_id), example_id) - 1 as p, count(*) over () as n from annotation_example)
        select example_id, case when p < floor(n * 0.8) then 'train' when p < floor(n * 0.8) + floor(n * 0.1) then 'validation' else 'test' end as split from r""",
    "split_manifest": f"""
        with s as (select distinct {sql.label('cell_type')} as stratum from annotation_example), g as (select unnest(['train', 'validation', 'test']) as split)
        select g.split, s.stratum, count(e.split) as n from s cross join g
        left join (select split, {sql.label('cell_type')} as st from annotation_example where cell_type is not null) e on e.split = g.split and e.st = s.stratum group by 1, 2""",
    "leaked_groups": """
        with k as (select md5(coalesce(tissue, '__none__') || chr(31) || coalesce(cell_type, '__none__')) as "group", split from annotation_example)
        select "group", count(*) filter (split = 'train') as train, count(*) filter (split = 'validation') as validation, count(*) filter (split = 'test') as test
        from k group by 1 having count(distinct split) > 1""",
    "dup_signatures": "select sha256(coalesce(response, '')) as signature, count(*) as n, count(distinct split) as splits from annotation_example group by 1 having count(distinct split) > 1",
    "label_overlap": f"""
        with p as (select distinct split, {sql.label('cell_type')} as l from annotation_example)
        select split, count(*) as labels, count(*) filter (l in (select l from p where split = 'train' and l is not null)) as seen,
               count(*) filter (l is null or l not in (select l from p where split = 'train' and l is not null)) as unseen from p group by 1""",
    "split_summary": f"""
        with s as (select split, tissue, {sql.label('cell_type')} as l, cell_type, source, cell_ontology_id, markers, {_LEN} as length from annotation_example)
        select coalesce(split, 'total') as split, count(*) as records, count(distinct tissue) as tissues, count(distinct l) as labels, count(distinct source) as sources,
               round(avg(case when cell_ontology_id is not null then 1.0 else 0.0 end), 4) as cl_coverage,
               count(*) filter (cell_type is null) as missing_cell_type, count(*) filter (tissue is null) as missing_tissue,
               count(*) filter (source is null) as missing_source, count(*) filter (len(coalesce(markers, [])) = 0) as missing_markers, min(length) as min_length,
               round(avg(length), 2) as mean_length, quantile_disc(length, 0.95) as p95_length, max(length) as max_length, count(*) filter (length > 200) as over_limit
        from s group by rollup (split)""",
    "label_support": f"""
        select {sql.label('cell_type')} as label, count(*) as total, count(*) filter (split = 'train') as train, count(*) filter (split = 'validation') as validation,
               count(*) filter (split = 'test') as test, count(cell_ontology_id) as with_cl_id, round(count(cell_ontology_id) / count(*), 6) as coverage,
               coalesce(string_agg(distinct cell_ontology_id, ';' order by cell_ontology_id), '') as cl_ids
        from annotation_example group by 1""",
    "group_keys": "select coalesce(tissue, '__none__') as \"group\", count(*) as n from annotation_example group by 1",
    "hash_sample": f"select l_orderkey, l_linenumber from lineitem where {sql.uniform('13', 'l_orderkey', 'l_linenumber')} < 0.1",
}
ORACLES["preflight"] = f"""
    with s as ({ORACLES["split_summary"]}), t as (select * from s where split = 'total'), leaks as (select count(*) as n from ({ORACLES["leaked_groups"]})),
    copies as (select count(*) as n from ({ORACLES["dup_signatures"]})), unseen as (select coalesce(sum(unseen), 0) as n from ({ORACLES["label_overlap"]}) where split <> 'train')
    select 'split ' || k || ' is empty' as warning from (select unnest(['train', 'validation', 'test']) as k) where k not in (select split from s where records > 0)
    union all select 'only ' || round(cl_coverage * 100)::int || '% of the records have an ontology id' from t where cl_coverage < 0.8
    union all select over_limit || ' records exceed the length limit' from t where over_limit > 0
    union all select missing_cell_type || ' records have no cell type' from t where missing_cell_type > 0
    union all select 'fewer than two labels' from t where labels < 2
    union all select n || ' groups are in several splits' from leaks where n > 0
    union all select n || ' texts are in several splits' from copies where n > 0
    union all select n || ' evaluation labels are not in training' from unseen where n > 0"""
