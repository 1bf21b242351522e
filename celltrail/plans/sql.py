"""Pieces of SQL that the oracles share. Blanks are Unicode's, as in the column expressions."""

from __future__ import annotations

WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def label(x: str) -> str:
    return squeeze(f"lower(translate({x}, '_-', '  '))")


def tissue(x: str) -> str:
    return squeeze(x)


def gene(x: str) -> str:
    return f"upper(replace(trim({strip(x)}, '\"''`'), ' ', ''))"


def genes(x: str) -> str:
    """Distinct symbols in order of first appearance."""
    parts = f"regexp_split_to_array(coalesce({x}, ''), '(?:{WS}|[,;|/])+')"
    kept = f"list_filter(list_transform({parts}, lambda m: {gene('m')}), lambda m: m <> '')"
    return f"(select list(m order by p) from (select m, min(p) as p from (select unnest({kept}) as m, generate_subscripts({kept}, 1) as p) group by m))"


def cl_id(x: str) -> str:
    return f"nullif(regexp_replace(upper({strip(x)}), '^CL_', 'CL:'), '')"


def uniform(*parts: str) -> str:
    joined = ", ".join(f"cast({p} as varchar)" for p in parts)
    return f"(('0x' || substr(md5(concat_ws(':', {joined})), 1, 8))::ubigint / 4294967296.0)"


#: Marker records, normalised: db(rec_id, tissue, cell_type, cl, m, source, evidence, metadata).
DB = f"""
    parts as (
        select rec_id, unnest(regexp_split_to_array(coalesce(markers, ''), '(?:{WS}|[,;|/])+')) as raw,
               generate_subscripts(regexp_split_to_array(coalesce(markers, ''), '(?:{WS}|[,;|/])+'), 1) as p
        from marker_record
    ), firsts as (
        select rec_id, {gene('raw')} as m, min(p) as p from parts where {gene('raw')} <> '' group by 1, 2
    ), db as (
        select r.rec_id, {tissue('tissue')} as tissue, cell_type, {cl_id('cell_ontology_id')} as cl, source, evidence, metadata,
               coalesce(f.m, []) as m
        from marker_record r left join (select rec_id, list(m order by p) as m from firsts group by 1) f using (rec_id)
    )"""

#: Predictions as evaluated: pr(pred_id, method, t, p, tc, pc, conf, runtime, cost), labels normalised, one row a delivery.
PREDICTIONS = f"""
    pr as (
        select pred_id, method, {label("coalesce(y_true, 'None')")} as t, {label("coalesce(cell_type, 'None')")} as p,
               nullif({cl_id('true_cl_id')}, '') as tc, nullif({cl_id('cell_ontology_id')}, '') as pc,
               case when confidence is null or isnan(confidence) then null else greatest(0.0, least(1.0, confidence)) end as conf,
               case when isnan(runtime_seconds) then null else runtime_seconds end as runtime,
               case when isnan(cost_usd) then null else cost_usd end as cost, arrived_at, cell_type, y_true
        from annotation_prediction
    )"""


def _singular(x: str) -> str:
    return f"case when {x} like '%s' and {x} not like '%ss' and length({x}) > 3 then {x}[1:-2] else {x} end"


def variants(source: str, p: str = "v") -> str:
    """CTEs that end in ``{p}``(label, place, variant) of the distinct labels (column ``label``) of a query."""
    from celltrail.functions.variants import ALIASES

    aliases = ", ".join(f"('{name}', {i}, '{alias}')" for name, others in ALIASES.items() for i, alias in enumerate(others))
    kind = "w[1] in ('b', 't') and n >= 3"
    return rf"""
    {p}l as (select distinct label from ({source}) where label is not null),
    {p}b as (select label, {label('label')} as b from {p}l),
    {p}s as (select label, t, min(p) as p from (
        select label, 0 as p, b as t from {p}b union all select label, 1, {label("regexp_replace(b, '\\([^)]*\\)', ' ', 'g')".replace("\\\\", "\\"))} from {p}b
        union all select label, 2, {label("replace(b, '+', ' ')")} from {p}b) where t <> '' group by 1, 2),
    {p}w as (select *, string_split(t, ' ') as w, len(string_split(t, ' ')) as n from {p}s),
    {p}r as (
        select label, p * 10 + 10 as p, array_to_string(w[1:n - 1] || [{_singular('w[n]')}], ' ') as t from {p}w
        union all select label, p * 10 + 11, array_to_string(w[3:n - 1] || [{_singular('w[n]')}] || [w[1], 'cell'], ' ') from {p}w where {kind} and w[2] in ('cell', 'cells')
        union all select label, p * 10 + 12, array_to_string(w[2:n - 2] || [{_singular('w[n - 1]')}] || [w[1], 'cell'], ' ') from {p}w where {kind} and w[n] in ('cell', 'cells')),
    {p}a as (select label, t, min(p) as p from (select label, t, p from {p}s union all select label, t, p from {p}r) where t <> '' group by 1, 2),
    {p}n(name, nth, alias) as (values {aliases}),
    {p}x as (select label, t, p from {p}a union all select label, alias, 1000 + p * 10 + nth from {p}a join {p}n on t = name),
    {p} as (select label, t as variant, row_number() over (partition by label order by min(p)) - 1 as place from {p}x group by 1, 2)"""


def _cleaned(x: str) -> str:
    out = f"regexp_replace({strip(x)}, '^(?:[-*]{WS}*)+', '')"
    out = f"regexp_replace(regexp_replace({out}, '^{WS}*[`*_]+', ''), '[`*_]+{WS}*$', '')"
    out = f"regexp_replace({strip(out)}, '(?i)^{WS}*(?:a|an|the){WS}+', '')"
    return squeeze(f"regexp_replace({out}, '^[ \\t\\r\\n.;]+|[ \\t\\r\\n.;]+$', '', 'g')")


def parsed(x: str) -> dict[str, str]:
    """What an answer says, by field. RE2 has no lookahead, so an id in the label's place is told by a condition."""
    lead, after = rf"^{WS}*(?:[-*]{WS}*)?(?:\*\*)?", rf"(?:\*\*)?{WS}*:{WS}*(?:\*\*)?{WS}*"
    t = f"coalesce({x}, '')"
    cell = rf"(?im){lead}cell{WS}*type{after}(.+)$"
    for_id = rf"(?im){lead}cell{WS}*ontology{WS}*id{after}(.+)$"
    bare_id = rf"(?im){lead}cell{WS}*ontology{WS}*id(?:\*\*)?{WS}*:(?:CL|GO)[:_]\d"
    likely = rf"(?is)\blikely{WS}+to{WS}+be{WS}+(?:a|an|the)?{WS}*(?:\*\*)?([A-Za-z][^*.\n]+?)(?:\*\*)?(?:[.;\n]|$)"
    cl = rf"(?im){lead}(?:cell{WS}*ontology{WS}*id|cl{WS}*id){after}(CL[:_]\d+)"
    sure = rf"(?im){lead}confidence(?:{WS}*score)?{after}([01](?:\.\d+)?|\d{{1,3}}(?:\.\d+)?%)"
    why = rf"(?ims){lead}(?:biological{WS}*)?reasoning{after}(.+)"
    first = f"regexp_extract(regexp_replace({t}, '^{WS}+', ''), '^([^\\n\\r]*)', 1)"
    no_label = rf"(?i)\b(given|provided|marker|predict|cell{WS}*type)\b"
    raw = f"regexp_extract({t}, '{sure}', 1)"
    return {
        "cell_type": f"""case when regexp_matches({t}, '{cell}') then {_cleaned(f"regexp_extract({t}, '{cell}', 1)")}
            when regexp_matches({t}, '{for_id}') and not regexp_matches({t}, '{bare_id}') then {_cleaned(f"regexp_extract({t}, '{for_id}', 1)")}
            when regexp_matches({t}, '{likely}') then {_cleaned(f"regexp_extract({t}, '{likely}', 1)")}
            when {first} = '' or regexp_matches({first}, '{no_label}') then 'Unknown' else {_cleaned(first)} end""",
        "cell_ontology_id": cl_id(f"nullif(regexp_extract({t}, '{cl}', 1), '')"),
        "confidence": f"""case when {raw} <> '' then greatest(0.0, least(1.0,
            case when {raw} like '%\\%' escape '\\' then replace({raw}, '%', '')::double / 100.0 else {raw}::double end)) end""",
        "reasoning": f"case when regexp_matches({t}, '{why}') then {_cleaned(f'''regexp_extract({t}, '{why}', 1)''')} end",
    }


#: The first prime from a number on.
def prime_from(n: str) -> str:
    return f"(select min(p) from range({n}, 2 * {n} + 3) x(p) where p >= 2 and not exists (select 1 from range(2, floor(sqrt(p))::bigint + 1) y(d) where p % d = 0))"


def draws(askers: str, seed: str, barred: str = "true") -> str:
    """CTEs that end in ``drawn``(k, m, r): ranked draws of ``askers``(k, own, wanted, label_key) from all markers of ``db``."""
    return f"""
    voc as (select m, row_number() over (order by m) - 1 as place from (select distinct unnest(m) as m from db)),
    size as (select {prime_from('n')} as p from (select count(*) as n from voc)),
    lm as (select distinct {label('cell_type')} as label_key, unnest(m) as m from db),
    ask as ({askers}),
    tries as (select k, own, wanted, label_key, j, (floor({uniform(seed, 'k', "'start'")} * p)::bigint + j * (1 + floor({uniform(seed, 'k', "'step'")} * (p - 1))::bigint)) % p as place
              from ask, size, range(0, 400) x(j) where j < p),
    fit as (select k, wanted, m, row_number() over (partition by k order by j) as r from tries join voc using (place)
            where not list_contains(coalesce(own, []), m) and {barred}),
    drawn as (select k, m, r from fit where r <= wanted)"""
