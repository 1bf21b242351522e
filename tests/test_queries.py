"""Every core query on the smallest tables against its SQL."""

import glob
import itertools
import json
import math
import os
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest

from celltrail.plans import all_oracles, all_queries, linking, sql

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        v = pd.Timestamp(v)
        return str(v.tz_convert("UTC").tz_localize(None) if v.tzinfo else v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def records(con, text):
    found = con.execute(text)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def suggestions(con):
    """For each label without id its likeliest terms: every listed form scored in every variant, by force."""
    forms = records(con, f"with {linking._MAP} select normalized_label as c, label, cl_id, term_name from onto")
    spelt = defaultdict(list)
    for r in records(con, f"with {sql.DB}, {sql.variants('select cell_type as label from db where cl is null').strip()} select label, variant from v"):
        spelt[r["label"]].append(r["variant"])
    out = {}
    for label, texts in spelt.items():
        best = {}
        for q, f in itertools.product(texts, forms):
            a, b = set(q.split(" ")), set(f["c"].split(" "))
            if a & b or q in f["c"] or f["c"] in q:
                score = round(0.65 * SequenceMatcher(None, q, f["c"]).ratio() + 0.35 * len(a & b) / len(a | b), 3)
                key = (-score, f["label"])
                if f["cl_id"] not in best or key < best[f["cl_id"]][0]:
                    best[f["cl_id"]] = (key, f)
        ranked = sorted(best.items(), key=lambda x: (x[1][0][0], x[1][1]["term_name"], x[0]))[:5]
        out[label] = [(i, cl, f["term_name"], f["label"], -key[0]) for i, (cl, (key, f)) in enumerate(ranked, 1)]
    return out, spelt


def template(con):
    found, spelt = suggestions(con)
    groups = {r["cell_type"]: r for r in records(con, all_oracles()["unmapped_groups"])}
    lines = []
    for label, g in groups.items():
        for rank, cl, term, form, score in found.get(label) or [(1, None, None, None, None)]:
            lines.append({"cell_type": label, **{k: g[k] for k in ("records", "tissues", "sources")}, "rank": rank, "suggested_cl_id": cl,
                          "suggested_label": form, "suggested_term_name": term, "suggestion_score": score})
    return lines, spelt


def check_fuzzy_candidates(got, con):
    want = {(label, *row) for label, ranked in suggestions(con)[0].items() for row in ranked}
    assert {(r["label"], r["rank"], r["cl_id"], r["term_name"], r["suggestion"], r["score"]) for r in got} == want and len(want) > 50


def check_curation_template(got, con):
    none = {"accepted_cl_id": None, "accepted_label": None, "notes": None}
    key = lambda r: (r["cell_type"], r["rank"])
    assert sorted(got, key=key) == sorted((r | none for r in template(con)[0]), key=key)


def plain_label(text):
    return " ".join((text or "").replace("_", " ").replace("-", " ").lower().split())


def check_auto_accept(got, con):
    lines, spelt = template(con)
    want = {}
    for r in sorted(lines, key=lambda r: r["rank"]):
        fits = {plain_label(r["suggested_label"]), plain_label(r["suggested_term_name"])} & set(spelt[r["cell_type"]])
        if r["suggested_cl_id"] and r["suggestion_score"] >= 0.8 and fits:
            want.setdefault(r["cell_type"], (r["rank"], r["suggested_cl_id"], r["suggested_label"]))
    assert {r["cell_type"]: (r["rank"], r["accepted_cl_id"], r["accepted_label"]) for r in got} == want and want


def check_apply_decisions(got, con):
    """Of labels alike in letters the last seen decides; its id's row is accepted, else the first; every other is cleared."""
    lines, _ = template(con)
    said = {}
    for r in records(con, f"select cell_type, min({sql.cl_id('cell_ontology_id')}) as cl, min(rec_id) as pos from marker_record where cell_type is not null group by 1 order by pos"):
        said.setdefault(plain_label(r["cell_type"]), []).append(r["cl"])
    by = defaultdict(list)
    for r in lines:
        by[plain_label(r["cell_type"])].append(r)
    want = Counter()
    for key, rows_ in by.items():
        last = said[key][-1]
        rows_.sort(key=lambda r: r["rank"])
        rank = next((r["rank"] for r in rows_ if last and r["suggested_cl_id"] == last), 1)
        for r in rows_:
            mine = r["rank"] == rank
            want[r["cell_type"], r["rank"], (last or r["suggested_cl_id"]) if mine else None, r["suggested_label"] if mine else None] += 1
    assert Counter((r["cell_type"], r["rank"], r["accepted_cl_id"], r["accepted_label"]) for r in got) == want


def check_p1_rejected(got, con):
    assert {(r["line_id"], r["reason"]) for r in got} == {(r["line_id"], r["reason"]) for r in records(con, all_oracles()["p1_found"])}
    for r in got:
        assert bool(r["edits"]) == (r["reason"] != "invalid_value")


def payloads(con):
    kind = {bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}
    files = {}
    for r in records(con, "select feed, file_no, file_id, payload from source_record"):
        at = files.setdefault((r["feed"], r["file_no"]), (r["file_id"], defaultdict(Counter)))[1]
        for name, value in json.loads(r["payload"]).items():
            at[name].update([kind[type(value)]] if value is not None else [])
    return files


def check_p6_found(got, con):
    """Fields that went and came are all told, none twice; changed types by force."""
    files = payloads(con)
    by = defaultdict(list)
    for r in got:
        by[r["file_id"]].append((r["change"], r["old_field"], r["new_field"]))
    for feed in {f for f, _ in files}:
        numbers = sorted(n for f, n in files if f == feed)
        for old, new in itertools.pairwise(numbers):
            (_, before), (file_id, now) = files[feed, old], files[feed, new]
            said = by.pop(file_id, [])
            gone = Counter(o for c, o, _ in said if c in ("removed", "renamed"))
            come = Counter(n for c, _, n in said if c in ("added", "renamed"))
            assert gone == Counter(before.keys() - now.keys()) and come == Counter(now.keys() - before.keys())
            main = lambda c: min(c, key=lambda t: (-c[t], t)) if c else None
            retyped = {n for n in before.keys() & now.keys() if main(before[n]) and main(now[n]) and main(before[n]) != main(now[n])}
            assert {o for c, o, n in said if c == "retyped" and o == n} == retyped
    assert not by and any(r["change"] == "renamed" for r in got)


def check_p6_unified(got, con):
    """Every row is there, and no value is lost."""
    given = {r["row_id"]: json.loads(r["payload"]) for r in records(con, "select row_id, payload from source_record")}
    assert Counter(r["row_id"] for r in got) == Counter(dict.fromkeys(given, 1))
    for r in got:
        held = [r[c] for c in ("marker", "cell_type", "tissue", "species") if r[c]] + [x.split("=", 1)[1] for x in r["other"]]
        words = sorted(w for v in held for w in v.split("; "))
        want = [w for v in given[r["row_id"]].values() if v is not None for w in (v if isinstance(v, list) else [v])]
        want = sorted(y for w in want for y in (json.dumps(w) if isinstance(w, bool) else str(w)).split("; ") if y)
        missing = Counter(want) - Counter(words)
        digits = "".join(c for c in r["cl_id"] or "" if c.isdigit()).lstrip("0")
        assert all("".join(c for c in w if c.isdigit()).lstrip("0") in digits for w in missing), (r, given[r["row_id"]])


#: What queries without SQL are held against.
CHECKS = {n[6:]: f for n, f in globals().items() if n.startswith("check_")}


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    df = all_queries()[name](spark, DATA)
    if name not in all_oracles():
        CHECKS[name]([r.asDict() for r in df.collect()], con)  # a query with neither fails here
        return
    got = rows(df.columns, df.collect())
    want = con.execute(all_oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, want.fetchall())
