"""Label mapping, packing, leaks and subjects."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from celltrail.llm.label_map import edits, map_labels, map_rows
from celltrail.llm.leaks import exact_leaks, find_leaks, myers, text_words
from celltrail.llm.packing import TOKENIZERS, best_two_fit, pack_documents, packing_report, token_counts
from celltrail.llm.subjects import Counts, Encoded, Languages, Lengths, corpus_shares, document_subjects, encode, models_from, pack, sentences, subject_shares, unpack

TERMS = "cl_id string, name string, synonyms array<struct<text:string,scope:string>>, is_obsolete boolean, label string"
LIST = [
    ("CL:1", "type 1 gorbalix cell", [("GRBC12", "EXACT"), ("immature lineage 3 element", "RELATED")], False, "x"),
    ("CL:2", "type 2 gorbalix cell", [], False, "x"), ("CL:3", "XF2-positive tremolat neuron", [("XF2+ tremolat neuron", "EXACT")], None, "x"),
    ("CL:4", "marginal tremolat neuron", None, False, "x"), ("CL:5", "tremolat neuron", [], False, "x"), ("CL:6", "oldish fibre", [], True, "x"),
]


MEANT = [
    ("Type_1_Gorbalix_Cells", "CL:1"), ("type I gorbalxi cell", "CL:1"), ("gorbalix cell, type 2", "CL:2"), ("GRBC12 cells", "CL:1"), ("grbc-12", "CL:1"),
    ("GRBC13", "unmatched"), ("type 3 gorbalix cell", "unmatched"), ("gorbalix cell", "unmatched"), ("XF2 pos tremolat neurons ?", "CL:3"),
    ("xf2+​ tremolat  neuron (cluster 7)", "CL:3"), ("tr3molat neuron", "CL:5"), ("~margnal tremolta neuron [Lung]", "CL:4"),
    ("tremolat fibre", "unmatched"), ("oldish fibre", "unmatched"), ("immature lineage 3 element", "unmatched"), ("cluster 4", "unmatched"),
    ("12: Tremolat neuron; donor 3", "CL:5"), ("", "unmatched"), ("​", "unmatched"), ("z" * 5000, "unmatched"),
]


def test_labels(spark):
    df = spark.createDataFrame([(label,) for label, _ in MEANT] * 2 + [(None,)], "label string")
    got = [(r.label, r.cl_id) for r in map_labels(df, spark.createDataFrame(LIST, TERMS)).collect()]
    assert sorted(got) == sorted(MEANT)


def test_label_blocks_and_edges(spark):
    terms = spark.createDataFrame(LIST, TERMS)
    df = spark.createDataFrame([("tremolat neuron?",), ("type 2 gorbalix cell.",)], "label string")
    by = [{tuple(r)[:2] for r in map_labels(df, terms, forms_per_block=n).collect()} for n in (1, 2, 1000)]
    assert by[0] == by[1] == by[2] == {("tremolat neuron?", "CL:5"), ("type 2 gorbalix cell.", "CL:2")}
    assert [r.cl_id for r in map_labels(df, terms.limit(0)).collect()] == ["unmatched"] * 2
    # Terms with several forms that a label matches alike, in any cut of the list.
    twice = [
        ("CL:7", "QH5-positive pludraston cell", [("QH5+ pludraston cell", "EXACT"), ("pludraston cell QH5 pos", "EXACT")], False, "x"),
        ("CL:8", "velm of kind 3", [("kind 3 velm", "EXACT"), ("velm", "EXACT")], False, "x"), ("CL:9", "kind 4 zorb", None, False, "x"),
    ]
    said = ["QH5+ pludraston cell", "velm kind 3", "Velms (kind 4)", "zorb, kidn 4", "kind 4 velm zorb", "qh-5 positive pludrastn cell", "velm; donor 3"]
    asked = spark.createDataFrame([(x,) for x in said], "label string")
    by = [{tuple(r)[:2] for r in map_labels(asked, spark.createDataFrame(LIST + twice, TERMS), forms_per_block=n).collect()} for n in (1, 2, 3, 5, 1000)]
    assert all(b == by[-1] for b in by)
    want = ["CL:7", "CL:8", "unmatched", "CL:9", "unmatched", "CL:7", "CL:8"]
    assert by[-1] == set(zip(said, want, strict=True))
    rows = spark.createDataFrame([("a", 1, "tremolat neuron"), ("a", 2, "Tremolat neuron"), ("b", 2, None), ("b", 3, "?")], "src string, row_id bigint, label string")
    assert {tuple(r) for r in map_rows(rows, terms).collect()} == {("a", 2, "CL:5"), ("b", 3, "unmatched")}
    assert map_rows(rows.limit(0), terms).count() == 0


def plain_edits(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_edits(a, b):
    assert edits(a, b) == plain_edits(a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.lists(st.sampled_from("abc"), max_size=9))
def test_myers(pattern, text):
    best = len(pattern)
    row = list(range(len(pattern) + 1))
    for w in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, row[-1])
    assert myers(pattern, text, 99)[0] == best


DOCS = "doc_id bigint, text string, item_id bigint"


def test_leaks_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 11, 12, 20, 40])))) for i in range(30)]
    docs = []
    for i in range(200):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        if rng.random() < 0.6:
            source = rng.choice(items)[1].split()
            a = rng.randrange(len(source))
            part = source[a : a + rng.randint(8, 25)]
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "zz"
            words[5:5] = part
        docs.append((i, ", ".join(words).upper(), 0))
    docs += [(900, None, 0), (901, "", 0), (902, " ".join(vocabulary) * 5000, 0)]
    got = {tuple(r) for r in exact_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = set()
    for d, text, _ in docs:
        w = text_words(text)
        windows = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for k, item in items:
            v = text_words(item)
            if any(tuple(v[i : i + 12]) in windows for i in range(len(v) - 11)):
                want.add((d, k))
    assert got == want and len(want) > 10
    salted = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id bigint, text string"), rows_per_task=2)
    assert {(r.doc_id, r.item_id) for r in salted.where("exact > 0").collect()} == want


def test_near_leaks(spark):
    words = [f"w{i}" for i in range(14)]
    changed, lost, apart = words[:], words[:], words[:]
    changed[5] = "zz"
    del lost[6]
    apart[3], apart[9] = "y", "z"
    docs = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate((words, changed, lost, apart))], DOCS)
    items = spark.createDataFrame([(1, " ".join(words[:12]))], "item_id bigint, text string")
    assert {(r.doc_id, r.distance) for r in find_leaks(docs, items).collect()} == {(0, 0), (1, 1), (2, 1)}
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_bins(sizes):
    bins = best_two_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    # First fit needs under twice the room; this never does worse than that.
    assert len(bins) <= 2 * -(-sum(sizes) // 50) + 1


def test_bin_beats_greedy():
    assert len(best_two_fit([6, 3, 4, 5, 2], 10)) == 2


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 5, 40, 300, 700, 1024, 1025, 5000])) for i in range(3000)] + [(1, 7), (9999, None)]
    sized = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    for per in (200, 10**6):
        packed = pack_documents(sized, items_per_bucket=per)
        assert packed.agg(F.sum("size")).first()[0] == sum(n or 0 for _, n in rows)
        assert packed.groupBy("container").agg(F.sum("size").alias("s")).where("s > 1024").count() == 0
        report = packing_report(packed).first()
        assert report.containers <= 1.02 * report.least_containers + 2
    short = packed.join(sized.where("n_tokens <= 1024").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id").where("piece > 0 and doc_id != 1")
    assert short.count() == 0
    assert packing_report(pack_documents(sized.limit(0))).first().containers == 0


@pytest.mark.skipif(not os.path.isdir(TOKENIZERS), reason="no tokenizers")
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a " * 50_000)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] >= 50_000


def test_sentences():
    assert sentences("One two. Three! Four 12?") == [["one", "two"], ["three"], ["four", "12"]]
    assert sentences(None) == [] and sentences(" ") == []
    words, lengths = encode("One two 7. Three 12!")
    assert lengths.tolist() == [3, 2] and words[2] == words[4] and len(set(words.tolist())) == 4


def test_stretches_without_stops():
    cut, many = Lengths(usual=10.0, lost=25.0).cut(np.array([8, 25, 26, 100], np.int32))
    assert cut.tolist() == [8, 25, 8, 9, 9] + [10] * 10 and cut.sum() == 159 and many.tolist() == [1, 1, 3, 10]
    (_, *lot), = pack([encode("a b c. " + "d " * 30), encode(None), encode("e f.")])
    texts = unpack(*lot, Lengths(usual=10.0, lost=25.0))
    assert texts.lengths.tolist() == [3, 10, 10, 10, 2] and texts.sentences.tolist() == [4, 1]
    prose = np.array([30, 45, 60], np.int32)  # ordinary where the corpus is like that
    assert Lengths(usual=40.0, lost=80.0).cut(prose)[0].tolist() == prose.tolist()


def test_models_are_probabilities():
    # Two subjects, words 0-5; P(w | v) of each subject sums to one over the words that follow v.
    rng = np.random.default_rng(1)
    languages = Languages(["en"], np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(1))
    counts = Counts(3)
    lengths = np.full(400, 6, np.int32)
    words = rng.integers(0, 6, 2400).astype(np.uint64)
    texts = Encoded(words, lengths, np.ones(400, np.int64))
    post = rng.random((400, 2)) * 0.5
    counts.add(texts, np.zeros(400, np.int64), np.concatenate([np.ones((400, 1)), post], axis=1))
    rows = pd.concat(list(counts.frames()))
    models = models_from(["a", "b"], languages, Lengths(), rows, focus=0.0)
    pairs = rows[rows["kind"] == 1]
    for _, some in pairs.groupby("before"):
        gain = models.pairs.rows[models.pairs.find(some["key"].to_numpy(np.int64).view(np.uint64))]
        base = (some["c0"] / some["c0"].sum()).to_numpy()[:, None]
        assert np.allclose((np.exp(gain) * base).sum(axis=0), 1.0, atol=0.02)


NOUNS = {
    "en": {"law": ["judges", "courts", "verdicts", "appeals", "cells"], "music": ["songs", "choirs", "violins", "drums", "scales"], "biology": ["genes", "cells", "enzymes", "tissues", "neurons"]},
    "de": {"law": ["richter", "gerichte", "urteile", "berufungen"], "music": ["lieder", "chöre", "geigen", "trommeln"], "biology": ["gene", "zellen", "enzyme", "gewebe"]},
}
PLAIN = {"en": "the {} followed the {} near the old {} for many years", "de": "die {} folgten den {} nahe der alten {} viele jahre lang"}
OTHER = {"en": ["gardens", "trains", "letters", "streets"], "de": ["gärten", "züge", "briefe", "straßen"]}


def corpus(n, seed):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(n):
        lang = rng.choice(["en", "de"])
        subjects = rng.sample(sorted(NOUNS[lang]), rng.choice([1, 1, 2]))
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice([*subjects, *subjects, None])
            a, b = rng.sample(NOUNS[lang][s], 2) if s else rng.sample(OTHER[lang], 2)
            parts.append((s, PLAIN[lang].format(a, b if rng.random() < 0.6 else rng.choice(OTHER[lang]), rng.choice(OTHER[lang]))))
        docs.append((i, ". ".join(p for _, p in parts) + ".", rng.choice([lang, lang.upper(), lang + "-XX", None]), "x"))
        truth[i] = {s for s in subjects if sum(p == s for p, _ in parts) >= 0.25 * len(parts)}
        if rng.random() < 0.08 and truth[i]:
            labels.append((i, rng.choice(sorted(truth[i])) if rng.random() < 0.95 else "law", "a"))
    return docs, labels, truth


def test_subjects_on_held_out_truth(spark):
    docs, labels, truth = corpus(2500, 4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, subject string").repartition(4)
    la = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    su = spark.createDataFrame([(s, s) for s in ("law", "music", "biology")], "subject string, description string")
    got = {}
    for r in document_subjects(d.drop("subject"), la, su).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    hit = sum(len(truth[i] & got.get(i, set())) for i in truth)
    said, true = sum(map(len, got.values())), sum(map(len, truth.values()))
    assert hit / said > 0.95 and hit / true > 0.95


def test_subject_edges(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "a b c", "xx")], "doc_id bigint, text string, lang string")
    la = spark.createDataFrame([(9, "law"), (3, "none such"), (3, None)], "doc_id bigint, subject string")
    su = spark.createDataFrame([("law",)], "subject string")
    assert document_subjects(d, la, su).count() == 0
    assert document_subjects(d, la, su.limit(0)).count() == 0
    assert document_subjects(d.limit(0), la, su).count() == 0
    shares = {(r.doc_id, r.subject): (r.sentences, r.of) for r in subject_shares(d, la.limit(0), su).collect()}
    assert shares == {(3, "none"): (1, 1)} == {(r.doc_id, r.subject): (r.sentences, r.of) for r in subject_shares(d, la, su.limit(0)).collect()}
    assert [(r.subject, r.documents, r.share) for r in corpus_shares(d, la.limit(0), su).collect()] == [("none", 1, 1.0)]
    assert corpus_shares(d.limit(0), la, su).count() == 0
