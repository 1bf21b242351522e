"""Overlaps, related splits, copies and response defects."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from celltrail.llm.copies import collapse_copies, find_copies, marker_words, words
from celltrail.llm.overlap import marker_set, overlap_counts, overlap_pairs
from celltrail.llm.related import assign_splits, related_groups, related_splits, spanning_forest
from celltrail.llm.responses import _REFUSALS, declines, defective, defects, says_nothing

EXAMPLE = (
    "example_id bigint, split string, tissue string, cell_type string, source string, markers array<string>, prompt string, "
    "metadata struct<original_markers:array<string>>, extra string"
)


def example(i, split="train", markers=None, prompt=None, original=None, source=None, tissue=None, cell_type=None):
    return (i, split, tissue, cell_type, source, markers, prompt, (original,), "x")


def test_overlap_against_brute_force(spark):
    rng = random.Random(3)
    rows, sets = [], {}
    for i in range(400):
        size = rng.choice([0, 1, 2, 3, 4, 5, 8, 12, 30])
        base = rng.sample(range(40), min(size, 40)) if rng.random() < 0.4 or not sets else list(rng.choice(list(sets.values()))[1])
        for _ in range(rng.randint(0, 2)):
            if base:
                base[rng.randrange(len(base))] = rng.randrange(60)
        split = rng.choice(["train", "train", "validation", "test", "other"])
        sets[i] = (split, set(base))
        rows.append(example(i, split, [f" g{m} " if rng.random() < 0.3 else f"G{m}" for m in base]))
    got = {tuple(r) for r in overlap_pairs(spark.createDataFrame(rows, EXAMPLE)).collect()}
    want = set()
    for i, (a, x) in sets.items():
        for j, (b, y) in sets.items():
            if i < j and (a == "train") != (b == "train") and "other" not in (a, b) and x | y and len(x & y) >= 0.7 * len(x | y) - 1e-9:
                want.add((i, j))
    assert got == want and len(want) > 50


@pytest.mark.parametrize("prompt", [
    "Tissue: Lung\n\nCluster markers:\nAB1, CD-2; EF3", "tissue = Lung | markers = AB1 / CD-2 / EF3", "Lung: AB1 CD-2 EF3",
    "A cluster from Lung expresses: AB1, CD-2, EF3. Name the cell type.", "Which cell type in Lung has these markers: AB1\nCD-2\nEF3?",
    "[Lung]\nTop genes -> AB1, CD-2, EF3",
])
def test_markers_in_prompt(spark, prompt):
    df = spark.createDataFrame([example(1, markers=[], prompt=prompt), example(2, markers=None, prompt=prompt, original=["q"])], EXAMPLE)
    got = {r.example_id: r.m for r in df.select("example_id", marker_set(df).alias("m")).collect()}
    assert got == {1: ["AB1", "CD-2", "EF3"], 2: ["Q"]}


def test_overlap_edges(spark):
    rows = [example(1, "train", ["A", None, " "]), example(2, "test", ["a"]), example(3, "test", None), example(4, None, ["A"]), example(5, "validation", ["a"] * 3000)]
    df = spark.createDataFrame(rows, EXAMPLE)
    assert {tuple(r) for r in overlap_pairs(df).collect()} == {(1, 2), (1, 5)}
    assert overlap_pairs(df.limit(0)).count() == 0
    counts = {r.split: (r.records, r.overlapping, r.exact) for r in overlap_counts(df).collect()}
    assert counts == {"test": (1, 1, 1), "validation": (1, 1, 1)}


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(parent):
        groups[find(x)].add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
    [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(150)],
], ids=["path", "star", "random"])
def test_forest(spark, edges):
    roots, forest = spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = defaultdict(set)
    for r in roots.collect():
        got[r.root].add(r.v)
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {frozenset(g) for g in got.values()} == want
    kept = [tuple(r) for r in forest.collect()]
    assert union_find(kept) == want and len(kept) == sum(len(g) - 1 for g in want)


def test_related(spark):
    rows = [
        example(5, source="Atlas A; b-set"), example(3, source="ATLAS_a"), example(9, source="B set"), example(7, tissue="Lung ", cell_type="T-cell"),
        example(8, tissue="lung", cell_type="t cell", source=" ; "), example(4, tissue="lung"), example(2), example(1, tissue="", cell_type=""),
    ]
    df = spark.createDataFrame(rows, EXAMPLE)
    got = {r.example_id: r.group_id for r in related_groups(df).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 7: 7, 8: 7, 4: 4, 2: 2, 1: 1}
    assert related_groups(df.limit(0)).count() == 0 and related_splits(df.limit(0)).count() == 0


def test_split_shares(spark):
    rng = random.Random(5)
    sizes = [3000, 900, 400] + [rng.choice([1, 1, 2, 3, 5, 9]) for _ in range(2000)]
    rows = [(g,) for g, n in enumerate(sizes) for _ in range(n)]
    dealt = assign_splits(spark.createDataFrame(rows, "group_id bigint"))
    assert dealt.count() == len(sizes) == dealt.select("group_id").distinct().count()
    share = {r.split: r.n / len(rows) for r in dealt.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert abs(share["train"] - 0.8) < 0.01 and abs(share["validation"] - 0.1) < 0.01 and abs(share["test"] - 0.1) < 0.01
    with pytest.raises(ValueError, match="add up"):
        assign_splits(spark.createDataFrame(rows, "group_id bigint"), {"train": 0.8, "test": 0.1})


MARKER = "rec_id bigint, tissue string, cell_type string, markers string, copies string"


def test_copies(spark):
    rows = [
        (4, "Lung", "T-cell CD4+", "AB1, CD2", "x"), (2, "LUNG ", "t​ cell  cd4+", "cd2;ab-1|AB1", "x"), (3, "lung", "T cell CD4", "AB1,CD2", "x"),
        (7, None, "", None, None), (6, "", None, " , ", None), (9, "Ｌung", "T cell cd4 +", "ab1 cd2", "x"), (9, "Lung", "T cell CD4+", "ab1 cd2", "x"),
    ]
    df = spark.createDataFrame(rows, MARKER)
    want = {(2, 4), (2, 9), (6, 7)}
    for limit in (1, 2, 10**6):
        assert {tuple(r) for r in find_copies(df, rows_per_task=limit).collect()} == want
    kept = {r.rec_id: r._copies for r in collapse_copies(df, rows_per_task=2).collect()}
    assert kept == {2: 4, 3: 1, 6: 2}
    assert find_copies(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "a " * 100_000, "b", "c", ""), (2, "A " * 100_000, "b", "c", "")], MARKER)
    assert find_copies(long).count() == 1


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_formatting_does_not_matter(text):
    assert words(text) == words(f"  {words(text)}. ") and marker_words(text) == marker_words(text + " ;, ")
    assert words(text.replace("a", "a​")) == words(text)


QUESTION = "Tissue: Lung\n\nCluster markers:\nAB12, CD34, EF56"
GOOD = "Cell type: T cell\nConfidence: 0.90\n\nReasoning: AB12 and CD34 are well-known signs of the T cell."


@pytest.mark.parametrize(("response", "want"), [
    (GOOD, []), (QUESTION + "\n\n" + GOOD, []), ("T cell.", []), ('{"cell_type": "T cell", "reasoning": "AB12 is a sign of it"}', []),
    ("Reasoning: I am sorry to see few negative markers, yet the call is clear. A doublet cannot be ruled out completely.", []),
    ("Reasoning: AB12 forms what older notes call a 'Zwischenzelle' signature, today read as a T cell.", []),
    (None, ["empty"]), ("", ["empty"]), (" \n​", ["empty"]), ("N/A", ["empty"]), ("Cell type:\nConfidence:\n\nReasoning:", ["empty"]),
    ('{"cell_type": "", "reasoning": ""}', ["empty"]), ("```\n```", ["empty"]), ("...", ["empty"]),
    (GOOD[:-9], ["truncated"]), ("Cell type: T ce", ["truncated"]), ("Cell type: T cell\nCell Ontology ID: CL:00", ["truncated"]),
    ("Cell type: T cell\nConfidence: 0.", ["truncated"]), ('{"cell_type": "T cell", "reas', ["truncated"]), (GOOD[:-1] + "...", ["truncated"]),
    ("I'm sorry, but I can't determine the cell type from this request.", ["refusal"]), ("Answering is against the policy I operate under.", ["refusal"]),
    ("Tut mir leid, das kann ich nicht beantworten und es ist nicht erlaubt.", ["refusal", "language"]),
    ("Sure! " + QUESTION + ".", ["copy"]), (QUESTION.lower() + "!", ["copy"]),
    ("Dieser Cluster besteht sehr wahrscheinlich aus T cell, weil AB12 und CD34 stark exprimiert werden.", ["language"]),
    ("Тип клеток: T cell. Гены AB12 хорошо известны.", ["language"]),
])
def test_defects(response, want):
    assert defects(response, QUESTION, "T cell", 0.9) == want


# One answer for each phrase that declines, in the order of the rules.
DECLINED = [
    ["I cannot help with that.", "We won't answer this."], ["I am unable to name it.", "I'm not authorized to determine this."], ["Sorry, but I pass."],
    ["I respectfully decline.", "I must refuse."], ["The lab declines this request.", "Your request was rejected."], ["This can't be answered."],
    ["Answering is against our guidelines."], ["That is not something we do."], ["This is beyond my scope."], ["I leave this to an expert."],
    ["As an AI I cannot say."], ["No answer is provided.", "No label was given."], ["I am not going to say it.", "It is not permitted to do so."],
    ["Das kann ich nicht beantworten.", "Das tut mir leid."], ["Je ne peux pas vous aider.", "Désolé, c'est tout."], ["Lo siento.", "No puedo responder."],
    ["Mi dispiace.", "Desculpe.", "Non posso aiutarti."], ["Я не могу ответить.", "Извините."], ["Przykro mi, ale nie.", "Nie mogę pomóc."],
    ["抱歉。", "无法回答", "申し訳ありません"], ["Ik kan u niet helpen.", "Helaas kan ik dat niet."],
]


def test_every_phrase_that_declines():
    assert len(DECLINED) == len(_REFUSALS)
    for (hint, phrase), answers in zip(_REFUSALS, DECLINED, strict=True):
        for answer in answers:
            low = answer.lower()
            assert re.search(hint, low) and re.search(phrase, low), answer
            assert declines(answer) and "refusal" in defects(answer, QUESTION, None, None)


@pytest.mark.parametrize(("response", "want"), [
    ("Cell type: T cell\n\nReasoning: AB12 is known (see the atlas of 2020.", ["truncated"]), ("Reasoning: it is the “classic pattern.", ["truncated"]),
    ('Reasoning: the atlas says "T cell and more.', ["truncated"]), ("Reasoning: this is fine :( but known.", []), ('Reasoning: a gap of 5" (or so) is known.', []),
    ("Tämä ryhmä on hyvin todennäköisesti T cell, koska geenit ovat vahvasti ilmentyneitä.", ["language"]),
    ("Bu küme büyük olasılıkla T cell, çünkü genler güçlü bir şekilde ifade ediliyor.", ["language"]),
    ("AB12, CD34 and EF56 in Lung.", []), ("Lung cluster: EF56 markers AB12 tissue CD34.", []), ("Tissue: Lung\n\nCluster markers:\nAB12, CD34, EF56.", ["copy"]),
])
def test_open_ends_languages_and_copies(response, want):
    assert defects(response, QUESTION, "T cell", 0.9) == want


@pytest.mark.parametrize("response", [" \n" * 50_000, "-" * 50_000, "null, " * 200, "Cell type:\n\nReasoning: ...\n" * 100, '{"cell_type": null}\n' * 100])
def test_long_answers_that_say_nothing(response):
    assert defects(response, QUESTION, None, None) == ["empty"]
    assert not says_nothing(response + "T cell.")


def test_defective(spark):
    p = spark.createDataFrame(
        [(1, 1, QUESTION, None, None, "e"), (1, 1, QUESTION, None, None, "e"), (2, 9, QUESTION + ".", None, float("nan"), "e"), (3, None, None, None, 0.5, "e"), (4, 1, GOOD, "T cell", 0.9, "e")],
        "pred_id bigint, example_id bigint, raw_response string, cell_type string, confidence double, prompt string",
    )
    e = spark.createDataFrame([(1, QUESTION, "e"), (1, None, "e"), (2, None, "e")], "example_id bigint, prompt string, raw_response string")
    assert {tuple(r) for r in defective(p, e).collect()} == {(1, "copy"), (3, "empty")}
    assert defective(p.limit(0), e).count() == 0 and defective(p, e.limit(0)).count() == 2
