"""Mapping free-entered labels to a canonical list.

Labels are made distinct, normalised, and scored against every form (name or
exact synonym) of the list through an inverted index of character n-grams with
inverse-frequency weights: weighted cosine. Every form above a threshold then
has to account for the label word by word (misspelled words may differ by few
edits, numbers not at all), and the winner must lead the next term by a margin;
otherwise the label is unmatched.

The list is cut into blocks of about ``forms_per_block`` forms, all forms of a
term in one block. Labels and blocks meet in tasks of bounded size; a block says
which forms account for a label but for leftover words, and which of the
label's words mean something in it. What all blocks say together decides, so
the result doesn't depend on their size. Nothing of the list is kept on the
driver but a table of fixed size with n-gram frequencies.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from celltrail.llm.visible import visible
from celltrail.session import cut_lineage, salted_join, shuffle_width

THRESHOLD = 0.2
MARGIN = 0.02
FORMS_PER_BLOCK = 20_000
LABELS_PER_TASK = 20_000
UNMATCHED = "unmatched"
#: Places of the table of n-gram frequencies.
GRAMS = 1 << 16
#: Scores and postings that a worker holds at once.
CELLS = 1_000_000

_TOKEN = re.compile(r"[^\W_]+")
_PLUS = re.compile(r"(?<=[^\W_])\+")
# Roman numerals of small series.
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6"}
# Digits typed for the letters they look like.
_LOOK = str.maketrans("0135", "oles")


def raw_tokens(text: str) -> list[str]:
    """Runs of letters and digits; a plus sign after one is the word ``positive``."""
    return _TOKEN.findall(_PLUS.sub(" positive ", visible(text)))


def numbered(raw: list[str]) -> list[tuple[str, str]]:
    """Words with the number that follows them, Roman numerals as digits."""
    pairs = zip(raw, raw[1:], strict=False)
    return [(a, _ROMAN.get(b, b)) for a, b in pairs if a.isalpha() and (b.isdigit() or b in _ROMAN)]


def tokens(raw: list[str], series: frozenset[str] = frozenset(), codes: frozenset[str] = frozenset()) -> tuple[str, ...]:
    """Words in singular; ``XF2 pos`` as ``xf2 positive``; numbers of a series, and codes, in one word."""
    out: list[str] = []
    for t in raw:
        last = out[-1] if out else ""
        if t in ("pos", "positive") and any(c.isdigit() for c in last):
            out.append("positive")
        elif t.isdigit() and last.isalpha() and last + t in codes:
            out[-1] = last + t
        elif series and last.isalpha() and (t.isdigit() or t in _ROMAN) and (word := _series(last, series)):
            out[-1] = word + _ROMAN.get(t, t)
        elif len(t) > 3 and t.endswith("s") and not t.endswith("ss"):
            out.append(t[:-1])
        else:
            out.append(t)
    return tuple(out)


def _series(word: str, series: frozenset[str]) -> str | None:
    if word in series:
        return word
    return next((s for s in sorted(series) if len(s) > 3 and edits(word, s) == 1), None)


@lru_cache(maxsize=200_000)
def _word_grams(w: str) -> tuple[int, ...]:
    """Places of a padded word's character bigrams and trigrams, and twice of the whole word if it holds a digit."""
    found = []
    if any(c.isdigit() for c in w):
        found += ["=" + w] * 2
        w = w.translate(_LOOK) if sum(c.isdigit() for c in w) == 1 and len(w) > 4 else w
    padded = f" {w} "
    for n in (2, 3):
        found += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
    return tuple(crc32(g.encode()) % GRAMS for g in found)


def grams(raw: list[str]) -> Counter:
    """N-gram places of a text, a number being one word with the word before it."""
    count: Counter = Counter()
    words: list[str] = []
    for t in tokens(raw):
        if t.isdigit() and words and words[-1].isalpha():
            words[-1] += t
        else:
            words.append(t)
    for w in words:
        count.update(_word_grams(w))
    return count


@lru_cache(maxsize=500_000)
def edits(a: str, b: str) -> int:
    """Edits between two words, a swap of neighbours being one."""
    if a == b:
        return 0
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
    return row[-1]


def allowed(word: str) -> int:
    """How many edits a listed word may suffer: none with a digit or under four letters."""
    if len(word) < 4 or any(c.isdigit() for c in word):
        return 0
    return 1 if len(word) < 7 else 2


def word_cost(typed: str, listed: str) -> int | None:
    """Edits from a listed to a typed word, or None if they can't be the same."""
    if typed == listed:
        return 0
    most = allowed(listed)
    if not most or abs(len(typed) - len(listed)) > most:
        return None
    cost = min(edits(typed, listed), edits(typed.translate(_LOOK), listed) + 1 if any(c.isdigit() for c in typed) else 99)
    return cost if cost <= most else None


def _letters(word: str) -> int:
    """The letters of a word as bits; an edit changes two at most."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits


class FormIndex:
    """Inverted n-gram index of a block of forms, with the words that tell its terms apart."""

    def __init__(self, forms: list[tuple[str, str]], idf: np.ndarray):
        raw = [raw_tokens(text) for _, text in forms]
        kept = [i for i, r in enumerate(raw) if r]
        raw = [raw[i] for i in kept]
        self.ids = [forms[i][0] for i in kept]
        self.series = [frozenset(a for a, _ in numbered(r)) for r in raw]
        self.words = [tokens(r, s) for r, s in zip(raw, self.series, strict=True)]
        self.codes = [frozenset(w for w in ws if not w.isdigit() and any(c.isdigit() for c in w)) for ws in self.words]
        self.of_term: dict[str, set[str]] = defaultdict(set)
        for cl, w in zip(self.ids, self.words, strict=True):
            self.of_term[cl].update(w)
        self.joined: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.joined["".join(w)].append(i)
        self.idf = idf
        # Postings by gram, one after another.
        rows = [(g, i, n * idf[g]) for i, r in enumerate(raw) for g, n in grams(r).items()]
        rows.sort(key=lambda x: x[0])
        gram = np.array([r[0] for r in rows], np.int64)
        self.post_form = np.array([r[1] for r in rows], np.int64)
        self.post_value = np.array([r[2] for r in rows], float)
        self.post_size = np.bincount(gram, minlength=GRAMS)
        self.post_start = np.cumsum(self.post_size) - self.post_size
        norms = np.sqrt(np.bincount(self.post_form, self.post_value**2, len(self.ids)))
        self.norms = np.where(norms > 0, norms, 1.0)
        self.vocabulary = sorted({w for ws in self.words for w in ws})
        at = {w: i for i, w in enumerate(self.vocabulary)}
        self.form_words = np.array([at[w] for ws in self.words for w in ws], np.int64)
        self.form_sizes = np.array([len(ws) for ws in self.words], np.int64)
        self.form_starts = np.cumsum(self.form_sizes) - self.form_sizes
        self.bits = np.array([_letters(w) for w in self.vocabulary], np.uint64)
        self.lengths = np.array([len(w) for w in self.vocabulary], np.int64)
        self.most = np.array([allowed(w) for w in self.vocabulary], np.int64)
        self.at = at
        # Series words by the number that follows them.
        self.by_number: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for w, i in at.items():
            if found := re.fullmatch(r"([^\W\d_]+)(\d+)", w):
                self.by_number[found[2]].append((found[1], i))
        self._matches: dict[str, np.ndarray] = {}
        self._pairs: dict[tuple[str, str], np.ndarray] = {}

    def cosines(self, vectors: list[Counter]) -> np.ndarray:
        """Weighted cosine of each vector with each form."""
        n = len(self.ids)
        gram = np.array([g for v in vectors for g in v], np.int64)
        weight = np.array([c for v in vectors for c in v.values()], float) * self.idf[gram]
        row = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        norm = np.sqrt(np.bincount(row, weight**2, len(vectors)))
        size = self.post_size[gram]
        before = np.cumsum(size) - size
        at = np.repeat(self.post_start[gram] - before, size) + np.arange(size.sum())
        cell = np.repeat(row * n, size) + self.post_form[at]
        score = np.bincount(cell, np.repeat(weight, size) * self.post_value[at], len(vectors) * n)
        return score.reshape(len(vectors), n) / self.norms / np.where(norm > 0, norm, 1.0)[:, None]

    def matches(self, word: str) -> np.ndarray:
        """Places of the listed words that a typed word may be."""
        if word not in self._matches:
            if len(self._matches) > 200_000:
                self._matches.clear()
            tried = {word, word.translate(_LOOK)} if any(c.isdigit() for c in word) else {word}
            near = np.zeros(len(self.vocabulary), bool)
            for w in tried:
                apart = np.bitwise_count(self.bits ^ np.uint64(_letters(w)))
                near |= (apart <= 2 * self.most) & (np.abs(self.lengths - len(w)) <= self.most)
            found = [i for i in np.flatnonzero(near) if word_cost(word, self.vocabulary[i]) is not None]
            self._matches[word] = np.array(found, np.int64)
        return self._matches[word]

    def pair_matches(self, word: str, number: str) -> np.ndarray:
        """Places of the listed words of a series that a word with a number may be."""
        key = (word, number)
        if key not in self._pairs:
            if len(self._pairs) > 200_000:
                self._pairs.clear()
            near = [i for x, i in self.by_number.get(number, ()) if x == word or (len(x) > 3 and edits(word, x) == 1)]
            self._pairs[key] = np.array(near, np.int64)
        return self._pairs[key]

    def cost(self, typed: tuple[str, ...], form: int) -> tuple[int, list[str]] | None:
        """Edits that make the label this form plus leftover words, and these; None if words of the form are missing."""
        left, total = list(typed), 0
        for listed in sorted(self.words[form], key=allowed):
            costs = [(c, i) for i, w in enumerate(left) if (c := word_cost(w, listed)) is not None]
            if not costs:
                return None
            cost, at = min(costs)
            total += cost
            left.pop(at)
        return total, left

    def read(self, labels: list[str]) -> Iterator[tuple[str, list[str], list[tuple[str, float, int, str, list[str]]]]]:
        """(label, its words that mean something here, hits) of each label; a hit is (id, cosine, edits, form, leftover words)."""
        lot: list[tuple[str, list[str], Counter]] = []
        size = 0
        for label in labels:
            if raw := raw_tokens(label):
                vector = grams(raw)
                lot.append((label, raw, vector))
                size += len(self.ids) + sum(self.post_size[g] for g in vector)
                if size > CELLS:
                    yield from self._lot(lot)
                    lot, size = [], 0
        if lot:
            yield from self._lot(lot)

    def _lot(self, lot: list[tuple[str, list[str], Counter]]) -> Iterator[tuple]:
        for (label, raw, _), score in zip(lot, self.cosines([v for _, _, v in lot]), strict=True):
            yield label, *self._one(raw, score)

    def _one(self, raw: list[str], score: np.ndarray) -> tuple[list[str], list[tuple[str, float, int, str, list[str]]]]:
        typed, pairs = tokens(raw), numbered(raw)
        known: set[str] = set()
        there = np.zeros(len(self.vocabulary), bool)
        for w in typed:
            if len(found := self.matches(w)):
                there[found] = True
                known.add(w)
        for a, n in pairs:
            if len(found := self.pair_matches(a, n)):
                there[found] = True
                known.add(a + n)
                known.update(self.vocabulary[i] for i in found)
        whole = np.add.reduceat(there[self.form_words], self.form_starts, dtype=np.int64) == self.form_sizes
        best: dict[str, tuple] = {}
        read: dict[tuple, tuple[str, ...]] = {}
        for i in np.flatnonzero(whole & (score >= THRESHOLD)):
            how = (self.series[i], self.codes[i])
            if how not in read:
                read[how] = tokens(raw, *how) if how[0] or how[1] else typed
            if found := self.cost(read[how], int(i)):
                self._keep(best, int(i), score, *found, pairs)
        for i in self.joined.get("".join(typed), ()):
            if score[i] >= THRESHOLD:
                self._keep(best, i, score, 0, [], pairs)
        return sorted(known), [hit for hits in best.values() for hit in hits]

    def _keep(self, best: dict, form: int, score: np.ndarray, cost: int, left: list[str], pairs: list[tuple[str, str]]) -> None:
        cl = self.ids[form]
        strange = {w for w in left if w not in self.of_term[cl]}
        strange |= {a + n for a, n in pairs if a in strange and a + n not in self.of_term[cl]}
        hit = (cl, float(score[form]), cost, " ".join(self.words[form]), sorted(strange))
        best.setdefault(cl, []).append(hit)


def list_forms(terms: DataFrame, scopes: tuple[str, ...] = ("EXACT",)) -> DataFrame:
    """(``cl_id``, ``form``, ``is_name``) of all terms in use: names and synonyms of the given scopes."""
    used = terms.where(~F.coalesce("is_obsolete", F.lit(False)) & F.col("cl_id").isNotNull())
    names = used.select("cl_id", F.col("name").alias("form"), F.lit(True).alias("is_name"))
    synonyms = used.select("cl_id", F.explode("synonyms").alias("s")).where(F.upper("s.scope").isin(*scopes))
    both = names.unionByName(synonyms.select("cl_id", F.col("s.text").alias("form"), F.lit(False).alias("is_name")))
    return both.where(F.length(F.trim("form")) > 0).distinct()


def map_labels(
    labels: DataFrame,
    terms: DataFrame,
    label: str = "label",
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    forms_per_block: int = FORMS_PER_BLOCK,
) -> DataFrame:
    """(label, ``cl_id``, ``score``, ``edits``, ``form``) of every distinct non-null label.

    ``cl_id`` is ``unmatched`` where no form scores above ``threshold`` and
    accounts for the label, or where another term needs as few edits and scores
    within ``margin``. Obsolete terms and synonyms of other scopes don't count.
    An empty list leaves all unmatched.
    """
    spark = labels.sparkSession
    distinct = cut_lineage(labels.select(F.col(label).alias("label")).where("label is not null").distinct())
    forms = cut_lineage(list_forms(terms).select("cl_id", "form").distinct())
    total = forms.count()
    if not total:
        return distinct.select(
            "label", F.lit(UNMATCHED).alias("cl_id"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("int").alias("edits"), F.lit(None).cast("string").alias("form"),
        )
    places = F.explode(_gram_places("form")).alias("place")
    seen = forms.select(places).groupBy("place").count().collect()  # at most GRAMS rows
    idf = np.full(GRAMS, math.log(1 + total))
    for r in seen:
        idf[r["place"]] = math.log(1 + total / r["count"])
    held = spark.sparkContext.broadcast(idf)

    blocks = -(-total // forms_per_block)
    parts = max(shuffle_width(spark), spark.sparkContext.defaultParallelism, -(-distinct.count() // LABELS_PER_TASK))
    task = (F.col("block") * parts + F.col("part")).cast("int").alias("task")
    listed = forms.withColumn("block", F.pmod(F.xxhash64("cl_id"), F.lit(blocks)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )
    typed = distinct.withColumn("part", F.pmod(F.xxhash64("label"), F.lit(parts)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    rows = listed.select(task, "block", "cl_id", F.col("form").alias("text")).unionByName(
        typed.select(task, "block", F.lit(None).cast("string").alias("cl_id"), F.col("label").alias("text"))
    )
    met = rows.repartitionByRange(blocks * parts, "task").sortWithinPartitions("task", F.col("cl_id").isNull(), "cl_id", "text")

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, index, of_block = None, None, None
        forms: list[tuple[str, str]] = []
        for frame in frames:
            out = []
            for (task, block), some in frame.groupby(["task", "block"], sort=True):
                is_form = some["cl_id"].notna()
                if task != at:
                    at, forms = task, []
                if block != of_block:
                    forms += list(zip(some["cl_id"][is_form], some["text"][is_form], strict=True))
                    index = None
                asked = some["text"][~is_form].tolist()
                if asked and index is None:
                    index, of_block = FormIndex(forms, held.value), block
                if asked and index.ids:
                    out += index.read(asked)
            hits = [[dict(zip(("cl_id", "score", "edits", "form", "left"), h, strict=True)) for h in row[2]] for row in out]
            columns = {"label": [r[0] for r in out], "known": [r[1] for r in out], "hits": hits}
            yield pd.DataFrame({name: pd.Series(values, dtype=object) for name, values in columns.items()})

    read = met.mapInPandas(
        score, "label string, known array<string>, hits array<struct<cl_id:string,score:double,edits:int,form:string,left:array<string>>>"
    )
    # One row a block of each label.
    said = read.groupBy("label").agg(
        F.array_distinct(F.flatten(F.collect_list("known"))).alias("known"), F.flatten(F.collect_list("hits")).alias("hits")
    )
    # What is left over must be comment, or repeat what other forms of the term say.
    whole = F.filter("hits", lambda h: ~F.arrays_overlap(h["left"], F.col("known")))
    scored = said.select("label", F.explode(whole).alias("h")).select("label", "h.*").where(F.col("score") >= threshold)
    of_term = Window.partitionBy("label", "cl_id").orderBy("edits", F.desc("score"), "form")
    scored = scored.withColumn("_n", F.row_number().over(of_term)).where("_n = 1")
    order = Window.partitionBy("label").orderBy("edits", F.desc("score"), "cl_id")
    ranked = scored.select(
        "*",
        F.row_number().over(order).alias("place"),
        F.lead("edits").over(order).alias("next_edits"),
        F.lead("score").over(order).alias("next_score"),
    ).where("place = 1")
    clear = (
        F.col("next_edits").isNull()
        | (F.col("next_edits") > F.col("edits"))
        | (F.col("score") - F.col("next_score") >= margin)
    )
    accepted = ranked.where(clear).select("label", "cl_id", "score", "edits", "form")
    return distinct.join(accepted, "label", "left").withColumn("cl_id", F.coalesce("cl_id", F.lit(UNMATCHED)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _gram_places(texts: pd.Series) -> pd.Series:
    return pd.Series([list(grams(raw_tokens(x))) for x in texts])


def map_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(``src``, ``row_id``, ``cl_id``) of every row of (``src``, ``row_id``, ``label``) to map.

    Rows whose label is null or exactly the name of a term in use are left out.
    A row id that comes twice with one label gives one row. Hot labels are
    salted when the mapping joins back.
    """
    names = list_forms(terms).where("is_name").select(F.col("form").alias("label")).distinct()
    typed = cut_lineage(rows.where("label is not null").join(names, "label", "left_anti").distinct())
    mapped = cut_lineage(map_labels(typed, terms).select("label", "cl_id"))
    return salted_join(typed, mapped, "label", "inner").select("src", "row_id", "cl_id").distinct()
