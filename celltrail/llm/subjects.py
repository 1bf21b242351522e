"""Subject areas of documents, by interpolated n-gram language models.

For each language and subject there is a bigram model P(w | v), interpolated
with the subject's unigram model and with the background model of all text of
the language. A sentence deals with the subject whose model needs fewest bits
per token, if it needs fewer than the background by a margin that is calibrated
on labelled documents held out of the models. A document is accepted for every
subject that enough of its sentences deal with.

Labelled documents and the background are counted in one pass; ``VOTES`` more
let all sentences of the corpus vote by their posteriors, so that few labels
do; the last pass reads the result. N-grams are counted exactly by the shuffle;
those under ``RARE`` of their language's tokens are left out of the models,
whose size so has a bound that doesn't depend on the corpus.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celltrail.session import cut_lineage, shuffle_width

#: At least this share of a document's sentences.
SHARE = 0.25
#: Words that a worker scores together.
WORDS_AT_ONCE = 60_000
#: Share of a language's tokens below which an n-gram says nothing: at most 1 / RARE unigrams and bigrams a language.
RARE = 4e-6
#: Share of a language's tokens below which a word doesn't tell the language.
RARE_FOR_LANGUAGE = 1e-5
#: Passes over the corpus in which sentences vote by their posteriors.
VOTES = 2
#: Nats a token by which a subject's model must beat the background before calibration, and the margins tried.
MARGIN = 0.06
MARGINS = (0.02, 0.03, 0.04, 0.05, 0.06, 0.075, 0.09, 0.11, 0.13)
#: One in so many labelled documents is held out to calibrate.
HELD_OUT = 5
#: Most labelled documents the models start from; beyond it, those with the smallest hashes.
LABELLED = 200_000

_END = re.compile(r"[.!?。！？…]+[\"'”’»)\]]*(?:\s+|$)|\n+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
#: A stretch longer than ``LOST`` times the 99th percentile of all has lost its stops.
LOST = 1.25

# Three-letter language codes and their two-letter forms.
_CODES = {
    "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl",
    "dut": "nl", "pol": "pl", "rus": "ru", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "ces": "cs", "cze": "cs",
    "tur": "tr", "ell": "el", "gre": "el", "hun": "hu", "ron": "ro", "rum": "ro", "ukr": "uk", "zho": "zh", "chi": "zh",
    "jpn": "ja", "kor": "ko", "ara": "ar", "hin": "hi",
}


class _Hashes(dict):
    """Hashes of words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = crc32(b"#" if word[0].isdigit() else word.encode())
        return value


_hashes = _Hashes()


def sentences(text: str | None) -> list[list[str]]:
    """Sentences as lower-case tokens, as their stops and line ends cut them."""
    parts = (_TOKEN.findall(part) for part in _END.split((text or "").lower()))
    return [p for p in parts if p]


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, digits being one word, and the words of each sentence."""
    parts = sentences(text)
    flat = list(chain.from_iterable(parts))
    words = np.fromiter(map(_hashes.__getitem__, flat), np.uint32, len(flat))
    return words.view(np.int32), np.fromiter(map(len, parts), np.int32, len(parts))


@dataclass
class Lengths:
    """The usual length of a sentence, and the length from which a stretch has lost its stops."""

    usual: float = 11.0
    lost: float = 1e9

    def cut(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sentence lengths with long stretches cut into pieces of usual length, and the pieces of each."""
        if not len(lengths) or lengths.max() <= self.lost:
            return lengths, np.ones(len(lengths), np.int64)
        many = np.where(lengths > self.lost, np.maximum(np.rint(lengths / self.usual), 1), 1).astype(np.int64)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        size, pieces = np.repeat(lengths, many).astype(np.int64), np.repeat(many, many)
        return (size * (nth + 1) // pieces - size * nth // pieces).astype(lengths.dtype), many


@dataclass
class Encoded:
    """Texts with sentences as word hashes, one after another."""

    words: np.ndarray
    lengths: np.ndarray  # words by sentence
    sentences: np.ndarray  # sentences by text

    def __post_init__(self) -> None:
        self.starts = _starts(self.lengths)
        self.text_starts = _starts(self.sentences)
        self.of_sentence = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def unigrams(self, language: np.ndarray) -> np.ndarray:
        """Keys of the words, each of its sentence's language."""
        key = (language.astype(np.uint64) + np.uint64(2)) * np.uint64(0x100000001B3)
        return _mixed(self.words + (key[self.of_sentence] << np.uint64(20)))

    def bigrams(self, unigrams: np.ndarray) -> np.ndarray:
        """Keys of each word after the one before it in its sentence."""
        return _mixed((self.before(unigrams) * np.uint64(0x9E3779B97F4A7C15)) ^ unigrams)

    def before(self, unigrams: np.ndarray) -> np.ndarray:
        """The key of the word before each, one of its own at the start of a sentence."""
        out = np.concatenate([unigrams[:1], unigrams[:-1]])
        out[self.starts] = 1
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)


def pack(texts: Iterable[tuple[np.ndarray, np.ndarray]], most: int = WORDS_AT_ONCE) -> Iterator[tuple[list[int], bytes, bytes, bytes]]:
    """Encoded texts in lots of about ``most`` words, a long text being a lot of its own; empty ones are left out.

    A lot is which of the texts it holds, their words, their sentences' lengths
    and their numbers of sentences.
    """
    rows: list[int] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def lot() -> tuple[list[int], bytes, bytes, bytes]:
        words, lengths = (np.concatenate(column).astype(np.int32).tobytes() for column in zip(*held, strict=True))
        return rows, words, lengths, np.array([len(n) for _, n in held], np.int32).tobytes()

    for row, (words, lengths) in enumerate(texts):
        if len(lengths):
            rows.append(row)
            held.append((words, lengths))
            size += len(words)
            if size >= most:
                yield lot()
                rows, held, size = [], [], 0
    if rows:
        yield lot()


def unpack(words: bytes, lengths: bytes, sentences: bytes, cut: Lengths) -> Encoded:
    """A lot as it is read."""
    pieces, many = cut.cut(np.frombuffer(lengths, np.int32))
    of_text = np.add.reduceat(many, _starts(np.frombuffer(sentences, np.int32)))
    return Encoded(np.frombuffer(words, np.uint32).astype(np.uint64), pieces, of_text)


@dataclass
class Table:
    """Sorted keys, each with a row of numbers; keys that aren't there have the row of zeros at the end."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; one past the last where a key isn't there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, len(self.keys))


def _table(keys: np.ndarray, rows: np.ndarray) -> Table:
    order = np.argsort(keys)
    return Table(keys[order], np.concatenate([rows[order], np.zeros((1, rows.shape[1]), rows.dtype)]))


@dataclass
class Languages:
    """Unigram models of the languages that the corpus names, to tell what a sentence is written in.

    A word has an entry for each language that has it: how much likelier it is
    there than a word the language has never seen.
    """

    names: list[str]
    keys: np.ndarray  # words, sorted
    first: np.ndarray  # first entry of each word, and their number after the last
    entries: np.ndarray  # language of each entry
    gains: np.ndarray
    unseen: np.ndarray  # by language

    def of(self, texts: Encoded) -> np.ndarray:
        """The likeliest language of each sentence; texts may change theirs."""
        if len(self.names) < 2 or not len(self.keys):
            return np.zeros(len(texts.lengths), np.int64)
        at = np.minimum(np.searchsorted(self.keys, texts.words), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == texts.words)
        at = at[known]
        many = self.first[at + 1] - self.first[at]
        entry = np.repeat(self.first[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        sentence = np.repeat(texts.of_sentence[known], many)
        size = len(self.names)
        score = np.bincount(sentence * size + self.entries[entry], self.gains[entry], len(texts.lengths) * size)
        return (score.reshape(-1, size) + texts.lengths[:, None] * self.unseen).argmax(axis=1)


@dataclass
class SubjectModels:
    """For each n-gram the nats by which each subject's model beats the background, a row a key.

    A pair that the corpus has seen is read by the bigram models, another word by the unigram models.
    """

    names: list[str]
    languages: Languages
    lengths: Lengths
    words: Table
    pairs: Table
    margin: float = MARGIN

    def gains(self, texts: Encoded, language: np.ndarray) -> np.ndarray:
        """Cross-entropy of the background less that of each subject, in nats a token, by sentence."""
        unigrams = texts.unigrams(language)
        pair = self.pairs.find(texts.bigrams(unigrams))
        gain = self.pairs.rows[pair]
        alone = pair == len(self.pairs.keys)
        gain[alone] = self.words.rows[self.words.find(unigrams[alone])]
        return np.add.reduceat(gain.astype(float), texts.starts, axis=0) / texts.lengths[:, None]

    def posteriors(self, texts: Encoded, gain: np.ndarray, margin: float, allowed: np.ndarray | None = None, floor: float = 0.1) -> np.ndarray:
        """By sentence the probability of each subject; what is missing to one is of none.

        What else a document is about shifts the odds between subjects, not
        against none. ``allowed`` holds the labelled subjects of each text, none
        for texts without labels.
        """
        k = len(self.names)
        total = gain * texts.lengths[:, None]
        if allowed is not None:
            free = ~allowed.any(axis=1, keepdims=True)
            total = total + np.repeat(np.where(free, 0.0, np.where(allowed, 1.0, -4.0)), texts.sentences, axis=0)
        top = total.max(axis=1, keepdims=True)
        some = 1.0 / (1.0 + np.exp(np.clip(margin * texts.lengths[:, None] - top, -50, 50)))
        like = np.exp(total - top)
        prior = np.full((len(texts.sentences), k), 1.0 / k)
        for _ in range(4):
            post = like * np.repeat(prior, texts.sentences, axis=0)
            post *= some / post.sum(axis=1, keepdims=True)
            by = np.add.reduceat(post, texts.text_starts, axis=0)
            prior = (by + floor) / (by.sum(axis=1, keepdims=True) + k * floor)
        return post

    def counted(self, texts: Encoded, margins: Iterable[float]) -> Iterator[np.ndarray]:
        """For each margin the sentences of each text by subject, those of none first.

        A sentence none of whose subjects beats the background by the margin is
        of none; between subjects that do, the document's other sentences count too.
        """
        gain = self.gains(texts, self.languages.of(texts))
        top = gain.max(axis=1)
        for margin in margins:
            said = np.where(top >= margin, self.posteriors(texts, gain, margin).argmax(axis=1) + 1, 0)
            yield np.add.reduceat(np.eye(len(self.names) + 1, dtype=np.int64)[said], texts.text_starts, axis=0)


def models_from(
    names: list[str], languages: Languages, lengths: Lengths, rows: pd.DataFrame, trust: float = 60.0, prior: float = 20.0,
    focus: float = 0.45, doubt: tuple[float, float] = (1.0, 8.0), own: float = 0.8,
) -> SubjectModels:
    """Models of summed counts: rows of ``kind``, ``key``, ``before``, ``word``, ``language``, ``c0`` (all) and ``c1`` ... by subject.

    With P0 the background, a subject's unigram model is
    P(w) = (c(w) + ``trust`` P0(w)) / (n + ``trust``), and its bigram model
    P(w | v) = (c(v, w) + ``prior`` Q(w | v)) / (c(v) + ``prior``), where
    Q(w | v) is P0(w | v) P(w) / P0(w), made to sum to one. Both are mixed with
    the background, which weighs 1 - ``own``. N-grams whose two commonest
    subjects don't hold ``focus`` of what they could beyond an even share (``doubt`` uses of a word or pair by all alike are added) are
    left to what the word says alone, words to the background.
    """
    k, spoken = len(names), max(len(languages.names), 1)
    columns = [f"c{i}" for i in range(k + 1)]
    one, two = (rows[rows["kind"] == kind].sort_values("key") for kind in (0, 1))

    def numbers(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = part["key"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], part["language"].to_numpy(int)[order], part[columns].to_numpy(float)[order]

    keys, language, count = numbers(one)
    total = np.zeros((spoken, k + 1))
    np.add.at(total, language, count)

    def quiet(count: np.ndarray, language: np.ndarray, doubt: float) -> np.ndarray:
        share = total[language, 1:] / np.maximum(total[language, 1:].sum(axis=1, keepdims=True), 1e-9)
        share = (count[:, 1:] + doubt * share) / (count[:, 1:].sum(axis=1, keepdims=True) + doubt)
        most = 2 if k > 2 else 1
        return np.sort(share, axis=1)[:, -most:].sum(axis=1) < most / k + (1 - most / k) * focus - 1e-9

    base = count[:, :1] / np.maximum(total[language, :1], 1.0)
    ratio = (count[:, 1:] / np.maximum(base, 1e-12) + trust) / (total[language, 1:] + trust)
    gain = np.log(own * ratio + 1 - own)
    gain[quiet(count, language, doubt[0])] = 0.0
    words = _table(keys, gain.astype(np.float32))

    pair_keys, pair_language, pair = numbers(two)
    order = np.argsort(two["key"].to_numpy(np.int64).view(np.uint64))
    before = two["before"].to_numpy(np.int64).view(np.uint64)[order]
    word = two["word"].to_numpy(np.int64).view(np.uint64)[order]
    finder = Table(keys, np.concatenate([count, np.zeros((1, k + 1))]))
    start = before == 1
    of_before = finder.rows[finder.find(before)]
    if start.any():  # sentences start with a word of their own, as often as pairs say
        sums = np.zeros((spoken, k + 1))
        np.add.at(sums, pair_language[start], pair[start])
        of_before[start] = sums[pair_language[start]]
    ratios = np.concatenate([ratio, np.ones((1, k))])[finder.find(word)]
    back = pair[:, :1] / np.maximum(of_before[:, :1], pair[:, :1])
    group = before ^ (pair_language.astype(np.uint64) * start)
    _, at = np.unique(group, return_inverse=True)
    mass, whole = np.zeros((at.max() + 1 if len(at) else 0, k)), np.zeros((at.max() + 1 if len(at) else 0, 1))
    np.add.at(mass, at, back * ratios)
    np.add.at(whole, at, back)
    z = mass + np.maximum(1 - whole, 0)  # pairs left out keep the background's mass
    expected = ratios / np.maximum(z[at], 1e-9) if len(at) else ratios
    ratio2 = (pair[:, 1:] / np.maximum(back, 1e-12) + prior * expected) / (of_before[:, 1:] + prior)
    gain2 = np.log(own * ratio2 + 1 - own)
    alone = quiet(pair, pair_language, doubt[1])
    gain2[alone] = np.concatenate([gain, np.zeros((1, k))])[finder.find(word[alone])]
    return SubjectModels(names, languages, lengths, words, _table(pair_keys, gain2.astype(np.float32)))


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each begins in it."""
    order = np.argsort(keys)
    there = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]]))


class Counts:
    """Weighted n-grams of a partition, merged whenever they are many."""

    def __init__(self, columns: int):
        self.columns, self.held, self.size = columns, ([], []), 0

    def add(self, texts: Encoded, language: np.ndarray, weights: np.ndarray) -> None:
        """``weights`` by sentence: the background's and each subject's."""
        unigrams = texts.unigrams(language)
        before, spoken, weights = texts.before(unigrams), language.astype(np.uint64), weights.astype(np.float32)
        for kind, keys, first in ((0, unigrams, unigrams), (1, texts.bigrams(unigrams), before)):
            order, starts = _runs(keys)
            at = order[starts]
            sentence = texts.of_sentence[order]
            marks = np.stack([first[at], unigrams[at], spoken[texts.of_sentence[at]]], axis=1)
            self._hold(kind, keys[at], marks, np.add.reduceat(weights[sentence], starts, axis=0))
        if self.size > 2_000_000:
            self._merge()

    def _hold(self, kind: int, keys: np.ndarray, marks: np.ndarray, weights: np.ndarray) -> None:
        self.held[kind].append((keys, marks, weights))
        self.size += len(keys)

    def _merge(self) -> None:
        self.size = 0
        for kind, parts in enumerate(self.held):
            if parts:
                keys, marks, weights = (np.concatenate(column) for column in zip(*parts, strict=True))
                parts.clear()
                order, starts = _runs(keys)
                at = order[starts]
                self._hold(kind, keys[at], marks[at], np.add.reduceat(weights[order], starts, axis=0))

    def frames(self) -> Iterator[pd.DataFrame]:
        self._merge()
        for kind in (0, 1):
            if not self.held[kind]:
                continue
            keys, marks, weights = self.held[kind][0]
            for i in range(0, len(keys), 20_000):
                some = slice(i, i + 20_000)
                fixed = {"kind": np.full(len(keys[some]), kind, np.int32), "key": keys[some].view(np.int64)}
                fixed |= {n: np.ascontiguousarray(marks[some, j]).view(np.int64) for j, n in enumerate(("before", "word"))}
                fixed["language"] = marks[some, 2].astype(np.int32)
                yield pd.DataFrame(fixed | {f"c{j}": weights[some, j] for j in range(self.columns)})


_LOT = "words binary, lengths binary, sentences binary"
_MARKS = "marked array<array<int>>, code array<string>, own array<boolean>, held array<boolean>"
_TALLY = "tally string, keys array<bigint>, times array<bigint>"


class Tally:
    """Words by language code, and the lengths of sentences, of a partition."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

    def add(self, codes: list[str | None], words: bytes, lengths: bytes, sentences: bytes) -> None:
        texts = unpack(words, lengths, sentences, Lengths())
        self._put(_LENGTHS, *np.unique(texts.lengths.astype(np.int64), return_counts=True))
        spoken = np.repeat(np.array([c or "" for c in codes], object), np.add.reduceat(texts.lengths, texts.text_starts))
        for c in set(codes) - {None}:
            self._put(c, *np.unique(texts.words[spoken == c], return_counts=True))

    def _put(self, name: str, keys: np.ndarray, times: np.ndarray) -> None:
        self.parts[name].append((keys.astype(np.int64), times))
        if len(self.parts[name]) > 50:
            self.parts[name] = [self._sum(name)]

    def _sum(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        keys, times = (np.concatenate(x) for x in zip(*self.parts[name], strict=True))
        order, starts = _runs(keys)
        return keys[order[starts]], np.add.reduceat(times[order], starts)

    def rows(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for name in self.parts:
            yield name, *self._sum(name)


_LENGTHS = "#"  # no language code


def encode_texts(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Texts (``doc_id``, ``text``, ``marked``, ``code``, ``own``, ``held``) encoded in lots, written to the shared folder; and (``code``, ``key``, ``n``).

    The second counts the words of each code, and under ``_LENGTHS`` the
    lengths of sentences.
    """
    names = ["doc_id", "marked", "code", "own", "held"]
    columns = [*names, "words", "lengths", "sentences", "tally", "keys", "times"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for frame in frames:
            # Texts held out come in lots of their own, so that judging reads no others.
            for some in (frame[frame["held"]], frame[~frame["held"]]):
                held = {n: some[n].tolist() for n in names}
                for rows, *lot in pack(map(encode, some["text"])):
                    of = [[held[n][i] for i in rows] for n in names]
                    tally.add(of[2], *lot)
                    yield pd.DataFrame({c: pd.Series([x], dtype=object) for c, x in zip(columns, [*of, *lot, None, None, None], strict=True)})
        for row in tally.rows():
            yield pd.DataFrame({c: pd.Series([x], dtype=object) for c, x in zip(columns, [None] * 8 + list(row), strict=True)})

    width = max(rows.sparkSession.sparkContext.defaultParallelism, shuffle_width(rows.sparkSession))
    schema = f"doc_id array<{kind}>, {_MARKS}, {_LOT}, {_TALLY}"
    both = cut_lineage(rows.select(*names, "text").repartition(width).mapInPandas(run, schema))
    told = both.where("tally is not null").select(F.col("tally").alias("code"), F.explode(F.arrays_zip("keys", "times")).alias("x"))
    counts = told.groupBy("code", F.col("x.keys").alias("key")).agg(F.sum("x.times").alias("n"))
    return both.where("words is not null").drop("tally", "keys", "times"), cut_lineage(counts)


def survey(found: DataFrame) -> tuple[Lengths, Languages]:
    """The usual and the longest ordinary sentence, and language models from the texts' own codes, wrong ones included.

    All codes count. A language of few texts is smoothed most, so it wins only
    sentences whose words the others lack.
    """
    sizes = found.where(F.col("code") == _LENGTHS).orderBy("key").toPandas()  # distinct lengths of sentences
    lengths = Lengths()
    if len(sizes):
        upto = sizes["n"].cumsum() / sizes["n"].sum()
        usual, long = (float(sizes["key"][int(np.argmax(upto >= q))]) for q in (0.5, 0.99))
        lengths = Lengths(usual, max(LOST * long, 2 * usual))
    sums = found.where(F.col("code") != _LENGTHS).groupBy("code").agg(F.sum("n").alias("all"))
    totals = {r["code"]: r["all"] for r in sums.collect()}  # codes of three letters at most
    names = sorted(totals)
    if len(names) < 2:
        nothing = np.zeros(0, np.int64)
        return lengths, Languages(names, nothing.astype(np.uint64), np.zeros(1, np.int64), nothing, nothing.astype(float), np.zeros(max(len(names), 1)))
    kept = found.join(F.broadcast(sums), "code").where(F.col("n") >= F.col("all") * RARE_FOR_LANGUAGE)  # one row a code
    got = kept.select("code", "key", "n").toPandas()  # at most 1 / RARE_FOR_LANGUAGE words a language
    language = got["code"].map({name: i for i, name in enumerate(names)}).to_numpy(np.int64)
    word = got["key"].to_numpy(np.int64).astype(np.uint64)
    order = np.lexsort((language, word))
    keys, first = np.unique(word[order], return_index=True)
    smooth = 0.2
    gains = np.log((got["n"].to_numpy(float)[order] + smooth) / smooth)
    unseen = np.log(smooth / (np.array([totals[n] for n in names], float) + smooth * (1 << 20)))
    return lengths, Languages(names, keys, np.append(first, len(word)), language[order], gains, unseen)


def language_code(lang: str = "lang"):
    """The two letters, or three where there is no shorter form, that a language code begins with."""
    head = F.lower(F.regexp_extract(lang, r"^\s*([A-Za-z]{2,3})\s*(?:[-_].*)?$", 1))
    known = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    return F.nullif(F.coalesce(known[head], head), F.lit(""))


def _said(marked: list, k: int) -> np.ndarray:
    """Labelled subjects of each text."""
    said = np.zeros((len(marked), k), bool)
    for i, mark in enumerate(marked):
        if mark is not None:
            said[i, list(mark)] = True
    return said


def fit_subjects(texts: DataFrame, tallies: DataFrame, names: list[str], votes: int = VOTES) -> SubjectModels:
    """Models of the subjects from encoded ``texts`` with ``marked`` (numbers of labelled subjects) and ``held`` (out), and their tallies.

    The first pass counts labelled texts and the background, the others let all
    sentences vote. Counts come to the driver as one row for each n-gram that
    isn't rare. Labels held out count for nothing but the margin.
    """
    spark = texts.sparkSession
    (lengths, languages), k = survey(tallies), len(names)
    marks = ["key bigint", "before bigint", "word bigint", "language int"]
    schema = ", ".join(["kind int", *marks, *[f"c{i} float" for i in range(k + 1)]])
    models = None
    for _ in range(votes + 1):
        shared = spark.sparkContext.broadcast((models, languages, lengths))

        def count(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            models, languages, lengths = shared.value
            counts = Counts(k + 1)
            for frame in frames:
                for marked, held, *lot in zip(*(frame[c] for c in ("marked", "held", "words", "lengths", "sentences")), strict=True):
                    lot = unpack(*lot, lengths)
                    mine, language = _said([m if not h else None for m, h in zip(marked, held, strict=True)], k), languages.of(lot)
                    if models:
                        post = models.posteriors(lot, models.gains(lot, language), models.margin, mine)
                    else:
                        post = np.repeat(mine / np.maximum(mine.sum(axis=1, keepdims=True), 1), lot.sentences, axis=0)
                    counts.add(lot, language, np.concatenate([np.ones((len(post), 1)), post], axis=1))
            yield from counts.frames()

        sums = [F.sum(f"c{i}").cast("float").alias(f"c{i}") for i in range(k + 1)]
        first = [F.first(c).alias(c) for c in ("before", "word", "language")]
        summed = cut_lineage(texts.mapInPandas(count, schema).groupBy("kind", "key").agg(*first, *sums))
        whole = summed.where("kind = 0").groupBy("language").agg((F.sum("c0") * RARE).alias("_least"))
        rows = summed.join(F.broadcast(whole), "language").where("c0 >= _least").drop("_least").toPandas()  # one row a language
        shared.destroy()
        models = models_from(names, languages, lengths, rows)
    models.margin = calibrated(models, texts)
    return models


def calibrated(models: SubjectModels, texts: DataFrame, share: float = SHARE) -> float:
    """The margin by which accepted subjects agree best with held out labels (F1); without any, the margin there is.

    Labels leave out subjects and some are wrong, alike for every margin; of
    equals the middle one is taken.
    """
    shared = texts.sparkSession.sparkContext.broadcast(models)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, out = shared.value, np.zeros((len(MARGINS), 3), np.int64)
        for frame in frames:
            for marked, held, *lot in zip(*(frame[c] for c in ("marked", "held", "words", "lengths", "sentences")), strict=True):
                lot, judged, mine = unpack(*lot, models.lengths), np.array(held, bool), _said(marked, len(models.names))
                for i, n in enumerate(models.counted(lot, MARGINS)):
                    found = n[:, 1:] >= np.maximum(share * lot.sentences[:, None] - 1e-9, 1)
                    out[i] += ((found & mine)[judged].sum(), (found & ~mine)[judged].sum(), (mine & ~found)[judged].sum())
        yield pd.DataFrame([(i, *map(int, row)) for i, row in enumerate(out)], columns=["margin", "hit", "false", "missed"])

    rows = texts.where(F.exists("held", lambda h: h)).mapInPandas(judge, "margin int, hit bigint, false bigint, missed bigint")
    sums = rows.groupBy("margin").agg(F.sum("hit"), F.sum("false"), F.sum("missed")).collect()
    shared.destroy()
    score = {r[0]: round(2 * r[1] / max(2 * r[1] + r[2] + r[3], 1), 4) for r in sums if r[1] + r[2] + r[3]}
    if not score:
        return models.margin
    best = [i for i in sorted(score) if score[i] == max(score.values())]
    return MARGINS[best[len(best) // 2]]


def subject_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame, votes: int = VOTES) -> DataFrame:
    """(``doc_id``, ``subject``, ``sentences``, ``of``, ``share``) of every subject with a sentence; ``none`` has the rest.

    ``labels`` has ``doc_id`` and ``subject``; several rows a document are
    several subjects, unknown subjects are ignored. Where a labelled document
    has a translation (``tgt_text``), it trains with the same label, so a
    subject labelled in one language is known in the other. A sentence counts
    for what is likeliest of the subjects and none. Null and empty texts have
    no rows; without labels or subjects all is none.
    """
    names = sorted(r["subject"] for r in subjects.select("subject").distinct().collect() if r["subject"])  # the list of subjects
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, subject string, sentences int, of int, share double"
    known = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else F.create_map().cast("map<string,int>")
    marked = labels.select("doc_id", known[F.col("subject")].alias("s")).where("s is not null").groupBy("doc_id").agg(F.collect_set("s").alias("marked"))
    marked = marked.orderBy(F.xxhash64("doc_id")).limit(LABELLED)
    sides = F.array(F.struct(F.col("text").alias("text"), (language_code("lang") if "lang" in documents.columns else F.lit(None).cast("string")).alias("code"), F.lit(True).alias("own")))
    if {"tgt_text", "tgt_lang"} <= set(documents.columns):
        other = F.when(F.col("marked").isNotNull() & (F.col("tgt_text") != F.col("text")), F.struct(F.col("tgt_text").alias("text"), language_code("tgt_lang").alias("code"), F.lit(False).alias("own")))
        sides = F.array_compact(F.array_append(sides, other))
    sided = documents.join(F.broadcast(marked), "doc_id", "left").select("doc_id", "marked", F.explode(sides).alias("x"))  # at most LABELLED rows
    held = F.col("marked").isNotNull() & F.col("x.own") & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD_OUT)) == 0)
    out = F.col("marked").isNotNull() & ~F.col("x.own") & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(HELD_OUT)) == 0)
    rows = sided.where(~F.coalesce(out, F.lit(False))).select("doc_id", "marked", "x.text", "x.code", "x.own", F.coalesce(held, F.lit(False)).alias("held"))
    texts, tallies = encode_texts(rows.where("text is not null"), kind)
    models = fit_subjects(texts, tallies, names, votes) if names else None
    lengths = models.lengths if models else survey(tallies)[0]
    shared = documents.sparkSession.sparkContext.broadcast((models, lengths))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, lengths = shared.value
        called = np.array(["none", *(models.names if models else [])], object)
        for frame in frames:
            for ids, own, *lot in zip(*(frame[c] for c in ("doc_id", "own", "words", "lengths", "sentences")), strict=True):
                lot = unpack(*lot, lengths)
                n = next(models.counted(lot, [models.margin])) if models else lot.sentences[:, None]
                i, s = np.nonzero(n * np.array(own, bool)[:, None])
                of = lot.sentences[i]
                yield pd.DataFrame({"doc_id": np.asarray(ids)[i], "subject": called[s], "sentences": n[i, s], "of": of, "share": n[i, s] / of})

    return texts.select("doc_id", "own", "words", "lengths", "sentences").mapInPandas(read, schema)


def corpus_shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(``subject``, ``documents``, ``sentences``, ``share``): how much of all the corpus's sentences each subject has, and none."""
    found = subject_shares(documents, labels, subjects)
    by = cut_lineage(found.groupBy("subject").agg(F.count_distinct("doc_id").alias("documents"), F.sum("sentences").alias("sentences")))
    total = by.agg(F.sum("sentences").alias("_all"))
    return by.crossJoin(F.broadcast(total)).select("subject", "documents", "sentences", (F.col("sentences") / F.col("_all")).alias("share"))  # one row


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, share: float = SHARE) -> DataFrame:
    """(``doc_id``, ``subject``) of each subject that at least ``share`` of the sentences deal with.

    Null and empty texts have no subject. Without labels or subjects the result
    is empty. Rows that repeat an id are read each.
    """
    found = subject_shares(documents, labels, subjects).where((F.col("share") >= share - 1e-9) & (F.col("subject") != "none"))
    return found.select("doc_id", "subject").distinct()
