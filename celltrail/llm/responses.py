"""Broken prompt and response pairs.

Ordered rules say what is wrong with a response: nothing said, the question
given back, an answer declined, an abrupt end, prose in another language. All
rules that apply are reported, in the order of ``DEFECTS``; the first of them is
the defect of the pair.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from celltrail.llm.visible import visible
from celltrail.session import salted_join

DEFECTS = ("empty", "copy", "refusal", "truncated", "language")

# Labels of the fields an answer may have.
_FIELD = r"(?:cell type|cell ontology id|cl id|confidence(?: score)?|(?:biological )?reasoning|answer|annotation|label)"
_LABEL = re.compile(rf"^[\W_]*({_FIELD})\W*?[:：][\s*_]*", re.I)
# Within a line: blank lines by the thousand are passed over once.
_LABELS = re.compile(rf"^(?:[^\w\n]|_)*{_FIELD}\W*?(?:[:：]|$)[*_]*", re.I | re.M)
_KEY = re.compile(r'"[^"\n]{1,40}"\s*:')
_WORD = re.compile(r"[^\W_]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[\w-]*\d[\w-]*")
# Words that say nothing.
_NOTHING = {"null", "none", "nan", "na", "n", "a", "empty", "json", "nil", "undefined", "blank", "text"}
# Words that may surround a question given back.
_AROUND = {
    "sure", "you", "asked", "ask", "question", "the", "your", "my", "me", "here", "is", "was", "it", "i", "see", "ok",
    "okay", "yes", "certainly", "of", "course", "to", "repeat", "repeating", "again", "request", "input", "prompt",
    "user", "q", "a", "said", "following", "received", "got", "regarding", "about", "answer", "response", "and",
}
_MOST_AROUND = 8
#: At least this share of the words of a copy stand as in the question.
COPIED = 0.6
_SMILE = re.compile(r"[:;]-?[()]")

_TASKS = (
    r"(?:help|assist|answer|provide|give|offer|say|determine|identify|name|annotate|assign|comply|fulfil|fulfill|"
    r"complete|tell|comment|respond|label|do (?:that|this|so)|make)"
)
# Phrases that decline, by language, and before each the letters it can't do without.
_REFUSALS = (
    (r"n't|not", rf"\b(?:i|we)(?:'m| am|'re| are)? (?:really |very |truly )?(?:sorry,? (?:but )?i )?(?:simply |just )?"
     rf"(?:can ?not|can't|could not|couldn't|will not|won't|must not|may not|shall not|do not|don't) (?:feel comfortable|{_TASKS})\b"),
    (r"unable|not", rf"\b(?:unable|not able|not (?:allowed|permitted|authori[sz]ed|in a position)) to {_TASKS}\b"),
    (r"sorry", r"\bsorry,? (?:but )?(?:i|this|that|we|no)\b(?! to)"),
    (r"declin|refuse|abstain|refrain",
     r"\b(?:i|we) (?:must |have to |need to |will |would rather )?(?:respectfully |politely )?(?:decline|refuse|abstain|refrain)\b"),
    (r"declin|request",
     r"\bdeclin(?:e|es|ed|ing) (?:this|the|your|to|that)\b|\brequest (?:is |was |has been )?(?:declined|denied|refused|rejected)\b"),
    (r"can", r"\b(?:can't|cannot|can not) be (?:fulfilled|answered|completed|processed|granted|honou?red)\b"),
    (r"against", r"\bagainst (?:the|my|our) (?:\w+ )?(?:policy|policies|guidelines?|rules?|principles|instructions)\b"),
    (r"not something", r"\bnot something (?:i|we)(?:'m| am|'re| are| can| may| could| will| do)?\b"),
    (r"outside|beyond", r"\b(?:outside|beyond) (?:of )?(?:what|the scope of what|my) ?(?:i can|i am|abilit|capabilit|scope|remit)"),
    (r"leave", r"\bleave (?:this|that|it)(?: one)? to (?:a|an|the) \w+"),
    (r"as an? ", r"\bas an? (?:ai|artificial|language|large language)\b[^.]*\b(?:not|cannot|can't|unable)\b"),
    (r"no (?:an|la|ce)", r"\bno (?:annotation|answer|label|cell type) (?:is|was|will be|can be) (?:given|provided|offered)\b"),
    (r"not", r"\bi am not (?:allowed|permitted|able|comfortable|going)\b|\bnot permitted to do\b"),
    (r"leid|nicht", r"\btut mir (?:sehr )?leid\b|\b(?:kann|darf|werde) (?:ich )?(?:\w+ ){0,4}nicht (?:\w+ ){0,2}(?:beantworten|helfen|sagen|beurteilen|bestimmen|nennen)"),
    (r"je |désol", r"\bje (?:suis (?:vraiment )?désolée?|ne peux (?:malheureusement )?pas|ne suis pas en mesure|refuse)\b|\bdésolée?,"),
    (r"siento|puedo", r"\blo siento\b|\bno puedo (?:ayudar|responder|proporcionar|decir|determinar)"),
    (r"posso|desculpe|lamento|dispiace", r"\b(?:não posso|desculpe|lamento,)|\bmi dispiace\b|\bnon posso (?:aiutar|rispond|fornire)"),
    (r"могу|извин|сожал", r"не могу (?:ответить|помочь|определить|назвать)|извините|к сожалению, я"),
    (r"mogę|przykro", r"\bnie mogę (?:odpowiedzieć|pomóc|podać)|\bprzykro mi\b"),
    (r"[抱对無无申]", r"抱歉|对不起|無法|无法(?:回答|提供|帮助|确定)|申し訳"),
    (r"helaas|niet", r"\bhelaas kan ik\b|\bik kan (?:\w+ ){0,3}niet (?:helpen|beantwoorden)"),
)
_REFUSAL_HINT = re.compile("|".join(hint for hint, _ in _REFUSALS))
_REFUSAL = re.compile("|".join(phrase for _, phrase in _REFUSALS))

# Words without content, by language; none of the others' words is an English one.
_ENGLISH = set(
    "the of and to with this that are which for from by be these than although most among other were likely have has "
    "it its their because yet been into at or an as is was but not all there both between who can could may would "
    "however while when where under over such they them we you your our his her in on no out".split()
)
_FOREIGN = set(
    "der die das und ist nicht mit von den dem ein eine einer auf für sich sind werden wird aus weil dass diese dieser "
    "dieses durch kaum sehr zu im als auch bei nach nur oder wie "
    "le la les des du et est dans pour que qui une sur par ce cette car sont pas plus avec ces au aux leur y restent "
    "el los las del y es en por se con una para como más este esta porque lo su sus al entre muy "
    "o os um uma e é não na dos das em são mais pois ao pelo pela também têm neste nesta "
    "il gli di che è per sono nel della delle dei con questo questa perché molto anche "
    "het een van en op te dat niet zijn voor met deze ook door omdat "
    "i w na z do jest są się nie to tej ten gdzie oraz przez "
    "och att det som för av är på till inte är "
    "og ikke dette fra ble eller når sig mot også "
    "ja on ei että joka ovat sekä mutta kuin myös tämä tässä ovat "
    "ve bir bu için ile olarak olan daha çok gibi değil "
    "a se že je na pro jsou nebo ale také který tato "
    "és az egy hogy nem ez vagy mint csak azt "
    "și este nu care sunt din mai pentru cu acest "
    "yang dan dari ini untuk dengan pada tidak adalah sebagai".split()
) - _ENGLISH - {"i", "to", "do", "die", "a", "se", "je", "ja", "mint", "van", "dan", "sig"}
# Letters that English prose does not have; a word in twenty may be a name.
_STRANGE = re.compile(r"[^\x00-\x7f]")

_REASONING = re.compile(r'reasoning\W{0,4}[:：]\s*(.*)', re.I | re.S)
_QUOTES = re.compile(r"'[^'\n]{2,60}'|\"[^\"\n]{2,60}\"|“[^”\n]{2,60}”")
_ENDS = re.compile(r"(?:[.!?。！？|]|[.!?。！？][\"'”’)\]*_`»]+|[)\]`%])\Z")
_FENCE = re.compile(r"\A\s*`{3,}\w*\s*|\s*`{3,}\s*\Z")


def says_nothing(text: str) -> bool:
    """No letter beside field names, keys and words for nothing."""
    bare = _LABELS.sub(" ", _KEY.sub(" ", text))
    return all(w in _NOTHING for w in _LETTERS.findall(bare.lower()))


def gives_back(text: str, question: str | None) -> bool:
    """The question from its start or from within, whole or in part, and nothing of its own but a few words around it.

    Every word is of the question but for those around, and most of them
    stand beside the same word as there.
    """
    if not question:
        return False
    asked = _WORD.findall(visible(question))
    known, beside = set(asked), set(zip(asked, asked[1:], strict=False))
    said = _WORD.findall(visible(text))
    strange = [w for w in said if w not in known]
    if len(strange) > _MOST_AROUND or any(w not in _AROUND for w in strange):
        return False
    copied = [w for w in said if w in known]
    same = [pair in beside for pair in zip(copied, copied[1:], strict=False)]
    held = sum(a or b for a, b in zip([False, *same], [*same, False], strict=True))
    return len(copied) >= 3 and held >= COPIED * len(copied)


def declines(text: str) -> bool:
    low = text.lower().replace("’", "'")
    return bool(_REFUSAL_HINT.search(low) and _REFUSAL.search(re.sub(r"\s+", " ", low)))


def left_open(text: str) -> bool:
    """The last line opens a bracket or quote that nothing closes."""
    line = _SMILE.sub(" ", text.rstrip().rsplit("\n", 1)[-1])
    for opening, closing in ("()", "[]", "{}", "“”", "„“", "«»"):
        if opening in line and line.rfind(opening) > line.rfind(closing):
            return True
    quotes = [m.start() for m in re.finditer('"', line)]
    return bool(len(quotes) % 2 and re.search(r'(?:^|[\s(\[])"\w', line[max(0, quotes[-1] - 1) :]))


def _alike(value: str, parsed: str | None) -> bool:
    """Whether an unpunctuated label is all of the parsed one: as many words, and the last one whole."""
    a, b = _WORD.findall(visible(value)), _WORD.findall(visible(parsed))
    return bool(a and b) and len(a) >= len(b) and a[-1].rstrip("s") in {w.rstrip("s") for w in b}


def stops_early(text: str, cell_type: str | None, confidence: float | None) -> bool:
    """Ends within a sentence, number, id or JSON object."""
    body = _FENCE.sub("", text).rstrip()
    at = 0 if body.startswith("{") else body.find("\n{") + 1
    if body.startswith("{") or at > 0:
        try:
            json.JSONDecoder(strict=False).raw_decode(body[at:].replace("```", ""))
        except ValueError:
            return True
        return False
    last = body.rsplit("\n", 1)[-1]
    if label := _LABEL.match(last):
        value, name = last[label.end() :].strip(" *_"), label[1].lower()
        if name in ("cell ontology id", "cl id"):
            return not re.search(r"\bCL[:_]\d{7}\b", value, re.I)
        if name.startswith("confidence"):
            if re.fullmatch(r"(?:0|1)?[.,]\d{2,}|1[.,]0|\d{1,3} ?%", value):
                return False
            one = re.fullmatch(r"[01]?[.,]\d", value)  # whole only if the parser read it so
            return not one or confidence is None or abs(float(value.replace(",", ".")) - confidence) > 1e-9
        if name == "cell type" and not _ENDS.search(value):
            return not _alike(value, cell_type)
    if body.endswith(("...", "…")) or left_open(body):
        return True
    if _ENDS.search(body):
        return False
    return not (len(_WORD.findall(body)) <= 8 and _alike(body, cell_type))


def foreign(text: str) -> bool:
    """The prose is not English: other script, or other languages' small words."""
    found = _REASONING.search(text)
    prose = found[1] if found and len(found[1]) > 20 else text
    prose = _QUOTES.sub(" ", _KEY.sub(" ", prose)) if not found else _QUOTES.sub(" ", prose)
    if not prose.isascii():
        letters = [c for c in prose if c.isalpha()]
        if sum(0x24F < ord(c) < 0xFF00 for c in letters) > 0.15 * len(letters):
            return True
    words = _LETTERS.findall(_SYMBOL.sub(" ", prose.lower()))
    english = sum(w in _ENGLISH for w in words)
    other = sum(w in _FOREIGN for w in words)
    strange = sum(bool(_STRANGE.search(w)) for w in words)
    return (
        (other >= 2 and other > english)
        or (other >= 1 and english == 0 and len(words) >= 6)
        or (english == 0 and len(words) >= 6 and strange >= 0.15 * len(words))
    )


def defects(response: str | None, question: str | None, cell_type: str | None, confidence: float | None) -> list[str]:
    """All defects of a response, in order."""
    text = response or ""
    if says_nothing(text):
        return ["empty"]
    out = []
    if gives_back(text, question):
        out.append("copy")
    if declines(text):
        out.append("refusal")
    if stops_early(text, cell_type, confidence):
        out.append("truncated")
    if foreign(text):
        out.append("language")
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _defects(response: pd.Series, question: pd.Series, cell_type: pd.Series, confidence: pd.Series) -> pd.Series:
    return pd.Series(
        [
            defects(r, q, t, None if c != c else c)
            for r, q, t, c in zip(response, question, cell_type, confidence, strict=True)
        ]
    )


def flag_responses(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """``predictions`` with ``defects`` (all that apply) and ``defect`` (the first, or null).

    The question is the example's ``prompt``; a prediction whose example or
    prompt is missing can't be told to give it back. A null response is empty.
    Delivered copies of a prediction are each judged. Examples asked by very
    many predictions are salted. ``examples`` should hold an id once; of several
    rows with one id the smallest prompt counts.
    """
    asked = examples.groupBy("example_id").agg(F.min("prompt").alias("_question"))
    joined = salted_join(predictions, asked, "example_id")
    confidence = F.coalesce(F.col("confidence").cast("double"), F.lit(float("nan")))
    # Not deterministic by name only: filters on the result must not run the rules a second time.
    found = _defects.asNondeterministic()(F.col("raw_response"), F.col("_question"), F.col("cell_type"), confidence)
    return joined.withColumn("defects", found).withColumn("defect", F.get("defects", 0)).drop("_question")


def defective(predictions: DataFrame, examples: DataFrame) -> DataFrame:
    """(``pred_id``, ``defect``) of each defective response."""
    needed = predictions.select("pred_id", "example_id", "raw_response", "cell_type", "confidence")
    return flag_responses(needed, examples.select("example_id", "prompt")).where("defect is not null").select(
        "pred_id", "defect"
    ).distinct()
