"""Problem 4: defective answers, one defect type each.

Types, first match wins: `empty`, `copy`, `refusal`, `truncated`, `other_language`.

Three statistics do the work. Languages of prompt and answer are compared by the posteriors of a character n-gram naive
Bayes model (`language`). Truncation of running text is read from an end-of-text n-gram model: over all answers it is
counted how often a character-class 3-gram is the last of an answer, and an end that is hardly ever an end is a cut. The
model is two counts for each of 262,144 codes, summed map-side. Refusals are sentences that a word n-gram naive Bayes
model (`declining`) finds declining, in an answer that names no technique. Rules decide only closed formats: brackets
and quotes of lists and JSON, an ellipsis, half an id or a comma after an id at the end, words that stand for no answer, words in common with
the prompt.

A null or blank answer is `empty`, also with a null prompt; with a null or wordless prompt there is neither a copy nor
another language. Of repeated ids the delivery latest by `order` counts; rows with a null id are dropped.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import cut, latest, spread
from sievemill.llm.declining import LEAST_ODDS, odds
from sievemill.llm.language import detect, words_of

#: What stands for no answer.
NO_ANSWER = {"none", "null", "na", "n a", "nil", "nan", "empty", "no output", "no answer", "no response", "not available", "not applicable", "undefined", "blank", "void", "nothing", "no data", "no content", "missing"}
TECHNIQUE = re.compile(r"\bT(?:A?\d{4})(?:\.\d{3})?(?![\w])", re.I)
_CAPTION = re.compile(r"^\W*(?:#+ *)?(?:assistant|answer|output|response|result|note|reply|summary|log|finding|input|text|question|prompt)\s*[:：]\s*", re.I)
_WORD = re.compile(r"\w+")
_FENCE = re.compile(r"^```[\w-]*[ \t]*\n?|\n?[ \t]*```$")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"?')
#: An ellipsis, half a technique id or an id with a comma at the end.
_CUT = re.compile(r"(?:…|\.\.\.)$|\bT\d{4}(?:\.\d{3})?\W*,$|\bT(?:A?\d{0,3}|A?\d{4}\.\d{1,2})$")
ID_MARK = "\x00"
GRAM_CODES = 1 << 18
#: Places that end an answer less often than the average place are cuts.
END_MIN = 1.0
LANGUAGE_MARGIN = 0.25
LANGUAGE_GRAMS = 45


def _classes() -> np.ndarray:
    """Class of each code point below 65536: id 1, digit 2, small letter 3, capital 4, blank 5, full stop of East Asia 6, other mark 7, ASCII marks from 8."""
    made = np.full(1 << 16, 7, np.uint8)
    marks = 8
    for i in range(1 << 16):
        c = chr(i)
        if c == ID_MARK:
            made[i] = 1
        elif c.isdigit():
            made[i] = 2
        elif c.isalpha():
            made[i] = 4 if c.isupper() else 3
        elif c.isspace():
            made[i] = 5
        elif c in "。！？":
            made[i] = 6
        elif 32 < i < 127:
            made[i] = marks
            marks += 1
    return made


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    return _classes()


def shape(text: str) -> np.ndarray:
    """Character classes of a text; a technique id is one character, code points above 65535 are marks."""
    points = np.frombuffer(TECHNIQUE.sub(ID_MARK, text).encode("utf-32-le", "replace"), np.uint32)
    return classes()[np.minimum(points, 0xFFFF)]


def gram_codes(text: str) -> np.ndarray:
    """Codes of the class 3-grams that end at each character; the start of the text counts as class 0."""
    s = np.r_[0, 0, shape(text).astype(np.int32)]
    return s[:-2] << 12 | s[1:-1] << 6 | s[2:]


def bare(text: str | None) -> str:
    """The answer without outer blanks, zero-width marks and a code fence."""
    t = re.sub(r"[​-‏⁠﻿]", "", text or "").strip()
    return _FENCE.sub("", _FENCE.sub("", t)).strip() if t.startswith("```") else t


def is_empty(text: str) -> bool:
    body = text
    if re.sub(r"\s", "", body) in ("[]",):
        return False
    words = " ".join(_WORD.findall(_CAPTION.sub("", body).lower()))
    return not words or words in NO_ANSWER


def letters(text: str) -> str:
    """The text in lower case without white space and punctuation."""
    return "".join(c for c in text.lower() if unicodedata.category(c)[0] not in "CPZ")


def is_copy(text: str, prompt: str | None) -> bool:
    """Nearly all words are the prompt's, nearly all of the prompt is there, and no technique was named beyond it.

    A prompt of fewer than 4 different words (a whole Chinese clause is one) must be given as it is, but for punctuation.
    """
    asked = Counter(_WORD.findall((prompt or "").lower()))
    if len(asked) < 4:
        whole = letters(prompt or "")
        return bool(whole) and whole in (letters(text), letters(_CAPTION.sub("", text)))
    if {x.upper() for x in TECHNIQUE.findall(text)} - {x.upper() for x in TECHNIQUE.findall(prompt or "")}:
        return False
    given = Counter(_WORD.findall(_CAPTION.sub("", text).lower()))
    for name in ("summary", "finding_summary", "input", "finding", "text", "note"):
        if name not in asked:
            given.pop(name, None)
    if not given:
        return False
    known = sum(1 for w in given if w in asked)
    return known >= 0.8 * len(given) and known >= 0.75 * len(asked)


def is_refusal(text: str) -> bool:
    """Declining sentences; beside a technique id they are a quotation or a reservation, for the task was done."""
    if TECHNIQUE.search(text):
        return False
    said = ". ".join(_STRING.findall(text)) if "{" in text or "[" in text else _CAPTION.sub("", text)
    return odds(said) > LEAST_ODDS


def open_brackets(text: str) -> bool:
    """Whether a list or object, or a string in one, is still open at the end."""
    depth, quote, i = 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote and not (quote == "'" and i + 1 < len(text) and text[i + 1].isalnum()):
                quote = ""
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth = max(0, depth - 1)
        elif depth and c in "\"'":
            quote = c
        i += 1
    return bool(depth or quote)


def is_truncated(text: str, ends: np.ndarray) -> bool:
    """An open list or object, an ellipsis, half an id, a comma after an id, or an end that hardly ever is one; `ends` is the end-of-text model."""
    if open_brackets(text) or _CUT.search(text):
        return True
    return bool(ends[gram_codes(text[-40:])[-1]] < END_MIN)


def running_text(text: str) -> str:
    """Sentences only: of lists and JSON the string values that are sentences."""
    if text[:1] in "[{":
        return " ".join(s for s in _STRING.findall(text) if re.search(r"[.!?。！？]$", s.strip()))
    return TECHNIQUE.sub(" ", text)


def is_other_language(text: str, prompt: str | None) -> bool:
    """The answer's sentences, without the longer words of the prompt, are in another language or script than the prompt.

    Both must be clear: by the mean log-likelihood of an n-gram the answer's language leads over the prompt's in the
    answer, and the prompt's over the answer's in the prompt. Languages without a model differ by their script.
    """
    if not prompt or not prompt.strip():
        return False
    asked_words = words_of(prompt)
    given, score, n = detect(words_of(running_text(text)), frozenset(w for w in asked_words if len(w) > 5))
    if given is None or n < LANGUAGE_GRAMS:
        return False
    asked, own, n_asked = detect(asked_words)
    if asked is None or asked == given or n_asked < LANGUAGE_GRAMS:
        return False
    if asked not in own or given not in score:
        return "unknown" not in (asked, given) or max(score.values()) / n - score.get(asked, min(score.values())) / n > LANGUAGE_MARGIN
    return (score[given] - score[asked]) / n > LANGUAGE_MARGIN and own[asked] > own[given]


def defect(prompt: str | None, answer: str | None, ends: np.ndarray) -> str | None:
    text = bare(answer)
    if is_empty(text):
        return "empty"
    if is_copy(text, prompt):
        return "copy"
    if is_refusal(text):
        return "refusal"
    if is_truncated(text, ends):
        return "truncated"
    if is_other_language(text, prompt):
        return "other_language"
    return None


def _count_ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    inside, last = np.zeros(GRAM_CODES, np.int64), np.zeros(GRAM_CODES, np.int64)
    for frame in frames:
        codes = [c for answer in frame.answer[frame.answer.notna()] if len(c := gram_codes(bare(answer)))]
        if codes:
            inside += np.bincount(np.concatenate(codes), minlength=GRAM_CODES)
            last += np.bincount(np.array([c[-1] for c in codes]), minlength=GRAM_CODES)
    used = np.flatnonzero(inside)
    yield pd.DataFrame({"gram": used.astype("int32"), "n": inside[used], "n_end": last[used]})


def end_model(answers: DataFrame) -> np.ndarray:
    """How much oftener than an average place a class 3-gram ends an answer, by code, from all answers; 0 for unseen ones."""
    parts = answers.select("answer").mapInPandas(_count_ends, "gram int, n long, n_end long")
    rows = parts.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end")).collect()  # at most GRAM_CODES rows
    made = np.zeros(GRAM_CODES)
    usual = sum(r.n_end for r in rows) / max(1, sum(r.n for r in rows))
    for r in rows:
        made[r.gram] = r.n_end / r.n / usual
    return made


def defects(df: DataFrame, ident: str, prompt: str, answer: str, *, order: str | None = None) -> DataFrame:
    """`ident`, `defect_type` of every defective pair."""
    at = F.col(order) if order else F.lit(None).cast("timestamp")
    plain = df.select(F.col(ident).alias("id"), at.alias("at"), F.col(prompt).alias("prompt"), F.col(answer).alias("answer"))
    pairs = spread(cut(latest(plain, ["id"], ["at"], ["prompt", "answer"])))
    ends = end_model(pairs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kinds = [(i, k) for i, p, a in zip(frame.id, *(frame[c].astype(object).where(frame[c].notna(), None) for c in ("prompt", "answer")), strict=True) if (k := defect(p, a, ends))]
            yield pd.DataFrame({"id": pd.Series([i for i, _ in kinds], dtype=object), "defect_type": pd.Series([k for _, k in kinds], dtype=object)})

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.mapInPandas(run, f"id {kind}, defect_type string").withColumnRenamed("id", ident)
