"""Problem 8: how demanding each document is to read, on the scale of graded examples.

Boosted regression trees over the distributions of word and sentence lengths, vocabulary, syntax and cohesion. They are
trained on the graded examples (at most `MAX_EXAMPLES`, the lowest hashes of the id), in folds by that hash as the
examples name no source; the line through the out-of-fold predictions calibrates the level, and `profile` shows the
predictions by document source. Documents are scored row by row in Arrow batches, over their whole texts.

Each document also gets a kind: `empty` (null or without words), `listing`, `other_language`, `short` (under 80 words)
or `prose`. Only prose has a level that means something; the level is null for the empty kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm import gbrt
from sievemill.llm.common import spread
from sievemill.llm.language import detect

MAX_EXAMPLES = 5000
FOLDS = 5
MIN_WORDS = 80
#: Words that tie English sentences together.
COMMON = set("the of and to a in is that it for on with as was be by this are at from or an have not which you we they their its his her our your i he she has had were but if when what there can will would should may could do does did so than then them these those who how no more one after before all any each into out up over under while where because although whether both either neither such only also must until most does about here every other same just very".split())
CONNECTIVES = set("however therefore consequently moreover furthermore nevertheless nonetheless thus hence although though because since whereas unless whether while so but and if when then first after before".split())
SUBORDINATORS = set("that which who whom whose although because since whereas unless whether while if when until where though than".split())
PRONOUNS = set("i you he she it we they me him her us them my your his our their this these those".split())
_WORDS = re.compile(r"[a-z0-9]+")
_ALPHA = re.compile(r"[^\W\d_]+")
_ALPHA_ASCII = re.compile(r"[a-z]+")
_PLAIN = re.compile(r"(?<!\S)[(\[\"'“‘’]*[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\]\"'’”]*(?!\S)")
_UNSPACED = re.compile("[\u3040-\u9fff\uac00-\ud7a3]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_VOWELS = re.compile(r"[aeiouy]+")
_NOMINAL = re.compile(r"(?:tion|sion|ment|ness|ity|ance|ence|ism|ship|ation)s?$")
SHARES = ["seven_letters", "ten_letters", "thirteen_letters", "four_syllables", "common", "nominal", "subordinators", "connectives", "pronouns", "adverbs"]
NAMES = ["letters", "letters_sd", "letters_p90", "syllables", "sentence", "sentence_sd", "sentence_p90", "type_token", "commas", "marks", "overlap", *SHARES]
#: Text whose words are to this share common English ones is English without a look at its letters.
SURELY_ENGLISH = 0.3


def _traits(w: str) -> tuple:
    """Letters, syllables and, as 0 or 1, what SHARES names."""
    n, syllables = len(w), max(1, len(_VOWELS.findall(w)))
    return n, syllables, n >= 7, n >= 10, n >= 13, syllables >= 4, w in COMMON, bool(_NOMINAL.search(w)), w in SUBORDINATORS, w in CONNECTIVES, w in PRONOUNS, w.endswith("ly")


class Lexicon:
    """Traits of the words a worker has met, as rows of one table; it is emptied when full, which changes no result."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, 2 + len(SHARES)))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.place) + len(words) > self.most:
            self.place.clear()
        fresh = [w for w in words if w not in self.place]
        at = len(self.place)
        if at + len(fresh) > len(self.table):
            grown = np.zeros((2 * (at + len(fresh)), self.table.shape[1]))
            grown[:at] = self.table[:at]
            self.table = grown
        for i, w in enumerate(fresh, at):
            self.place[w] = i
            self.table[i] = _traits(w)
        return self.table[[self.place[w] for w in words]]


@lru_cache(maxsize=1)
def lexicon() -> Lexicon:
    return Lexicon()


class Reading:
    """A text taken apart once: its sentences as lists of lower-cased words, and the count of each word."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.low = self.text.lower()
        words = (_ALPHA_ASCII if self.low.isascii() else _ALPHA).findall
        self.sentences = [w for s in _SENTENCE.split(self.low) if (w := words(s))]
        self.seen = Counter(w for s in self.sentences for w in s)
        self.n = sum(map(len, self.sentences))

    def features(self) -> np.ndarray:
        """Feature row, in the order of NAMES; zeros without words."""
        if not self.n:
            return np.zeros(len(NAMES))
        n, sentences, text = self.n, self.sentences, self.text
        counts = np.fromiter(self.seen.values(), float, len(self.seen))
        traits = lexicon().rows(list(self.seen))
        letters = traits[:, 0]
        order = np.argsort(letters, kind="stable")
        mean = (letters * counts).sum() / n
        deviation = np.sqrt(((letters - mean) ** 2 * counts).sum() / n)
        p90 = letters[order][np.searchsorted(np.cumsum(counts[order]), 0.9 * n)]
        syllables, *shares = counts @ traits[:, 1:] / n
        lengths = sorted(map(len, sentences))
        k = len(lengths)
        middle = n / k
        deviation_of = (sum((x - middle) ** 2 for x in lengths) / k) ** 0.5
        place = 0.9 * (k - 1)
        low = int(place)
        sentence_p90 = lengths[low] + (place - low) * (lengths[min(low + 1, k - 1)] - lengths[low])
        content = [{w for w in s if len(w) > 4} for s in sentences]
        pairs = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:], strict=False)]
        marks = (text.count(";") + text.count(":") + text.count("(")) / len(sentences)
        return np.array([mean, deviation, p90, syllables, middle, deviation_of, sentence_p90, len(self.seen) / n**0.75, text.count(",") / len(sentences), marks, sum(pairs) / len(pairs) if pairs else 0.0, *shares])

    def kind(self) -> str:
        if not self.n and not _WORDS.search(self.low):
            return "empty"
        tokens = len(self.text.split())
        plain = len(_PLAIN.findall(self.text))
        if plain < 0.4 * tokens and (self.text.isascii() or len(_UNSPACED.findall(self.text)) < 0.2 * len(self.text)):
            return "listing"
        common = sum(k for w, k in self.seen.items() if w in COMMON)
        if common < SURELY_ENGLISH * self.n:
            language, _, grams = detect(Counter({w: k for w, k in self.seen.items() if w.isalpha()}))
            if common < 0.12 * self.n and (language in (None, "en") or grams < 60):
                return "listing"
            if language not in (None, "en"):
                return "other_language"
        if plain < 0.7 * tokens:
            return "listing"
        return "short" if len(_WORDS.findall(self.low)) < MIN_WORDS else "prose"


def features(text: str) -> np.ndarray:
    return Reading(text).features()


def kind_of(text: str | None) -> str:
    return Reading(text).kind()


def train(examples: DataFrame, *, limit: int = MAX_EXAMPLES, folds: int = FOLDS) -> tuple[gbrt.Boosted, pd.DataFrame]:
    """The calibrated model and the examples with their out-of-fold levels.

    Examples with a null level or a blank text are left out; without any example the level is a constant 0.
    """
    usable = examples.where("reading_level IS NOT NULL AND trim(text) <> ''").select("example_id", "text", F.col("reading_level").cast("double").alias("level"), F.xxhash64("text").alias("h"))
    rows = usable.dropDuplicates(["h"]).orderBy("h").limit(limit).toPandas()  # at most `limit` rows
    if rows.empty:
        return gbrt.Boosted(0.0, 0.1, []), rows.assign(held_out=[])
    x = np.vstack([features(t) for t in rows.text])
    model, held = gbrt.cross_validated(x, rows.level.to_numpy(), np.arange(len(rows)) % folds)
    return model, rows.drop(columns=["text", "h"]).assign(held_out=held)


def _score(model: gbrt.Boosted, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                texts = batch.column(text).to_pylist()
                read = [Reading(t) for t in texts]
                kinds = [r.kind() for r in read]
                levels = model.predict(np.vstack([r.features() for r in read]))
                levels = [None if k == "empty" else float(v) for k, v in zip(kinds, levels, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(kinds, pa.string()), pa.array(levels, pa.float64())], names=[*keep, "kind", "level"])

    return run


def score(documents: DataFrame, model: gbrt.Boosted, *, keep: list[str], text: str = "text", lowest: int = 1, highest: int = 4) -> DataFrame:
    """`keep`, kind, level and grade (the level rounded to the scale); one row per input row, no shuffle of results."""
    plain = spread(documents.select(*keep, text))
    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    scored = plain.mapInArrow(_score(model, keep, text), f"{kept}, kind string, level double")
    grade = F.least(F.greatest(F.round("level").cast("int"), F.lit(lowest)), F.lit(highest))
    return scored.withColumn("grade", F.when(F.col("kind") != "empty", grade))


def profile(scored: DataFrame, source: str = "source") -> DataFrame:
    """Per source (trimmed, lower case) and kind: documents, mean level and documents per grade."""
    where = F.lower(F.trim(source)).alias("source")
    counts = [F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in (1, 2, 3, 4)]
    return scored.groupBy(where, "kind").agg(F.count("*").alias("documents"), F.avg("level").alias("mean_level"), *counts)
