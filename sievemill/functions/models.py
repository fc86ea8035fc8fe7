"""Opaque row functions behind small interfaces, each with a deterministic stand-in that needs no network."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.functions import fixed, text


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Summarizer(Protocol):
    def summarize(self, prompts: list[str]) -> list[str | None]: ...


class Labeller(Protocol):
    def label(self, prompts: list[str]) -> list[str | None]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str], issues: list[str | None]) -> list[str | None]:
        """A JSON object of the OUTPUT fields for each prompt; `issues` is what was wrong with the last attempt."""


class Judge(Protocol):
    def judge(self, steps: list[str], sources: list[str]) -> list[str]: ...


class ControlExtractor(Protocol):
    def extract(self, texts: list[str]) -> list[str | None]:
        """A JSON array of CONTROL objects for each text."""


STEP = "struct<step_number int, title string, command_or_action string, explanation string, vendor_product string, step_type string, ui_breadcrumb string, substeps array<string>, evidence_tier string, supporting_urls array<string>>"
OUTPUT = f"struct<steps array<{STEP}>, priority string, estimated_effort string, prerequisites array<string>, verification string, source_control_ids array<string>, executive_summary string, limitations array<string>>"
CONTROL = "struct<control_id string, title string, remediation_steps string, audit_procedure string, mitre_ids array<string>>"


class TacticLabeller:
    """Names the first technique of every tactic that the prompt has a word of, as a list literal."""

    def label(self, prompts: list[str]) -> list[str | None]:
        first = {}
        for technique, tactics in fixed.TECHNIQUE_TACTICS.items():
            first.setdefault(tactics[0], technique)
        return [str([first[t] for t, words in fixed.TACTIC_WORDS.items() if t in first and any(w in p.lower() for w in words)][: fixed.MAX_TECHNIQUES]) for p in prompts]


class ControlGenerator:
    """One step per control block of the prompt, in its words; on a second attempt it names all techniques and confirms."""

    def generate(self, prompts: list[str], issues: list[str | None]) -> list[str | None]:
        out = []
        for prompt, wrong in zip(prompts, issues, strict=True):
            ids = re.findall(r"Control: (\S+)", prompt)
            todo = re.findall(r"Remediation: ([^\n]*)", prompt)
            named = ", ".join(dict.fromkeys(re.findall(r"\bT\d{4}(?:\.\d{3})?\b", prompt)))
            head = prompt.split("\n", 1)[0]
            substeps = ["Open the settings of the system.", "Apply the change."] + (["Verify that the new value is shown."] if wrong else [])
            steps = [{"step_number": i, "title": f"Apply {c}", "command_or_action": t, "explanation": f"{head} {named}" if wrong else head, "step_type": "ui", "ui_breadcrumb": "Settings", "substeps": substeps} for i, (c, t) in enumerate(zip(ids, todo, strict=False), 1)]
            out.append(json.dumps({"steps": steps, "priority": "medium", "estimated_effort": "1 hour", "prerequisites": [], "verification": "Check the settings again.", "source_control_ids": ids, "executive_summary": head, "limitations": []}))
        return out


class OverlapJudge:
    """SUPPORTED where half of a step's longer words stand in the source, PARTIALLY_SUPPORTED where any does."""

    def judge(self, steps: list[str], sources: list[str]) -> list[str]:
        out = []
        for step, source in zip(steps, sources, strict=True):
            words, have = ({w for w in re.findall(r"[a-z0-9]+", x.lower()) if len(w) > 4} for x in (step, source))
            share = len(words & have) / len(words) if words else 0
            out.append("SUPPORTED" if share >= 0.5 else "PARTIALLY_SUPPORTED" if share else "NOT_SUPPORTED")
        return out


class BlockExtractor:
    """Controls of blocks that start with a dotted number."""

    def extract(self, texts: list[str]) -> list[str | None]:
        out = []
        for t in texts:
            heads = list(re.finditer(r"(?m)^\s*(\d+(?:\.\d+)+)[ \t]+([^\n]+)", t))
            ends = [*(h.start() for h in heads[1:]), len(t)][: len(heads)]
            out.append(json.dumps([{"control_id": h[1], "title": h[2].strip(), "remediation_steps": t[h.end() : e].strip(), "mitre_ids": re.findall(r"\bT\d{4}(?:\.\d{3})?\b", t[h.end() : e])} for h, e in zip(heads, ends, strict=True)]))
        return out


class HashEmbedder:
    """Signed feature hashing of words and their neighbours; unit length."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            words = re.findall(r"[a-z0-9]+", (t or "").lower())
            for feature in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
                h = zlib.crc32(feature.encode())
                out[i, h % self.dim] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embedded(df: DataFrame, column: str, out: str, embedder: Embedder) -> DataFrame:
    """Adds `out array<float>`, made in batches; a null text gives a zero vector."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            yield pd.Series([v.astype("float32") for v in embedder.embed(s.fillna("").tolist())])

    return df.withColumn(out, F.pandas_udf(run, T.ArrayType(T.FloatType()), F.PandasUDFType.SCALAR_ITER)(F.col(column)))


def summarized(findings: DataFrame, summarizer: Summarizer | None, prompt: str = "prompt", cache: DataFrame | None = None) -> DataFrame:
    """Adds `technical_summary` and `summary_source`: the cached or the model's text if it is valid, else the plain sentence.

    `cache` is (key, summary) with the key that is added as `cache_key`; `operators.state.cache_put` stores what is new.
    """
    from sievemill.operators.state import cache_lookup

    plain = text.plain_summary("title", F.coalesce("cve_ids", F.array().cast("array<string>")), F.coalesce("services", F.array().cast("array<string>")))
    if summarizer is None:
        return findings.withColumn("technical_summary", plain).withColumn("summary_source", F.lit("plain")).withColumn("cache_key", F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        wanted = prompts[prompts.notna()]
        said = pd.Series(summarizer.summarize(wanted.tolist()), index=wanted.index, dtype=object) if len(wanted) else pd.Series(dtype=object)
        return said.reindex(prompts.index)

    keyed = findings.withColumn("_key", F.sha2(F.coalesce(prompt, F.lit("")), 256))
    if cache is not None:
        keyed = cache_lookup(keyed, cache.select(F.col("key").alias("_key"), F.col("summary").alias("_cached")), "_key", "_cached").drop("hit")
    else:
        keyed = keyed.withColumn("_cached", F.lit(None).cast("string"))
    # The model is asked only where the cache has nothing: a null prompt reaches `ask` as one to leave out.
    asked = keyed.withColumn("_said", F.coalesce("_cached", text.clean_summary(ask(F.when(F.col("_cached").isNull(), F.coalesce(prompt, F.lit("")))))))
    good = F.coalesce(text.valid_summary("_said"), F.lit(False))
    source = F.when(good & F.col("_cached").isNotNull(), "cache").when(good, "model").otherwise("plain")
    return asked.withColumn("technical_summary", F.when(good, F.col("_said")).otherwise(plain)).withColumn("summary_source", source).withColumn("cache_key", F.col("_key")).drop("_said", "_cached", "_key")


def labelled(df: DataFrame, labeller: Labeller, prompt: str = "prompt") -> DataFrame:
    """Adds `raw_model_output` and the `mitre_ids` named in it."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return pd.Series(labeller.label(prompts.fillna("").tolist()))

    return df.withColumn("raw_model_output", ask(F.col(prompt))).withColumn("mitre_ids", text.technique_ids("raw_model_output"))


def generated(df: DataFrame, generator: Generator, prompt: str = "prompt", issues: str = "issues") -> DataFrame:
    """Adds `output` (null where the answer is no JSON of its form); `issues array<string>` goes to the model as lines."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series, wrong: pd.Series) -> pd.Series:
        return pd.Series(generator.generate(prompts.fillna("").tolist(), [w if w else None for w in wrong]))

    return df.withColumn("output", F.from_json(ask(F.col(prompt), F.array_join(F.coalesce(issues, F.array().cast("array<string>")), "\n")), OUTPUT))


def judged(df: DataFrame, judge: Judge, steps: Column, source: str, out: str = "verdicts") -> DataFrame:
    """Adds the judge's verdict of each of `steps` (array of texts) against the source."""

    @F.pandas_udf("array<string>")
    def ask(lists: pd.Series, sources: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in lists]
        flat = [s or "" for x in lists if x is not None for s in x]
        said = iter(judge.judge(flat, [s or "" for s, n in zip(sources, sizes, strict=True) for _ in range(n)]))
        return pd.Series([[next(said) for _ in range(n)] for n in sizes])

    return df.withColumn(out, ask(steps, F.col(source)))


def extracted_controls(df: DataFrame, extractor: ControlExtractor, body: str = "text") -> DataFrame:
    """One row per control of each text, with the other columns; texts without any give no row."""

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        return pd.Series(extractor.extract(texts.fillna("").tolist()))

    own = [c for c in df.columns if c != body]
    return df.withColumn("_c", F.explode(F.from_json(ask(F.col(body)), f"array<{CONTROL}>"))).select(*own, "_c.*")
