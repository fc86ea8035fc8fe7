"""Texts and records made for models and viewers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from random import Random

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions import fixed, text

_NONE = "array<string>"


def packet_context(findings: Column | str, source: Column | str, kind: Column | str) -> Column:
    """Text of a packet for a prompt: a head, then per finding title, severity, 500 characters, CVE ids and 5 assets."""
    rows = text.col(findings)
    listed = lambda name, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n    {name}: "), F.array_join(items, ", "))).otherwise(F.lit(""))

    def one(f: Column, i: Column) -> Column:
        assets = F.transform(F.slice(F.coalesce(f["affected_assets"], F.array().cast("array<struct<identifier:string,asset_type:string,details:string>>")), 1, 5), lambda a: a["identifier"])
        head = F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), F.coalesce(f["title"], F.lit("")), F.lit(" ("), F.upper(F.coalesce(f["severity"], F.lit("unknown"))), F.lit(")"))
        return F.concat(head, F.lit("\n    "), F.substring(F.coalesce(f["description"], F.lit("")), 1, 500), F.lit("..."), listed("CVEs", F.coalesce(f["cve_ids"], F.array().cast(_NONE))), listed("Affected", assets))

    count = lambda s: F.size(F.filter(rows, lambda f: F.lower(f["severity"]) == s)).cast("string")
    head = F.concat(F.lit("Source: "), text.col(source), F.lit(" ("), text.col(kind), F.lit(")\nFindings: "), F.size(rows).cast("string"), F.lit(" total ("), count("critical"), F.lit(" critical, "), count("high"), F.lit(" high)\n\n--- Findings ---\n"))
    return F.concat(head, F.array_join(F.transform(rows, one), "\n"))


def examples(pool: Column | str) -> Column:
    """Numbered reference examples of an array of (technical_summary, mitre_ids, similarity), similarity to 3 places."""
    return F.array_join(F.transform(text.col(pool), lambda e, i: F.concat(F.format_string("Example %d (similarity %.3f)\nSummary: ", i + 1, e["similarity"]), F.coalesce(e["technical_summary"], F.lit("")), F.lit("\nTechniques: "), text.list_literal(e["mitre_ids"]))), "\n\n")


def query_text(summary: Column | str, ids: Column | str) -> Column:
    """What is embedded to look for controls."""
    head = F.concat(F.lit(fixed.QUERY_HEAD), F.coalesce(text.col(summary), F.lit("")))
    return F.when(F.size(text.col(ids)) > 0, F.concat(head, F.lit(fixed.QUERY_IDS), F.array_join(text.col(ids), ", "), F.lit("."))).otherwise(head)


def controls_text(best: Column | str, *lists: Column | str) -> Column:
    """Blocks of the best control, then the others, each control id once in order.

    A control is (control_id, vendor_product, remediation_steps, audit_procedure); missing fields read N/A.
    """
    rows = F.array_compact(F.concat(F.array(text.col(best)), *[F.coalesce(text.col(x), F.array().cast("array<struct<control_id:string,vendor_product:string,remediation_steps:string,audit_procedure:string>>")) for x in lists]))
    ids = F.transform(rows, lambda c: F.coalesce(c["control_id"], F.lit("unknown")))
    first = F.filter(rows, lambda c, i: F.array_position(ids, F.coalesce(c["control_id"], F.lit("unknown"))) == i + 1)
    field = lambda c, name: F.coalesce(c[name], F.lit("N/A"))
    block = lambda c, i: F.concat(F.when((i == 0) & text.col(best).isNotNull(), "[BEST MATCH] ").otherwise(""), F.lit("Control: "), F.coalesce(c["control_id"], F.lit("unknown")), F.lit("\n  Vendor/Product: "), field(c, "vendor_product"), F.lit("\n  Remediation: "), field(c, "remediation_steps"), F.lit("\n  Audit: "), field(c, "audit_procedure"))
    return F.array_join(F.transform(first, block), "\n\n")


def grounding_excerpt(supports: Column | str, most: int = 20, size: int = 500) -> Column:
    """At most so many supporting passages, each cut to its size, as a list."""
    return F.array_join(F.transform(F.slice(F.filter(text.col(supports), lambda s: text.safe_str(s) != ""), 1, most), lambda s: F.concat(F.lit("- "), F.substring(text.strip(s), 1, size))), "\n")


def snake_keys(raw: Column | str) -> Column:
    """JSON text with camel-case keys in snake case."""
    spaced = F.regexp_replace(text.col(raw), r'(?<=[a-z0-9])([A-Z])(?=[A-Za-z0-9]*"\s*:)', "_$1")
    keys = F.array_distinct(F.regexp_extract_all(spaced, F.lit(r'"([A-Za-z0-9_]*_[A-Z][A-Za-z0-9_]*)"\s*:'), F.lit(1)))
    return F.aggregate(keys, spaced, lambda t, k: F.replace(t, F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit('"'), F.lower(k), F.lit('"'))))


def search_reason(vendor_matched: Column, similarity: Column, composite: Column, hinted: Column, *, similarity_below: float = 0.42, composite_below: float = 0.48) -> Column:
    """Why a finding should be looked up elsewhere too, or null; the first reason that holds.

    Matched vendors never are; null scores are no reason.
    """
    lone = ~F.coalesce(vendor_matched, F.lit(False))
    return F.when(lone & F.coalesce(hinted, F.lit(False)), "vendor hint").when(lone & (similarity < similarity_below), "low similarity").when(lone & (composite < composite_below), "low composite")


def hinted(words: list[str], *texts: Column) -> Column:
    """Whether any of the texts holds any of the words, in any case."""
    return text.any_of(F.lower(F.concat_ws(" ", *texts)), [w.lower() for w in words if w]) if any(words) else F.lit(False)


def by_keywords(body: Column | str, families: list[tuple[list[str], list[str]]], default: list[str], most: int = 3) -> Column:
    """Techniques of the first keyword families that match, at least the default ones if there are too few."""
    low = F.lower(F.coalesce(text.col(body), F.lit("")))
    none = F.array().cast(_NONE)
    hits = text.bound(low, lambda t: F.flatten(F.array(*[F.when(text.any_of(t, words), F.array(*[F.lit(i) for i in ids])).otherwise(none) for words, ids in families]))) if families else none
    found = F.slice(F.array_distinct(hits), 1, most)
    filled = F.array_distinct(F.concat(found, F.array(*[F.lit(t) for t in default])))
    return F.when(F.size(found) >= len(default), found).otherwise(F.slice(filled, 1, len(default)))


def control_techniques(label: Column | str, body: Column | str) -> Column:
    """Techniques of a control by the words of its label and text: at most three, at least two."""
    found = by_keywords(F.concat_ws(" ", text.col(label), text.col(body)), fixed.TECHNIQUE_FAMILIES, [])
    some = F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(t) for t in fixed.TECHNIQUE_DEFAULT]))
    filled = F.slice(F.array_distinct(F.concat(some, F.array(*[F.lit(t) for t in fixed.TECHNIQUE_FILL]))), 1, 2)
    return F.when(F.size(some) >= 2, some).otherwise(filled)


def context_text(kind: Column, summary: Column | str, ids: Column | str, partner_summary: Column | str, wrong_ids: Column | str) -> Column:
    """The retrieval part of a training prompt by `labels.context_kind`.

    `partner` shows the partner's summary with the row's own ids (nothing if the summaries are equal), `contradictory` and
    `self` the row's summary with wrong ids or its own; no example is also what a kind without its text gives.
    """
    cut = lambda c, n: F.substring(F.trim(F.coalesce(text.col(c), F.lit(""))), 1, n)
    shown = lambda said, given: F.concat(F.lit("1. Summary: "), said, F.lit("\n   Verified MITRE IDs: "), text.list_literal(given), F.lit(" (similarity=0.850)"))
    own, theirs = cut(summary, 200), cut(partner_summary, 200)
    wrong = F.concat(F.coalesce(F.nullif(cut(summary, 120), F.lit("")), F.lit("Unrelated.")), F.lit(" [contradictory RAG]"))
    return F.coalesce(
        F.when((kind == "contradictory") & (F.size(wrong_ids) > 0), shown(wrong, text.col(wrong_ids))),
        F.when((kind == "partner") & (theirs != own) & text.col(partner_summary).isNotNull(), shown(F.concat(theirs, F.lit("...")), text.col(ids))),
        F.when(kind == "self", shown(F.concat(cut(F.replace(text.col(summary), F.lit("\n"), F.lit(" ")), 120), F.lit("...")), text.col(ids))),
        F.lit(fixed.NO_EXAMPLES),
    )


def is_transient(error: Exception) -> bool:
    """Whether a call is worth another try: by its status code, else by its message."""
    code = getattr(error, "code", None)
    if isinstance(code, int):
        return code in fixed.TRANSIENT_CODES
    said = str(error)
    return not re.search(fixed.PERMANENT_ERROR, said) and bool(re.search(fixed.TRANSIENT_ERROR, said))


def is_limited(error: Exception) -> bool:
    """Whether the service asks to wait longer."""
    return is_transient(error) and (getattr(error, "code", None) == 429 or bool(re.search(fixed.LIMITED_ERROR, str(error))))


def with_fallback(calls: list[Callable], **options) -> object:
    """The first of several models that answers; each is tried with `retrying`, and only transient failures move on."""
    for i, call in enumerate(calls):
        try:
            return retrying(call, **{"limited": is_limited, "transient": is_transient} | options)
        except Exception as e:
            if i + 1 == len(calls) or not is_transient(e):
                raise
    return None


def identifier(name: str) -> str:
    """A name that may stand in a query unquoted; others are an error."""
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_]*", name):
        raise ValueError(f"not a plain name: {name!r}")
    return name


def retrying(call: Callable, *, attempts: int = 5, base: float = 1.0, most: float = 60.0, limited: Callable[[Exception], bool] = lambda e: False, transient: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> object:
    """Calls until it succeeds: full-jitter waits, at least half of `most` on a rate limit; other errors pass at once."""
    rng = Random(seed)
    for turn in range(attempts):
        try:
            return call()
        except Exception as e:
            if turn + 1 == attempts or not (transient(e) or limited(e)):
                raise
            wait = rng.uniform(0, min(most, base * 2**turn))
            sleep(max(wait, most / 2) if limited(e) else wait)
    return None
