"""Verification of remediation output: grounding, relevance, completeness, substeps, verdict. Rows hold arrays of steps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import fixed, text

STEP = "array<struct<step_number int, title string, command_or_action string, explanation string, step_type string, ui_breadcrumb string, substeps array<string>>>"


def step_text(s: Column) -> Column:
    return F.concat_ws(" ", s["title"], s["command_or_action"], s["explanation"], F.coalesce(s["ui_breadcrumb"], F.lit("")), F.coalesce(s["step_type"], F.lit("")), F.array_join(F.coalesce(s["substeps"], F.array().cast("array<string>")), " "))


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def grounding(steps: str, source: str) -> Column:
    """Share of steps with a word of the source; 0 without steps."""
    words = text.step_tokens(source)
    hits = F.filter(steps, lambda s: F.arrays_overlap(text.step_tokens(step_text(s)), words))
    return _share(F.size(hits), F.greatest(F.coalesce(F.size(steps), F.lit(0)), F.lit(0)), 0.0)


def judged(verdicts: Column | str) -> Column:
    """Mean of judge verdicts: 1 for SUPPORTED, 0.5 for PARTIALLY_SUPPORTED, else 0."""
    value = lambda v: F.when(F.startswith(F.upper(F.trim(v)), F.lit("SUPPORTED")), 1.0).when(F.startswith(F.upper(F.trim(v)), F.lit("PARTIALLY_SUPPORTED")), 0.5).otherwise(0.0)
    v = text.col(verdicts)
    return _share(F.aggregate(v, F.lit(0.0), lambda s, x: s + value(x)), F.size(v), 0.0)


def combined(heuristic: Column, judge: Column | None) -> Column:
    """The heuristic alone without a judge or at 1, else the mean of both."""
    return heuristic if judge is None else F.when(heuristic >= 1.0, heuristic).otherwise((heuristic + judge) / 2)


def relevance(steps: str, summary: str, ids: str) -> Column:
    """Mean of the summary's words that the steps hold and of the ids that they name."""
    whole = F.array_join(F.transform(steps, step_text), " ")
    words = text.step_tokens(summary)
    recall = _share(F.size(F.array_intersect(words, text.step_tokens(whole))), F.size(words), 0.0)
    named = F.size(F.filter(ids, lambda t: F.contains(F.upper(whole), F.upper(t))))
    mention = _share(named, F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.lit(0)), 1.0)
    return F.when(F.size(steps) > 0, (recall + mention) / 2).otherwise(0.0)


def top_controls(best: str, vendor: str, framework: str, n: int = 3) -> Column:
    """First n distinct control ids: best, then vendor, then framework candidates."""
    none = F.array().cast("array<string>")
    ids = F.concat(F.array(F.col(best)), F.coalesce(vendor, none), F.coalesce(framework, none))
    return F.slice(F.array_distinct(F.filter(ids, lambda c: c.isNotNull() & (c != ""))), 1, n)


def completeness(top: Column, references: str, lifted: Column | None = None) -> Column:
    """Share of top controls that prefix a referenced id or are prefixed by one; 1 without any.

    Where `lifted` (an output from a search that names its limitations) none at all still counts as the threshold.
    """
    hits = F.filter(top, lambda c: F.exists(references, lambda r: F.startswith(c, r) | F.startswith(r, c)))
    score = _share(F.size(hits), F.size(top), 1.0)
    return score if lifted is None else F.when(F.coalesce(lifted, F.lit(False)) & (F.size(hits) == 0), F.greatest(score, F.lit(fixed.PASS_COMPLETENESS))).otherwise(score)


def substeps(steps: str) -> Column:
    return _share(F.size(F.filter(steps, lambda s: F.size(s["substeps"]) > 0)), F.greatest(F.coalesce(F.size(steps), F.lit(0)), F.lit(0)), 0.0)


def _note(check: str, severity: str, message: Column) -> Column:
    return F.concat(F.lit(f"[{check}/{severity}] "), message)


def substep_issues(steps: str) -> Column:
    """Per step, in order: few substeps, no place in the interface (not for commands), no confirmation among substeps."""
    subs = lambda s: F.coalesce(s["substeps"], F.array().cast("array<string>"))
    command = lambda s: F.coalesce(F.trim(s["command_or_action"]).rlike(fixed.CLI_STEP), F.lit(False))
    sure = lambda s: F.exists(subs(s), lambda x: x.rlike(fixed.CONFIRMATION))
    of_step = lambda s, told: F.concat(F.lit("Step "), s["step_number"].cast("string"), F.lit(told))

    def notes(s: Column) -> Column:
        few = F.when(F.size(subs(s)) == 0, _note("substep_quality", "error", of_step(s, ": no substeps"))).when(F.size(subs(s)) < 3, _note("substep_quality", "warning", of_step(s, ": fewer than 3 substeps")))
        lost = F.when(~command(s) & (F.coalesce(s["ui_breadcrumb"], F.lit("")) == ""), _note("substep_quality", "warning", of_step(s, ": no breadcrumb")))
        unsure = F.when((F.size(subs(s)) > 0) & ~sure(s), _note("substep_quality", "warning", of_step(s, ": no confirmation")))
        return F.array_compact(F.array(few, lost, unsure))

    return F.flatten(F.transform(steps, notes))


def issues(steps: str, source: str, summary: str, ids: str, top: Column, references: str) -> Column:
    """What each check has to say, as `[check/severity] message` in the order of the checks; made for the next attempt."""
    none = F.array().cast("array<string>")
    empty = F.array(*[_note(c, "error", F.lit("no steps")) for c in ("grounding", "relevance", "substep_quality")])
    words = text.step_tokens(source)
    loose = F.transform(F.filter(steps, lambda s: ~F.arrays_overlap(text.step_tokens(step_text(s)), words)), lambda s: _note("grounding", "warning", F.concat(F.lit("Step "), s["step_number"].cast("string"), F.lit(": no word of the source controls"))))
    whole = F.array_join(F.transform(steps, step_text), " ")
    asked = text.step_tokens(summary)
    recall = _share(F.size(F.array_intersect(asked, text.step_tokens(whole))), F.size(asked), 0.0)
    low = F.when(recall < 0.1, F.array(_note("relevance", "warning", F.lit("few words of the summary in the steps")))).otherwise(none)
    missing = F.filter(F.coalesce(ids, none), lambda t: ~F.contains(F.upper(whole), F.upper(t)))
    unnamed = F.when(F.size(missing) > 0, F.array(_note("relevance", "warning", F.concat(F.lit("techniques not named: "), F.array_join(missing, ", "))))).otherwise(none)
    unused = F.filter(top, lambda c: ~F.exists(F.coalesce(references, none), lambda r: F.startswith(c, r) | F.startswith(r, c)))
    left = F.when(F.size(unused) > 0, F.array(_note("completeness", "warning", F.concat(F.lit("top controls not used: "), F.array_join(unused, "; "))))).otherwise(none)
    return F.when(F.size(steps) > 0, F.concat(loose, low, unnamed, left, substep_issues(steps))).otherwise(F.concat(empty, left))


def verdict(df: DataFrame, *, steps: str = "steps", source: str = "source", summary: str = "summary", ids: str = "mitre_ids", best: str = "best", vendor: str = "vendor_ids", framework: str = "framework_ids", references: str = "references", judge: Column | None = None, lifted: Column | None = None) -> DataFrame:
    """Adds the four scores (rounded to 4), `passed` on the unrounded ones, and `issues` of all checks.

    `lifted` marks outputs that searched beyond the graph and name their limitations (see `completeness`).
    """
    top = top_controls(best, vendor, framework)
    scores = {
        "grounding": (combined(grounding(steps, source), judge), fixed.PASS_GROUNDING),
        "relevance": (relevance(steps, summary, ids), fixed.PASS_RELEVANCE),
        "completeness": (completeness(top, references, lifted), fixed.PASS_COMPLETENESS),
        "substep_quality": (substeps(steps), fixed.PASS_SUBSTEPS),
    }
    made = df
    for name, (score, _) in scores.items():
        made = made.withColumn(f"_{name}", score)
    passed = F.lit(True)
    for name, (_, least) in scores.items():
        passed = passed & (F.col(f"_{name}") >= least)
    made = made.withColumn("passed", passed).withColumn("issues", issues(steps, source, summary, ids, top, references))
    for name in scores:
        made = made.withColumn(name, F.round(f"_{name}", 4)).drop(f"_{name}")
    return made


def retried(rows: DataFrame, generate: Callable[[DataFrame, int], DataFrame], check: Callable[[DataFrame], DataFrame], retries: int = 2) -> DataFrame:
    """Generates and checks; rows that fail are generated again, up to `retries` times. Adds `attempts`.

    Each pass covers only the rows that failed the one before and hands their `issues` (null at first) to `generate`;
    the last attempt stays, passed or not.
    """
    from sievemill.operators.state import checkpointed

    own = [c for c in rows.columns if c != "issues"]
    done, todo = None, rows.select(*own, F.lit(None).cast("array<string>").alias("issues"))
    for attempt in range(retries + 1):
        checked = checkpointed(check(generate(todo, attempt)).withColumn("attempts", F.lit(attempt + 1)))
        final = checked if attempt == retries else checked.where("passed")
        done = final if done is None else done.unionByName(final)
        if attempt < retries:
            todo = checked.where("NOT passed").select(*own, "issues")
    return done
