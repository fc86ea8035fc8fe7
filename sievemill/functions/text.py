"""Column expressions for extraction and normalisation; all stay in the JVM. Null text gives null, or an empty array."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions import fixed

WS = r"[\s ]+"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at either end (`trim` knows blanks only)."""
    return F.regexp_replace(col(x), rf"^{WS}|{WS}$", "")


def safe_str(x: Column | str, default: str = "") -> Column:
    return F.coalesce(strip(x), F.lit(default))


def collapse(x: Column | str) -> Column:
    """Runs of white space become one blank; ends are stripped."""
    return F.trim(F.regexp_replace(col(x), WS, " "))


def blank_to_null(x: Column | str) -> Column:
    return F.when(strip(x) != "", strip(x))


def first_filled(*xs: Column | str) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(x) for x in xs])


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once a row: branches of a condition would compute it anew each."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def constants(words: list[str]) -> Column:
    """A literal array; one split of one literal, which the optimizer folds, is far quicker to plan than a literal each."""
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def any_of(x: Column, words: list[str]) -> Column:
    """Whether the lower-cased text holds any of the words, anywhere; null for null."""
    return F.exists(constants(words), lambda w: F.contains(x, w)) if words else F.lit(False)


def _ordered(x: Column, families: list[tuple[str, list[str]]]) -> Column:
    chain = F.when(F.lit(False), F.lit(""))
    for name, words in families:
        chain = chain.when(any_of(x, words), F.lit(name))
    return chain


def severity_of(x: Column | str) -> Column:
    """A cell as a severity: by score bands if it is a number, else by the first family with a word in it."""
    low = F.lower(strip(x))
    score = low.try_cast("double")
    banded = F.when(F.lit(False), F.lit(""))
    for least, name in fixed.SCORE_BANDS:
        banded = banded.when(score >= least, F.lit(name))
    return F.when(low.isNull(), F.lit("unknown")).when(score.isNotNull() & ~F.isnan(score), banded.otherwise("info")).otherwise(F.coalesce(_ordered(low, fixed.SEVERITY_WORDS), F.lit("unknown")))


def severity_of_attribute(x: Column | str) -> Column:
    """A severity attribute of an extraction by the words of running text; null and blank are unknown."""
    return severity_in_text(strip(F.coalesce(col(x), F.lit(""))))


def severity_in_text(x: Column | str) -> Column:
    return F.coalesce(bound(F.lower(col(x)), lambda low: _ordered(low, fixed.SEVERITY_TEXT_WORDS)), F.lit("unknown"))


def score_of(x: Column | str) -> Column:
    """A number from 0 to 10, else null."""
    n = strip(x).try_cast("double")
    return F.when((n >= 0) & (n <= 10), n)


def timestamp_of(x: Column | str) -> Column:
    """Timestamp without zone from ISO text, with T or blank, or a date; else null."""
    text = strip(x)
    return F.coalesce(text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")])


def _all(x: Column | str, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(col(x), F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def cves(x: Column | str) -> Column:
    """Distinct CVE ids, sorted; their case is kept."""
    return F.array_sort(F.array_distinct(_all(x, fixed.CVE)))


def ips(x: Column | str) -> Column:
    """Distinct IPv4 texts in order, whose first number is 2 to 254."""
    return F.array_distinct(F.filter(_all(x, fixed.IPV4), lambda ip: F.split_part(ip, F.lit("."), F.lit(1)).cast("int").between(2, 254)))


def _first(x: Column | str, pattern: str) -> Column:
    found = F.regexp_extract(col(x), pattern, 1)
    return F.when(found != "", strip(found))


def cvss_in_text(x: Column | str) -> Column:
    return _first(x, fixed.CVSS_TEXT).try_cast("double")


def oid(x: Column | str) -> Column:
    return _first(x, fixed.OID)


def nvt_title(x: Column | str) -> Column:
    return _first(x, fixed.NVT_TITLE)


def ports(x: Column | str) -> Column:
    """Distinct port numbers of `n/TCP` and `n/UDP` in order, 1 to 65535, as text."""
    return F.array_distinct(F.filter(_all(x, fixed.PORT, 1), lambda p: p.try_cast("long").between(1, 65535)))


def services(x: Column | str) -> Column:
    """Upper-case service words found anywhere, in the order of the list; `https` holds `http` too."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return bound(low, lambda t: F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w.upper())) for w in fixed.SERVICE_WORDS])))


def hostnames(x: Column | str) -> Column:
    return F.array_distinct(_all(F.lower(col(x)), fixed.HOSTNAME))


def split_list(x: Column | str) -> Column:
    """Comma-separated text as an array of stripped, non-empty parts."""
    return F.filter(F.transform(F.split(col(x), ","), strip), lambda p: p != "")


def document_summary(x: Column | str) -> Column:
    """Text after a summary heading if over 50 characters, else the first paragraph over 100; at most 1,000."""
    text = col(x)
    heads = []
    for head in (r"executive\s+summary", "summary", "overview"):
        body = strip(F.regexp_extract(text, rf"(?is){head}[:\s]*\n(.*?)(?=\n\s*\n|\Z)", 1))
        heads.append(F.when(F.length(body) > 50, F.substring(body, 1, 1000)))
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: F.length(p) > 100)
    return F.coalesce(*heads, F.substring(F.get(paragraphs, F.lit(0)), 1, 1000))


def title_without_score(x: Column | str) -> Column:
    return collapse(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?i)\s*\(CVSS:\s*[^)]+\)\s*$", ""))


def clean_summary(x: Column | str) -> Column:
    """One blank between words, none before marks, no repeated terminators."""
    text = F.regexp_replace(collapse(F.coalesce(col(x), F.lit(""))), r"\s+([,.;:])", "$1")
    return F.trim(F.regexp_replace(text, r"([.?!]){2,}", "$1"))


def word_count(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(x, " ")))


def valid_summary(x: Column | str) -> Column:
    """5 to 80 words, ends with a full stop, at most two sentence ends, no boilerplate; null is not valid."""
    text = clean_summary(x)
    bare = reduce(lambda t, noise: F.regexp_replace(t, noise, ""), fixed.SUMMARY_NOISE, text)
    ends = F.regexp_count(bare, F.lit(r"[.!?](?:\s|$)"))
    banned = reduce(lambda a, b: a | b, [text.rlike(f"(?i){p}") for p in fixed.BANNED_SUMMARY])
    return word_count(text).between(*fixed.SUMMARY_WORDS) & F.endswith(text, F.lit(".")) & (ends <= fixed.SUMMARY_ENDS) & ~banned


def plain_summary(title: Column | str, cve_ids: Column | str, service_names: Column | str) -> Column:
    """The sentence made without a model from title, first CVE and first service."""
    name = title_without_score(title)
    cve, service = blank_to_null(F.get(col(cve_ids), F.lit(0))), blank_to_null(F.get(col(service_names), F.lit(0)))
    filled = lambda form: reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.coalesce(kv[1], F.lit(""))), {"{cve}": cve, "{service}": service, "{title}": name}.items(), F.lit(form))
    text = F.when(cve.isNotNull() & service.isNotNull(), filled(fixed.PLAIN_BOTH)).when(cve.isNotNull(), filled(fixed.PLAIN_CVE)).when(service.isNotNull(), filled(fixed.PLAIN_SERVICE)).when(name != "", filled(fixed.PLAIN_TITLE)).otherwise(F.lit(fixed.PLAIN_NOTHING))
    return clean_summary(text)


def evidence(excerpt: Column | str, description: Column | str) -> Column:
    """The excerpt's first 2,500 characters, or the description's first 1,000."""
    e = F.coalesce(col(excerpt), F.lit(""))
    return F.when(e != "", F.substring(e, 1, 2500)).otherwise(F.substring(F.coalesce(col(description), F.lit("")), 1, 1000))


def joined_or(x: Column | str, default: str) -> Column:
    return F.coalesce(F.when(F.size(col(x)) > 0, F.array_join(col(x), ", ")), F.lit(default))


def cache_key(**fields: Column) -> Column:
    """SHA-256 over the JSON of the fields in name order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def technique_ids(x: Column | str) -> Column:
    """Ids named in model text, upper case, distinct in order; text after the first closing bracket is not read."""
    head = F.split_part(F.coalesce(col(x), F.lit("")), F.lit("]"), F.lit(1))
    return F.array_distinct(F.transform(_all(head, r"(?i)\bT\d{4}(?:\.\d{3})?\b"), F.upper))


def tokens(x: Column | str, pattern: str = "[a-z0-9]+", stop: list[str] = fixed.STOPWORDS) -> Column:
    """Distinct words over two characters that are no stop words."""
    found = F.filter(_all(F.lower(col(x)), pattern), lambda w: F.length(w) > 2)
    return F.array_except(found, constants(stop))


def step_tokens(x: Column | str) -> Column:
    """Distinct words and paths of a remediation step or its source, without their own stop words."""
    return tokens(x, r"[a-z0-9\\/.]+", fixed.STEP_STOPWORDS)


def root(x: Column | str) -> Column:
    return F.split_part(F.upper(col(x)), F.lit("."), F.lit(1))


def normal_ids(x: Column | str) -> Column:
    """Stripped, upper-case ids of the right form, distinct in order."""
    ids = F.transform(F.coalesce(col(x), F.array().cast("array<string>")), lambda t: F.upper(strip(t)))
    return F.array_distinct(F.filter(ids, lambda t: t.rlike(fixed.TECHNIQUE)))


def control_key(x: Column | str) -> Column:
    """`ac-2.1` as `AC-02.1`; other texts upper case without blanks."""
    text = F.upper(F.regexp_replace(F.coalesce(col(x), F.lit("")), r"\s", ""))
    head, number, tail = (F.regexp_extract(text, r"^([A-Z]{2})-(\d+)((?:\.\d+)*)$", g) for g in (1, 2, 3))
    padded = F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number)
    return F.when(head != "", F.concat(head, F.lit("-"), padded, tail)).otherwise(text)


def without_placeholders(x: Column | str, mark: str = "[ASSIGNMENT]") -> Column:
    return collapse(F.regexp_replace(col(x), r"\{\{[^}]*\}\}", mark))


def training_text(x: Column | str, cap: int = fixed.TRAINING_TEXT_CAP) -> Column:
    """Collapsed text without a leading label, cut at the cap with an ellipsis."""
    text = F.regexp_replace(collapse(F.coalesce(col(x), F.lit(""))), r"(?i)^(?:technical[ _]summary|summary|finding|description)\s*:\s*", "")
    return F.when(F.length(text) > cap, F.concat(F.rtrim(F.substring(text, 1, cap - 1)), F.lit("…"))).otherwise(text)


def list_literal(ids: Column | str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(col(ids), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))


def parse_literal(x: Column | str) -> Column:
    return _all(x, "'([^']*)'", 1)


def slug(x: Column | str, prefix: str = "fw-", size: int = 48) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(x), F.lit(""))), r"(?U)[^\w]+", "-"), "^-+|-+$", "")
    return F.substring(F.concat(F.lit(prefix), body), 1, size)


def node_id(*parts: Column, prefix: str = "ctl-", size: int = 24) -> Column:
    """Prefix and the first hex digits of the SHA-256 of the NUL-joined parts."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, size))


def truncate(x: Column | str, size: int) -> Column:
    return F.when(F.length(col(x)) > size, F.concat(F.regexp_replace(F.substring(col(x), 1, size - 1), r"\s+$", ""), F.lit("…"))).otherwise(col(x))


def step_numbers(issues: Column | str) -> Column:
    return F.array_distinct(F.flatten(F.transform(col(issues), lambda m: F.regexp_extract_all(m, F.lit(r"(?i)Step\s+(\d+)"), F.lit(1)))))


def has_c2_evidence(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike(fixed.C2_EVIDENCE), F.lit(False))


def has_initial_access(x: Column | str) -> Column:
    return bound(F.lower(F.coalesce(col(x), F.lit(""))), lambda low: any_of(low, fixed.TACTIC_WORDS["initial-access"]))


def technique_tactics() -> Column:
    """Map of technique to its tactics."""
    return F.from_json(F.lit(json.dumps(fixed.TECHNIQUE_TACTICS)), "map<string,array<string>>")


def tactics_in(x: Column | str) -> Column:
    """Tactics with at least one of their words anywhere in the text."""
    return bound(F.lower(F.coalesce(col(x), F.lit(""))), lambda low: F.array_compact(F.array(*[F.when(any_of(low, words), F.lit(t)) for t, words in fixed.TACTIC_WORDS.items()])))
