"""Report text: pages, sections, findings. PDF bytes go through a pluggable extractor; the rest is plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.functions import fixed, text

PAGE = "path string, page_no int, page_text string, error string"
MARK = "\x1e"


def corpus_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime of the files below a folder; the bytes are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")


def pages(spark: SparkSession, folder: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """One row per page; a file that cannot be read gives one row with its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame.path, frame.content, strict=True):
                try:
                    out += [(path, i, t, None) for i, t in enumerate(extract(content))]
                except Exception as e:  # one bad file must not end the scan
                    out.append((path, None, None, str(e)[:500]))
            yield pd.DataFrame(out, columns=["path", "page_no", "page_text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(run, PAGE)


def page_batches(page_rows: DataFrame, size: int = 5, path: str = "pdf_path") -> DataFrame:
    """Groups of consecutive pages: batch_index, start_page, end_page, text with a header line per page."""
    page = F.struct("page_no", F.concat(F.lit("--- Page "), (F.col("page_no") + 1).cast("string"), F.lit(" ---\n"), F.coalesce("page_text", F.lit(""))).alias("t"))
    grouped = page_rows.where("page_no IS NOT NULL").groupBy(path, F.floor(F.col("page_no") / size).cast("int").alias("batch_index"))
    return grouped.agg(F.min("page_no").alias("start_page"), F.max("page_no").alias("end_page"), F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["t"]), "\n\n").alias("text"))  # at most `size` pages a group


def sections(doc: Column | str) -> Column:
    """Finding sections: from each score header to the next, else from each severity line, else the whole text."""
    t = F.coalesce(text.col(doc), F.lit(""))

    def parts(pattern: str, group: str) -> Column:
        marked = F.split(F.regexp_replace(t, f"({pattern})", f"{MARK}{group}"), MARK)
        return F.filter(F.transform(F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))), text.strip), lambda s: s != "")

    by_header, by_line = parts(fixed.SECTION_HEADER, "$1"), parts(fixed.SECTION_LINE, "$1")
    return F.when(F.size(by_header) > 0, by_header).when(F.size(by_line) > 0, by_line).otherwise(F.array(t))


def findings(docs: DataFrame, ident: str, body: str) -> DataFrame:
    """One finding per section of each document, with the extracted fields and their caps."""
    cut = docs.select(F.col(ident).alias("doc_id"), F.posexplode(sections(body)).alias("row_no", "section"))
    s = F.col("section")
    hosts = F.concat(F.slice(text.ips(s), 1, 20), F.slice(text.hostnames(s), 1, 10))
    return cut.select(
        "doc_id",
        "row_no",
        text.severity_in_text(F.substring_index(s, "\n", 1)).alias("severity"),
        F.coalesce(text.nvt_title(s), F.substring(text.strip(F.substring_index(s, "\n", 1)), 1, 200)).alias("title"),
        F.substring(s, 1, 5000).alias("description"),
        F.substring(s, 1, 2000).alias("raw_excerpt"),
        F.transform(hosts, lambda h: F.struct(h.alias("identifier"), F.lit("host").alias("asset_type"), F.lit(None).cast("string").alias("details"))).alias("affected_assets"),
        text.cves(s).alias("cve_ids"),
        text.cvss_in_text(s).alias("cvss_score"),
        text.oid(s).alias("nvt_oid"),
        text.nvt_title(s).alias("nvt_title"),
        text.ports(s).alias("ports"),
        text.services(s).alias("services"),
        text.hostnames(s).alias("hostnames"),
    )


def chunks(body: Column | str, size: int = 2000) -> Column:
    """The whole text in parts of `size` characters."""
    t = F.coalesce(text.col(body), F.lit(""))
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(t) - 1) / size), F.lit(0))), lambda i: F.substr(t, (i * size + 1).cast("int"), F.lit(size)))


_TITLE = r"(?m)^[ \t]*(?:\d+(?:\.\d+)+)[ \t]+"


def _marked(body: Column | str, pattern: str, kept: str) -> Column:
    """Parts of a text that start with a match of the pattern, which becomes `kept`."""
    parts = F.split(F.regexp_replace(F.coalesce(text.col(body), F.lit("")), pattern, f"{MARK}{kept}"), MARK)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def benchmark_blocks(docs: DataFrame, ident: str, body: str, least: int = 80, most: int | None = None) -> DataFrame:
    """Blocks that start with a dotted number, of at least so many characters, with their title line.

    Give whole documents (`whole_documents`): a block that runs over the end of a page is one block.
    """
    blocks = F.filter(F.transform(_marked(body, f"({_TITLE})", "$1"), text.strip), lambda b: F.length(b) >= least)
    chosen = F.slice(blocks, 1, most) if most else blocks
    cut = docs.select(F.col(ident).alias("doc_id"), F.posexplode(chosen).alias("block_no", "block"))
    return cut.select("doc_id", "block_no", F.regexp_extract("block", r"^(\d+(?:\.\d+)+)", 1).alias("number"), text.strip(F.regexp_extract("block", r"^\d+(?:\.\d+)+[ \t]+([^\n]*)", 1)).alias("title"), "block")


def whole_documents(page_rows: DataFrame, path: str = "pdf_path") -> DataFrame:
    """path and `body`: the pages of each file in order, one of each number, joined by line ends."""
    one = page_rows.where(F.col(path).isNotNull() & F.col("page_no").isNotNull()).groupBy(path, "page_no").agg(F.max(F.coalesce("page_text", F.lit(""))).alias("t"))
    return one.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "t"))), lambda p: p["t"]), "\n").alias("body"))  # the pages of one file


_BLOCK = "array<struct<label string, description string>>"


def rule_blocks(body: Column | str, most: int) -> Column:
    """Controls under rule headers: their description, rationale, audit and remediation of over 20 characters each, 80 in all."""

    def one(b: Column) -> Column:
        parts = [text.collapse(named_section(b, name, fixed.BLOCK_SECTIONS)) for name in ("Description", "Rationale", "Audit", "Remediation")]
        told = cleaned(F.array_join(F.filter(F.array(*parts), lambda p: F.length(p) > 20), "\n\n"))
        return F.struct(F.substring_index(b, "\n", 1).alias("label"), told.alias("description"))

    made = F.filter(F.transform(_marked(body, fixed.RULE_HEADER, "$1-$2\n"), one), lambda c: F.length(c["description"]) >= 80)
    return F.transform(F.slice(made, 1, most), lambda c: F.struct(c["label"].alias("label"), F.substring(c["description"], 1, 2000).alias("description")))


def triple_blocks(body: Column | str, most: int) -> Column:
    """Controls under numbers of three parts: the lines of over two characters, over 50 in all."""

    def one(b: Column) -> Column:
        lines = F.transform(F.split(b, "\n"), text.strip)
        kept = F.filter(lines, lambda x, i: (i == 1) | ((i > 1) & (F.length(x) > 2)))
        return F.struct(F.get(lines, F.lit(0)).alias("label"), cleaned(text.collapse(F.array_join(kept, " "))).alias("description"))

    made = F.filter(F.transform(_marked(body, fixed.TRIPLE_HEADER, "$1\n"), one), lambda c: F.length(c["description"]) > 50)
    return F.transform(F.slice(made, 1, most), lambda c: F.struct(c["label"].alias("label"), F.substring(c["description"], 1, 2000).alias("description")))


def benchmark_controls(docs: DataFrame, ident: str, body: str, most: int = 14) -> DataFrame:
    """doc_id, place, label, description: rule blocks where there are three or more, else those and the triple blocks."""
    rules = rule_blocks(body, most)
    chosen = F.when(F.size(rules) >= 3, rules).otherwise(F.slice(F.concat(rules, triple_blocks(body, most)), 1, most))
    each = docs.select(F.col(ident).alias("doc_id"), F.posexplode(chosen.cast(_BLOCK)).alias("place", "c"))
    return each.select("doc_id", "place", "c.label", "c.description")


def cleaned(body: Column | str) -> Column:
    """Extracted text without footer lines, page marks and leaders, collapsed, without marks at either end."""
    t = text.col(body)
    for pattern, by in ((fixed.FOOTER_LINE, " "), (fixed.PAGE_MARK, " "), (fixed.LEADER_LINE, " "), (fixed.TOC_TRAIL, "")):
        t = F.regexp_replace(t, pattern, by)
    return F.regexp_replace(text.collapse(t), r"^[\s.:;,_\-–—]+|[\s.:;,_\-–—]+$", "")


def demo_graph(controls: DataFrame, framework: str) -> DataFrame:
    """Export rows (vendor_name, control_id, description, mitre_ids) of benchmark or catalog controls, for `graph.nodes_and_links`."""
    from sievemill.functions import render

    return controls.select(F.col(framework).alias("vendor_name"), F.col("label").alias("control_id"), "description", render.control_techniques("label", "description").alias("mitre_ids"))


def named_section(body: Column | str, name: str, others: list[str]) -> Column:
    """Text after a line `name:` up to the next known heading line."""
    rest = "|".join(others)
    return text.blank_to_null(F.regexp_extract(text.col(body), rf"(?ms)^[ \t]*{name}:[ \t]*(.*?)(?=^[ \t]*(?:{rest}):|\z)", 1))


def display_clean(body: Column | str) -> Column:
    """Control text for display: without placeholders, dotted leaders and lines of dots and numbers."""
    t = F.regexp_replace(text.strip(text.col(body)), r"\[[Aa]ssignment:\s*[^\]]*\]", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\.{4,}", " "), r"(?m)^[\s.]{3,}\d*[\s.]*$", " ")
    return text.collapse(t)


def extraction_findings(rows: DataFrame) -> DataFrame:
    """Findings of extracted attributes: severity, title, description, affected_hosts, hostnames, cve_ids, cvss_score, ports,
    services (all lists as comma-separated text), remediation, extraction_text.

    Hosts come before host names, each once; CVE ids are found in their text; scores outside 0 to 10 are null. The title
    falls back to the extracted text. Titles, descriptions and excerpts are cut to 500, 2,000 and 5,000 characters.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(text.split_list(c), none)
    hosts = F.array_distinct(F.concat(listed("affected_hosts"), listed("hostnames")))
    return rows.select(
        *[c for c in ("finding_id", "packet_id") if c in rows.columns],
        text.severity_of_attribute("severity").alias("severity"),
        F.substring(F.coalesce("title", "extraction_text"), 1, 500).alias("title"),
        F.substring(F.coalesce("description", F.lit("")), 1, 2000).alias("description"),
        F.transform(hosts, lambda h: F.struct(h.alias("identifier"), F.lit("host").alias("asset_type"), F.lit(None).cast("string").alias("details"))).alias("affected_assets"),
        F.substring(F.coalesce("extraction_text", F.lit("")), 1, 5000).alias("raw_excerpt"),
        F.coalesce(F.regexp_extract_all("cve_ids", F.lit(fixed.CVE), F.lit(0)), none).alias("cve_ids"),
        text.score_of("cvss_score").alias("cvss_score"),
        F.coalesce(F.transform(F.array(text.blank_to_null("remediation")), lambda x: x), none).alias("recommendations"),
        listed("ports").alias("ports"),
        listed("services").alias("services"),
        listed("hostnames").alias("hostnames"),
    ).withColumn("recommendations", F.array_compact("recommendations"))
