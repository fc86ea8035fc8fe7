"""Problem 5: cut oversized page batches into overlapping pieces at natural boundaries.

Separators form a hierarchy: section (page or heading), paragraph, line, sentence, word, character. A unit that exceeds the
room of a piece is split by the next finer separator only, and units are packed greedily up to the limit. Each piece
starts with the last `overlap` characters of the one before.

Pages of one batch arrive sorted from the shuffle and are packed as a stream, so a batch of any length needs the memory
of one page and one piece. Lengths are found first; only pages of oversized batches are moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 8000
OVERLAP = 200
SPAN = 4096
#: Cut points, coarse to fine: a cut falls at the end of a match.
SEPARATORS = (
    re.compile(r"\f|\n(?=[ \t]*(?:#{1,6} |SECTION\b|Section \d|CHAPTER\b|Control \S+\n|\d+(?:\.\d+)* [A-Z]))"),
    re.compile(r"\n[ \t\r]*\n\s*"),
    re.compile(r"\r?\n"),
    re.compile(r"[.!?…]+[\"')\]»”]*\s+|[。！？]+[”』」]*"),
    re.compile(r"\s+"),
)


def units(text: str, room: int, level: int = 0) -> Iterator[str]:
    """Consecutive parts of `text`, each at most `room` long, cut by the coarsest separator that does it."""
    if len(text) <= room:
        if text:
            yield text
        return
    if level == len(SEPARATORS):
        for at in range(0, len(text), room):
            yield text[at : at + room]
        return
    start = 0
    for cut in SEPARATORS[level].finditer(text):
        if 0 < cut.end() < len(text):
            yield from units(text[start : cut.end()], room, level + 1)
            start = cut.end()
    yield from units(text[start:], room, level + 1)


class Packer:
    """Packs units of numbered pages into pieces of at most `limit` characters."""

    def __init__(self, limit: int, overlap: int) -> None:
        if not 0 <= overlap < limit:
            raise ValueError("the overlap must be less than the limit")
        self.limit, self.overlap = limit, overlap
        self.held: list[tuple[int, str]] = []
        self.size = self.fresh = 0

    def add(self, page: int, text: str) -> Iterator[tuple[int, int, str]]:
        for unit in units(text, self.limit - self.overlap):
            if self.size + len(unit) > self.limit:
                yield self.piece()
                self._keep_tail()
            self.held.append((page, unit))
            self.size += len(unit)
            self.fresh += len(unit)

    def piece(self) -> tuple[int, int, str]:
        return self.held[0][0], self.held[-1][0], "".join(t for _, t in self.held)

    def close(self) -> Iterator[tuple[int, int, str]]:
        if self.fresh:
            yield self.piece()

    def _keep_tail(self) -> None:
        left, tail = self.overlap, []
        for page, text in reversed(self.held):
            if not left:
                break
            tail.append((page, text[-left:]))
            left -= len(tail[-1][1])
        self.held = tail[::-1]
        self.size, self.fresh = sum(len(t) for _, t in self.held), 0


def batches(progress: DataFrame) -> DataFrame:
    """pdf_path, batch_index, first, last of the latest `ok` entry with both pages; ties go to the greater entry_id."""
    good = progress.where("status = 'ok' AND start_page IS NOT NULL AND end_page IS NOT NULL AND pdf_path IS NOT NULL AND batch_index IS NOT NULL")
    best = good.groupBy("pdf_path", "batch_index").agg(F.max(F.struct("logged_at", "entry_id", "start_page", "end_page")).alias("e"))
    return best.select("pdf_path", "batch_index", F.least("e.start_page", "e.end_page").alias("first"), F.greatest("e.start_page", "e.end_page").alias("last"))


def batch_pages(progress: DataFrame, pages: DataFrame) -> DataFrame:
    """pdf_path, batch_index, page_no for pages in a batch.

    A batch of under SPAN pages lists its numbers. A wider one (a stray number can make it billions) lists the blocks of
    SPAN numbers it touches and meets only the pages that exist there, at most SPAN of one file in a block.
    """
    span = F.col("last").cast("long") - F.col("first").cast("long")
    ranges = batches(progress)
    narrow = ranges.where(span < SPAN).select("pdf_path", "batch_index", F.explode(F.sequence("first", "last")).alias("page_no"))
    bounds = pages.where("page_no IS NOT NULL").groupBy("pdf_path").agg(F.min("page_no").alias("lo"), F.max("page_no").alias("hi"))
    wide = ranges.where(span >= SPAN).join(bounds, "pdf_path").select("pdf_path", "batch_index", F.greatest("first", "lo").alias("first"), F.least("last", "hi").alias("last")).where("first <= last")
    block = lambda c: F.floor(F.col(c) / SPAN).cast("int")
    blocks = wide.select("*", F.explode(F.sequence(block("first"), block("last"))).alias("block"))
    there = pages.where("page_no IS NOT NULL").select("pdf_path", "page_no", block("page_no").alias("block")).distinct()
    met = blocks.join(there, ["pdf_path", "block"]).where("page_no BETWEEN first AND last").select("pdf_path", "batch_index", "page_no")
    return narrow.unionByName(met)


def oversized(progress: DataFrame, pages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """pdf_path, batch_index, n_chars of batches above the limit; a page delivered twice counts once, null as 0."""
    sizes = pages.groupBy("pdf_path", "page_no").agg(F.max(F.coalesce(F.char_length("page_text"), F.lit(0))).alias("n"))
    return batch_pages(progress, pages).join(sizes, ["pdf_path", "page_no"]).groupBy("pdf_path", "batch_index").agg(F.sum("n").alias("n_chars")).where(F.col("n_chars") > limit)


def _split_stream(limit: int, overlap: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["pdf_path", "batch_index", "piece_no", "start_page", "end_page", "text"]
        key, packer, number = None, None, 0
        for frame in frames:
            out: list[tuple] = []
            for path, batch, page, text in zip(frame.pdf_path, frame.batch_index, frame.page_no, frame.page_text, strict=True):
                if (path, batch) != key:
                    if packer:
                        for p in packer.close():
                            out.append((*key, number, *p))
                    key, packer, number = (path, batch), Packer(limit, overlap), 0
                for p in packer.add(page, text):
                    out.append((*key, number, *p))
                    number += 1
            yield pd.DataFrame(out, columns=names)
        if packer:
            yield pd.DataFrame([(*key, number, *p) for p in packer.close()], columns=names)

    return run


def pieces(progress: DataFrame, pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """pdf_path, batch_index, piece_no, start_page, end_page, text of every oversized batch.

    Joined without their overlaps, the pieces of a batch are its pages in order, character for character. Null and
    blank-free pages are fine: null adds nothing, a page without any break is cut at characters. Empty tables give no
    pieces; extra columns are ignored.
    """
    large = oversized(progress, pages, limit).select("pdf_path", "batch_index")
    keys = batch_pages(progress, pages).join(large, ["pdf_path", "batch_index"], "left_semi")
    texts = pages.where("page_text IS NOT NULL").groupBy("pdf_path", "page_no").agg(F.max(F.struct(F.char_length("page_text").alias("n"), "page_text")).alias("p")).select("pdf_path", "page_no", F.col("p.page_text").alias("page_text"))
    joined = keys.join(texts, ["pdf_path", "page_no"]).select("pdf_path", "batch_index", "page_no", "page_text")
    laid = joined.repartition("pdf_path", "batch_index").sortWithinPartitions("pdf_path", "batch_index", "page_no")
    return laid.mapInPandas(_split_stream(limit, overlap), "pdf_path string, batch_index int, piece_no int, start_page int, end_page int, text string")
