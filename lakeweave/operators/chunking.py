"""Documents into chunks: packed sections, windows of units, sliding splits, Markdown sections.

Each splitter is a small function of one text, run in Arrow batches; Spark deals the documents. Offsets are true places
in the text, indexes run from 0, and every splitter moves on by at least one character.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..shipping import ship_package

MOST, LEAST, OVERLAP, BLOCK_MOST, SOFT_STEP, HARD = 2000, 400, 100, 3000, 1600, 2600
SPEC = "chunk_index int, content string, start long, stop long, section string"
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)\s*$")

Span = tuple[int, int]


def _lines(text: str) -> Iterator[Span]:
    at = 0
    for line in text.splitlines(keepends=True):
        yield at, at + len(line)
        at += len(line)


def cut_span(text: str, start: int, stop: int, most: int, marks: str = "。\n", least: float = 0.5) -> list[Span]:
    """Pieces of at most ``most`` characters, cut behind the last mark that lies past ``least`` of a piece."""
    out = []
    while stop - start > most:
        at = max(text.rfind(m, start + int(most * least), start + most) for m in marks) + 1
        end = at if at > start else start + most
        out.append((start, end))
        start = end
    if stop > start:
        out.append((start, stop))
    return out


def sections(text: str) -> list[tuple[str, int, int]]:
    """(path of headings, start, stop) of the parts between Markdown headings; fenced code isn't read for headings."""
    out, path, start, fenced = [], [], 0, False
    for a, b in _lines(text):
        line = text[a:b].rstrip("\n")
        if line.lstrip().startswith("```"):
            fenced = not fenced
        found = None if fenced else _HEADING.match(line)
        if found:
            if text[start:a].strip():
                out.append((" / ".join(p for p in path if p), start, a))
            level = len(found[1])
            path = [*path[: level - 1], *[""] * (level - 1 - len(path[: level - 1])), found[2]]
            start = a
    if text[start:].strip():
        out.append((" / ".join(p for p in path if p), start, len(text)))
    return out


def section_pack(text: str) -> list[tuple[int, int, str]]:
    """Sections packed up to MOST characters: long ones are cut first, short chunks join the one before."""
    spans: list[tuple[int, int, str]] = []
    for path, a, b in sections(text):
        spans += [(x, y, path) for x, y in (cut_span(text, a, b, SOFT_STEP) if b - a > BLOCK_MOST else [(a, b)])]
    packed: list[tuple[int, int, str]] = []
    for a, b, path in spans:
        if packed and b - packed[-1][0] <= MOST:
            packed[-1] = (packed[-1][0], b, packed[-1][2])
        else:
            packed.append((max(a - OVERLAP, packed[-1][0] + 1) if packed else a, b, path))
    merged: list[tuple[int, int, str]] = []
    for a, b, path in packed:
        if merged and merged[-1][1] - merged[-1][0] < LEAST and b - merged[-1][0] <= HARD:
            merged[-1] = (merged[-1][0], b, merged[-1][2])
        else:
            merged.append((a, b, path))
    return [(x, y, path) for a, b, path in merged for x, y in (cut_span(text, a, b, MOST) if b - a > HARD else [(a, b)])]


def fixed_overlap(text: str) -> list[tuple[int, int, str]]:
    """A window over units between blank lines: as many as fit, the last one again at the start of the next."""
    units: list[Span] = []
    for m in re.finditer(r"(?:[^\n]+\n?)+", text):
        units += cut_span(text, m.start(), m.end(), MOST, "。，\n")
    out, i = [], 0
    while i < len(units):
        j = i
        while j + 1 < len(units) and units[j + 1][1] - units[i][0] <= MOST:
            j += 1
        out.append((units[i][0], units[j][1], ""))
        if j + 1 >= len(units):
            break
        i = max(j, i + 1) if units[j][1] - units[j][0] <= OVERLAP else j + 1
    return out


def sliding(text: str, size: int = 1200, overlap: int = 120) -> list[tuple[int, int, str]]:
    """Pieces of ``size`` with an overlap, cut behind a paragraph, line or blank past 55% of a piece."""
    out, start = [], 0
    while start < len(text):
        stop = min(start + size, len(text))
        if stop < len(text):
            for mark in ("\n\n", "\n", " "):
                at = text.rfind(mark, start + int(size * 0.55), stop)
                if at >= 0:
                    stop = at + len(mark)
                    break
        out.append((start, stop, ""))
        if stop >= len(text):
            break
        start = max(stop - overlap, start + 1)
    return out


def atomic(text: str) -> list[tuple[int, int, str]]:
    return [(0, len(text), "")] if text.strip() else []


def recursive(text: str, most: int = 3000, overlap: int = 200, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[tuple[int, int, str]]:
    """Spans of at most ``most`` characters for a model's context: cut behind the last paragraph end, else line end, else
    blank, that lies past the overlap; each span after the first begins up to ``overlap`` characters before the last's
    end, behind the first blank there."""
    out, start, n = [], 0, len(text)
    while n - start > most:
        end = start + most
        for m in marks:
            at = text.rfind(m, start + overlap + 1, end) if m else -1
            if at >= 0:
                end = at + len(m)
                break
        out.append((start, end, ""))
        blank = text.find(" ", end - overlap, end)
        start = max(start + 1, blank + 1 if blank >= 0 else end - overlap)
    return [*out, (start, n, "")] if text.strip() else []


STRATEGIES: dict[str, Callable[[str], list[tuple[int, int, str]]]] = {"atomic": atomic, "section_pack": section_pack, "fixed_overlap": fixed_overlap, "sliding": sliding, "recursive": recursive}


def strategy(text: Column, source: Column | None = None) -> Column:
    """atomic under 500 tokens; packed sections for Markdown; windows for logs and lists and for very long texts."""
    tokens = tx.estimated_tokens(text)
    lines = F.split(text, "\n")
    listed = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(\[?\d{1,2}:\d{2}|\d{4}-\d{2}-\d{2}|[-*•])"))) / F.greatest(F.size(lines), F.lit(1))
    by_text = F.when(tokens < 500, "atomic").when(text.rlike(r"(?m)^#{1,6}\s+\S"), "section_pack").when(listed > 0.3, "fixed_overlap").when(tokens > 4000, "fixed_overlap").otherwise("section_pack")
    return by_text if source is None else F.when(source == "markdown", "section_pack").when(source.isin("chat", "log"), "fixed_overlap").otherwise(by_text)


#: A task passes chunks on when it holds this many characters of them, however many texts a batch has.
PIECE = 1 << 20
_KINDS = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())


class _Held:
    """Chunks (row of the batch, and the columns of ``SPEC``) until they are passed on."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += len(row[2])

    def taken(self, keys: pa.Array) -> pa.RecordBatch:
        at, *columns = (pa.array(c, kind) for c, kind in zip(zip(*self.rows, strict=True), _KINDS, strict=True))
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([keys.take(at), *columns], names=["key", "chunk_index", "content", "start", "stop", "section"])


def chunk(docs: DataFrame, key: str, text: str, how: str | Column) -> DataFrame:
    """(key, chunk_index, content, start, stop, section): ``how`` names a strategy, or is a column that does."""
    ship_package(docs.sparkSession)
    chosen = F.lit(how) if isinstance(how, str) else how
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), chosen.alias("how"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _Held()
            for at in range(batch.num_rows):
                t = batch.column(1)[at].as_py()
                for i, (a, b, path) in enumerate(STRATEGIES[batch.column(2)[at].as_py()](t)):
                    held.add(at, i, t[a:b], a, b, path)
                    if held.size >= PIECE:
                        yield held.taken(batch.column(0))
            if held.rows:
                yield held.taken(batch.column(0))

    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, {SPEC}").withColumnRenamed("key", key)


#: Ends of sentences, and the size that chunks should have.
SENTENCE_ENDS, IDEAL = "。！？.!?；;", 2000


def breaks(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Of each document: chunks, breaks between them, how many leave a sentence whole, and how many lie well: after a
    sentence, or before an empty line, a heading or a list item. Documents with one chunk have no break."""
    w = Window.partitionBy(key).orderBy(order)
    after = F.lead(content).over(w)
    whole = F.right(F.col(content), F.lit(1)).isin(*SENTENCE_ENDS)
    well = whole | after.rlike(r"^(\n\n| .|#{1,4} |[-*+] |[1-5]\. )")
    rows = chunks.select(key, after.isNotNull().alias("_b"), (after.isNotNull() & whole).alias("_w"), (after.isNotNull() & (F.length(content) > 0) & well).alias("_g"), F.length(content).alias("_n"))
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.count_if("_b").alias("breaks"), F.count_if("_w").alias("whole"), F.count_if("_g").alias("good"), F.coalesce(F.stddev_pop("_n"), F.lit(0.0)).alias("std"))
    share = lambda c: F.when(F.col("breaks") == 0, 1.0).otherwise(F.col(c) / F.greatest(F.col("breaks"), F.lit(1)))
    size = F.greatest(F.lit(0.0), 1 - F.col("std") / 1000)
    return out.withColumns({"integrity": share("whole"), "semantic": share("good")}).withColumn("score", 0.3 * size + 0.4 * F.col("semantic") + 0.3 * F.col("integrity"))


def quality(chunks: DataFrame) -> DataFrame:
    """Sizes and the share of chunks that end at a sentence, and their weighted score."""
    ends = F.rtrim("content").rlike(r"[.!?。！？]$").cast("double")
    n = F.length("content")
    out = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.avg(n).alias("mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(ends).alias("whole_sentences"))
    size = F.greatest(F.lit(0.0), 1 - F.col("std") / F.greatest(F.col("mean"), F.lit(1.0)))
    return out.withColumn("score", 0.3 * size + 0.7 * F.col("whole_sentences"))
