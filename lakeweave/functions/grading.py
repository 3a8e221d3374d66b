"""Grades of converted documents: content, structure, and the weighted whole; completeness of a reviewed document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

from .text import cleanliness, looks_like_markdown, syntax_score

# Weights of the whole, what Markdown form adds, and the least score of each grade.
WEIGHTS = {"cleanliness": 0.2, "syntax": 0.3, "content": 0.2, "structure": 0.3}
BONUS = 0.1
GRADES = (("S", 0.95), ("A", 0.85), ("B", 0.70), ("C", 0.50))


def _lines(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(pattern)))


def content_score(text: Column) -> Column:
    """0.4 for each 1,000 characters (0.6 at most) and a third of 0.4 for each paragraph (0.4 at most); 0 for blank text."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    paragraphs = F.size(F.filter(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"\s+", "") != ""))
    score = F.least(F.length(bare) / 1000 * 0.4, F.lit(0.6)) + F.least(paragraphs / 3 * 0.4, F.lit(0.4))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0.0).otherwise(score)


def structure_score(text: Column) -> Column:
    """0.1 for each heading (0.3 at most) and list item (0.2 at most), 0.2 for tables, 0.15 for code and for links each; 1 at
    most, and 0.5 for text without any of these."""
    headings, items = _lines(text, r"^#{1,6}\s+"), _lines(text, r"^[-*+]\s+|^\d+\.\s+")
    has = lambda found, x: F.when(found >= 1, x).otherwise(0.0)
    total = (
        F.least(headings * 0.1, F.lit(0.3)) + F.least(items * 0.1, F.lit(0.2)) + has(_lines(text, r"^\|.+\|$"), 0.2)
        + has(F.floor(F.regexp_count(text, F.lit("```")) / 2), 0.15) + has(F.regexp_count(text, F.lit(r"\[[^\]]+\]\([^)]+\)")), 0.15)
    )
    return F.when(total == 0, 0.5).otherwise(F.least(total, F.lit(1.0)))


def overall_score(text: Column) -> Column:
    parts = {"cleanliness": cleanliness(text), "syntax": syntax_score(text), "content": content_score(text), "structure": structure_score(text)}
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    return F.when(looks_like_markdown(text, None), F.least(F.lit(1.0), total + BONUS)).otherwise(total)


def grade(score: Column) -> Column:
    """S to C by the least score of each; D below. Scores are held to nine places, so that sums at a limit reach it."""

    def graded(held: Column) -> Column:
        out = F.lit("D")
        for name, least in reversed(GRADES):
            out = F.when(held >= least, name).otherwise(out)
        return out

    return let(F.round(score, 9), graded)


def missing_parts(text: Column, title: Column) -> Column:
    """What a complete document lacks: a title, a heading."""
    no_title = F.coalesce(F.trim(title), F.lit("")) == ""
    return F.array_compact(F.array(F.when(no_title, "title"), F.when(~F.coalesce(text.rlike(r"(?m)^#{1,6}\s+\S"), F.lit(False)), "heading")))
