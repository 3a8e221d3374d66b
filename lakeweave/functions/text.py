"""Text as column expressions: normalising, Markdown tests, redaction, token estimates, reviews, quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

# What counts as Markdown.
MARKDOWN_PATTERNS = (
    r"(?m)^#{1,6}\s+\S+",
    r"(?m)^[-*+]\s+\S+",
    r"(?m)^\d+\.\s+\S+",
    r"(?m)^>\s+\S+",
    r"(?m)^```",
    r"\[[^\]]+\]\([^)]+\)",
    r"(?m)^\|.+\|$",
)

# What is redacted from documents, in this order.
SENSITIVE = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PHONE": r"\b(?:\+?86)?1[3-9]\d{9}\b",
    "ID_CARD": r"\b(?:\d{15}|\d{18}|\d{17}[Xx])\b",
    "CREDIT_CARD": r"\b(?:4\d{12}(?:\d{3})?|5[1-5]\d{14}|3[47]\d{13})\b",
    "API_KEY": r"(?i)\b(?:sk-|ak-|api[_-]?key[_-]?)[a-zA-Z0-9]{16,}\b",
    "PASSWORD": r"(?i)(?:password|pwd|pass)[\s]*[=:][\s]*[^\s&]+",
    "SECRET": r"(?i)(?:secret|token)[\s]*[=:][\s]*[a-zA-Z0-9]{8,}",
}

# What is redacted from listings, in this order.
LISTING_SENSITIVE = {
    "EMAIL": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "PHONE": r"(?<!\d)(?:\+?\d[\d\-\s]{8,}\d)(?!\d)",
    "SECRET": r"(?i)\b(?:sk|api|token|secret)[-_a-z0-9]{12,}\b",
    "IP": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "ID": r"\b\d{8,}\b",
}

# What a review flags.
REVIEW_FLAGS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "api_key": r"(?i)\b(?:sk|api|token|secret)[-_a-z0-9]{12,}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "phone": r"\b(?:\+?\d[\d\-\s]{8,}\d)\b",
}


def normalized(text: Column) -> Column:
    """Line ends as LF; no NUL and no byte-order mark."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[\\x00﻿]", "")


def normalized_markdown(text: Column) -> Column:
    """No blanks at line ends, at most one empty line, trimmed."""
    lines = F.regexp_replace(normalized(text), r"(?m)[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _any_of(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def looks_like_markdown(text: Column, head: int | None = 4000) -> Column:
    return _any_of(F.substring(text, 1, head) if head else text, MARKDOWN_PATTERNS)


def looks_garbled(text: Column) -> Column:
    """Over a fifth odd characters, one character eleven times running, or mostly very short lines."""
    odd = F.length(F.regexp_replace(text, r"[\w\s\p{IsHan}\p{L}.,;:!?()\[\]'\"-]", "")) / F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 10)) / F.greatest(F.size(lines), F.lit(1))
    return (odd > 0.2) | text.rlike(r"(\S)\1{10,}") | ((F.size(lines) > 5) & (short > 0.7))


def token_count(text: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def estimated_tokens(text: Column) -> Column:
    """Han characters over 1.5, Latin letters over 4, all others over 2; truncated."""
    han, latin = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return (han / 1.5 + latin / 4 + (F.length(text) - han - latin) / 2).cast("int")


#: What any match of ``SENSITIVE`` holds: a text without it needs one scan in place of seven.
SENSITIVE_HINT = r"@|\d{11}|(?i:sk-|ak-|api|pass|pwd|secret|token)"


def redacted(text: Column, patterns: dict[str, str] | None = None, label: str = "[{}_REDACTED]") -> Column:
    out = text
    for name, pattern in (patterns or SENSITIVE).items():
        out = F.regexp_replace(out, pattern, label.format(name))
    return out if patterns else F.when(text.rlike(SENSITIVE_HINT), out).otherwise(text)


def listing_text(text: Column, limit: int) -> Column:
    """Redacted, white space collapsed, cut."""
    return F.substring(F.trim(F.regexp_replace(redacted(text, LISTING_SENSITIVE, "[REDACTED_{}]"), r"\s+", " ")), 1, limit)


def truncated(text: Column, most: int = 200, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.trim(F.substring(text, 1, most)), F.lit(suffix)))


def preview(text: Column, most: int) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def safe_filename(name: Column, most: int = 100) -> Column:
    """No path or control characters, no dots or blanks at the ends, the suffix kept when cut."""
    safe = F.regexp_replace(F.regexp_replace(name, r'[\\/*?:"<>|]', "_"), r"^[. ]+|[. ]+$", "")
    suffix = F.regexp_extract(safe, r"(\.[^.]*)$", 1)
    stem = F.regexp_replace(safe, r"\.[^.]*$", "")
    cut = F.when(F.length(safe) <= most, safe).otherwise(F.concat(F.substr(stem, F.lit(1), F.greatest(F.lit(most) - F.length(suffix), F.lit(0))), suffix))
    return F.when(F.coalesce(cut, F.lit("")) == "", "unnamed").otherwise(cut)


def masked(text: Column, visible: int = 3, mask: str = "*") -> Column:
    n = F.length(text)
    middle = F.repeat(F.lit(mask), F.greatest(n - 2 * visible, F.lit(0)))
    return F.when(n <= 2 * visible, F.repeat(F.lit(mask), n)).otherwise(F.concat(F.substring(text, 1, visible), middle, F.right(text, F.lit(visible))))


def title(text: Column, most: int = 255) -> Column:
    """The first heading's text, else the first line that isn't blank."""
    heading = F.regexp_extract(text, r"(?m)^#{1,6}\s+(.+?)\s*$", 1)
    # F.trim itself as the function would get the line's number as the characters to trim
    first = F.try_element_at(F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\p{Zs}+|\p{Zs}+$", "")), lambda x: x != ""), F.lit(1))
    return F.substring(F.when(heading != "", heading).otherwise(F.coalesce(first, F.lit(""))), 1, most)


def section_path(headings: Column) -> Column:
    return F.array_join(F.filter(headings, lambda h: F.coalesce(F.trim(h), F.lit("")) != ""), " / ")


def pseudonym(value: Column, prefix: str = "seller-", digits: int = 10) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value.cast("string"), 256), 1, digits))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def review_quality(text: Column) -> Column:
    """1 less 0.25 for under 100 characters and for over 30% blanks."""
    n = F.length(text)
    blank = (n - F.length(F.translate(text, " \n\t\r", ""))) / n
    return 1.0 - 0.25 * (F.when(n < 100, 1).otherwise(0) + F.when((n == 0) | (blank > 0.3), 1).otherwise(0))


def review_flags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in REVIEW_FLAGS.items())))


def review_verdict(quality: Column, n_flags: Column) -> Column:
    return F.when((quality >= 0.5) & (n_flags == 0), "approved").otherwise("manual_review")


def shingles(text: Column, n: int = 3) -> Column:
    """Distinct word n-grams, lower case."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return let(words, lambda ws: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def cleanliness(text: Column) -> Column:
    """Steps over the share of control characters."""
    share = F.regexp_count(text, F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")) / F.greatest(F.length(text), F.lit(1))
    return F.when(share < 0.005, 1.0).when(share < 0.01, 0.8).when(share < 0.05, 0.5).otherwise(0.0)


def syntax_score(text: Column) -> Column:
    """Code fences in pairs 0.3, links 0.2, tables 0.2 (none: 0.15), headings 0.15, lists 0.15."""
    fences = F.regexp_count(text, F.lit("```")) % 2 == 0
    has = lambda p: text.rlike(p)
    return (
        F.when(fences, 0.3).otherwise(0.0) + 0.2
        + F.when(has(r"(?m)^\|.+\|$"), 0.2).otherwise(0.15)
        + F.when(has(r"(?m)^#{1,6}\s+"), 0.15).otherwise(0.0)
        + F.when(has(r"(?m)^[-*+]\s+|^\d+\.\s+"), 0.15).otherwise(0.0)
    )


def weighted_quality(completeness: Column, accuracy: Column, timeliness: Column, consistency: Column, uniqueness: Column) -> Column:
    return 0.25 * completeness + 0.30 * accuracy + 0.20 * timeliness + 0.15 * consistency + 0.10 * uniqueness


def clamped(value: Column) -> Column:
    """0 to 1; not a number, infinite or missing is 0."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
