"""Quality rules as a bitmask ledger, in DataFrame expressions alone.

Every rule is evaluated once for each document. The ledger keeps the measurements and one long whose bit *i* says that
rule *i* failed; policies are masks over those bits, so a new policy version or an ablation needs no second pass over
the texts. Null texts count as empty, repeated rows keep one ledger row each, extra columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """``failed`` is a SQL predicate over the measurements; bit numbers are never reused."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > 2 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(5, "capitals", "n_words > 0 AND 2 * n_caps_words > n_words"),
    Rule(6, "exclamations", "4 * n_exclaims > n_words"),
    Rule(7, "one_word_repeated", "4 * n_same_next > n_words"),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words", "n_exclaims", "n_same_next")

#: Version -> names of the rules it enforces.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
}


def policy_mask(version: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[version])


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once for each row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))


def _paired(hashes: Column, apart: int) -> Column:
    """Of every hash that has one ``apart`` places on: the hash of both."""
    n = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + apart), n), lambda a, b: F.xxhash64(a, b))


def _covered(starts: Column) -> Column:
    """Words in windows that begin at the sorted distinct ``starts``."""
    gaps = F.zip_with(starts, _tail(starts), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


def _repeated_starts(windows: Column) -> Column:
    """Sorted positions of the windows whose hash occurs twice or more."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = _let(ordered, lambda s: F.zip_with(s, _tail(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def _repeat_words(words: Column) -> Column:
    n = F.size(words)
    ones = F.transform(words, lambda w: F.xxhash64(w))
    # hashes of 2, 4 and then 8 words, each from two that lie side by side
    windows = _let(_let(_let(ones, lambda hs: _paired(hs, 1)), lambda hs: _paired(hs, 2)), lambda hs: _paired(hs, 4))
    counted = _let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(_let(_repeated_starts(ws), _covered)))
    return F.when(n <= WINDOW, F.lit(0)).otherwise(counted)


def measurements(text: Column) -> Column:
    """A struct of all measurements (long) of one text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    caps = lambda ws: F.size(F.filter(ws, lambda w: (w == F.upper(w)) & (w != F.lower(w))))
    same = lambda ws: F.size(F.filter(F.zip_with(ws, _tail(ws), lambda a, b: a == b), lambda x: x))
    fields = lambda ws, ls: {
        "n_words": F.size(ws),
        "word_chars": F.aggregate(ws, F.lit(0).cast("long"), lambda s, w: s + F.length(w)),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
        "n_lines": F.size(ls),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": _repeat_words(ws),
        "n_caps_words": caps(ws),
        "n_exclaims": F.regexp_count(text, F.lit("!")),
        "n_same_next": same(ws),
    }
    return _let(words, lambda ws: _let(lines, lambda ls: F.struct(*(v.cast("long").alias(k) for k, v in fields(ws, ls).items()))))


def ledger(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``m`` (measurements) and ``failures`` (bitmask), one row for each row of ``docs``."""
    measured = docs.select(*keep, F.inline(F.array(F.struct(measurements(F.col(text)).alias("m"))))).select(*keep, "m", "m.*")
    bits = [F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return measured.select(*keep, "m", mask.alias("failures"))


def passes(failures: Column, version: str) -> Column:
    return failures.bitwiseAND(F.lit(policy_mask(version)).cast("long")) == 0


def ablations(book: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: documents that failed it, those that failed it alone, and those kept without it.

    The texts aren't read again: documents are counted by failure mask, at most one row for each mask.
    """
    masks = book.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    full = policy_mask(version)
    rules = [r for r in RULES if full >> r.bit & 1]
    per_rule = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules)))
    held = masks.select("failures", "n", per_rule.alias("r")).select("failures", "n", "r.rule", "r.bit")
    here = F.col("failures").bitwiseAND(F.lit(full).cast("long"))
    return held.groupBy("rule").agg(
        F.sum(F.when(here.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(here == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(here.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )


def kept_documents(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass the policy, with their own columns."""
    whole = [F.col(f"`{c}`") for c in docs.columns]
    book = ledger(docs.select(F.struct(*whole).alias("row"), F.col("text")), keep=("row",))
    return book.where(passes(F.col("failures"), version)).select("row.*")


def scored(docs: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger laid out flat with the base verdict and the policy's verdict."""
    book = ledger(docs)
    base = ~passes(F.col("failures"), "base")
    return book.select("doc_id", *(F.col(f"m.{m}").alias(m) for m in MEASURES), "failures", base.alias("base_failed"), (~base & passes(F.col("failures"), version)).alias("kept"))
