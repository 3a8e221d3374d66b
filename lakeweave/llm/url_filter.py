"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

All of it is DataFrame expressions and Spark ML's DataFrame API. The trees are fitted on labelled URLs (a table
``url, label``; 1 is unwanted): pass your own to ``fit``. ``seed_urls`` draws a default table by rule, without any word
list: both classes have every form of host, path and query, at different rates, so no single trait gives the label away.
Suffix statistics are smoothed log-odds, from the labelled rows alone, of a host's last label, of its last two labels, of
the last two letters of its longest name, and of a path's file suffix; the ``statistics`` most extreme of each are kept as
literal maps, so that scoring needs no join.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, and are judged on the same features. Of rules
that fit, the longest wins (host and path together); of equal length the one with the longer host, then block before
allow. ``judged`` replaces input columns named host, path, rule, verdict or block_score and keeps all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path prefix)
DEFAULT_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Value of each feature by name; the last four are the suffix statistics.
FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "host_digits", "host_hyphens", "path_hyphens",
    "entropy", "n_params", "query_length", "longest_label", "shortest_word", "is_ip", "top_odds", "domain_odds", "ending_odds", "file_odds",
)
STATISTICS = ("top", "domain", "ending", "file")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; both empty for null URLs and those without ``://``."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def rule_columns(rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits ``host`` and ``path``; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        text = F.when(fits, F.lit(host + path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def seed_urls(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """The default labelled table (url, label), half of it unwanted. Names are drawn from syllables in both classes. An
    unwanted URL is mostly of one of four kinds: names chained by hyphens, names with digits under seldom top levels,
    queries of several parameters, addresses. Every trait stands on other URLs of both classes too, at lower rates."""

    def h(salt: int) -> Column:
        return F.xxhash64("id", F.lit(salt))

    def below(salt: int, n: int) -> Column:
        return F.pmod(h(salt), F.lit(n))

    def pick(items: Sequence[str], salt: int) -> Column:
        return F.element_at(F.array(*map(F.lit, items)), (below(salt, len(items)) + 1).cast("int"))

    kind = F.when(F.col("label") == 1, below(35, 20))

    def chance(low: int, high: int, bad: int, good: int, salt: int) -> Column:
        """True in ``bad`` of 100 unwanted rows of the kinds ``low`` to ``high``, and in ``good`` of 100 other rows."""
        return below(salt, 100) < F.when(kind.between(low, high), bad).otherwise(good)

    def name(salt: int, most: int) -> Column:
        """2 to ``most`` syllables."""
        parts = [F.concat(pick("b c d f g h l m n p r s t v th st br".split(), salt + 2 * k), pick("a e i o u ea ou er an in".split(), salt + 2 * k + 1)) for k in range(most)]
        return F.concat(*parts[:2], *(F.when(below(salt + 50 + k, 3) > 0, x).otherwise("") for k, x in enumerate(parts[2:])))

    digits = below(1, 9000).cast("string")
    short, word = name(100, 3), name(200, 4)
    joined = F.when(chance(0, 8, 96, 4, 2), F.concat_ws("-", short, F.when(chance(0, 8, 45, 30, 3), pick("x go my top go4 up re".split(), 4)).otherwise(name(300, 2)), F.when(chance(0, 8, 35, 10, 5), name(400, 2)))).otherwise(word)
    site = F.when(chance(9, 12, 95, 3, 6), F.concat(joined, F.substring(digits, 1, 3))).otherwise(joined)
    top = F.when(chance(9, 16, 70, 4, 7), pick("info biz xyz top click".split(), 8)).otherwise(pick("com org net com org net edu io".split(), 9))
    under = F.when(below(10, 2) == 0, "example.").otherwise("")
    address = F.concat_ws(".", *((below(11 + k, 223) + 1).cast("string") for k in range(4)))
    host = F.when(chance(17, 19, 95, 1, 15), address).otherwise(F.concat(pick(("", "www.", "blog.", "m."), 16), site, F.lit("."), under, top))
    slug = F.concat_ws("-", name(500, 3), F.when(below(17, 2) == 0, name(600, 3)), F.when(below(18, 3) == 0, name(700, 2)))
    section = pick("en de fr es news item p".split(), 19)
    deep = F.concat_ws("/", section, (below(20, 30) + 1995).cast("string"), slug)
    path = F.when(below(21, 100) < 50, F.concat_ws("/", section, digits)).when(chance(0, 19, 20, 60, 22), deep).otherwise(F.concat_ws("/", section, slug, F.when(chance(0, 19, 50, 10, 23), F.hex(h(24)))))
    tail = F.when(chance(9, 19, 40, 5, 25), pick((".php", ".cgi", ".asp"), 26)).otherwise(pick(("", "/", ".html", ""), 27))
    few = pick(("", "", "", "?utm_source=feed", "?page=2&ref=x", "#top"), 28)
    many = F.concat(F.lit("?"), pick("id uid c".split(), 29), F.lit("="), F.hex(h(30)), F.lit("&"), pick("sid aff z".split(), 31), F.lit("="), digits, F.lit("&src="), F.substring(F.hex(h(32)), 1, 5))
    url = F.concat(pick(("http://", "https://"), 33), host, F.lit("/"), path, tail, F.when(chance(13, 16, 96, 3, 34), many).otherwise(few))
    return spark.range(rows).withColumn("label", (F.col("id") % 2).cast("int")).select(url.alias("url"), "label")


def _keys(host: Column, path: Column) -> dict[str, Column]:
    """What each suffix statistic is counted by."""
    names = F.filter(F.split(F.regexp_replace(host, r"(\.[^.]*)$", ""), r"[.\-0-9]"), lambda w: ~w.isin("", "www", "example"))
    longest = F.array_max(F.transform(names, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return {
        "top": F.regexp_extract(host, r"[^.]*$", 0),
        "domain": F.regexp_extract(host, r"[^.]*\.?[^.]*$", 0),
        "ending": F.coalesce(F.right(longest, F.lit(2)), F.lit("")),
        "file": F.regexp_extract(path, r"\.[A-Za-z0-9]{1,5}$", 0),
    }


def _map(pairs: Sequence[tuple[str, float]]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair)) if pairs else F.create_map(F.lit(""), F.lit(0.0))


def feature_columns(url: Column, host: Column, path: Column, odds: dict[str, list[tuple[str, float]]]) -> dict[str, Column]:
    """Every feature as a column of doubles; none is null."""
    url = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    count = lambda c, of: F.length(c) - F.length(F.translate(c, of, ""))
    labels = F.split(host, r"\.")
    chars = F.filter(F.split(host, ""), lambda c: c != "")
    shares = F.transform(F.array_distinct(chars), lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.length(host))
    words = F.filter(F.split(host, r"[.\-]"), lambda w: ~w.isin("", "www", "m"))
    value = {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "host_labels": F.size(labels),
        "path_depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)),
        "host_digits": count(host, "0123456789"),
        "host_hyphens": count(host, "-"),
        "path_hyphens": count(path, "-"),
        "entropy": -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p)),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "query_length": F.length(query),
        "longest_label": F.coalesce(F.array_max(F.transform(labels, F.length)), F.lit(0)),
        "shortest_word": F.coalesce(F.array_min(F.transform(words, F.length)), F.lit(0)),
        "is_ip": F.when(host.rlike(r"^\d+(\.\d+){3}$"), 1).otherwise(0),
    } | {f"{s}_odds": F.try_element_at(_map(odds[s]), key) for s, key in _keys(host, path).items()}
    return {f: F.coalesce(value[f].cast("double"), F.lit(0.0)) for f in FEATURES}


class UrlFilter:
    """Fitted suffix statistics (by name: key and log-odds) and trees."""

    def __init__(self, trees: GBTClassificationModel, odds: dict[str, list[tuple[str, float]]]):
        self.trees, self.odds = trees, odds

    def importances(self) -> dict[str, float]:
        return dict(zip(FEATURES, map(float, self.trees.featureImportances.toArray()), strict=True))

    def judged(self, pages: DataFrame, threshold: float = 0.5, rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES) -> DataFrame:
        """``pages`` with host, path, rule, block_score (double, the trees' probability) and verdict (allow or block)."""
        ours = ("host", "path", "rule", "block_score", "verdict")
        kept = [c for c in pages.columns if c not in ours]
        # the page's own columns are held in one struct, so that no name of theirs meets one of these
        ready = with_host_and_path(pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("page"), F.col("url")))
        p = vector_to_array(F.col("probability"))[1]
        text, verdict = rule_columns(rules)
        out = self.trees.transform(_assembled(ready, self.odds)).withColumn("rule", text).withColumn("block_score", p)
        out = out.withColumn("verdict", F.coalesce(verdict, F.when(p >= threshold, "block").otherwise("allow")))
        return out.select(*(F.col(f"page.`{c}`") for c in kept), *ours)


def _assembled(rows: DataFrame, odds: dict[str, list[tuple[str, float]]]) -> DataFrame:
    columns = feature_columns(F.col("url"), F.col("host"), F.col("path"), odds)
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows.withColumns(columns)).drop(*FEATURES)


def fit(labelled: DataFrame, trees: int = 20, depth: int = 4, statistics: int = 500) -> UrlFilter:
    """Fits on every labelled URL with a label; ``statistics`` bounds the kept keys of each suffix statistic (those with
    the most extreme odds, ties by key). Keys of fewer than 5 labelled rows have no odds."""
    rows = with_host_and_path(labelled.where("label IS NOT NULL").select("url", F.col("label").cast("double").alias("label"))).cache()
    odds: dict[str, list[tuple[str, float]]] = {}
    for s, key in _keys(F.col("host"), F.col("path")).items():
        counted = rows.groupBy(key.alias("key")).agg(F.log((F.sum("label") + 1.0) / (F.count(F.lit(1)) - F.sum("label") + 1.0)).alias("odds"), F.count(F.lit(1)).alias("n"))
        odds[s] = [(r["key"], r["odds"]) for r in counted.where("n >= 5").orderBy(F.abs("odds").desc(), "key").limit(statistics).collect()]
    gbt = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.8, seed=7)
    model = gbt.fit(_assembled(rows, odds).select("features", "label"))
    rows.unpersist()
    return UrlFilter(model, odds)
