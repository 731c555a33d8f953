"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for all other URLs.

The labelled URLs are those that a rule decides. One aggregation sums them up by their binned features and suffixes; all
that is learnt comes from that table. Features: length, depth of the path, share of digits, character entropy, number of
parameters, hyphens and labels of the host, length of the host, and two suffix statistics: the smoothed share of blocked
URLs among the labelled ones with the host's last label, and with the last two labels. The rates of all suffixes stay a
table and meet the URLs in joins by suffix, for which the engine picks the way by the table's size; a suffix without
labelled URLs gets the overall share. Trees with a logistic loss are fitted on the driver to FIT_ROWS rows of the summed
table at most, drawn by a hash, with their full weights. They are scored inside the engine as arrays of cuts and leaves.

Defined cases: a null url or one without :// has empty host and path, no rule, and is judged by its features as an empty
string; without labelled URLs the method allows; ties between rules cannot occur, as rules of equal length that fit the
same URL would be equal; repeated rows repeat; very long urls are read whole; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import materialize

FIT_ROWS = 20_000
TREES, TREE_DEPTH, RATE, PENALTY = 24, 3, 0.3, 1.0
PRIOR = 20.0

#: The rules as (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def apply_rules(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    size = F.length(text)
    share = lambda c: (size - F.length(F.replace(text, c, F.lit("")))) / size
    return F.when(size == 0, F.lit(0.0)).otherwise(F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda acc, c: acc + F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c)))))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _bin(value: Column, step: float, most: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor(value / F.lit(step)), F.lit(most))).cast("int")


LEXICAL = ["length", "depth", "digits", "entropy", "params", "hyphens", "labels", "host_length"]
FEATURES = [*LEXICAL, "suffix1", "suffix2"]


def lexical_features(df: DataFrame) -> DataFrame:
    """df (url, host, path) with binned features and the host's suffixes."""
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    return df.withColumns({
        "length": _bin(F.length(url), 6, 30),
        "depth": _bin(_count(F.col("path"), "/"), 1, 12),
        "digits": _bin(digits / F.greatest(F.length(url), F.lit(1)), 0.02, 30),
        "entropy": _bin(_entropy(url), 0.15, 36),
        "params": _bin(F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1), 1, 12),
        "hyphens": _bin(_count(F.col("host"), "-"), 1, 8),
        "labels": _bin(_count(F.col("host"), "."), 1, 10),
        "host_length": _bin(F.length("host"), 3, 24),
        "one": F.element_at(F.split("host", r"\."), -1),
        "two": F.regexp_extract("host", r"([^.]*\.?[^.]*)$", 1),
    })


def suffix_rates(summed: DataFrame, col: str, name: str, overall: float) -> DataFrame:
    """(col, name): the binned block rate of every suffix in col among the labelled URLs."""
    rate = 20 * (F.sum("b") + PRIOR * overall) / (F.sum("n") + PRIOR)
    return summed.groupBy(col).agg(F.floor(rate).cast("int").alias(name))


def rated(df: DataFrame, summed: DataFrame, overall: float) -> DataFrame:
    """df with its suffix statistics."""
    for col, name in (("one", "suffix1"), ("two", "suffix2")):
        df = df.join(suffix_rates(summed, col, name, overall), col, "left").withColumn(name, F.coalesce(name, F.lit(int(20 * overall))))
    return df


class Tree:
    """A node: a leaf's value, or a feature, its largest value on the left, and two nodes."""

    def __init__(self, value: float, feature: int = -1, cut: int = 0, left: Tree | None = None, right: Tree | None = None):
        self.value, self.feature, self.cut, self.left, self.right = value, feature, cut, left, right

    def cells(self, depth: int) -> tuple[list[int], list[int], list[float]]:
        """Features and cuts by node of the full tree of that depth (node i leads to 2i + 1 and 2i + 2), and its leaves."""
        nodes, level = [], [self]
        for _ in range(depth):
            nodes += level
            level = [side for t in level for side in ((t.left, t.right) if t.left else (t, t))]
        return [max(0, t.feature) for t in nodes], [t.cut for t in nodes], [t.value for t in level]

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.apply(x), self.right.apply(x))


def grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> Tree:
    total_g, total_h = grad.sum(), hess.sum()
    leaf = Tree(round(float(-RATE * total_g / (total_h + PENALTY)), 9))
    best, choice = 1e-6, None
    if depth:
        for f in range(x.shape[1]):
            g, h = np.cumsum(np.bincount(x[:, f], grad)), np.cumsum(np.bincount(x[:, f], hess))
            gain = g**2 / (h + PENALTY) + (total_g - g) ** 2 / (total_h - h + PENALTY) - total_g**2 / (total_h + PENALTY)
            k = int(np.argmax(gain[:-1])) if len(gain) > 1 else -1
            if k >= 0 and gain[k] > best:
                best, choice = float(gain[k]), (f, k)
    if choice is None:
        return leaf
    left = x[:, choice[0]] <= choice[1]
    return Tree(0.0, choice[0], choice[1], grow(x[left], grad[left], hess[left], depth - 1), grow(x[~left], grad[~left], hess[~left], depth - 1))


def boost(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[float, list[Tree]]:
    """x: distinct rows of binned features; n, positive: how many URLs each stands for, and how many are blocked."""
    rate = min(max(positive.sum() / n.sum(), 1e-3), 1 - 1e-3)
    start = round(math.log(rate / (1 - rate)), 9)
    raw, trees = np.full(len(x), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        trees.append(grow(x, n * p - positive, n * p * (1 - p), TREE_DEPTH))
        raw += trees[-1].apply(x)
    return start, trees


def raw_score(start: float, trees: list[Tree], depth: int = TREE_DEPTH) -> Column:
    """The trees' sum, from the columns FEATURES; one constant holds all trees."""
    numbers = lambda values, end="": f"array({', '.join(f'{v!r}{end}' for v in values)})"
    rows = [(numbers(f), numbers(c), numbers(v, "D")) for f, c, v in (t.cells(depth) for t in trees)]
    forest = F.expr(f"array({', '.join(f'named_struct({chr(39)}f{chr(39)}, {f}, {chr(39)}c{chr(39)}, {c}, {chr(39)}v{chr(39)}, {v})' for f, c, v in rows)})")
    levels = F.array(*[F.lit(k) for k in range(depth)])

    def leaf(x: Column, t: Column) -> Column:
        down = lambda i, _: 2 * i + F.when(F.get(x, F.get(t["f"], i)) <= F.get(t["c"], i), 1).otherwise(2)
        return F.get(t["v"], F.aggregate(levels, F.lit(0), down) - ((1 << depth) - 1))

    return F.aggregate(forest, F.lit(start), lambda total, t: total + leaf(F.array(*FEATURES), t))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each page; score: the trees' probability that the URL is to be blocked."""
    host, path = split_url(F.col("url"))
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = apply_rules(F.col("host"), F.col("path"))
    src = lexical_features(src.withColumns({"rule": rule, "ruled": verdict}))
    labelled = src.where(F.col("ruled").isNotNull())
    summed = materialize(labelled.groupBy(*LEXICAL, "one", "two").agg(F.count("*").alias("n"), F.sum((F.col("ruled") == "block").cast("bigint")).alias("b")), "labelled")
    count, blocked, rows = summed.agg(F.sum("n"), F.sum("b"), F.count("*")).first()
    overall = (blocked or 0) / max(1, count or 0)
    share = min(1.0, fit_rows / max(1, rows))
    drawn = F.pmod(F.xxhash64(*LEXICAL, "one", "two"), F.lit(1_000_003)) < F.lit(math.ceil(share * 1_000_003))
    fitted = rated(summed.where(drawn), summed, overall).groupBy(*FEATURES).agg(F.sum("n").alias("n"), F.sum("b").alias("b")).collect()
    out = rated(src, summed, overall)
    if fitted:
        fitted.sort()
        x = np.array([[r[f] for f in FEATURES] for r in fitted], np.int64)
        start, trees = boost(x, np.array([r["n"] for r in fitted], float), np.array([r["b"] for r in fitted], float))
        out = out.withColumn("score", 1 / (1 + F.exp(-raw_score(start, trees))))
    else:
        out = out.withColumn("score", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
