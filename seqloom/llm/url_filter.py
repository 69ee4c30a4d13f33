"""URL verdicts by rules, and by gradient-boosted trees where no rule fits.

Rules name a host and the beginning of a path; the longest that fits wins.  They
are evaluated as expressions.  The trees see lexical features only: lengths,
depth, digit ratio, entropy, parameters, and statistics of the host's suffix.

Labels: an own label column, or else the rules' verdicts.  The trees are fitted on
the driver to at most ``SAMPLE`` distinct labelled URLs, those with the least hash
(a sample that does not depend on partitions; a threshold on the hash leaves little
more than these to be sent); all URLs are judged, in Arrow batches.

The suffix statistics are counted over all labelled pages and joined to the URLs.
They are kept by ``FOLDS`` folds of the URLs, and a URL that the trees are fitted to
has them without its own fold, so that no label is a feature of itself.
Suffixes of over one in ``HOT`` of the pages to be judged, fewer than ``HOT`` of a
kind by that, go with the function; the others are joined through a shuffle.

Defined cases: null URLs and those without "://" have an empty host and path, fit
no rule and are judged by the trees; without labels of both kinds the method says
what the labels say, "allow" without any; repeated rows each get a row; an empty
table gives an empty result; columns beyond id, URL and label are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import arrow_map, stage, table

SAMPLE = 20_000
HOT = 1_000
PRIOR = 10.0
FOLDS = 5
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ features

FEATURES = ("length", "host_length", "path_length", "query_length", "depth", "host_labels", "digits", "host_digits", "entropy", "host_entropy", "parameters", "hyphens", "secure", "longest_segment", "suffix_rate", "suffix_count", "second_rate", "first_segment_rate")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


@dataclass
class Suffixes:
    """Share of blocked URLs, shrunk to the whole, by last host label, by the two
    last, and by the first path segment; and how often the last label was seen."""

    last: dict[str, tuple[float, int]]
    second: dict[str, float]
    segment: dict[str, float]
    mean: float

    @staticmethod
    def keys(host: str, path: str) -> tuple[str, str, str]:
        labels = host.split(":")[0].split(".")
        return labels[-1], ".".join(labels[-2:]), path[1:].split("/")[0][:16]

    @classmethod
    def fit(cls, rows: Sequence[tuple[str, str]], blocked: np.ndarray, prior: float = PRIOR) -> Suffixes:
        tables: tuple[dict[str, list], ...] = ({}, {}, {})
        for row, y in zip(rows, blocked):
            for t, key in zip(tables, cls.keys(*row)):
                seen = t.setdefault(key, [0, 0])
                seen[0] += int(y)
                seen[1] += 1
        return cls.of(tables, float(blocked.mean()) if len(blocked) else 0.0, prior)

    @classmethod
    def without(cls, tables: Sequence[dict[str, Sequence[Sequence[int]]]], fold: int, mean: float) -> Suffixes:
        """From counts by fold, the fold's own left out."""
        return cls.of([{k: tuple(sum(x) - x[fold] for x in v) for k, v in t.items()} for t in tables], mean)

    @classmethod
    def of(cls, tables: Sequence[dict[str, Sequence[int]]], mean: float, prior: float = PRIOR) -> Suffixes:
        """From (blocked, seen) by last label, by the two last and by first segment."""
        rate = lambda s: (s[0] + prior * mean) / (s[1] + prior)
        return cls({k: (rate(s), s[1]) for k, s in tables[0].items()}, {k: rate(s) for k, s in tables[1].items()}, {k: rate(s) for k, s in tables[2].items()}, mean)


def features(url: str, host: str, path: str, suffixes: Suffixes) -> list[float]:
    rest = url[url.find(path) + len(path) :] if path else url[url.find("://") + 3 + len(host) :] if "://" in url else ""
    query = rest.split("#")[0]
    last, second, segment = Suffixes.keys(host, path)
    rate, count = suffixes.last.get(last, (suffixes.mean, 0))
    n = max(len(url), 1)
    return [
        len(url), len(host), len(path), len(query), path.count("/"), host.count(".") + 1 if host else 0, sum(c.isdigit() for c in url) / n, sum(c.isdigit() for c in host) / max(len(host), 1),
        _entropy(url), _entropy(host), query.count("=") + query.count("&"), url.count("-"), float(url[:8].lower() == "https://"), max(map(len, path.split("/"))),
        rate, math.log1p(count), suffixes.second.get(second, suffixes.mean), suffixes.segment.get(segment, suffixes.mean),
    ]


# --------------------------------------------------------------------- trees


class BoostedTrees:
    """Binary logistic boosting: trees over binned features, Newton leaves."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 5) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, width = x.shape
        share = min(max(y.mean(), 1e-6), 1 - 1e-6)
        self.base = math.log(share / (1 - share))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-12)
            nodes = (1 << self.depth) - 1
            feature, cut, node = np.full(nodes, -1), np.zeros(nodes), np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                inside = node - first
                best = np.full(count, 1e-9)
                where = np.zeros(count)
                for j, c in enumerate(cuts):
                    size = len(c) + 1
                    if size < 2:
                        continue
                    cell = inside * size + binned[:, j]
                    g, h, k = (np.bincount(cell, w, count * size).reshape(count, size) for w in (grad, hess, None))
                    gl, hl, kl = (v.cumsum(1)[:, :-1] for v in (g, h, k))
                    gt, ht, kt = (v.sum(1, keepdims=True) for v in (g, h, k))
                    gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(kl < self.least) | (kt - kl < self.least)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(count), top]
                    better = value > best
                    best[better] = value[better]
                    feature[first : first + count][better] = j
                    where[better] = c[top[better]]
                cut[first : first + count] = where
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[np.arange(n), np.maximum(f, 0)] > cut[node]))
            leaf = node - nodes
            leaves = 1 << self.depth
            value = self.rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + self.ridge)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, np.maximum(f, 0)] > cut[node]))
            out += value[node - len(feature)]
        return out


@dataclass
class Model:
    suffixes: Suffixes
    trees: BoostedTrees | None
    constant: str = "allow"

    @classmethod
    def fit(cls, rows: Sequence[tuple[str, str, str]], blocked: Sequence[bool], suffixes: Suffixes | None = None, folds: Sequence[int] | None = None, others: Sequence[Suffixes] = ()) -> Model:
        """``others[f]`` are the suffixes for rows of fold f, from all other folds;
        without them, those of the rows themselves are taken."""
        y = np.array(blocked, float)
        if suffixes is None:
            folds = [i % FOLDS for i in range(len(rows))]
            own = [(h, p) for _, h, p in rows]
            suffixes = Suffixes.fit(own, y)
            others = [Suffixes.fit([r for r, g in zip(own, folds) if g != f], y[np.array(folds) != f]) for f in range(FOLDS)] if rows else []
        if len(set(blocked)) < 2:
            return cls(suffixes, None, "block" if len(y) and y[0] else "allow")
        return cls(suffixes, BoostedTrees().fit(np.array([features(*r, others[f]) for r, f in zip(rows, folds)], float), y))

    def blocks(self, rows: Sequence[tuple[str, str, str]], suffixes: Suffixes | None = None) -> np.ndarray:
        if self.trees is None or not len(rows):
            return np.full(len(rows), self.constant == "block")
        return self.trees.score(np.array([features(*r, suffixes or self.suffixes) for r in rows], float)) > 0


# --------------------------------------------------------------------- Spark


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path as the rules see them; both empty without "://"."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def suffix_keys(host: Column, path: Column) -> list[Column]:
    """``Suffixes.keys`` as expressions."""
    name = F.substring_index(host, ":", 1)
    return [F.substring_index(name, ".", -1), F.substring_index(name, ".", -2), F.substring(F.substring_index(F.expr("substring(path, 2)"), "/", 1), 1, 16)]


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def suffix_counts(judged: DataFrame) -> DataFrame:
    """(kind, suffix, blocked, seen, open, by_fold) over all pages: those labelled
    "block", those labelled, those without a rule, and the first two by fold."""
    label = F.coalesce("label", "by_rule")
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), k.alias("suffix")) for i, k in enumerate(suffix_keys(F.col("host"), F.col("path"))))))
    one = judged.select(label.eqNullSafe("block").cast("long").alias("blocked"), F.coalesce(label.isin("allow", "block"), F.lit(False)).cast("long").alias("seen"), F.col("by_rule").isNull().cast("long").alias("open"), fold_of(F.col("url")).alias("fold"), each.alias("k"))
    by_fold = F.struct(*(F.array(*(F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)) for f in range(FOLDS))).alias(c) for c in ("blocked", "seen")))
    return one.groupBy("k.kind", "k.suffix").agg(*(F.sum(c).alias(c) for c in ("blocked", "seen", "open")), by_fold.alias("by_fold"))


def least_hashed(distinct: DataFrame, sample: int) -> list:
    """The ``sample`` rows of least hash, with their fold.  A threshold that twice as
    many pass (and 1000 more) is set by their number, so each task sends few."""
    share = (2 * sample + 1000) / max(distinct.count(), 1)
    at = F.shiftrightunsigned(F.xxhash64("url"), 1)
    few = distinct if share >= 1 else distinct.filter(at < F.lit(int(share * (1 << 63))))
    found = few.select("url", "host", "path", "label", at.alias("at"), fold_of(F.col("url")).alias("fold")).collect()
    return sorted(found, key=lambda r: (r.at, r.url))[:sample]


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", label: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    ``label`` ("allow", "block" or null) replaces the rules' verdicts in training.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), host.alias("host"), path.alias("path"), (label if label is not None else F.lit(None).cast("string")).alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), "label")
    labelled = judged.select("url", "host", "path", F.coalesce("label", "by_rule").alias("label")).filter("label IN ('allow', 'block')")
    distinct = labelled.groupBy("url", "host", "path").agg(F.when(F.avg((F.col("label") == "block").cast("int")) > 0.5, "block").otherwise("allow").alias("label"))
    rows = least_hashed(stage(distinct, "labelled"), sample)
    counts = stage(suffix_counts(judged), "suffixes")
    blocked, seen, unruled = (x or 0 for x in counts.filter("kind = 0").agg(F.sum("blocked"), F.sum("seen"), F.sum("open")).first())
    mean = blocked / seen if seen else 0.0
    is_hot = F.col("open") * HOT > unruled

    def tables(found: DataFrame, folds: bool = False) -> tuple[dict, dict, dict]:
        out: tuple[dict, dict, dict] = ({}, {}, {})
        for r in found.collect():
            out[r.kind][r.suffix] = (r.by_fold.blocked, r.by_fold.seen) if folds else (r.blocked, r.seen)
        return out

    wanted = {(i, k) for r in rows for i, k in enumerate(Suffixes.keys(r.host, r.path))}  # at most three for a row
    wanted_df = pages.sparkSession.createDataFrame(sorted(wanted), "kind int, suffix string")
    known = tables(counts.join(wanted_df, ["kind", "suffix"]), True)
    others = [Suffixes.without(known, f, mean) for f in range(FOLDS)]
    model = Model.fit([(r.url, r.host, r.path) for r in rows], [r.label == "block" for r in rows], Suffixes({}, {}, {}, mean), [r.fold for r in rows], others)
    hot = tables(counts.filter(is_hot & (F.col("seen") > 0)))

    # rows that need no join get a key that no suffix has, and so spread over the tasks
    joined = judged.drop("label")
    rare = counts.filter(~is_hot & (F.col("seen") > 0))
    hot_keys = counts.filter(is_hot).select("kind", "suffix").collect()  # fewer than HOT of a kind
    for i, key in enumerate(suffix_keys(F.col("host"), F.col("path"))):
        known = [r.suffix for r in hot_keys if r.kind == i]
        own = F.when(F.col("by_rule").isNotNull() | key.isin(known), F.concat(F.lit("-"), "url", F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))).otherwise(F.concat(F.lit("+"), key))
        found = rare.filter(F.col("kind") == i).select(F.concat(F.lit("+"), "suffix").alias(f"_k{i}"), F.struct("blocked", "seen").alias(f"s{i}"))
        joined = joined.withColumn(f"_k{i}", own).join(found, f"_k{i}", "left").drop(f"_k{i}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = batch.to_pydict()
            verdicts = list(cols["by_rule"])
            open_ = [i for i, v in enumerate(verdicts) if v is None]
            near = tuple(dict(t) for t in hot)
            for i in open_:
                for k, key in enumerate(Suffixes.keys(cols["host"][i], cols["path"][i])):
                    if (s := cols[f"s{k}"][i]) is not None:
                        near[k][key] = (s["blocked"], s["seen"])
            for i, blocked in zip(open_, model.blocks([(cols["url"][i], cols["host"][i], cols["path"][i]) for i in open_], Suffixes.of(near, mean))):
                verdicts[i] = "block" if blocked else "allow"
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return arrow_map(joined, run, "page_id long, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
