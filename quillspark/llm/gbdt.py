"""A quality classifier: gradient-boosted trees on histograms of document statistics.

Trees of a fixed depth are grown level by level from histograms of gradients (logistic loss), over features cut into at most BINS
bins. They are flattened into arrays (feature, threshold by node; value by leaf), and scoring walks all trees of a batch of rows
at once in numpy. Features come from the whole text only.

A null text counts as empty; an empty text has all-zero statistics and gets a score like any other. Without usable labels the
score is 0.5, and with labels of one class only it is near that class. Repeated rows of labels count as often as they occur;
labels that are null are skipped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, prepare, q, texts_of, without

#: Learning uses at most so many labelled rows, chosen by a hash of the id.
TRAIN_ROWS = 20_000
BINS, TREES, DEPTH, RATE, RIDGE = 64, 80, 4, 0.15, 2.0
FEATURES = (
    "log_chars", "log_words", "word_length", "word_length_deviation", "long_words", "short_words", "upper", "lower", "digits", "spaces", "ascii_signs", "other_signs",
    "bars_and_marks", "commas_and_stops", "distinct_words", "top_word", "top_three_words", "same_word_runs", "distinct_pairs", "repeated_lines", "line_length", "words_with_marks", "capitalised", "url_like",
)


@lru_cache(1)
def kinds() -> np.ndarray:
    """By code point: 0 other signs, 1 upper, 2 lower and other letters, 3 digits, 4 space, 5 ASCII signs, 6 bars and marks, 7 commas and stops."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((2, r"\p{L}"), (1, r"\p{Lu}"), (3, r"\p{N}"), (4, r"\s"), (5, r"[!-/:-@\[-`{-~]"), (6, r"[|#$%&*<>{}~^\\!]"), (7, r"[.,;:?]")):
        out[np.frombuffer("".join(regex.findall(pattern + "+", every)).encode("utf-32-le"), np.uint32)] = kind
    return out


def statistics(text: str) -> list[float]:
    """The features of a text."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    share = np.bincount(kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=8) / n
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)] + [0]
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float((lengths > 15).mean()), float((lengths <= 3).mean()), share[1], share[2], share[3], share[4], share[5] + share[6] + share[7], share[0],
        share[6], share[7], len(counts) / w, top[0] / w, sum(top) / w, sum(map(str.__eq__, words, words[1:])) / w, len(set(zip(words, words[1:]))) / w, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), sum(not x[-1].isalnum() for x in words) / w, sum(x[0].isupper() for x in words) / w, (text.count("://") + text.count("@") + text.count("www.")) / w,
    ]


class Trees:
    """Trees of one depth as arrays: node i of a level has children 2i+1 and 2i+2; a row goes right where its feature is over the threshold."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of features."""
        raw = np.full(len(x), self.base)
        if len(self.feature):
            trees, depth = np.arange(len(self.feature))[None, :], int(np.log2(self.value.shape[1]))
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                rows, node = np.arange(len(part))[:, None], np.zeros((len(part), len(self.feature)), np.int64)
                for _ in range(depth):
                    node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
                raw[at : at + 4096] += self.value[trees, node - self.feature.shape[1]].sum(1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, bins: int = BINS) -> Trees:
    """Boosted trees for labels 0 and 1; the same rows give the same trees."""
    if not len(x):
        return Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    n, m = x.shape
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
    flat = binned + np.arange(m) * bins  # one histogram for all features
    nodes, leaves = 2**depth - 1, 2**depth
    feature, threshold, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, leaves))
    raw = np.full(n, base)
    allowed = np.stack([np.arange(bins) < len(cuts[j]) for j in range(m)])
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            key = ((node - first)[:, None] * (m * bins) + flat).ravel()
            hg = np.bincount(key, np.repeat(g, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            hh = np.bincount(key, np.repeat(h, m), width * m * bins).reshape(width, m, bins).cumsum(2)
            g_all, h_all = hg[:, :1, -1:], hh[:, :1, -1:]
            gain = hg**2 / (hh + ridge) + (g_all - hg) ** 2 / (h_all - hh + ridge) - g_all**2 / (h_all + ridge)
            gain = np.where(allowed & (hh > 1) & (h_all - hh > 1), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            cut_at = np.full(width, bins)
            for i in np.flatnonzero(gain[np.arange(width), best] > 1e-6):
                j, b = divmod(int(best[i]), bins)
                feature[t, first + i], threshold[t, first + i], cut_at[i] = j, cuts[j][b], b
            own = node - first
            node = 2 * node + 1 + (binned[np.arange(n), feature[t, node]] > cut_at[own])
        leaf = node - nodes
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        raw += value[t, leaf]
    return Trees(base, feature, threshold, value)


def with_statistics(df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
    """df with an array of the text's statistics; a column of that name is replaced."""
    prepare(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([[float(v) for v in statistics(t)] for piece in pieces(batch) for t in texts_of(piece)], pa.list_(pa.float64()))

    return without(df, out).withColumn(out, features(q(text)))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", where: Column | None = None, train_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from labelled documents: at most train_rows labels (those with the smallest hash of the id), which are broadcast.

    `where` is a condition on labels. Of several rows with one id the one with the smallest statistics counts, once for each label.
    """
    usable = labels.where(q(key).isNotNull() & q(label).isin(0, 1) & (F.lit(True) if where is None else where))
    picked = usable.select(q(key).alias("_k"), q(label).cast("int").alias("_y")).orderBy(F.xxhash64("_k"), "_k", "_y").limit(train_rows)
    joined = docs.select(q(key).alias("_k"), q(text).alias("_t")).join(F.broadcast(picked), "_k")
    rows = with_statistics(joined, "_t", "_x").groupBy("_k", "_y").agg(F.min("_x").alias("_x")).collect()
    rows.sort(key=lambda r: (r["_k"], r["_y"]))
    x = np.array([r["_x"] for r in rows], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["_y"] for r in rows], float))


def score(df: DataFrame, trees: Trees, text: str = "text", out: str = "score") -> DataFrame:
    """df with the probability of label 1, from the whole text; a column of that name is replaced. No shuffle."""
    prepare(df.sparkSession)

    @F.arrow_udf(T.DoubleType())
    def probability(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            x = np.array([statistics(t) for piece in pieces(batch) for t in texts_of(piece)], float).reshape(-1, len(FEATURES))
            yield pa.array(trees.score(x), pa.float64())

    base = without(df, out) if text.lower() != out.lower() else df
    return base.withColumn(out, probability.asNondeterministic()(q(text)))
