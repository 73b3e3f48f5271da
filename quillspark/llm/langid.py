"""Language identification by rank-order profiles of character n-grams.

A text is lower-cased; runs of anything but letters become one boundary. Its 1- to 3-grams (no boundary inside a word's n-gram but
at its ends) are ranked by frequency, ties by code points. The distance to a language is the sum, over the text's TOP most frequent n-grams, of how
far each is out of place in the language's profile; an n-gram that the profile lacks counts TOP. The nearest language wins, ties
to the smaller name. The score is 1 less the distance as a share of the largest possible one.

Null texts and texts without a letter give `und` with score 0; so does every text if nothing was learned. Very long texts are
counted whole. Repeated rows count as often as they occur. Input columns that are called like an output are replaced, whatever their case.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import batches_by_bytes, pieces, prepare, q, texts_of, without

UNKNOWN = "und"
TOP = 300
#: Learning reads at most about so many texts of each language, chosen by a hash of the row.
TRAIN_ROWS = 3000
#: Profiles go along with a function, so many at a time (10 MB at most); of more languages there are more functions, one after another.
MAX_LANGUAGES = 2000
BITS = 21


@lru_cache(1)
def is_letter() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out[np.frombuffer("".join(regex.findall(r"\p{L}+", every)).encode("utf-32-le"), np.uint32)] = True
    return out


def ngrams(text: str) -> np.ndarray:
    """Every n-gram of a text as a number: up to three code points of 21 bits, the boundary as 32."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one boundary after each run of letters
    c = np.where(letter, codes, 32)[keep].astype(np.int64)
    edge = np.array([32])
    c = np.concatenate([edge, c] if c[-1] == 32 else [edge, c, edge])
    two, three = c[:-1] << BITS | c[1:], c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:]
    return np.concatenate([c[c != 32], two, three[c[1:-1] != 32]])


def ranked(text: str, top: int = TOP) -> np.ndarray:
    """The most frequent n-grams of a text, most frequent first."""
    grams = ngrams(text)
    if not len(grams):
        return grams
    grams.sort()
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    counts = np.diff(np.append(first, len(grams)))
    keys = grams[first]
    if len(keys) > 4 * top:  # only those that can be among the first
        least = np.partition(counts, -top)[-top]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:top]]


class Profiles:
    """Ranks of n-grams in each language: for each n-gram the languages that have it, one after another."""

    def __init__(self, rows: dict[str, list[int]], top: int = TOP):
        self.rows, self.languages, self.top = rows, sorted(rows), top
        grams = [np.asarray(rows[name], np.int64) for name in self.languages]
        key = np.concatenate([np.zeros(0, np.int64), *grams])
        order = np.argsort(key, kind="stable")
        self.keys, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(key))
        self.language = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.rank = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])[order]

    def parts(self, languages: int) -> list["Profiles"]:
        """Profiles of so many languages at most each, in order of their names."""
        if len(self.languages) <= languages:
            return [self]
        names = [self.languages[i : i + languages] for i in range(0, len(self.languages), languages)]
        return [Profiles({n: self.rows[n] for n in some}, self.top) for some in names]

    def predict(self, text: str) -> tuple[str, float]:
        keys = ranked(text, self.top)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = np.flatnonzero(self.keys[at] == keys)
        size = self.first[at[known] + 1] - self.first[at[known]]
        ends = np.cumsum(size)
        entry = np.repeat(self.first[at[known]] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        nearer = self.top - np.abs(self.rank[entry] - np.repeat(known, size))  # than an n-gram that the profile lacks
        out = self.top * len(keys) - np.bincount(self.language[entry], nearer, len(self.languages))
        best = int(out.argmin())
        return self.languages[best], 1.0 - float(out[best]) / (self.top * len(keys))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None, key: str | None = None, train_rows: int = TRAIN_ROWS, top: int = TOP) -> Profiles:
    """Profiles from rows with text and language, `where` holds.

    Reads about train_rows rows of each language at most, chosen by a hash of key and text (of the text alone without a key); all rows if there are fewer, and
    always those with the language's smallest hash, so no language is lost: a documented bound on labelled rows. Counts are summed on the executors; the driver gets
    a row for each language and `top` n-grams of it.
    """
    prepare(docs.sparkSession)
    known = docs.where(q(text).isNotNull() & q(lang).isNotNull() & (F.lit(True) if where is None else where))
    turn = F.pmod(F.xxhash64(*([] if key is None else [q(key)]), q(text), F.lit("langid")), F.lit(2**40))
    known = known.select(q(lang).alias("l"), q(text).alias("t"), turn.alias("turn"))
    share = F.greatest(F.min("turn"), F.floor(F.lit(float(train_rows)) / F.count("*") * 2**40))
    limits = known.groupBy("l").agg(share.alias("limit"))
    picked = known.join(F.broadcast(limits) if limits.count() <= MAX_LANGUAGES else limits, "l").where(F.col("turn") <= F.col("limit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "t", 2 << 20):
            frame = pd.DataFrame({"l": batch.column("l").to_pylist(), "t": texts_of(batch.column("t"))})
            for name, own in frame.groupby("l"):
                keys, n = np.unique(np.concatenate([ngrams(t) for t in own.t]), return_counts=True)
                yield pa.record_batch({"l": pa.array([name] * len(keys), pa.string()), "k": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    sums = picked.select("l", "t").mapInArrow(count, "l string, k long, n long").groupBy("l", "k").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "k"))
    rows: dict[str, list[int]] = {}
    for r in sums.withColumn("r", rank).where(F.col("r") <= top).select("l", "k", "r").collect():
        rows.setdefault(r.l, []).append((r.r, r.k))
    return Profiles({k: [x for _, x in sorted(v)] for k, v in rows.items()}, top)


def predict(df: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and its score; columns of those names are replaced. No shuffle."""
    prepare(df.sparkSession)
    kind = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])

    def best_of(some: Profiles) -> Column:
        @F.arrow_udf(kind)
        def best(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = [some.predict(t) for piece in pieces(batch) for t in texts_of(piece)]
                yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["lang", "score"])

        return best.asNondeterministic()(q(text))

    first, *others = profiles.parts(MAX_LANGUAGES)
    tmp, more = "_quill_best", "_quill_more"
    found = df.withColumn(tmp, best_of(first))
    for some in others:  # a later name wins by a higher score only
        found = found.withColumn(more, best_of(some)).withColumn(tmp, F.when(F.col(f"{more}.score") > F.col(f"{tmp}.score"), F.col(more)).otherwise(F.col(tmp))).drop(more)
    return without(found, lang, score).select("*", F.col(f"{tmp}.lang").alias(lang), F.col(f"{tmp}.score").alias(score)).drop(tmp)
