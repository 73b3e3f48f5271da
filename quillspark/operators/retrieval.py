"""Retrieval over a lexical index and vectors, with several queries at once: a row for each (query, result).

Every top-k is a window by query; Spark keeps only k rows of each query in a task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

K1, B, RRF = 1.2, 0.75, 60
EACH, FUSED, TOP = 50, 20, 5
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Rows in a block of items and of queries, and in a tile of one that is multiplied at a time.
BLOCK = BROADCAST_QUERIES = 32_768
TILE = 2048
#: Scores of texts by queries that a task adds up at a time.
CELLS = 1 << 19
DIMENSIONS = 64


def top(rows: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """[W4, T3] The first k rows of each query, numbered from 1."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(items: DataFrame, key: str, text: str) -> DataFrame:
    """[K3] (term, key, tf, length): the lexical index. A text without terms has one row with a null term, so that lengths cover every text."""
    words = t.terms(F.col(text))
    rows = items.select(F.col(key), words.alias("w"))
    rows = rows.select(key, F.size("w").alias("length"), F.explode_outer("w").alias("term"))
    return rows.groupBy("term", key, "length").agg(F.count("term").alias("tf"))


def bm25(items: DataFrame, queries: DataFrame, key: str, text: str = "text", k: int = EACH, index: DataFrame | None = None) -> DataFrame:
    """[J8] (query_id, key, score, rank). queries: (query_id, query). Distinct terms of a query count once; ties to the smaller key.

    A text's terms meet the queries' where they were found (bm25_in_tasks), so that only each task's first k of a query are shuffled. A built index (postings()) is
    read instead where given; it, over BROADCAST_QUERIES queries, and texts with a key in common meet the queries by joins.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(t.terms(F.col("query")))).alias("term"))
    if index is None:
        if are_distinct(items, key) and queries.count() <= BROADCAST_QUERIES:
            return bm25_in_tasks(items, asked, key, text, k)
        rows = items.select(key, t.terms(F.col(text)).alias("w"))
        # An outer explode: of the other Spark infers a filter on the list, and would find each text's words once more for it.
        rows = rows.select(key, F.size("w").alias("length"), F.explode_outer("w").alias("term")).where("term IS NOT NULL")
        hits = rows.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", key, "length").agg(F.count("*").alias("tf"))
        facts = items.agg(F.count("*").alias("n"), F.avg(F.size(t.terms(F.col(text)))).alias("mean_length"))
    else:
        hits = index.join(asked.select("term").distinct(), "term", "left_semi")
        facts = index.select(key, "length").distinct().agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    scored = hits.join(df, "term").join(asked, "term").crossJoin(F.broadcast(facts))  # one row of facts
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    sums = scored.groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))
    return top(sums, k, [F.desc("score"), F.col(key)])


def are_distinct(items: DataFrame, key: str) -> bool:
    return not items.groupBy(key).count().where("count > 1").head(1)


def term_totals(items: DataFrame, key: str, text: str) -> DataFrame:
    """[K3] (term, df, occurrences): postings() by term. A text's terms are counted where they were found, TILE texts at a time; with keys in common by postings()."""
    if not are_distinct(items, key):
        return postings(items, key, text).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tiles(batches):
            vocabulary = pc.unique(batch["_w"].flatten())
            _, term, tf = hits_in(batch["_w"], vocabulary)
            occurrences = np.bincount(term, tf, minlength=len(vocabulary)).astype(np.int64)
            yield pa.record_batch({"term": vocabulary, "df": np.bincount(term, minlength=len(vocabulary)), "occurrences": occurrences})

    counts = items.select(t.terms(F.col(text)).alias("_w")).mapInArrow(counted, "term string, df long, occurrences long")
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, TILE) for b in batches for at in range(0, b.num_rows, TILE))


def hits_in(words: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the text, place of the term, tf) of a batch's terms that are in the vocabulary, by text, then term."""
    size = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False)
    term = pc.index_in(words.flatten(), value_set=vocabulary)
    known = pc.is_valid(term).to_numpy(zero_copy_only=False)
    pair = np.repeat(np.arange(len(size), dtype=np.int64), size)[known] * len(vocabulary) + term.drop_null().to_numpy()
    pair, tf = np.unique(pair, return_counts=True)
    return *divmod(pair, max(len(vocabulary), 1)), tf


def bm25_in_tasks(items: DataFrame, asked: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """bm25() of items with distinct keys for no more queries than a task holds; asked: (query_id, term).

    The queries' terms go to all tasks. One pass over the texts counts them, a second adds up each text's score for each query and keeps a task's first k of a query.
    Both make the terms in the JVM and take TILE texts at a time, in lots of CELLS scores.
    """
    pairs = asked.distinct().toArrow().sort_by([("query_id", "ascending"), ("term", "ascending")]).combine_chunks()
    vocabulary = pc.unique(pairs["term"])
    ids = pairs["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    queries, whose = ids.dictionary, ids.indices.to_numpy()
    which = pc.index_in(pairs["term"].combine_chunks(), value_set=vocabulary).to_numpy()
    whose = whose[np.argsort(which, kind="stable")]  # the queries of each term, one term after another
    n_of = np.bincount(which, minlength=len(vocabulary))
    begin = np.cumsum(n_of) - n_of
    rows = items.select(F.col(key).alias("_k"), t.terms(F.col(text)).alias("_w"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, sized, total = np.zeros(len(vocabulary), np.int64), 0, 0, 0
        for batch in tiles(batches):
            df += np.bincount(hits_in(batch["_w"], vocabulary)[1], minlength=len(vocabulary))
            n, sized, total = n + batch.num_rows, sized + batch.num_rows - batch["_w"].null_count, total + len(batch["_w"].flatten())
        yield pa.record_batch({"place": np.arange(len(df) + 3), "n": np.r_[df, n, sized, total]})

    counts = rows.select("_w").mapInArrow(counted, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow().sort_by("place")["n"].to_numpy()
    counts = counts if len(counts) else np.zeros(len(vocabulary) + 3, np.int64)
    df, (n, sized, total) = counts[:-3], counts[-3:]
    weight, mean_length = np.log(1 + (n - df + 0.5) / (df + 0.5)), total / max(sized, 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(queries), -np.inf)  # of each query, what the k-th of this task's texts has
        pool = None
        for batch in tiles(batches):
            doc, term, tf = hits_in(batch["_w"], vocabulary)
            length = pc.list_value_length(batch["_w"]).fill_null(0).to_numpy(zero_copy_only=False)[doc]
            part = weight[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
            lot = max(1, CELLS // max(1, len(queries)))
            found = []
            for at in range(0, batch.num_rows, lot):
                here = slice(*np.searchsorted(doc, (at, at + lot)))
                each = n_of[term[here]]
                cell = np.repeat((doc[here] - at) * len(queries), each)
                cell += whose[np.repeat(begin[term[here]] - (np.cumsum(each) - each), each) + np.arange(len(cell))]
                box = min(lot, batch.num_rows - at), len(queries)
                score = np.bincount(cell, np.repeat(part[here], each), minlength=box[0] * box[1]).reshape(box)
                has = np.zeros(box, bool)
                has.ravel()[cell] = True
                if len(score) > k:
                    least = np.maximum(least, np.partition(np.where(has, score, -np.inf), -k, axis=0)[-k])
                i, q = np.nonzero(has & (score >= least - 2e-6))
                found.append((at + i, q, score[i, q]))
            i, q, score = (np.concatenate(f) for f in zip(*found, strict=True))
            new = pa.table({"_q": q, "_k": batch["_k"].take(pa.array(i)), "score": score})
            pool = new if pool is None else pa.concat_tables([pool, new])
            pool = first_rows(pool, k)
            q, score = pool["_q"].to_numpy(), pool["score"].to_numpy()
            full = np.flatnonzero(np.bincount(q, minlength=len(queries)) == k)
            worst = np.full(len(queries), np.inf)
            np.minimum.at(worst, q, score)
            least[full] = np.maximum(least[full], worst[full])
        if pool is not None:
            yield from pa.table({"query_id": queries.take(pool["_q"].combine_chunks()), "_k": pool["_k"], "score": pool["score"]}).to_batches()

    kinds = asked.select("query_id").schema, items.select(key).schema
    shape = f"query_id {kinds[0][0].dataType.simpleString()}, _k {kinds[1][0].dataType.simpleString()}, score double"
    found = rows.mapInArrow(best, shape).select("query_id", F.col("_k").alias(key), F.round("score", 6).alias("score"))
    return top(found, k, [F.desc("score"), F.col(key)])


def first_rows(rows: pa.Table, k: int) -> pa.Table:
    """The first k rows (_q, _k, score) of each _q by rounded score; ties to the smaller _k."""
    rank = np.zeros(rows.num_rows, np.int64)
    rank[pc.sort_indices(rows["_k"], null_placement="at_start").to_numpy()] = np.arange(rows.num_rows)
    kept = first_of(rows["_q"].to_numpy(), rows["score"].to_numpy(), np.zeros(rows.num_rows, bool), rank, k)
    return rows.take(pa.array(kept)).combine_chunks()


def embedded(items: DataFrame, text: str = "text", out: str = "vector", dim: int = DIMENSIONS) -> DataFrame:
    """[V1, V2] items with an embedding without a model: terms counted by a hash bucket (md5, so that any engine agrees), to unit length; zeros for no terms.

    Terms and hashes are made in the JVM. Counting is a batch of rows at once in numpy: as expressions it would scan a text's terms for each dimension.
    """

    @F.arrow_udf("array<double>")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            n = len(lists)
            size = np.diff(lists.offsets.to_numpy())
            buckets = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.bincount(np.repeat(np.arange(n), size) * dim + buckets, minlength=n * dim).reshape(n, dim).astype(float)
            norm = np.sqrt((counts**2).sum(1, keepdims=True))
            flat = np.divide(counts, norm, out=np.zeros_like(counts), where=norm > 0).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(flat))

    words = F.coalesce(t.terms(F.col(text)), F.array().cast("array<string>"))
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dim)
    return items.withColumn(out, counted(buckets))


def blocks_of(n: int, block: int) -> int:
    """How many blocks n rows are dealt into: about `block` rows at most in each, and several from a few thousand rows on, for all tasks to have some."""
    return max(1, -(-n // block), min(6, -(-n // 2048)))


def unpacked(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A column of vectors as (matrix, which are whole: of the first's length, all finite; which have a null in them; lengths). A short vector ends in zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64())
    place = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    column = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    x = np.zeros((len(size), max(int(size.max(initial=0)), 1)))
    gaps = np.zeros(len(size), bool)
    if flat.null_count:
        gaps[place[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = True
    x[place, column] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    return x, np.isfinite(x).all(1) & ~gaps & (size >= 0), gaps | (size < 0), size


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, added up from the first component on, as t.dot does."""
    total = np.zeros(len(x))
    for j in range(min(x.shape[1], y.shape[1])):
        total += x[:, j] * y[:, j]
    return total


def places(score: np.ndarray) -> np.ndarray:
    """What orders scores as they are when rounded to six places (halves up, by their shortest decimal form, as round() does)."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = score * 1e6
        out = np.floor(np.abs(scaled) + 0.5) * np.sign(scaled)
        unsure = np.isfinite(score) & ((np.abs(np.abs(scaled) % 1 - 0.5) < 1e-3) | (np.abs(scaled) > 1e10))
    for i in np.flatnonzero(unsure):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP, Context(prec=400)).scaleb(6))
    return out


def first_of(by: np.ndarray, score: np.ndarray, none: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each `by`: NaN, then by rounded score, no score last; ties by rank."""
    kind = np.where(none, 2, np.where(np.isnan(score), 0, 1))
    order = np.lexsort((rank, np.where(kind == 1, -places(score), 0), kind, by))
    start = np.flatnonzero(np.r_[True, by[order][1:] != by[order][:-1]]) if len(order) else np.zeros(0, int)
    turn = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[turn < k]


def met(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in x, place in y, inner product) of pairs whose product may reach `least` of the row of x: found in single precision with room for its error,
    then added up exactly. least is read anew for each tile of y."""
    fine = max(np.abs(x).max(initial=0), np.abs(y).max(initial=0)) < 1e15
    kind = np.float32 if fine else np.float64
    xs, ys = x.astype(kind), y.astype(kind)
    room = max(1e-5, 1.2e-7 * x.shape[1]) * np.sqrt((xs.astype(float) ** 2).sum(1)) * np.sqrt((ys.astype(float) ** 2).sum(1).max(initial=0)) + 2e-6
    for at in range(0, len(y), TILE):
        rough = xs @ ys[at : at + TILE].T
        i, j = divmod(np.flatnonzero(rough >= (least - room).astype(kind)[:, None]), rough.shape[1])
        for lot in range(0, len(i), 1 << 18):
            a, b = i[lot : lot + (1 << 18)], at + j[lot : lot + (1 << 18)]
            yield a, b, in_order(x[a], y[b])


def nearest_in(asked: pa.ChunkedArray, vectors: pa.ChunkedArray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, place of the row, score, whether it has none) of each query's first k rows of a block."""
    x, x_whole, x_gaps, x_size = unpacked(asked)
    y, y_whole, y_gaps, y_size = unpacked(vectors)
    lengths = x_size[x_whole]
    common = int(np.bincount(lengths).argmax()) if len(lengths) else 0
    x_whole, y_whole = x_whole & (x_size == common), y_whole & (y_size == common)
    mine, rows = np.flatnonzero(x_whole), np.flatnonzero(y_whole)
    rows = rows[np.argsort(rank[rows], kind="stable")]
    if len(rows) > k:  # of rows that are copies, the first k are enough
        alike = np.unique(y[rows], axis=0, return_inverse=True)[1].ravel()
        rows = rows[np.sort(first_of(alike, np.zeros(len(rows)), np.zeros(len(rows), bool), rank[rows], k))]
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool))]
    for at in range(0, len(mine) if len(rows) else 0, TILE):
        here = mine[at : at + TILE]
        q = x[here][:, :max(common, 1)]
        v = y[rows][:, :max(common, 1)]
        start = (q.astype(np.float64) @ v[: max(TILE, k)].T) if len(rows) else np.zeros((len(here), 0))
        least = np.partition(start, -k, axis=1)[:, -k] if start.shape[1] >= k else np.full(len(here), -np.inf)
        least = least - 1e-12 * np.abs(least)
        pool = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)]
        for a, b, score in met(q, v, least):
            pool = [np.concatenate(p) for p in zip(pool, (a, b, score), strict=True)]
            if len(pool[0]) > 4 * k * len(here):
                kept = first_of(pool[0], pool[2], np.zeros(len(pool[0]), bool), rank[rows[pool[1]]], k)
                pool = [p[kept] for p in pool]
                full = np.flatnonzero(np.bincount(pool[0], minlength=len(here)) == k)
                worst = np.full(len(here), np.inf)
                np.minimum.at(worst, pool[0], pool[2])
                least[full] = np.maximum(least[full], worst[full])
        out.append((here[pool[0]], rows[pool[1]], pool[2], np.zeros(len(pool[0]), bool)))
    # What has nulls, is of another length or is not finite meets all, one by one.
    for odd, others, turned in ((np.flatnonzero(~x_whole), np.arange(len(y)), False), (np.flatnonzero(~y_whole), mine, True)):
        for i in odd:
            left = y if turned else x
            right = x if turned else y
            with np.errstate(all="ignore"):
                score = in_order(np.broadcast_to(left[i], (len(others), left.shape[1])), right[others])
            none = (y_gaps if turned else x_gaps)[i] | (x_gaps if turned else y_gaps)[others] | ((x_size if turned else y_size)[others] != (y_size if turned else x_size)[i])
            out.append((others, np.full(len(others), i), score, none) if turned else (np.full(len(others), i), others, score, none))
    a, b, score, none = (np.concatenate(p) for p in zip(*out, strict=True))
    kept = first_of(a, score, none, rank[b], k)
    return a[kept], b[kept], score[kept], none[kept]


def dense(items: DataFrame, queries: DataFrame, key: str, vector: str = "vector", k: int = EACH, skip_self: bool = False) -> DataFrame:
    """[J7] Exact search by inner product of unit vectors. queries: (query_id, query_vector). Rows and queries are dealt into blocks of BLOCK at most; a task has one
    block of each and gives each query's first k of it. Scores are added up and rounded as t.dot and round() do it; a pair without a score comes last."""
    parts, turns = blocks_of(items.count(), BLOCK), blocks_of(queries.count(), BROADCAST_QUERIES)
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = items.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).withColumn("_part", F.pmod(F.xxhash64("_k"), F.lit(parts)).cast("int")).withColumn("_turn", span(turns))
    asked = queries.select(F.col("query_id").alias("_q"), F.col("query_vector").alias("_x")).withColumn("_turn", F.pmod(F.xxhash64("_q"), F.lit(turns)).cast("int")).withColumn("_part", span(parts))
    each = k + 1 if skip_self else k

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rank = np.zeros(left.num_rows, np.int64)
        rank[pc.sort_indices(left["_k"], null_placement="at_start").to_numpy()] = np.arange(left.num_rows)
        a, b, score, none = nearest_in(right["_x"], left["_v"], rank, each)
        return pa.table({"query_id": right["_q"].take(pa.array(a)), "_k": left["_k"].take(pa.array(b)), "score": pa.array(score, mask=none)})

    kinds = queries.select("query_id").schema, items.select(key).schema
    shape = f"query_id {kinds[0][0].dataType.simpleString()}, _k {kinds[1][0].dataType.simpleString()}, score double"
    n = min(parts * turns, 2000)
    found = rows.repartition(n, "_part", "_turn").groupBy("_part", "_turn").cogroup(asked.repartition(n, "_part", "_turn").groupBy("_part", "_turn")).applyInArrow(best, shape)
    scored = found.select("query_id", F.col("_k").alias(key), F.round("score", 6).alias("score"))
    if skip_self:
        scored = scored.where(F.col(key) != F.col("query_id"))
    return top(scored, k, [F.desc("score"), F.col(key)])


def over(items: DataFrame, key: str, vector: str, limit: float) -> DataFrame:
    """(a, b, score): all pairs of rows, a < b, whose inner product is over limit. Blocks as in dense(), each pair of blocks once."""
    parts = blocks_of(items.count(), BLOCK)
    rows = items.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).withColumn("_own", F.pmod(F.xxhash64("_k"), F.lit(parts)).cast("int"))
    left = rows.withColumn("_i", F.col("_own")).withColumn("_j", F.explode(F.sequence("_own", F.lit(parts - 1))))
    right = rows.withColumn("_j", F.col("_own")).withColumn("_i", F.explode(F.sequence(F.lit(0), "_own")))
    kind = items.select(key).schema[0].dataType.simpleString()

    def found(some: pa.Table, others: pa.Table) -> Iterator[pa.RecordBatch]:
        x, x_whole, _, x_size = unpacked(some["_v"])
        y, y_whole, _, y_size = unpacked(others["_v"])
        same = some.num_rows and others.num_rows and some["_own"][0] == others["_own"][0]
        for size in np.intersect1d(x_size[x_whole], y_size[y_whole]):
            mine, rows_ = np.flatnonzero(x_whole & (x_size == size)), np.flatnonzero(y_whole & (y_size == size))
            for at in range(0, len(mine), TILE):
                here = mine[at : at + TILE]
                for a, b, score in met(x[here], y[rows_], np.full(len(here), limit)):
                    good = score > limit
                    a, b, score = here[a[good]], rows_[b[good]], score[good]
                    yield pa.table({"_a": some["_k"].take(pa.array(a)), "_b": others["_k"].take(pa.array(b)), "score": score, "_same": np.full(len(a), bool(same))})

    def all_of(some: pa.Table, others: pa.Table) -> pa.Table:
        none = pa.table({"_a": some["_k"].slice(0, 0), "_b": others["_k"].slice(0, 0), "score": np.zeros(0), "_same": np.zeros(0, bool)})
        return pa.concat_tables([none, *found(some, others)])

    n = min(parts * (parts + 1) // 2, 2000)
    pairs = left.select("_i", "_j", "_own", "_k", "_v").repartition(n, "_i", "_j").groupBy("_i", "_j").cogroup(right.select("_i", "_j", "_own", "_k", "_v").repartition(n, "_i", "_j").groupBy("_i", "_j")).applyInArrow(all_of, f"_a {kind}, _b {kind}, score double, _same boolean")
    pairs = pairs.where("(_same AND _a < _b) OR (NOT _same AND _a <> _b)")  # within a block both orders of a pair are met
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), F.round("score", 6).alias("score"))


def fuse(first: DataFrame, second: DataFrame, key: str, k: int = TOP, c: int = RRF) -> DataFrame:
    """[J9, U2, A1] Reciprocal-rank fusion of two ranked lists; ties keep the first list's order, then the second's."""
    both = first.select("query_id", key, F.col("rank").alias("r1")).join(second.select("query_id", key, F.col("rank").alias("r2")), ["query_id", key], "full_outer")
    score = F.coalesce(1 / (c + F.col("r1")), F.lit(0.0)) + F.coalesce(1 / (c + F.col("r2")), F.lit(0.0))
    out = both.withColumn("score", F.round(score, 9))
    return top(out, k, [F.desc("score"), F.asc_nulls_last("r1"), F.asc_nulls_last("r2")]).select("query_id", key, "rank", "score")


def lexical_score(query: Column, passage: Column) -> Column:
    """[V4] A rerank score without a model: the share of the query's distinct terms that the passage has."""
    asked = F.array_distinct(t.terms(query))
    return F.round(F.size(F.array_intersect(asked, t.terms(passage))) / F.greatest(F.size(asked), F.lit(1)), 6)


def rerank(ranked: DataFrame, items: DataFrame, queries: DataFrame, key: str, text: str = "text", candidates: int = FUSED, k: int = TOP, score=lexical_score) -> DataFrame:
    """[T4] The first `candidates` results of each query, scored again (score: a function of the query's and the passage's column), the best k."""
    few = ranked.where(F.col("rank") <= candidates).select("query_id", key, F.col("rank").alias("before"))
    rows = few.join(items.select(key, text), key).join(queries.select("query_id", "query"), "query_id")
    scored = rows.select("query_id", key, "before", score(F.col("query"), F.col(text)).alias("score"))
    return top(scored, k, [F.desc("score"), F.col("before")]).select("query_id", key, "rank", "score")


def asked_vectors(queries: DataFrame, embed: Callable[[DataFrame, str, str], DataFrame] = embedded, prefix: str = "") -> DataFrame:
    """[V2] (query_id, query_vector) of queries, each with the prefix that its model wants (QUERY_PREFIX, say)."""
    return embed(queries.withColumn("query", F.concat(F.lit(prefix), "query")) if prefix else queries, "query", "query_vector").select("query_id", "query_vector")


def hybrid(items: DataFrame, queries: DataFrame, key: str, text: str = "text", each: int = EACH, k: int = TOP, embed: Callable[[DataFrame, str, str], DataFrame] = embedded, prefix: str = "") -> DataFrame:
    """[C2, T3] BM25 and dense search, fused. embed: a model, from (table, text column, new column) to the table with vectors of unit length."""
    vectors, asked = embed(items.select(key, text), text, "vector"), asked_vectors(queries, embed, prefix)
    return fuse(dense(vectors, asked, key, k=each), bm25(items, queries, key, text, each), key, k)


def search(items: DataFrame, queries: DataFrame, key: str, text: str = "text", mode: str = "rerank", k: int = TOP, embed: Callable[[DataFrame, str, str], DataFrame] = embedded, prefix: str = "", score=lexical_score) -> DataFrame:
    """[C2] A query in one of the modes bm25, dense, hybrid, rerank. embed, prefix and score take models (V1, V2, V4)."""
    if mode == "bm25":
        return bm25(items, queries, key, text, k).select("query_id", key, "rank", "score")
    if mode == "dense":
        return dense(embed(items.select(key, text), text, "vector"), asked_vectors(queries, embed, prefix), key, k=k).select("query_id", key, "rank", "score")
    if mode == "hybrid":
        return hybrid(items, queries, key, text, k=k, embed=embed, prefix=prefix)
    if mode == "rerank":
        return rerank(hybrid(items, queries, key, text, k=FUSED, embed=embed, prefix=prefix), items, queries, key, text, k=k, score=score)
    raise ValueError(f"unknown mode {mode}")
