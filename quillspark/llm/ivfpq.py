"""Approximate nearest neighbours by inner product: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

The index is fitted on a bounded sample (TRAIN vectors with the smallest hash of their id): k-means centroids, then for each of PARTS slices of a
vector a codebook of 256 for what the centroid leaves. Every row is indexed: its list and a byte per slice. A query probes the lists
whose centroids have the largest inner product with it, and more of them until they hold as many rows as it asks for; tables of its inner products with all codes give each row's approximate score
(asymmetric distance); the best RERANK rows of each block are scored exactly in double precision, and so is every other row whose approximate score and
greatest error (what its codes leave of it, as long as the query) reach the k-th of those: of the rows of probed lists none is lost. Ties to the smaller id.
How many lists to probe is measured on the table: the fewest that hold TARGET of the true neighbours, among all rows, of PROBE_QUERIES of its queries, by brute force.

Lists are packed into blocks of at most BLOCK rows (a list that holds more, like that of one very common vector, is split), queries into blocks of QUERY_BLOCK;
a task has one block of each. So no task grows with a list, and memory is bounded by a block.

Vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate; nor do those of another length than
most. Repeated ids are rows of their own as candidates, but a query is every distinct (id, vector), ranked on its own; rows with the query's id are left out.
An empty table gives no rows. Only key and vector are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import prepare, q, written

TRAIN, PARTS, CODES, RERANK, TARGET, PROBE_QUERIES = 20_000, 16, 256, 400, 0.99, 200
BOOK_TRAIN = 8192  # of TRAIN, for the codebooks
BLOCK, QUERY_BLOCK, MAX_LISTS = 16_384, 1024, 4096


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the rows of x; a centre without rows stays where it was."""
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], 1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    x, centres = x.astype(np.float32), centres.astype(np.float32)
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - x[i : i + 2048] @ centres.T).argmin(1) for i in range(0, max(1, len(x)), 2048)])


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, ties to smaller ids."""
    if len(scores) > k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Index:
    """Centroids, codebooks and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, rows: int, parts: int = PARTS):
        rng = np.random.default_rng(7)
        lists = int(np.clip(round(rows**0.5), 1, MAX_LISTS))
        self.centres = kmeans(sample, min(lists, max(1, len(sample) // 8)), 10, rng)
        self.slices = [s for s in np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))]
        rest = sample - self.centres[nearest(sample, self.centres)]
        rest = rest[rng.permutation(len(rest))[:BOOK_TRAIN]]
        self.books = [kmeans(rest[:, s], CODES, 6, rng) for s in self.slices]
        self.probes = len(self.centres)

    def measure(self, asked: np.ndarray, found: list[np.ndarray], target: float) -> None:
        """Probe the fewest lists that hold the target of true neighbours. found: the lists of those of each row of asked."""
        order = np.argsort(-(asked @ self.centres.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1, kind="stable")
        deep = np.concatenate([place[i, lists] for i, lists in enumerate(found)]) if found else np.zeros(0, int)
        self.probes = int(np.quantile(deep, target, method="higher")) + 1 if len(deep) else len(self.centres)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        return own, np.stack([nearest(rest[:, s], b) for s, b in zip(self.slices, self.books, strict=True)], 1).astype(np.uint8)

    def probe(self, x: np.ndarray, held: np.ndarray, need: np.ndarray) -> list[np.ndarray]:
        """The lists for each query, nearest first: as many as are probed, and more until they hold as many rows as it needs."""
        order = np.argsort(-(x @ self.centres.T), axis=1, kind="stable")
        enough = (held[order].cumsum(1) < need[:, None]).sum(1) + 1
        return [lists[: max(self.probes, n)] for lists, n in zip(order, enough, strict=True)]

    def search(self, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, probed: list[np.ndarray], k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, exact score) of the best k rows of a block for each query."""
        order = np.argsort(lists, kind="stable")
        ids, lists, codes, vectors = ids[order], lists[order], codes[order].astype(np.int64), vectors[order]
        flat = codes + np.arange(codes.shape[1]) * CODES
        start, past = (np.searchsorted(lists, np.arange(len(self.centres)), side) for side in ("left", "right"))
        near = queries @ self.centres.T
        coded = self.centres[lists]
        for m, (s, b) in enumerate(zip(self.slices, self.books, strict=True)):
            coded[:, s] += b[codes[:, m]]
        error = np.sqrt(((vectors - coded) ** 2).sum(1)) + 1e-9 * np.sqrt((vectors**2).sum(1))  # and that of adding up
        out = []
        for i, x in enumerate(queries):
            lists_here = probed[i][past[probed[i]] > start[probed[i]]]
            if not len(lists_here):
                continue
            rows = np.concatenate([np.arange(start[j], past[j]) for j in lists_here])
            table = np.zeros((len(self.slices), CODES))
            for m, (s, b) in enumerate(zip(self.slices, self.books, strict=True)):
                table[m, : len(b)] = b @ x[s]
            rows = rows[ids[rows] != query_ids[i]]
            rough = near[i, lists[rows]] + table.ravel()[flat[rows]].sum(1)
            most = max(rerank, k)
            if len(rows) > most:
                first = rough >= np.partition(rough, -most)[-most]
                exact = vectors[rows[first]] @ x
                least = np.partition(exact, -k)[-k]
                rows = rows[first | ~(rough + error[rows] * np.sqrt(x @ x) < least)]
            exact = vectors[rows] @ x
            best = top(exact, ids[rows], k)
            out.append((np.full(len(best), i), ids[rows[best]], exact[best]))
        return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def vectors_of(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """The rows that take part as (id, v), their number and the vectors' length."""
    good = df.select(q(key).cast("long").alias("id"), q(vector).cast("array<double>").alias("v")).where(q("id").isNotNull() & usable(F.col("v")))
    sizes = sorted(((r[1], -r[0]) for r in good.groupBy(F.size("v")).count().collect()), reverse=True)
    if not sizes:
        return good, 0, 0
    return good.where(F.size("v") == -sizes[0][1]), sizes[0][0], -sizes[0][1]


def matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """An Arrow column of lists of one length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, rerank: int = RERANK, train: int = TRAIN, block: int = BLOCK, query_block: int = QUERY_BLOCK, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df that is_query (a condition on df's key as `id`) holds for, its k nearest of the other rows."""
    prepare(df.sparkSession)
    good, rows, dim = vectors_of(df, key, vector)
    kind = "query_id long, rank int, vec_id long, score double"
    if not rows:
        return df.sparkSession.createDataFrame([], kind)
    sample = good.orderBy(F.xxhash64("id"), "id").limit(train).select("v").toPandas().v
    index = Index(np.stack(sample.to_numpy()), rows)

    @F.arrow_udf(T.StructType([T.StructField("list", T.IntegerType()), T.StructField("code", T.BinaryType())]))
    def indexed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            own, codes = index.encode(matrix(batch, dim)) if len(batch) else (np.zeros(0, int), np.zeros((0, 1), np.uint8))
            yield pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], ["list", "code"])

    base = written(good.withColumn("x", indexed(F.col("v"))).select("id", "v", "x.list", "x.code"), "ivfpq-index")
    in_list = sorted(tuple(r) for r in base.groupBy("list").count().collect())
    held = np.zeros(len(index.centres), np.int64)
    held[[name for name, _ in in_list]] = [n for _, n in in_list]

    some = good.where(is_query).distinct().orderBy(F.xxhash64("id"), F.xxhash64("v")).limit(PROBE_QUERIES).toPandas()
    if len(some):
        tried, tried_ids = np.stack(some.v.to_numpy()), some.id.to_numpy()

        def nearest_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(tried)
            for batch in batches:
                ids, own = batch["id"].to_numpy(), batch["list"].to_numpy()
                scores = tried @ matrix(batch["v"], dim).T
                for i, mine in enumerate(tried_ids):
                    here = np.flatnonzero(ids != mine)
                    score, id_, list_ = (np.concatenate(x) for x in zip(best[i], (scores[i, here], ids[here], own[here]), strict=True))
                    few = top(score, id_, k)
                    best[i] = score[few], id_[few], list_[few]
            n = [len(b[0]) for b in best]
            score, id_, list_ = (np.concatenate(x) for x in zip(*best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), n), pa.int32()), pa.array(score), pa.array(id_, pa.int64()), pa.array(list_, pa.int32())], ["place", "score", "id", "list"])

        true = base.mapInArrow(nearest_of_part, "place int, score double, id long, list int")
        turn = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), "id"))
        true = true.withColumn("turn", turn).where(F.col("turn") <= k).groupBy("place").agg(F.collect_list("list").alias("lists")).collect()
        index.measure(tried[[r.place for r in true]], [np.array(r.lists) for r in true], target)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def probed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, own in batches:
            yield pa.array([x.astype(np.int32) for x in index.probe(matrix(vectors, dim), held, k + own.to_numpy())] if len(own) else [], pa.list_(pa.int32()))

    # Rows with the query's own id are no candidates, however many they are.
    asked = good.where(is_query).withColumn("own", F.count("*").over(Window.partitionBy("id"))).distinct()
    asked = written(asked.withColumn("lists", probed(F.col("v"), F.col("own"))).drop("own").withColumn("q", F.xxhash64("v")), "ivfpq-queries")

    # Blocks: lists one after another up to `block` rows; a larger list has blocks of its own. A row for each list, MAX_LISTS at most.
    first, parts, at, filled = {}, {}, 0, 0
    for name, n in in_list:
        if filled and filled + n > block:
            at, filled = at + 1, 0
        first[name], parts[name] = at, -(-n // block)
        if n > block:
            at, filled = at + parts[name], 0
        else:
            filled += n
    plan = df.sparkSession.createDataFrame([(k_, first[k_], parts[k_]) for k_ in first], "list int, first long, parts long")
    placed = base.join(F.broadcast(plan), "list").withColumn("block", F.expr("first + pmod(xxhash64(id), parts)")).drop("first", "parts")
    wanted = asked.select("id", "q", "v", F.explode("lists").alias("list")).join(F.broadcast(plan), "list")
    wanted = wanted.select("id", "q", "v", "list", F.explode(F.expr("sequence(first, first + parts - 1)")).alias("block")).groupBy("id", "q", "block").agg(F.first("v").alias("v"), F.collect_set("list").alias("lists"))
    load = wanted.groupBy("block").agg(F.ceil(F.count("*") / query_block).alias("turns"))
    load = load.join(placed.groupBy("block").agg(F.lit(1).alias("one")), "block").drop("one")
    wanted = wanted.join(load, "block").withColumn("turn", F.expr("pmod(xxhash64(id), turns)")).drop("turns")
    placed = placed.join(load, "block").withColumn("turn", F.explode(F.expr("sequence(0L, turns - 1)"))).drop("turns")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        ids, query_ids = left["id"].to_numpy(), right["id"].to_numpy()
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
        at_, found, score = index.search(ids, left["list"].to_numpy(), codes, matrix(left["v"], dim), query_ids, matrix(right["v"], dim), [np.array(x, np.int64) for x in right["lists"].to_pylist()], k, rerank)
        return pa.table({"query_id": pa.array(query_ids[at_], pa.int64()), "q": pa.array(right["q"].to_numpy()[at_], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64())})

    found = placed.groupBy("block", "turn").cogroup(wanted.groupBy("block", "turn")).applyInArrow(best, "query_id long, q long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
