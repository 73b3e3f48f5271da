"""Exact top-k by inner product of whole-number vectors, by no-random-access aggregation of sorted lists.

In a sub-block of LISTS rows each component is a list sorted by value. A query reads a list from the end that it likes best, all lists to growing DEPTHS, from
the start: after each depth a row's score lies between its lower bound (what has been read of it, plus the worst that each list unread for it can hold) and its
upper bound (the same plus the value at the depth reached, the best that the list still holds). The k-th largest lower bound, or the k-th best score of earlier
sub-blocks if that is more, is what a row must reach. Once the outsiders, rows not read anywhere, cannot reach it, and at most FEW rows can, reading stops and the
scores of these rows are resolved; else the next depth is read, at last all of it. Bounds of all rows for all queries still reading are matrix products over
what has been read, zero elsewhere. Ties at the bound are kept and broken by the smaller id.

Rows go into blocks of about BLOCK, queries into blocks of QUERY_BLOCK; every block of rows meets every block of queries in one task, which reads its sub-blocks one
after another and carries each query's k best along; the k best of each task are merged. Nothing is approximated. Components become floor(scale * x) in
double precision. Where products could pass 2^53, bounds are widened by what rounding may do to them and scores are resolved in integers of any length; a
score beyond 64 bits is given as the nearest number of 64 bits, in its right rank.

Vectors that are null or hold null or non-finite components (or such as scale makes infinite) take no part, nor those of another length than most; zero vectors do. A query
is every distinct (id, vector), ranked on its own; candidates are all rows but those of the query's id, repeated rows each. An empty table gives no rows. Only key and
vector are read, so other columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, q, written
from .ivfpq import matrix, top

BLOCK, LISTS, QUERY_BLOCK = 16_384, 2048, 512
#: Shares of the lists that are read, one after another; rows left at which scores are resolved.
DEPTHS, FEW = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0), 64
LONG = 2**63 - 1


class SortedLists:
    """The rows of a sub-block as one sorted list for each component."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, order, 0)
        self.place = np.empty_like(order)
        np.put_along_axis(self.place, order, np.arange(self.n)[:, None], 0)

    def read(self, depth: int, ups: np.ndarray, downs: np.ndarray, rest_up: np.ndarray, rest_down: np.ndarray) -> np.ndarray:
        """For each row and query what the first depth entries of the lists (from above where the query is positive, else from below) say of the score, if unread
        entries hold rest_up or rest_down."""
        high = np.where(self.place >= self.n - depth, self.x - rest_up, 0.0)
        low = np.where(self.place < depth, self.x - rest_down, 0.0)
        return high @ ups.T + low @ downs.T + (ups @ rest_up + downs @ rest_down)

    def best(self, queries: np.ndarray, own_ids: np.ndarray, k: int, bound: np.ndarray, slack: float = 0.0) -> list[np.ndarray]:
        """For each query the places of all rows that may be among the k best, given that k rows elsewhere score bound (-inf: none) or more. slack: by how much a bound may be off."""
        ups, downs = np.maximum(queries, 0), np.minimum(queries, 0)
        bound, out = bound - slack, [np.zeros(0, np.int64)] * len(queries)
        reading = np.arange(len(queries))
        for depth in (max(1, int(self.n * share)) for share in DEPTHS):
            up, down = ups[reading], downs[reading]
            # What the next entries hold; when all is read nothing is unread.
            ahead_up, ahead_down = self.values[max(0, self.n - 1 - depth)], self.values[min(self.n - 1, depth)]
            upper = self.read(depth, up, down, ahead_up, ahead_down)
            other = self.ids[:, None] != own_ids[None, reading]
            lower = np.where(other, self.read(depth, up, down, self.values[0], self.values[-1]), -np.inf)
            if (other.sum(0) >= k).all():
                bound[reading] = np.maximum(bound[reading], np.partition(lower, -k, axis=0)[-k] - slack)
            may = other & (upper + slack >= bound[reading])
            outsiders = up @ ahead_up + down @ ahead_down + slack >= bound[reading]  # as good as a row read nowhere may be
            done = (may.sum(0) <= FEW) & ~outsiders if depth < self.n else np.ones(len(reading), bool)
            for i in np.flatnonzero(done).tolist():
                out[reading[i]] = np.flatnonzero(may[:, i])
            reading = reading[~done]
            if not len(reading):
                break
        return out


def exact_scores(x: np.ndarray, query: np.ndarray, slack: float) -> np.ndarray:
    """Inner products: in double precision where that is exact, else as Python's integers."""
    if not slack:
        return x @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in x], object)


def sortable(score: int) -> bytes:
    """Bytes in the order of whole numbers of any length."""
    n = (abs(score).bit_length() + 7) // 8
    return (0x8000 + n).to_bytes(2) + score.to_bytes(n) if score >= 0 else (0x8000 - n).to_bytes(2) + ((1 << 8 * n) - 1 + score).to_bytes(n)


def block_best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, id, score) of the k best rows for each query."""
    most = float(np.abs(x).max(initial=0)), float(np.abs(queries).max(initial=0))
    slack, scale, down_x, down_q = 0.0, 1, x, queries
    if 4 * most[0] * most[1] * x.shape[1] >= 2.0**53:  # bounds of components scaled by powers of two to 1 at most
        powers = [int(np.frexp(m)[1]) for m in most]
        down_x, down_q, scale = np.ldexp(x, -powers[0]), np.ldexp(queries, -powers[1]), 1 << max(0, sum(powers))
        slack = x.shape[1] * (x.shape[1] + 8) * 2.0**-50
    found = [(ids[:0], np.zeros(0, object if slack else float)) for _ in queries]
    for at in range(0, len(ids), LISTS):
        lists = SortedLists(ids[at : at + LISTS], down_x[at : at + LISTS])
        bound = np.array([s[-1] / scale if len(s) == k else -np.inf for _, s in found], float)
        for i, rows in enumerate(lists.best(down_q, query_ids, k, bound, slack)):
            if len(rows):
                all_ids, scores = np.concatenate([found[i][0], lists.ids[rows]]), np.concatenate([found[i][1], exact_scores(x[at + rows], queries[i], slack)])
                keep = np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], all_ids[j]))[:k]) if slack else top(scores, all_ids, k)
                found[i] = all_ids[keep], scores[keep]
    places = np.repeat(np.arange(len(queries)), [len(s) for _, s in found])
    return places, np.concatenate([f for f, _ in found]), np.concatenate([s for _, s in found])


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of df that is_query (a condition on df's key as `id`) holds for, the k highest scores among the other rows."""
    prepare(df.sparkSession)
    kind = "query_id long, rank int, vec_id long, score long"
    whole = F.transform(q(vector).cast("array<double>"), lambda x: x * scale)  # floor() of Spark would end at 64 bits
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = df.where(q(key).isNotNull() & q(vector).isNotNull() & finite).select(q(key).cast("long").alias("id"), whole.alias("v"))
    good = written(good, "nra-vectors")  # rows keep their places in its files, by which they are dealt into blocks
    facts = sorted(((r.n, -r.d) for r in good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()), reverse=True)
    if not facts:
        return df.sparkSession.createDataFrame([], kind)
    rows, dim = facts[0][0], -facts[0][1]
    good = good.where(F.size("v") == dim)
    asked = good.where(is_query).select(F.col("id").alias("query"), F.col("v").alias("asked"), F.xxhash64("v").alias("q")).distinct()
    blocks, turns = -(-rows // block), max(1, -(-asked.count() // query_block))
    placed = good.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    placed = placed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    wanted = asked.withColumn("turn", F.pmod(F.xxhash64("query", "q"), F.lit(turns)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        at, found, score, query_ids, own = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if left.num_rows and right.num_rows:
            query_ids, own = right["query"].to_numpy(), right["q"].to_numpy()
            at, found, score = block_best(left["id"].to_numpy(), np.floor(matrix(left["v"], dim)), query_ids, np.floor(matrix(right["asked"], dim)), k)
        whole = [int(s) for s in score]
        columns = {"query_id": query_ids[at], "q": own[at], "vec_id": found, "score": [max(-LONG, min(LONG, s)) for s in whole]}
        return pa.table({n: pa.array(x, pa.int64()) for n, x in columns.items()} | {"place": pa.array(map(sortable, whole), pa.binary())})

    found = placed.groupBy("block", "turn").cogroup(wanted.groupBy("block", "turn")).applyInArrow(best, "query_id long, q long, vec_id long, score long, place binary")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("place"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
