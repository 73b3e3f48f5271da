"""Nearest neighbours and exact top-k."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ivfpq, nra


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("clash")).withColumn("id", F.lit(1))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:600] = x[7]  # a third is one vector
    good = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return good + [(2000, None), (2010, [0.0] * 16), (2020, [1.0, None] + [0.0] * 14), (2030, [float("nan")] * 16), (2040, [float("inf")] + [0.0] * 15), (2050, [1.0] * 3), (None, [1.0] * 16), (5, good[5][1])]


def best(pool, query, own, k):
    scored = sorted(((-float(np.dot(np.array(v, float), query)), i) for i, v in pool if i != own))
    return [(i, -s) for s, i in scored[:k]]


def test_neighbours(spark, rows):
    found = ivfpq.search(frame(spark, rows), F.col("id") % 10 == 0, k=8, block=200, query_block=30, rerank=60).collect()
    pool = [(i, v) for i, v in rows if i is not None and i < 2000]
    hit = n = 0
    for i, v in pool[:900:10]:
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == i)
        due = best(pool, np.array(v, float), i, 8)
        assert [r for r, _, _ in got] == list(range(1, 9))
        assert all(s == pytest.approx(float(np.dot(np.array(dict(pool)[j], float), np.array(v, float)))) for _, j, s in got)
        hit, n = hit + len({j for _, j, _ in got} & {j for j, _ in due}), n + 8
    assert hit / n >= 0.9
    assert {r.query_id for r in found} == set(range(0, 900, 10))
    assert ivfpq.search(frame(spark, rows).limit(0), F.col("id") % 10 == 0).count() == 0
    few = ivfpq.search(frame(spark, rows[:4]), F.col("id") == 0, k=8).collect()
    assert len(few) == 3


def test_exact_top(spark, rows):
    found = nra.search(frame(spark, rows), F.col("id") % 10 == 0, k=5, block=250, query_block=40).collect()
    pool = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and len(v) == 16]
    assert any(i == 2010 for i, _ in pool)
    for i, v in pool:
        if i % 10 == 0:
            got = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])]
            assert got == [(j, int(s)) for j, s in best(pool, v, i, 5)]
    assert nra.search(frame(spark, rows).limit(0), F.col("id") % 10 == 0).count() == 0
    assert nra.search(frame(spark, rows[:3]), F.col("id") == 0, k=5).count() == 2


def test_lists_stop_early_without_losing_rows():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 12)) * 50)
    ids = np.arange(500)
    lists = nra.SortedLists(ids, x)
    queries = np.floor(rng.normal(size=(20, 12)) * 50)
    scores = x @ queries.T
    for bound in (np.full(20, -np.inf), np.sort(scores, 0)[-5]):
        for i, got in enumerate(lists.best(queries, np.full(20, -1), 5, bound)):
            assert set(np.flatnonzero(scores[:, i] >= np.sort(scores[:, i])[-5])) <= set(got)
    steep = np.zeros((500, 12))
    steep[:, 0] = np.arange(500)
    reads = []
    lists = nra.SortedLists(ids, steep)
    read = lists.read
    lists.read = lambda depth, *how: reads.append(depth) or read(depth, *how)
    (got,) = lists.best(np.eye(12)[:1], np.array([499]), 5, np.array([-np.inf]))
    assert {494, 495, 496, 497, 498} <= set(got) and 499 not in got and max(reads) < 100  # reading stopped
    assert len(lists.best(np.zeros((1, 12)), np.array([3]), 5, np.array([-np.inf]))[0]) == 499


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(size=(60, 4)) * 1e9)
    x[7] = x[3] + [0, 0, 0, 1]  # differ in the last place only
    x[11, 0], x[12, 0] = 1e30, -1e300
    frame_ = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, [1e308, 0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    found = nra.search(frame_, F.col("id") % 10 == 0, k=5, block=25, query_block=4, scale=256.0).collect()
    whole = [[int(np.floor(256.0 * v)) for v in r] for r in x]
    for i in range(0, 60, 10):
        due = sorted(((-sum(a * b for a, b in zip(whole[i], whole[j])), j) for j in range(60) if j != i))[:5]
        got = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])]
        assert got == [(j, max(-nra.LONG, min(nra.LONG, -s))) for s, j in due]


def test_queries_of_one_id_are_ranked_each(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(40, 8)))] + [(0, [float(v) for v in rng.normal(size=8)])]
    for search in (ivfpq.search, nra.search):
        found = search(frame(spark, rows), F.col("id") == 0, k=6).collect()
        assert sorted(r["rank"] for r in found) == sorted([1, 2, 3, 4, 5, 6] * 2) and all(r.vec_id for r in found)


def test_lists_are_probed_until_enough_rows_are_met(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(3, 8)) + 50, rng.normal(size=(400, 8))])  # a list of three rows
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    found = ivfpq.search(frame(spark, rows), F.col("id") < 3, k=20, target=0.01).collect()
    assert all(sum(r.query_id == i for r in found) == 20 for i in range(3))


def test_neighbours_of_uneven_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 16))
    x[rng.choice(6000, 20, replace=False)] *= 1000
    found = ivfpq.search(frame(spark, [(i, [float(v) for v in r]) for i, r in enumerate(x)]), F.col("id") % 100 == 0, k=20, rerank=60, train=1000).collect()
    pool, hit = x.astype(np.float32).astype(float), 0
    for i in range(0, 6000, 100):
        scores = pool @ pool[i]
        scores[i] = -np.inf
        hit += len({r.vec_id for r in found if r.query_id == i} & set(np.argsort(-scores)[:20].tolist()))
    assert len(found) == 1200 and hit / 1200 >= 0.95
