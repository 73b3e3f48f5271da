"""Pairs of passages that may conflict: a similarity join, filtered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t
from .retrieval import dense, over

NEAR_DUPLICATE = 0.95
NEIGHBOURS = 10


def neighbours(items: DataFrame, key: str, vector: str = "vector", block: str | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """[J10, W10, Q19] For each row its k nearest by inner product, itself taking one of the k places and then dropped.

    With `block` (a column), neighbours are looked for among rows of the same block only: an equi-join, for tables whose square is out of reach.
    Without it, all rows are a query set against all rows, in blocks.
    """
    if block is None:
        asked = items.select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector"))
        ranked = dense(items, asked, key, vector, k)
    else:
        left = items.select(F.col(key).alias("query_id"), F.col(vector).alias("query_vector"), block)
        scored = left.join(items.select(key, vector, block), block).select("query_id", key, F.round(t.dot(F.col("query_vector"), F.col(vector)), 6).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
        ranked = scored.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.where(F.col("query_id") != F.col(key)).select("query_id", key, "rank", "score")


def alike(items: DataFrame, key: str, vector: str, limit: float) -> DataFrame:
    """[J10, J12] (a, b, score): all pairs a < b whose inner product is over limit, however many a row has."""
    return over(items, key, vector, limit)


def candidate_pairs(found: DataFrame, items: DataFrame, key: str, note: str, vector: str = "vector", limit: float = NEAR_DUPLICATE) -> DataFrame:
    """[J11, J12, P6-P8, T5] (a, b, retrieval_score): neighbours as pairs with a < b, of different notes, not near duplicates (cosine over limit;
    a pair without vectors is kept). A pair found from both sides keeps the score of the smaller query."""
    pairs = found.select(F.least("query_id", key).alias("a"), F.greatest("query_id", key).alias("b"), F.struct("query_id", "score").alias("first"))
    pairs = pairs.groupBy("a", "b").agg(F.min("first").alias("first"))
    side = lambda x: items.select(F.col(key).alias(x), F.col(note).alias(f"{x}_note"), F.col(vector).alias(f"{x}_vector"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.col("a_note") != F.col("b_note"))
    return rows.where(F.coalesce(t.cosine(F.col("a_vector"), F.col("b_vector")), F.lit(-1.0)) <= limit).select("a", "b", F.col("first.score").alias("retrieval_score"))


def contradictions(judged: DataFrame, min_score: float = 0.5, scope: str | None = None) -> DataFrame:
    """[P2, P3] Judged pairs that are findings: verdict true, score high enough, of the scope asked for."""
    rows = judged.where(F.col("verdict") & (F.col("score") >= min_score))
    if scope is not None and scope not in ("factual", "temporal"):
        raise ValueError(f"unknown scope {scope}")
    return rows if scope is None else rows.where(F.col("type") == scope)


def mock_judge(pairs: DataFrame) -> DataFrame:
    """[V7] A verdict without a model: no contradiction."""
    return pairs.withColumns({"verdict": F.lit(False), "type": F.lit("none"), "score": F.lit(0.0), "reasoning": F.lit("no model")})


def coherent(judged: DataFrame) -> DataFrame:
    """Verdicts that make sense: a type exactly when there is a contradiction, a score from 0 to 1."""
    return judged.where((F.col("verdict") == (F.col("type") != "none")) & F.col("score").between(0, 1))
