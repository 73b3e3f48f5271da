"""Clusters of passages, the gaps and the unnamed concepts found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MIN_SIZE, MAX_CLUSTERS, GAPS, SEED, ABSENCE = 3, 30, 3, 42, 0.20


def default_k(n: int) -> int:
    """[V5] The number of clusters for n points."""
    return max(1, n) if n < 4 else min(n, max(2, round(n**0.5)))


def kmeans(points: DataFrame, vector: str = "vector", k: int | None = None, seed: int = SEED) -> DataFrame:
    """[V5, S12] points that have a vector, with cluster_id, by MLlib. Labels differ from other libraries'; sizes, order and cap are what clusters() settles."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = points.where(F.col(vector).isNotNull())
    n = rows.count() if k is None else k
    if not n:
        return rows.withColumn("cluster_id", F.lit(None).cast("int"))
    rows = rows.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    # By blocks: below 1000 clusters the solver by rows sends all distances between centres to the driver in each iteration.
    model = KMeans(k=default_k(n) if k is None else k, seed=seed, featuresCol="_features", predictionCol="cluster_id", solver="block").fit(rows)
    return model.transform(rows).drop("_features")


def assign(points: DataFrame, centres: DataFrame, vector: str = "vector") -> DataFrame:
    """points with the cluster_id of the nearest of a few given centres (cluster_id, centre), ties to the smaller id. The centres travel as one array."""
    every = centres.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "centre"))).alias("centres"))
    far = lambda c: F.aggregate(F.zip_with(c.centre, F.col(vector), lambda a, b: a.cast("double") - b.cast("double")), F.lit(0.0), lambda s, d: s + d * d)
    best = F.array_min(F.transform("centres", lambda c: F.struct(F.round(far(c), 9).alias("d"), c.cluster_id.alias("cluster_id"))))
    return points.crossJoin(F.broadcast(every)).withColumn("cluster_id", best.cluster_id).drop("centres")


def clusters(members: DataFrame, key: str, min_size: int = MIN_SIZE, limit: int = MAX_CLUSTERS) -> DataFrame:
    """[A6, P13, T6, T7] (cluster_id, size, members in order), large clusters first; small ones are left out; limit 0 or less: no cap."""
    rows = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.sort_array(F.collect_list(key)).alias("members")).where(F.col("size") >= min_size)
    rows = rows.orderBy(F.desc("size"), "cluster_id")
    return rows.limit(limit) if limit > 0 else rows


def mock_gaps(clusters_: DataFrame) -> DataFrame:
    """[V8, V9] One gap for each cluster, in the clusters' order, without a model."""
    n = F.row_number().over(Window.orderBy(F.desc("size"), "cluster_id"))  # clusters are few: at most the square root of the points
    return clusters_.select(
        "cluster_id", F.col("size").alias("cluster_size"), F.concat(F.lit("mock-gap-"), n.cast("string")).alias("suggested_note_title"),
        F.lit("Which wider subject holds these notes together?").alias("gap_question"), F.slice("members", 1, 3).alias("supporting_chunk_ids"),
    )


def valid_support(proposals: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """[J16] Proposals (cluster_id, proposal, ids) with only those ids that are in the cluster, in their order."""
    rows = proposals.select("cluster_id", "proposal", F.posexplode("ids").alias("i", key))
    rows = rows.join(members.select("cluster_id", key), ["cluster_id", key], "left_semi")
    return rows.groupBy("cluster_id", "proposal").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", key))), lambda x: x[key]).alias("ids"))


def absent_terms(items: DataFrame, proposals: DataFrame, text: str = "text", absence: float = ABSENCE, k: int = 10) -> DataFrame:
    """[A7, P12, T9] Proposed terms (cluster_id, term, confidence) that occur in less than a share of all texts, the most confident k.

    The proposals, one for each cluster at most, travel as one array; each text is read once, and counts are summed before the shuffle.
    """
    asked = proposals.agg(F.collect_set(F.lower("term")).alias("asked"))
    every = items.crossJoin(F.broadcast(asked)).select(F.lower(text).alias("low"), F.explode("asked").alias("low_term"))
    share = every.groupBy("low_term").agg(F.round(F.avg(F.contains("low", F.col("low_term")).cast("int")), 6).alias("term_freq"))
    rows = proposals.join(share, F.lower("term") == F.col("low_term")).where(F.col("term_freq") < absence).drop("low_term")
    return rows.orderBy(F.desc("confidence"), "cluster_id").limit(k)


def concept_evidence(members: DataFrame, note: str, key: str) -> DataFrame:
    """[A8] Each cluster's distinct notes and its chunks."""
    return members.groupBy("cluster_id").agg(F.sort_array(F.collect_set(note)).alias("notes"), F.sort_array(F.collect_list(key)).alias("chunk_ids"))


def mock_concept(clusters_: DataFrame) -> DataFrame:
    """[V15, V16] A term for each cluster without a model."""
    return clusters_.select("cluster_id", F.lit("mock_concept").alias("term"), F.lit(0.9).alias("confidence"))


def mean_centres(members: DataFrame, vector: str = "vector") -> DataFrame:
    """(cluster_id, centre): the mean of each cluster's vectors."""
    rows = members.select("cluster_id", F.posexplode(vector).alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return rows.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: F.round(s.x, 9)).alias("centre"))


def is_named(term: Column) -> Column:
    """Whether a proposal is one: an abstention has an empty term, which every text contains."""
    return F.coalesce(term, F.lit("")) != ""
