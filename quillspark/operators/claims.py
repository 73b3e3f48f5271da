"""Claims of notes: how sure they are, and how they change between revisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

ALIGNED, IDENTICAL, MIN_DRIFT = 0.75, 0.98, 4
LONGEST = 1000


def claims(notes: DataFrame, key: list[str], text: str = "content", granularity: str = "sentence") -> DataFrame:
    """[F14, F15, F17, W9] (key, sentence_index, claim, context): each claim with the two before and after it."""
    prose = t.claim_text(F.col(text))
    split = {"sentence": t.claim_sentences, "paragraph": t.claim_paragraphs}[granularity]
    rows = notes.select(*key, split(prose).alias("all"))
    # An outer explode: of the other Spark infers a filter on the list, and would split each text once more for it.
    rows = rows.select(*key, "all", F.posexplode_outer("all").alias("sentence_index", "claim")).where("claim IS NOT NULL")
    return rows.select(*key, "sentence_index", "claim", t.context(F.col("all"), F.col("sentence_index")).alias("context"))


def select_notes(notes: DataFrame, only: str | None, path: str = "source_rel", exact: bool = False) -> DataFrame:
    """[S3, S4] Notes by file name: a part of it in any case, or (exact) the whole name or path."""
    if only is None:
        return notes
    name = F.substring_index(path, "/", -1)
    return notes.where((name == only) | (F.col(path) == only)) if exact else notes.where(F.contains(F.lower(name), F.lit(only.lower())))


def mock_confidence(rows: DataFrame) -> DataFrame:
    """[V17, V18] A level for each claim without a model: 1 if it is hedged, else 3."""
    hedged = t.is_hedged(F.col("claim"))
    return rows.withColumn("level", F.when(hedged, 1).otherwise(3)).withColumn("confidence", F.when(hedged, 0.9).otherwise(0.8))


def tentative(rated: DataFrame, threshold: int = 2, min_confidence: float = 0.0, note: str = "source_rel") -> DataFrame:
    """[P5, T10] Claims rated at most `threshold`, surely enough, with the level's name, by note, level, place. What is left is shuffled first: a sort reads its
    rows twice, for bounds and for order, and would split and rate every text twice."""
    rows = rated.where((F.col("confidence") >= min_confidence) & (F.col("level") <= threshold))
    return rows.withColumn("label", t.level_label(F.col("level"))).repartition(note).orderBy(note, "level", "sentence_index")


def confidence_counts(rated: DataFrame, threshold: int = 2) -> DataFrame:
    """[A13] One row: claims, findings, abstentions (no confidence, middle level)."""
    return rated.agg(F.count("*").alias("claims"), F.count_if(F.col("level") <= threshold).alias("findings"), F.count_if((F.col("confidence") == 0) & (F.col("level") == 3)).alias("abstentions"))


def adjacent(revisions: DataFrame, note: str = "rel_path", seq: str = "seq", content: str = "content") -> DataFrame:
    """[J13, W6, T11] Each revision of a note with the next one."""
    order = Window.partitionBy(note).orderBy(seq)
    rows = revisions.select(note, seq, F.col(content).alias("before"), F.lead(content).over(order).alias("after"), F.lead(seq).over(order).alias("after_seq"))
    return rows.where(F.col("after_seq").isNotNull())


def align(before: DataFrame, after: DataFrame, key: list[str], vector: str = "vector", low: float = ALIGNED, high: float = IDENTICAL) -> DataFrame:
    """[J14, W7, P11] For each claim before, the most similar claim after in the same pair of revisions (ties to the first), if it is like it but not the same.

    before and after: key, sentence_index, claim, vector. An equi-join on the pair: claims meet within a note only.
    """
    left = before.select(*key, F.col("sentence_index").alias("before_index"), F.col("claim").alias("before_claim"), F.col(vector).alias("_x"))
    right = after.select(*key, F.col("sentence_index").alias("after_index"), F.col("claim").alias("after_claim"), F.col(vector).alias("_y"))
    pairs = left.join(right, key).select(*key, "before_index", "before_claim", "after_index", "after_claim", F.round(t.cosine(F.col("_x"), F.col("_y")), 6).alias("cosine"))
    best = F.row_number().over(Window.partitionBy(*key, "before_index").orderBy(F.desc("cosine"), "after_index"))
    rows = pairs.withColumn("_r", best).where(F.col("_r") == 1).drop("_r")
    return rows.where((F.col("cosine") >= low) & (F.col("cosine") < high))


def edit_distance(a: Column, b: Column) -> Column:
    """[P10] Levenshtein distance; for texts over LONGEST characters LONGEST, whatever they hold."""
    return F.when((F.length(a) > LONGEST) | (F.length(b) > LONGEST), F.lit(LONGEST)).otherwise(F.levenshtein(a, b))


def is_noise(a: Column, b: Column) -> Column:
    """[P9, U7] Whether two claims differ in form only: case and signs, the order of words, or fewer than three characters."""
    x, y = t.normalised(a), t.normalised(b)
    words = lambda c: F.array_sort(F.split(c, " "))
    return (x == y) | (words(x) == words(y)) | (edit_distance(x, y) < 3)


def drift_events(judged: DataFrame, min_score: int = MIN_DRIFT) -> DataFrame:
    """[P4] Judged pairs that are a change of position: (drift, type, score 1-5, ...)."""
    return judged.where(F.col("drift") & (F.col("score") >= min_score))


def mock_drift(pairs: DataFrame) -> DataFrame:
    """[V13, V14] A verdict without a model: no drift."""
    return pairs.withColumns({"drift": F.lit(False), "type": F.lit("none"), "score": F.lit(1), "reasoning": F.lit("no model")})


def drift_counts(revisions: DataFrame, pairs: DataFrame, kept: DataFrame, events: DataFrame) -> DataFrame:
    """[A11] One row: revisions walked, pairs aligned, pairs left after the noise filters, events."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(revisions, "walked_commits").crossJoin(one(pairs, "pairs_aligned")).crossJoin(one(kept, "pairs_considered")).crossJoin(one(events, "events"))


def drift_totals(revisions: DataFrame, aligned: DataFrame, judge: Callable[[DataFrame], DataFrame], min_score: int = MIN_DRIFT) -> DataFrame:
    """[A11] drift_counts() of aligned pairs in one pass over them. judge adds a verdict (drift, score) to each pair by its columns."""
    rows = judge(aligned).withColumn("_kept", ~is_noise(F.col("before_claim"), F.col("after_claim")))
    counts = rows.agg(F.count("*").alias("pairs_aligned"), F.count_if("_kept").alias("pairs_considered"), F.count_if(F.col("_kept") & F.col("drift") & (F.col("score") >= min_score)).alias("events"))
    return revisions.agg(F.count("*").alias("walked_commits")).crossJoin(counts)


def findings_per_note(events: DataFrame, note: str = "rel_path") -> DataFrame:
    """[A12]"""
    return events.groupBy(note).agg(F.count("*").alias("findings"))
