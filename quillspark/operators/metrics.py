"""Evaluation against gold data. An empty denominator counts as 1 for precision and recall, as 0 for F1."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t

#: Items that a document's text meets at a time.
BLOCK = 256
#: Members of a class that travel together.
PIECE = 4096


def precision_recall(rows: DataFrame, found: Column, gold: Column, by: list[str] | None = None) -> DataFrame:
    """[A14, A22] tp, fp, fn, precision, recall and f1 of a condition against the true one, by group if asked for."""
    counts = rows.groupBy(*(by or [])).agg(F.count_if(found & gold).alias("tp"), F.count_if(found & ~gold).alias("fp"), F.count_if(~found & gold).alias("fn"))
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    out = counts.withColumn("_p", p).withColumn("_r", r)
    f1 = F.when(F.col("_p") + F.col("_r") == 0, 0.0).otherwise(2 * F.col("_p") * F.col("_r") / (F.col("_p") + F.col("_r")))
    return out.withColumn("precision", F.round("_p", 6)).withColumn("recall", F.round("_r", 6)).withColumn("f1", F.round(f1, 6)).drop("_p", "_r")


def gold_sets(found: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """[J19, U6] One row: distinct keys found and true (tp), found only (fp), true only (fn), and what follows from them."""
    both = found.select(*key).distinct().withColumn("_found", F.lit(True)).join(gold.select(*key).distinct().withColumn("_gold", F.lit(True)), key, "full_outer")
    return precision_recall(both, F.coalesce("_found", F.lit(False)), F.coalesce("_gold", F.lit(False)))


def gold_pairs(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """[J20] pairs (a, b, ...) with the gold rows (chunk_a_id, chunk_b_id, ...) of the same two, whichever comes first."""
    keyed = gold.withColumns({"a": F.least("chunk_a_id", "chunk_b_id"), "b": F.greatest("chunk_a_id", "chunk_b_id")}).drop("chunk_a_id", "chunk_b_id")
    return keyed.join(pairs, ["a", "b"], "left")


def greedy_match(proposals: DataFrame, scores: DataFrame, least: int = 4) -> DataFrame:
    """[J21] Proposals in order each claim the best gold item not yet claimed (score at least `least`; ties to the smaller gold id).

    A fold over proposals, each of which needs the outcome of those before; an evaluation's few dozen of them are folded in one expression.
    proposals: proposal_id, place; scores: proposal_id, gold_id, score.
    """
    options = scores.where(F.col("score") >= least).groupBy("proposal_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "gold_id"))).alias("options"))
    rows = proposals.join(options, "proposal_id").agg(F.sort_array(F.collect_list(F.struct("place", "proposal_id", "options"))).alias("p"))
    start = F.from_json(F.lit("[]"), "array<struct<proposal_id:string,gold_id:string>>")

    def claim(done: Column, p: Column) -> Column:
        free = F.filter(p.options, lambda o: ~F.exists(done, lambda d: d.gold_id == o.gold_id.cast("string")))
        return F.when(F.size(free) == 0, done).otherwise(F.concat(done, F.array(F.struct(p.proposal_id.cast("string").alias("proposal_id"), F.get(free, F.lit(0)).gold_id.cast("string").alias("gold_id")))))

    return rows.select(F.inline(F.aggregate("p", start, claim)))


def members(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b) for every member of matching classes. pairs: (_l, _r), each once; left: (_l, a), right: (_r, b). Texts are compared once for each class; its members
    travel as lists of PIECE at most, dealt over all tasks before they are spread out."""

    def packed(rows: DataFrame, by: str, key: str) -> DataFrame:
        all_ = rows.groupBy(by).agg(F.collect_list(F.struct(key)).alias("_all"))
        starts = F.sequence(F.lit(1), F.size("_all"), F.lit(PIECE))
        return all_.select(by, F.explode(F.transform(starts, lambda i: F.slice("_all", i, PIECE))).alias(f"_{by}"))

    rows = pairs.join(packed(left, "_l", a), "_l").join(packed(right, "_r", b), "_r").select("__l", "__r")
    rows = rows.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.select(F.explode("__l").alias("_a"), "__r").select("_a", F.explode("__r").alias("_b")).select(f"_a.{a}", f"_b.{b}")


def drift_matches(found: DataFrame, gold: DataFrame) -> DataFrame:
    """[J22] Events and gold events of notes with one file name whose claims, before and after, begin alike: the gold claim's first ten characters are in the found one."""
    name = lambda c: F.substring_index(c, "/", -1)
    left = found.select(name(F.col("note")).alias("name"), F.col("event_id"), F.col("before_claim").alias("x"), F.col("after_claim").alias("y"))
    right = gold.select(name(F.col("note")).alias("name"), F.col("id"), F.substring("before_claim", 1, 10).alias("u"), F.substring("after_claim", 1, 10).alias("v"))
    left, right = left.select(F.struct("name", "x", "y").alias("_l"), "event_id"), right.select(F.struct("name", "u", "v").alias("_r"), "id")
    met = left.select("_l", "_l.*").distinct().join(right.select("_r", "_r.*").distinct(), "name").where(F.contains("x", F.col("u")) & F.contains("y", F.col("v")))
    return members(met.select("_l", "_r"), left, right, "event_id", "id")


def concept_matches(found: DataFrame, gold: DataFrame) -> DataFrame:
    """[J23, F32] Concepts and gold concepts that share a note and whose terms contain one another or share half of the gold term's words."""
    left = found.select("concept_id", t.gold_words(F.col("term")).alias("x"), F.explode("notes").alias("note"))
    right = gold.select("id", t.gold_words(F.col("canonical_term")).alias("y"), F.explode("supporting_notes").alias("note"))
    # A class has the same terms and notes, so a pair of members is found once, however many notes they share.
    left = left.groupBy("concept_id").agg(F.sort_array(F.collect_set(F.struct("x", "note"))).alias("_l"))
    right = right.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("y", "note"))).alias("_r"))
    shared = F.size(F.array_intersect(F.split("x", " +"), F.split("y", " +"))) / F.size(F.array_distinct(F.split("y", " +")))
    met = left.select("_l").distinct().select("_l", F.inline("_l")).join(right.select("_r").distinct().select("_r", F.inline("_r")), "note")
    met = met.where(F.contains("x", F.col("y")) | F.contains("y", F.col("x")) | (shared >= 0.5)).select("_l", "_r").distinct()
    return members(met, left, right, "concept_id", "id")


def span_jaccard(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """[A24]"""
    inter = F.greatest(F.least(end_a, end_b) - F.greatest(start_a, start_b), F.lit(0))
    union = F.greatest(end_a, end_b) - F.least(start_a, start_b)
    return F.when(union <= 0, 0.0).otherwise(F.when(inter == 0, 0.0).otherwise(inter / ((end_a - start_a) + (end_b - start_b) - inter)))


def claim_matches(found: DataFrame, gold: DataFrame) -> DataFrame:
    """[J24] Claims and gold claims of notes with one file name: spans that overlap by half, or the same words."""
    name = lambda c: F.substring_index(c, "/", -1)
    left = found.select(name(F.col("note")).alias("name"), "claim_id", F.col("start").alias("s1"), F.col("stop").alias("e1"), t.gold_claim(F.col("claim")).alias("x"))
    right = gold.select(name(F.col("note")).alias("name"), "id", F.col("start").alias("s2"), F.col("stop").alias("e2"), t.gold_claim(F.col("claim_text")).alias("y"))
    near = F.coalesce(span_jaccard(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2")) >= 0.5, F.lit(False))
    return left.join(right, "name").where(near | (F.col("x") == F.col("y"))).select("claim_id", "id")


def confusion(rows: DataFrame, gold: str, predicted: str, values: list) -> DataFrame:
    """[A19] A row for each true value, a column for each predicted one."""
    counts = rows.groupBy(gold).pivot(predicted, values).agg(F.count(F.lit(1)))
    return counts.select(gold, *(F.coalesce(F.col(str(v)), F.lit(0)).alias(f"predicted_{v}") for v in values))


def quadratic_kappa(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """[A18] One row: agreement of two ratings, weighted by the square of how far they are apart; 1 if no disagreement was to be expected."""
    cells = rows.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    square = (F.col("g") - F.col("p")) * (F.col("g") - F.col("p"))
    seen = cells.agg(F.sum(F.col("n") * square).alias("seen"), F.sum("n").alias("total"))
    left, right = cells.groupBy("g").agg(F.sum("n").alias("a")), cells.groupBy("p").agg(F.sum("n").alias("b"))
    due = left.crossJoin(F.broadcast(right)).agg(F.sum(F.col("a") * F.col("b") * square).alias("due"))  # a cell for each pair of levels
    return seen.crossJoin(due).select(F.when(F.col("due") == 0, 1.0).otherwise(F.round(1 - F.col("seen") * F.col("total") / F.col("due"), 6)).alias("kappa"))


def overlap_ratio(a: Column, b: Column) -> Column:
    """[A23] Shared content words as a share of the larger set."""
    x, y = t.content_words(a), t.content_words(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def substring_score(a: Column, b: Column) -> Column:
    """[V20] A score from 1 to 5 by shared content words."""
    return ratio_score(overlap_ratio(a, b))


def ratio_score(r: Column) -> Column:
    return F.when(r >= 0.8, 5).when(r >= 0.5, 4).when(r >= 0.25, 3).when(r >= 0.1, 2).otherwise(1)


def windows(first: np.ndarray, before: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each run of `width` places among n (of all, if fewer), how many different words it holds: a word counts where it stands first in the run.
    first: the places of the words that count, in order; before: the place of the same word before each, -1 without one."""
    runs = max(n - width, 0) + 1
    low, high = np.maximum(before, first - width) + 1, np.minimum(first + 1, runs)
    low = np.minimum(low, high)
    return np.cumsum(np.bincount(low, minlength=runs + 1) - np.bincount(high, minlength=runs + 1))[:runs]


def best_ratios(asked: Column, sizes: Column, words: Column) -> Column:
    """[A23] For each of several sets of content words (asked) the largest overlap_ratio with any run of its `sizes` words of a text, or with all if it has
    fewer. words: the text's words in order, null for those that are not content words. A text is coded once for all sets."""

    @F.arrow_udf("array<double>")
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for wanted, widths, lines in batches:
            out = []
            for i in range(len(lines)):
                coded = lines[i].values.dictionary_encode()
                codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                n, held = len(codes), {}
                place = np.flatnonzero(codes >= 0)
                by = place[np.argsort(codes[place], kind="stable")]
                before = np.full(n, -1)
                same = codes[by[1:]] == codes[by[:-1]]
                before[by[1:][same]] = by[:-1][same]
                scores = []
                for want, width in zip(wanted[i].values, widths[i].values.to_pylist(), strict=True):
                    if width not in held:
                        held[width] = windows(place, before[place], width, n)
                    known = pc.drop_null(pc.index_in(want.values, coded.dictionary)).to_numpy(zero_copy_only=False)
                    mine = place[np.isin(codes[place], known)]
                    shared = windows(mine, before[mine], width, n)
                    scores.append(float((shared / np.maximum(np.maximum(held[width], len(want.values)), 1)).max()))
                out.append(scores)
            yield pa.array(out, pa.list_(pa.float64()))

    return best(asked, sizes, words)


def passage_scores(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str = "text") -> DataFrame:
    """[V20, A23] (item, doc, score): the score of an item's text with the run of as many words of a document that is most like it, for those that reach 3.

    A run that reaches 3 holds a quarter of the item's content words, so the document does: that is counted by a join, the rest is aligned. A document's text
    meets the items that are left in blocks of about BLOCK, so it travels once for each block.
    """
    asked = items.select(item, t.content_words(F.col(text)).alias("asked"), F.size(t.plain_words(F.col(text))).alias("size"))
    words = docs.select(doc, F.explode_outer(t.content_words(F.col(text))).alias("word")).where("word IS NOT NULL")  # outer: as in bm25()
    met = words.join(asked.select(item, F.size("asked").alias("n"), F.explode("asked").alias("word")), "word").groupBy(item, doc, "n").agg(F.count("*").alias("both"))
    blocks = max(1, -(-items.count() // BLOCK))
    left = met.where("both >= 0.25 * n").select(item, doc).join(asked, item).withColumn("_block", F.pmod(F.xxhash64(item), F.lit(blocks)))
    few = left.groupBy(doc, "_block").agg(F.collect_list(F.struct(item, "asked", "size")).alias("_items"))
    rows = few.join(docs.select(doc, F.col(text).alias("_text")), doc)
    line = F.transform(t.plain_words(F.col("_text")), lambda w: F.when(t.is_content_word(w), w))
    each = lambda name: F.transform("_items", lambda x: x[name])
    best = rows.select(doc, each(item).alias("_ids"), best_ratios(each("asked"), each("size"), line).alias("_best"))
    both = best.select(doc, F.explode(F.arrays_zip("_ids", "_best")).alias("x"))
    return both.select(F.col("x._ids").alias(item), doc, ratio_score(F.col("x._best")).alias("score")).where("score >= 3")


def hits_at_k(ranked: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """[A15] (query_id, difficulty, hit, recall) from ranked (query_id, title, rank) and expected (query_id, difficulty, titles)."""
    few = ranked.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("title").alias("found"))
    rows = expected.join(few, "query_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    shared = F.size(F.array_intersect("titles", "found"))
    return rows.select("query_id", "difficulty", (shared > 0).cast("int").alias("hit"), F.round(shared / F.size("titles"), 6).alias("recall"))


def hit_rates(hits: DataFrame) -> DataFrame:
    """[A16]"""
    return hits.groupBy("difficulty").agg(F.count("*").alias("queries"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("recall"), 6).alias("recall"))


def latency(rows: DataFrame, value: str, by: list[str], shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """[A17] Percentiles by the rank nearest to p (n - 1), halves to even, with median and mean.

    Rows of equal value are counted first, so what is sorted within a group is its distinct values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*by).orderBy("_v")
    placed = counts.withColumn("_upto", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*by)))
    at = {p: F.bround(F.lit(p) * (F.col("_all") - 1), 0) for p in shares}
    pick = [F.min(F.when(F.col("_upto") > at[p], F.col("_v"))).alias(f"p{round(p * 100)}") for p in shares]
    low, high = F.floor((F.col("_all") - 1) / 2), F.ceil((F.col("_all") - 1) / 2)
    middle = (F.min(F.when(F.col("_upto") > low, F.col("_v"))) + F.min(F.when(F.col("_upto") > high, F.col("_v")))) / 2
    return placed.groupBy(*by).agg(*pick, F.round(middle, 6).alias("median"), F.round(F.sum(F.col("_v") * F.col("_n")) / F.sum("_n"), 6).alias("mean"), F.sum("_n").alias("n"))


def axis_report(judged: DataFrame, axes: list[str], least: int = 4) -> DataFrame:
    """[A20, V21] One row: the share of answers with every axis at least `least`, and each axis's mean; nulls (skipped) count in skip_rate only."""
    done = judged.where(F.col(axes[0]).isNotNull())
    good = F.forall(F.array(*axes), lambda x: x >= least)
    means = done.agg(F.round(F.avg(good.cast("int")), 6).alias("pass_rate"), *(F.round(F.avg(a), 6).alias(f"mean_{a}") for a in axes))
    return means.crossJoin(judged.agg(F.round(F.avg(F.col(axes[0]).isNull().cast("int")), 6).alias("skip_rate")))


def stage_recall(found: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """[A21] One row: the share of gold keys that a stage found (1 without gold)."""
    n, hit = gold.agg(F.count("*").alias("gold")), gold.join(found.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("hit"))
    return n.crossJoin(hit).withColumn("recall", F.when(F.col("gold") == 0, 1.0).otherwise(F.round(F.col("hit") / F.col("gold"), 6)))
