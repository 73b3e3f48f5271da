"""Registered queries over the whole of their tables, on tables made for it."""

import numpy as np
from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.functions import text as t
from quillspark.operators import claims, clusters, metrics, notes, pairs, retrieval


def test_pairs_across_labels_without_a_cap(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 16))
    x[:25] = x[0] + 0.3 * x[:25]  # more than ten that are alike
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    s = np.round(x @ x.T, 6)
    both = np.concatenate([x, x * np.where(np.arange(16) % 2 == 0, 0.9, 1.1)])  # near_duplicate_pairs adds a near copy of each row
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    ids = [*range(60), *(-1 - i for i in range(60))]
    due = {(ids[a], ids[b]) for a in range(120) for b in range(120) if ids[a] < ids[b] and both[a] @ both[b] > 0.95}
    found = catalog.queries()["near_duplicate_pairs"](spark, str(tmp_path)).collect()
    assert len(found) == len(due) > 60 and {(r.a, r.b) for r in found} == due
    assert sum(-1 in pair for pair in due) > 10  # more partners than a row has neighbours
    near = {tuple(sorted((i, j))) for i in range(60) for j in np.lexsort((np.arange(60), -s[i]))[:10].tolist() if i != j}
    due = {(a, b) for a, b in near if a // 4 != b // 4 and x[a] @ x[b] <= 0.95}
    assert {(r.a, r.b) for r in catalog.queries()["similar_pairs"](spark, str(tmp_path)).collect()} == due


def test_passages_are_found_anywhere(spark, tmp_path):
    passage, longer = "Glaciers carve valleys through ancient granite mountains", "river deltas spread. Slowly, sediment settles! Then tides return: lagoons form"
    filler = " ".join(f"filler{i} sentence number{i}." for i in range(200))
    spark.createDataFrame([(1, passage), (2, longer)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"{filler} {passage}. {filler}"), (2, filler), (3, f"{filler}\n\nGlaciers carve valleys.\n\n{filler}"), (4, passage), (5, None), (6, f"{filler} where {longer} again {filler}")]
    docs.append((7, " ".join(f"{w} {filler}" for w in passage.split())))  # all its words, far from each other
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in catalog.queries()["substring_match"](spark, str(tmp_path)).select("item_id", "doc_id", "score").collect()} == {(1, 1, 5), (1, 3, 3), (1, 4, 5), (2, 6, 5)}


def test_passage_scores_are_those_of_every_run(spark, tmp_path):
    """Brute force: each passage against each run of as many words, by shared content words of the larger set."""
    rng = np.random.default_rng(8)
    words = [*(f"word{i}" for i in range(12)), "the", "of", "Alpha.", "beta,", "is"]
    line = lambda n: " ".join(rng.choice(words, n))
    items, docs = [(i, line(int(rng.integers(3, 9)))) for i in range(6)], [(i, line(int(rng.integers(0, 40)))) for i in range(12)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plain = lambda text: [w for w in "".join(c for c in text.lower() if c not in "?.,").split()]
    content = lambda ws: {w for w in ws if len(w) >= 3 and w not in t.STOPWORDS}
    due = set()
    for i, item in items:
        asked, size = content(plain(item)), len(plain(item))
        for d, text in docs:
            own = plain(text)
            runs = [content(own[at : at + size]) for at in range(max(1, len(own) - size + 1))]
            best = max((len(asked & run) / max(len(asked), len(run)) for run in runs if asked and run), default=0)
            if best >= 0.25:
                due.add((i, d, 5 if best >= 0.8 else 4 if best >= 0.5 else 3))
    assert {tuple(r) for r in catalog.queries()["substring_match"](spark, str(tmp_path)).select("item_id", "doc_id", "score").collect()} == due


def test_drafts_hold_whole_turns(spark, tmp_path):
    long = "word " * 40
    turns = [(1, 0, f"{long}end\nsecond line [^3]\n## third\nlast"), (1, 1, f"{long}\n\n{long}"), (2, 1, long + "[^7] more")]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r.conv_id: r for r in catalog.queries()["attribution"](spark, str(tmp_path)).collect()}
    assert (found[1].total_sentences, found[1].cited_sentences, found[1].orphan_footnotes) == (6, 2, "3")
    assert (found[2].total_sentences, found[2].cited_sentences, found[2].orphan_footnotes) == (1, 1, "7")
    assert catalog.queries()["answer_strength"](spark, str(tmp_path)).collect()[0].drafts == 2


def test_gold_terms_are_compared_once_for_all_copies(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PIECE", 3, raising=False)
    terms = ["hot ring", "ring", "cold bolt", None]
    found = [(i, terms[i % 4], [f"n{i % 3}", f"n{i % 5}"]) for i in range(60)] + [(7, "ring", ["n9", "n1"])]
    gold = [(i, ["hot ring small", "bolt", "ring"][i % 3], [f"n{i % 2}", f"n{i % 5}", "n9"]) for i in range(20)]
    kept = metrics.concept_matches(spark.createDataFrame(found, "concept_id long, term string, notes array<string>"), spark.createDataFrame(gold, "id long, canonical_term string, supporting_notes array<string>"))
    like = lambda x, y: y in x or x in y or len(set(x.split()) & set(y.split())) / len(set(y.split())) >= 0.5
    assert sorted(tuple(r) for r in kept.collect()) == sorted({(c, g) for c, x, n in found for g, y, m in gold if x and set(n) & set(m) and like(x, y)})
    events = [("a/x.md", i % 30, f"the claim {i % 2} before all", "after it") for i in range(60)]
    due = [("b/x.md", i, f"the claim {i % 2} or so", "after it") for i in range(9)]
    rows = metrics.drift_matches(spark.createDataFrame(events, "note string, event_id long, before_claim string, after_claim string"), spark.createDataFrame(due, "note string, id long, before_claim string, after_claim string"))
    assert sorted(tuple(r) for r in rows.collect()) == sorted((e[1], g[1]) for e in events for g in due if g[2][:10] in e[2])
    for plan in (kept, rows):  # what meets in the join by note are distinct texts
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert any("_l#" in line and line.lstrip(" :+-").startswith("Aggregate") for line in text.splitlines())


def test_blocks_of_vectors_rank_as_expressions_do(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 40, raising=False)
    monkeypatch.setattr(retrieval, "TILE", 16, raising=False)
    rng = np.random.default_rng(4)
    x = [[float(v) for v in r] for r in np.round(rng.normal(size=(150, 4)), 2)]
    x[40:70], x[71:80] = [x[3]] * 30, [[v + 4e-7 for v in x[3]]] * 9  # copies, and rows that differ beyond the sixth place
    x[100:106] = [None, [1.0, None, 0.0, 0.0], [1.0, 2.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [0.0] * 4]
    items = spark.createDataFrame(list(enumerate(x)), "id long, v array<double>")
    asked = items.where("id % 10 < 4").select(F.col("id").alias("query_id"), F.col("v").alias("query_vector"))
    every = items.crossJoin(asked).select("query_id", "id", F.round(t.dot(F.col("v"), F.col("query_vector")), 6).alias("score"))
    due = retrieval.top(every, 12, [F.desc("score"), F.col("id")])
    found = retrieval.dense(items, asked, "id", "v", k=12)
    assert sorted(map(str, found.collect())) == sorted(map(str, due.collect()))
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan and "FlatMapCoGroups" in plan


def test_alike_pairs_are_those_over_the_limit_unrounded(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9500002, 0.0]), (2, [0.95, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in pairs.alike(rows, "id", "v", 0.95).collect()] == [(0, 1, 0.95)]


def test_texts_are_split_into_claims_once(spark):
    notes = spark.createDataFrame([("a", "This is one claim. It is probably another claim."), ("b", ""), ("c", None)], "source_rel string, raw string")
    rows = claims.tentative(claims.mock_confidence(claims.claims(notes, ["source_rel"], "raw")).drop("context"))
    assert [(r.source_rel, r.sentence_index) for r in rows.collect()] == [("a", 1)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "RepartitionByExpression" in plan


def test_drift_is_counted_in_one_pass(spark):
    revisions = spark.range(3)
    aligned = spark.createDataFrame([("it is red", "it is blue", 0.4), ("it is red", "It is red!", 0.9), ("cats sleep long", "dogs never sleep", 0.65)], "before_claim string, after_claim string, cosine double")
    judge = lambda rows: rows.withColumns({"drift": F.col("cosine") < 0.7, "score": F.when(F.col("cosine") < 0.5, 5).otherwise(3)})
    kept = aligned.where(~claims.is_noise(F.col("before_claim"), F.col("after_claim")))
    due = claims.drift_counts(revisions, aligned, kept, claims.drift_events(judge(kept))).first()
    assert claims.drift_totals(revisions, aligned, judge).first() == due and tuple(due) == (3, 3, 2, 1)


def test_words_of_a_text_are_found_once_for_its_postings(spark):
    docs = spark.createDataFrame([(1, "Red fish, blue fish."), (2, ""), (3, None), (4, "one fish")], "doc_id long, text string")
    found = retrieval.bm25(docs, spark.createDataFrame([(9, "fish one")], "query_id long, query string"), "doc_id")
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [4, 1]
    lines = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("regexp_extract_all(lower(text" in line for line in lines)


def test_a_text_is_scored_where_its_words_were_found(spark, monkeypatch):
    """As by joins with a built index, with copies and ties over several tasks, tiles and lots; what is shuffled are a task's first k of a query."""
    monkeypatch.setattr(retrieval, "TILE", 16)
    monkeypatch.setattr(retrieval, "CELLS", 64, raising=False)
    rng = np.random.default_rng(5)
    line = lambda n: " ".join(rng.choice([f"w{i}" for i in range(30)], n))
    texts = [line(int(rng.integers(0, 25))) for _ in range(150)]
    texts[20:60], texts[70], texts[71] = [texts[3]] * 40, None, ""
    docs = spark.createDataFrame([(i * 7 % 150, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([*((i, line(8)) for i in range(12)), (12, texts[3]), (13, None), (14, "w1 unknown"), (None, "w2"), (3, "w4 w5")], "query_id long, query string")
    one = asked.where("query_id <> 3")
    found, due = retrieval.bm25(docs, one, "doc_id", k=7), retrieval.bm25(docs, one, "doc_id", k=7, index=retrieval.postings(docs, "doc_id", "text"))
    assert sorted(map(str, found.collect())) == sorted(map(str, due.collect())) and found.count() > 80
    assert "MapInArrow" in (plan := found._jdf.queryExecution().toString()) and "Join" not in plan
    both = retrieval.bm25(docs, asked, "doc_id", k=7).where("query_id = 3 AND rank = 1").collect()
    terms_once = asked.where("query_id = 3").groupBy("query_id").agg(F.array_join(F.collect_list("query"), " ").alias("query"))
    assert both == retrieval.bm25(docs, terms_once, "doc_id", k=1).collect()
    assert retrieval.bm25(docs, asked.where("query_id < 0"), "doc_id").count() == 0 and retrieval.bm25(docs.where("doc_id < 0"), asked, "doc_id").count() == 0
    copies = docs.unionAll(docs.where("doc_id = 0"))  # a key in common: by joins
    assert "MapInArrow" not in retrieval.bm25(copies, one, "doc_id")._jdf.queryExecution().toString()


def test_terms_of_a_text_are_counted_where_they_were_found(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retrieval, "TILE", 3)
    docs = [(1, "Red fish, blue fish."), (2, ""), (3, None), (4, "one fish"), (5, "Blue BLUE"), (None, "red ÄRA_9")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.queries()["bm25_index"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {("red", 2, 2), ("fish", 2, 3), ("blue", 2, 3), ("one", 1, 1), ("ära_9", 1, 1)} and found.columns == ["term", "df", "occurrences"]
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning(") == 1  # no hits by term and text
    copies = spark.createDataFrame([*docs, (4, "two fish")], "doc_id long, text string")  # of one length: a posting
    assert {tuple(r) for r in retrieval.term_totals(copies, "doc_id", "text").where("term = 'fish'").collect()} == {("fish", 2, 4)}


def test_kmeans_sends_no_distances_between_centres_to_the_driver(spark):
    """Once k times k times the length of a vector passes a million, the solver by rows has a job of k tasks in each iteration, which return all distances between centres."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 64)))], "id long, vector array<double>").coalesce(2)
    sc, k = spark.sparkContext, 130
    sc.setJobGroup("kmeans", "kmeans")
    try:
        found = clusters.kmeans(points, k=k)
        tracker = sc.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("kmeans") for s in tracker.getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages if s) < k
    assert found.count() == 400 and found.agg(F.countDistinct("cluster_id")).first()[0] > k // 2


def test_sections_are_packed_once_and_tokens_counted_as_by_the_pattern(spark):
    rng = np.random.default_rng(7)
    for top in (128, 256, 0x3000):
        for text in ("".join(map(chr, rng.integers(0, top, 30))) for _ in range(400)):
            assert notes.count_tokens(text) == len(notes.TOKENS.findall(text))
    body = "\n\n".join(" ".join(f"Word{i} is here." for i in range(90)) for _ in range(3))
    rows = notes.chunks(spark.createDataFrame([("a", f"# T\n{body}\n## U\nshort é — “q”"), ("b", ""), ("c", None)], "source_rel string, body string"))
    due = [("a", i, c[0], c[3]) for i, c in enumerate([*notes.pack(f"{body}\n"), *notes.pack("short é — “q”")])]
    assert sorted(tuple(r) for r in rows.select("source_rel", "chunk_index", "text", "token_count").collect()) == due and len(due) > 2
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("ArrowEvalPython ") + plan.count("ArrowEvalPython[") == 1 and "size(found" not in rows._jdf.queryExecution().optimizedPlan().toString()
