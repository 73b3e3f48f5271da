import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.operators import answers, claims, clusters, links, metrics, notes, pairs, reports, retrieval, store
from quillspark.plans import commands
from quillspark.sources import vault
from quillspark.streaming import reingest


def frame(spark, kind, *rows):
    return spark.createDataFrame(list(rows), kind)


# Notes


def test_sections_keep_open_headings(spark):
    body = "pre\n# A\n\n## B\ntext b\n### C #\ntext c\n## D\n\n# E\nlast"
    rows = notes.sections(frame(spark, "source_rel string, body string", ("n.md", body), ("empty.md", ""), ("plain.md", "x"))).collect()
    found = [(r.source_rel, r.heading_path, r.section) for r in sorted(rows, key=lambda r: (r.source_rel, r.section_index))]
    assert found == [("n.md", [], "pre\n"), ("n.md", ["A", "B"], "text b\n"), ("n.md", ["A", "B", "C"], "text c\n"), ("n.md", ["E"], "last"), ("plain.md", [], "x")]
    for r in rows:
        if r.source_rel == "n.md":
            assert body[r.char_start : r.char_start + len(r.section)] == r.section


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 30), min_size=1, max_size=8), min_size=1, max_size=12))
def test_packing_keeps_every_unit_in_order(sizes):
    paragraphs = [" ".join("W" + "a b c"[: 1] * 1 + f"{i}x{j} " + "w " * n + "." for j, n in enumerate(p)) for i, p in enumerate(sizes)]
    section = "\n\n".join(paragraphs)
    found = notes.pack(section, target=60, least=10, overlap=0.15)
    marks = re.findall(r"\d+x\d+", section)
    first: list[str] = []
    for text, start, end, tokens in found:
        assert 0 <= start <= end <= len(section) and tokens > 0
        first += [m for m in re.findall(r"\d+x\d+", text) if m not in first]
    assert first == marks
    assert [s for _, s, _, _ in found] == sorted(s for _, s, _, _ in found)


def test_packing_by_hand():
    section = "One two three four.\n\nFive six seven eight.\n\nNine ten eleven twelve."
    assert [c[0] for c in notes.pack(section, target=10, least=4, overlap=0.5)] == ["One two three four.\n\nFive six seven eight.", "Five six seven eight.\n\nNine ten eleven twelve."]
    assert notes.pack("  \n\n ") == []


def test_an_edit_keeps_the_id_and_changes_the_hash(spark):
    rows = [notes.chunks(frame(spark, "source_rel string, body string", ("a.md", b))).first() for b in ("old text", "new text")]
    assert rows[0].chunk_id == rows[1].chunk_id and rows[0].content_hash != rows[1].content_hash


def test_bad_yaml_is_kept_as_error(spark):
    rows = notes.frontmatter_maps(frame(spark, "frontmatter string", ("a: 1\nb: [x, y]",), ("a: [",), ("- x",), (None,), ("",))).collect()
    assert [r.properties for r in rows] == [{"a": "1", "b": '["x", "y"]'}, {}, {}, {}, {}]
    assert [r.frontmatter_error is None for r in rows] == [True, False, False, True, True]


# Links


def test_link_classes(spark):
    rows = frame(spark, "source_rel string, body string", ("a.md", "[[b]] [[gone]] [[a]] ![[b]]"), ("x/b.md", "[[A.md]]"), ("y/b.md", ""), ("c.md", "[[x/B]] [[c]]"), ("d.md", "none"))
    found = links.links(rows)
    assert {(r.source, r.target_raw) for r in links.broken(found).collect()} == {("a", "gone")}
    assert sorted((r.source, r.target) for r in links.one_way(found).collect()) == [("a", "y/b"), ("a", "y/b"), ("c", "x/b")]
    assert [(r.node, r.outbound_count) for r in links.orphans(found).collect()] == [("c", 1)]
    assert {(r.source, r.target_raw, tuple(r.candidates)) for r in links.shadowed(found).collect()} == {("a", "b", ("x/b", "y/b"))}
    assert {r.defect: r.findings for r in links.audit_totals(links.audit(rows)).collect()} == {"broken": 1, "one-way": 3, "orphan": 1, "shadowed": 2}
    with pytest.raises(ValueError, match="unknown"):
        links.audit(rows, ("wrong",))
    report = reports.audit_markdown(links.audit(rows, ("broken",)), links.nodes(rows), "v").first().report
    assert "## Broken links (1)\n- `a` → `gone` [[...]]" in report and "## Orphan notes (0)\n_none found._" in report


# Retrieval


def ranks(spark, *rows):
    return frame(spark, "query_id int, doc string, rank int", *rows)


def test_fusion(spark):
    found = retrieval.fuse(ranks(spark, (1, "a", 1), (1, "b", 2)), ranks(spark, (1, "a", 1), (1, "c", 2)), "doc").collect()
    assert [(r.doc, r["rank"]) for r in sorted(found, key=lambda r: r["rank"])] == [("a", 1), ("b", 2), ("c", 3)]
    assert found[0].score == pytest.approx(2 / 61, abs=1e-8)


@pytest.mark.parametrize("mode", ["bm25", "dense", "hybrid", "rerank"])
def test_search_finds_the_text(spark, mode):
    items = frame(spark, "id int, text string", (1, "orbits of the planets"), (2, "the taste of bread"), (3, None), (4, ""))
    asked = frame(spark, "query_id int, query string", (7, "planets and orbits"), (8, "taste of bread"), (9, "zzz"))
    found = {(r.query_id, r["rank"]): r.id for r in retrieval.search(items, asked, "id", mode=mode).collect()}
    assert found[7, 1] == 1 and found[8, 1] == 2


def test_built_index_gives_the_same(spark):
    items = frame(spark, "id int, text string", (1, "a b b"), (2, "b c"), (3, "c c d"))
    asked = frame(spark, "query_id int, query string", (1, "b c"))
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "score").collect()))
    assert key(retrieval.bm25(items, asked, "id")) == key(retrieval.bm25(items, asked, "id", index=retrieval.postings(items, "id", "text")))


def test_large_query_sets_go_by_blocks(spark, monkeypatch):
    items = spark.range(40).select("id", F.array(F.sin("id"), F.cos("id")).alias("vector"))
    asked = items.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    key = lambda df: sorted(map(tuple, df.collect()))
    small = key(retrieval.dense(items, asked, "id", k=3, skip_self=True))
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 7)
    assert key(retrieval.dense(items, asked, "id", k=3, skip_self=True)) == small and len(small) == 120


# Pairs, clusters


def test_pairs_skip_one_note_and_near_duplicates(spark):
    v = [(1, "a", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "b", [1.0, 0.01]), (4, "b", [0.5, 0.5])]
    items = frame(spark, "id int, note string, vector array<double>", *v)
    found = pairs.candidate_pairs(pairs.neighbours(items, "id"), items, "id", "note")
    assert sorted((r.a, r.b) for r in found.collect()) == [(1, 4), (2, 4)]
    assert pairs.contradictions(pairs.mock_judge(found)).count() == 0
    with pytest.raises(ValueError, match="scope"):
        pairs.contradictions(pairs.mock_judge(found), scope="x")


@pytest.mark.parametrize(("n", "k"), [(1, 1), (3, 3), (4, 2), (16, 4), (100, 10)])
def test_default_k(n, k):
    assert clusters.default_k(n) == k


def test_blobs_are_clusters(spark):
    points = frame(spark, "id int, vector array<double>", *((i, [float(i // 4 * 10), i % 4 * 0.1]) for i in range(12)), (99, None))
    found = clusters.clusters(clusters.kmeans(points, k=3), "id").collect()
    assert sorted(tuple(r.members) for r in found) == [(0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11)]
    gaps = clusters.mock_gaps(clusters.clusters(clusters.kmeans(points, k=3), "id", limit=2)).collect()
    assert sorted(r.suggested_note_title for r in gaps) == ["mock-gap-1", "mock-gap-2"]


def test_absent_terms(spark):
    items = frame(spark, "text string", ("Alpha beta",), ("beta",), ("beta gamma",), ("delta",), ("x",), ("y",))
    found = clusters.absent_terms(items, frame(spark, "cluster_id int, term string, confidence double", (1, "alpha", 0.5), (2, "beta", 0.9), (3, "", 1.0), (4, "omega", 0.7))).collect()
    assert [(r.term, r.term_freq) for r in found] == [("omega", 0.0), ("alpha", pytest.approx(1 / 6, abs=1e-6))]


# Claims, answers


def test_drift_of_a_note(spark):
    history = frame(spark, "rel_path string, seq int, content string", ("n.md", 0, "We think the old engine is the best choice for all of us."), ("n.md", 1, "We think the new engine is the best choice for all of us."), ("m.md", 0, "Alone."))
    found = commands.drift_pairs(history, low=0.5).collect()
    assert [(r.rel_path, r.before_claim[9:16]) for r in found] == [("n.md", "the old")]
    assert commands.drift(history).count() == 0


def test_only_selects_notes(spark):
    rows = frame(spark, "source_rel string", ("a/Big.md",), ("b/bigger.md",))
    assert claims.select_notes(rows, "BIG").count() == 2
    assert claims.select_notes(rows, "Big.md", exact=True).count() == 1 and claims.select_notes(rows, "ig.md", exact=True).count() == 0


def test_attribution_of_drafts(spark):
    body = "## What the vault says\n\nOne[^1]\nTwo\nThree[^3]\n[^9]: not a line\n\n## Citations\n\n[^1]: `c1` — \"x\"\n[^2]: bad\n"
    row = answers.attribution(frame(spark, "body string, retrieved array<string>", (body, ["c1"]))).first()
    assert (row.total_sentences, row.cited_sentences, row.orphan_footnotes, row.invalid_refs) == (3, 2, [3], ["bad", "not"])
    outside = answers.attribution(frame(spark, "body string, retrieved array<string>", ("## What the vault says\n\nNothing.\n\n## Citations\n", []))).first()
    assert (outside.total_sentences, outside.attribution_rate) == (0, 1.0)


def test_hints_come_after_hits(spark):
    hits = frame(spark, "query_id int, id string, rank int, score double", (1, "a", 1, 0.9))
    hints = frame(spark, "query_id int, id string, place int", (1, "a", 0), (1, "c", 1), (1, "b", 2), (1, "gone", 3))
    found = answers.evidence(hits, hints, frame(spark, "id string", ("a",), ("b",), ("c",)), "id", k=3).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [("a", 0.9), ("c", 0.0), ("b", 0.0)]


# Metrics


def test_greedy_match(spark):
    scores = frame(spark, "proposal_id string, gold_id string, score int", ("p1", "g1", 5), ("p2", "g1", 5), ("p2", "g2", 4), ("p3", "g2", 5), ("p3", "g3", 3))
    found = metrics.greedy_match(frame(spark, "proposal_id string, place int", ("p1", 1), ("p2", 2), ("p3", 3)), scores).collect()
    assert {(r.proposal_id, r.gold_id) for r in found} == {("p1", "g1"), ("p2", "g2")}


def test_kappa_and_empty_denominators(spark):
    rows = frame(spark, "g int, p int", (1, 1), (2, 2), (3, 1))
    assert metrics.quadratic_kappa(rows, "g", "p").first().kappa == pytest.approx(0.0, abs=0.3)
    assert metrics.quadratic_kappa(frame(spark, "g int, p int", (1, 1), (1, 1)), "g", "p").first().kappa == 1.0
    row = metrics.precision_recall(rows.where("g > 9"), F.col("p") == 1, F.col("g") == 1).first()
    assert (row.precision, row.recall, row.f1) == (1.0, 1.0, 1.0)


def test_gold_matches(spark):
    concept = metrics.concept_matches(frame(spark, "concept_id int, term string, notes array<string>", (1, "slow decay", ["a"]), (2, "other", ["a"])), frame(spark, "id string, canonical_term string, supporting_notes array<string>", ("c", "Decay rate", ["a", "b"])))
    assert [(r.concept_id, r.id) for r in concept.collect()] == [(1, "c")]
    claim = metrics.claim_matches(frame(spark, "note string, claim_id int, start int, stop int, claim string", ("x/n.md", 1, 0, 10, "A b."), ("x/n.md", 2, 50, 60, "Same, words")), frame(spark, "note string, id string, start int, stop int, claim_text string", ("n.md", "g1", 2, 12, "z"), ("n.md", "g2", 90, 99, "same words")))
    assert {(r.claim_id, r.id) for r in claim.collect()} == {(1, "g1"), (2, "g2")}


# Store, sources, commands


def test_upsert_replaces(spark, tmp_path):
    table = store.ChunkTable(spark, str(tmp_path / "db"))
    assert table.count() == 0
    row = lambda i, text: (i, "n.md", "A > B", text, "h", 1, 0, [0.0])
    rows = lambda *r: spark.createDataFrame(list(r), store.SCHEMA)
    assert table.upsert(rows(row("a", "old"), row("b", "x"))) == 2
    table.upsert(rows(row("a", "new")))
    assert {(r.chunk_id, r.text) for r in table.read().collect()} == {("a", "new"), ("b", "x")}
    assert store.split_headings(table.read()).first().heading_path == ["A", "B"]
    with pytest.raises(ValueError, match="chunk id"):
        table.upsert(rows(row("a'; --", "x")))
    table.reset()
    assert store.ChunkTable(spark, str(tmp_path / "db")).count() == 0


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "my vault"
    for name, text in {"a.md": "---\ntitle: A\n---\n# A\nThe planets move in orbits. Maybe they slow down a little.\n\n[[b]]\n", "sub dir/b.md": "# B\nBread is baked from flour and water.\n\n[[a]] [[gone]]", "c.txt": "no note"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_vault_is_listed_and_filtered(spark, folder):
    assert sorted(r.source_rel for r in vault.read_vault(spark, folder).collect()) == ["a.md", "sub dir/b.md"]
    assert [r.source_rel for r in vault.read_vault(spark, folder, exclude=("sub*/**",)).collect()] == ["a.md"]
    with pytest.raises(FileNotFoundError):
        vault.read_vault(spark, folder + "/none")
    with pytest.raises(NotADirectoryError):
        vault.read_vault(spark, folder + "/a.md")


def test_commands_end_to_end(spark, folder, tmp_path):
    table = store.ChunkTable(spark, str(tmp_path / "db"))
    report = commands.ingest(spark, folder, table).first()
    assert (report.files, report.with_frontmatter, report.chunks) == (2, 1, 2)
    assert commands.query(spark, table, "baked bread").first().source_rel == "sub dir/b.md"
    assert {(r.defect, r.target) for r in commands.audit(spark, folder).collect()} == {("broken", "gone")}
    assert [r.claim for r in commands.confidence(spark, folder).collect()] == ["Maybe they slow down a little."]
    gaps = tmp_path / "gaps.json"
    gaps.write_text('{"schema_version": 1, "findings": [{"gap_question": "bread?", "suggested_note_title": "t-x", "rationale": "", "cluster_id": 0, "cluster_size": 2, "supporting_chunk_ids": []}]}')
    row = commands.answer(spark, table, str(gaps), min_supporting=1).first()
    assert row.evidence_strength == "strong" and row.cited_sentences == 1
    gaps.write_text('{"schema_version": 2}')
    with pytest.raises(ValueError, match="version"):
        vault.read_gaps(spark, str(gaps))


def test_stream_replaces_changed_notes(spark, folder, tmp_path):
    table = store.ChunkTable(spark, str(tmp_path / "db"))
    for text in ("first text of the note", "second text of the note"):
        with open(folder + "/new.md", "w") as f:
            f.write(text)
        import os

        os.utime(folder + "/new.md", (1, 2_000_000_000 + len(text)))
        reingest.start(spark, folder, table, str(tmp_path / f"check{len(text)}")).awaitTermination(120)
        rows = {r.source_rel: r.text for r in table.read().collect()}
        assert rows["new.md"] == text and len(rows) == 3


def test_git_history_follows_renames(spark, tmp_path):
    import subprocess

    from quillspark.sources import git

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in (("old.md", "first version of a longer text\n"), ("old.md", "second version of a longer text\n")):
        (tmp_path / name).write_text(text)
        run("add", "-A")
        run("commit", "-qm", "x")
    run("mv", "old.md", "new.md")
    run("commit", "-qm", "move")
    rows = git.read_history(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.rel_path, r.content[:6]) for r in rows] == [("new.md", "first "), ("new.md", "second"), ("new.md", "second")]
    with pytest.raises(git.GitError):
        git.content_at(str(tmp_path), "HEAD", "new.md")
    with pytest.raises(git.GitError):
        git.safe_path("../x")
