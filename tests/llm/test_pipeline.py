"""The corpus pipeline, stage by stage on small tables, and the subpackage's place in the library."""

import random
import re
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
import base64

import corpus_pipeline
from quillspark.llm import queries

from .test_documents import WORDS, brute_classes, copies, text_of

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    rows = [(i, text_of(rng, rng.randint(30, 90)).capitalize() + ".", "en", f"s{i % 3 if i % 2 else 0}") for i in range(120)]
    rows += [(200 + i, copies(rng, rows[i][1], 1), "en", "s1") for i in range(10)]
    rows += [(300 + i, " | ".join(rng.choice(WORDS) for _ in range(40)), "en", "s2") for i in range(40)]
    rows += [(400, None, "en", None), (401, "123 456 !!", "en", "s1"), (402, "", None, "s1"), (0, rows[0][1], "en", "s0"), (None, rows[1][1], "en", "s0")]
    top = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars", "'x' AS score", "1 AS position").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in [*range(0, 120, 2), *range(300, 340, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = (before.collect(), docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
    before, after = seen["language"]
    assert sorted((str(r.doc_id) for r in before if not re.search("[a-z]", r.text or ""))) == sorted(set(str(r.doc_id) for r in before) - set(str(r.doc_id) for r in after) | {"400", "401", "402"})
    before, after = seen["quality"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == set(range(300, 340))
    before, after = seen["near_duplicates"]
    classes = brute_classes([(r.doc_id, r.text) for r in before])
    assert len(after) == len({c for _, c in classes})
    before, after = seen["mixing"]
    assert {r.text for r in before} == {r.text for r in after} and len(after) % 16 == 0
    their = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.BYTE_RANKS), "rb"))}, special_tokens={})
    before, after = seen["encoding"]
    assert sorted(len(their.encode_ordinary(r.text)) for r in before) == sorted(r.n_tokens for r in after) and all(r.round_trip for r in after)
    assert corpus_pipeline.run(spark, folder).count() == len(after)


def test_empty_tables_pass_through(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0


def test_nothing_else_imports_the_subpackage():
    for file in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in file.parts:
            assert not re.search(r"import.*\bllm\b|from .*\bllm\b", file.read_text())


def test_every_operator_has_a_query():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()} == set(range(1, 11))
