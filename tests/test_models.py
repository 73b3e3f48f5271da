"""Prompts, verdicts, stubs, sections, and models in the places of the defaults."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import verdicts
from quillspark.operators import notes, reports, retrieval, stubs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("kind, answer, due", [
    ("contradiction", '{"verdict": true, "type": "factual", "score": 0.8, "reasoning": "r", "more": 1}', (True, "factual", 0.8, "r")),
    ("contradiction", '{"verdict": true, "type": "factual", "score": 0.8}', None), ("contradiction", "no json", None), ("contradiction", None, None), ("contradiction", "[1]", None), ("contradiction", '{"verdict": true} x', None),
    ("drift", '{"drift": false, "type": "none", "score": 1, "reasoning": ""}', (False, "none", 1, "")), ("drift", '```json\n{"drift": false, "type": "none", "score": 1, "reasoning": ""}\n```', None),
    ("confidence", '```json\n{"level": 5, "rationale": "r", "confidence": 1}\n```', (5, "r", 1.0)), ("confidence", '{"level": 6, "rationale": "r", "confidence": 1}', None), ("confidence", '{"level": 1, "rationale": "r", "confidence": -0.1}', None),
])
def test_verdicts(spark, kind, answer, due):
    found = one(spark, verdicts.parsed(F.lit(answer).cast("string"), kind))
    assert (None if found is None else tuple(found)) == due


def test_prompts_and_retries(spark):
    made = one(spark, verdicts.prompt('<a>{text}</a> {"json": {n}} {other}', {"text": F.lit("1 < 2 {n}"), "n": F.lit(None)}))
    assert made == '<a>1 &lt; 2 {n}</a> {"json": } {other}'
    good = json.dumps({"level": 2, "rationale": "ok", "confidence": 0.5})
    model = lambda p: F.when(p == "strict", F.lit(good)).when(p.isNotNull(), F.lit("hm"))
    rows = spark.range(1)
    for prompts, due in ((["a", "strict"], (2, "ok", 0.5)), (["a", "b", "c"], (3, "abstained", 0.0))):
        found = verdicts.asked(rows, [F.lit(p) for p in prompts], model, "confidence").first()
        assert tuple(found.verdict) == due and found.abstained == (due[1] == "abstained")


def test_stub_files(spark, tmp_path):
    df = spark.createDataFrame([("b-note", "two\n"), ("A note", "one")], "suggested_note_title string, body string")
    assert [(p.name, p.read_text()) for p in stubs.write_stubs(df, tmp_path / "out")] == [("a-note.md", "one"), ("b-note.md", "two\n")]
    with pytest.raises(FileExistsError):
        stubs.write_stubs(df.unionByName(spark.createDataFrame([("new", "x")], df.schema)), tmp_path / "out")
    assert not (tmp_path / "out" / "new.md").exists()
    for bad in ("../x", "", ".."):
        with pytest.raises(ValueError, match="unsafe"):
            stubs.write_stubs(spark.createDataFrame([(bad, "x")], df.schema), tmp_path / "out")
    os.symlink(tmp_path / "elsewhere.md", tmp_path / "out" / "link.md")
    with pytest.raises(ValueError, match="unsafe"):
        stubs.write_stubs(spark.createDataFrame([("link", "x")], df.schema), tmp_path / "out")
    assert reports.answer_markdown(df, "suggested_note_title").first().report == "one\n\n---\n\ntwo"
    assert json.loads(reports.answer_json(df.withColumn("rate", F.lit(1 / 3)), "suggested_note_title").first().report)["findings"][0]["rate"] == 0.3333


def test_sections_are_appended(tmp_path):
    at = datetime(2024, 5, 6, 7, 8, 9)
    for title in ("first", "second"):
        stubs.append_section(tmp_path / "B.md", title, ["- a", "- b"], at)
    assert (tmp_path / "B.md").read_text() == "\n## 2024-05-06 07:08:09 — first\n\n- a\n- b\n\n## 2024-05-06 07:08:09 — second\n\n- a\n- b\n"


def test_models_take_the_places_of_defaults(spark):
    items = spark.createDataFrame([(1, "x"), (2, "yy")], "id long, text string")
    asked = spark.createDataFrame([(0, "zz")], "query_id long, query string")
    embed = lambda df, text, out: df.withColumn(out, F.array(F.length(text).cast("double")))
    found = retrieval.search(items, asked, "id", mode="dense", k=1, embed=embed, prefix="p: ").first()
    assert (found.id, found.score) == (2, 10.0)
    long = " ".join(f"Sentence number {i} here." for i in range(40))
    assert len(notes.pack(long, 50, 5, 0.1, count_tokens=len)) > len(notes.pack(long, 50, 5, 0.1))
