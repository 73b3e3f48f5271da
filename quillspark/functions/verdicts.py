"""Prompts for models and what comes back: JSON that must be whole, asked for again where it is not.

A model is a function from a column of prompts to a column of answers, null for null. Nothing here needs one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as t

#: The fields of each kind of verdict with their types; bounds of numbers, and whether the JSON may be fenced.
KINDS: dict[str, dict] = {
    "contradiction": {"fields": {"verdict": "boolean", "type": "string", "score": "double", "reasoning": "string"}},
    "drift": {"fields": {"drift": "boolean", "type": "string", "score": "int", "reasoning": "string"}},
    "concept": {"fields": {"term": "string", "confidence": "double", "rationale": "string"}, "bounds": {"confidence": (0.0, 1.0)}, "fenced": True},
    "confidence": {"fields": {"level": "int", "rationale": "string", "confidence": "double"}, "bounds": {"level": (1, 5), "confidence": (0.0, 1.0)}, "fenced": True},
    "match": {"fields": {"score": "int", "reasoning": "string"}, "bounds": {"score": (1, 5)}, "fenced": True},
}
#: What stands for a verdict that could not be had.
NEUTRAL: dict[str, dict] = {
    "contradiction": {"verdict": False, "type": "none", "score": 0.0, "reasoning": "abstained"},
    "drift": {"drift": False, "type": "none", "score": 0, "reasoning": "abstained"},
    "concept": {"term": "", "confidence": 0.0, "rationale": "abstained"},
    "confidence": {"level": 3, "rationale": "abstained", "confidence": 0.0},
    "match": {"score": 1, "reasoning": "abstained"},
}


def parsed(answer: Column, kind: str) -> Column:
    """A verdict as a struct; null if the answer is null or no JSON object, lacks a field, has one of another type, or a number out of its bounds."""
    how = KINDS[kind]
    value = F.try_parse_json(t.strip_json_fence(answer) if how.get("fenced") else answer)
    fields = {n: F.try_variant_get(value, f"$.{n}", of) for n, of in how["fields"].items()}
    whole = F.schema_of_variant(value).startswith("OBJECT")
    for name, x in fields.items():
        whole = whole & x.isNotNull()
        if name in how.get("bounds", {}):
            whole = whole & x.between(*how["bounds"][name])
    return F.when(whole, F.struct(*(x.alias(n) for n, x in fields.items())))


def neutral(kind: str) -> Column:
    """[V23] The verdict that an abstention counts as."""
    return F.struct(*(F.lit(NEUTRAL[kind][n]).cast(of).alias(n) for n, of in KINDS[kind]["fields"].items()))


def prompt(template: str, fields: Mapping[str, Column]) -> Column:
    """A template with each {name} replaced by a field, escaped for XML (null: empty); other braces stay. Fields are never read as templates."""
    parts = re.split(r"\{(" + "|".join(map(re.escape, fields)) + r")\}", template) if fields else [template]
    return F.concat(*(t.escape_xml(F.coalesce(fields[x].cast("string"), F.lit(""))) if i % 2 else F.lit(x) for i, x in enumerate(parts)))


def asked(rows: DataFrame, prompts: list[Column], model: Callable[[Column], Column], kind: str, out: str = "verdict") -> DataFrame:
    """[V23] rows with a verdict and `abstained`: the first answer that parses, of one prompt after another (stricter ones later); else the neutral verdict. Later
    prompts are null, so that the model is not called, once there is a verdict. Each step is a column of its own, so no expression holds another one twice."""
    answer, found = "_quill_answer", "_quill_verdict"
    rows = rows.withColumn(answer, model(prompts[0])).withColumn(found, parsed(F.col(answer), kind))
    for more in prompts[1:]:
        rows = rows.withColumn(answer, model(F.when(F.col(found).isNull(), more)))
        rows = rows.withColumn(answer, parsed(F.col(answer), kind)).withColumn(found, F.coalesce(found, answer))
    return rows.withColumn(out, F.coalesce(found, neutral(kind))).withColumn("abstained", F.col(found).isNull()).drop(answer, found)
