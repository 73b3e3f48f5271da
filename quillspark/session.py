"""Sessions: workers find this package, and what an interactive session should be set to."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package when the driver found it through its own sys.path only."""
    env = spark.sparkContext.environment
    paths = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def session(name: str = "quillspark", **conf: str) -> SparkSession:
    """A session with adaptive execution; the cluster's own settings hold where conf names none."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return prepare(builder.getOrCreate())
