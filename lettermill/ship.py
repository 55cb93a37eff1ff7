"""Makes this package importable in Python workers whose driver found it on its own path."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def to_workers(spark: SparkSession) -> None:
    """Puts the package's folder on the workers' path. On a cluster install the package or give it as --py-files; a folder that is not there does no harm."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
