"""All registered queries (importing the modules fills the registry)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_corpus, q_ingest, q_metrics, q_narratives, q_periods, q_propagation, q_reports, q_rules, q_segments  # noqa: F401  (registration side effects)
from .registry import REGISTRY, Query  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY["hourly_peaks"].build(spark, sf_dir)
