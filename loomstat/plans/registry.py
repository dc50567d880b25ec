"""All registered queries of the library, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_aggregate, q_gates, q_joins, q_predicates, q_rows, q_scores, q_sinks, q_spatial, q_streams, q_text, q_vectors, q_votes, q_windows  # noqa: F401  they register themselves
from .base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attention by region, from groups that pass the release gate."""
    return QUERIES["gated_attention"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
