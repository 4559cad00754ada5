"""Registry of the engine's queries and of their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import codebooks, codecs, deviation, joins, profile, streams
from weftline.plans.registry import Query

REGISTRIES = [deviation.R, profile.R, codebooks.R, joins.R, codecs.R, streams.R]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deviation.agg_error_metrics(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: q for r in REGISTRIES for name, q in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for r in REGISTRIES for name, q in r.sql.items()}
