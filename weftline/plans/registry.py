"""A query is a function (spark, sf_dir) -> DataFrame, registered under its name with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def fp16(x: str) -> str:
    """SQL of half-precision rounding."""
    unit = f"pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -14) - 10)"
    return f"CAST(CASE WHEN {x} = 0 THEN 0 WHEN abs({x}) >= 65520 THEN sign({x}) * CAST('inf' AS DOUBLE) ELSE round_even({x} / {unit}, 0) * {unit} END AS FLOAT)"


def bf16(x: str) -> str:
    unit = f"pow(2.0, greatest(floor(log2(abs(CAST({x} AS DOUBLE)))), -126) - 7)"
    return f"CAST(CASE WHEN {x} = 0 THEN 0 ELSE round_even({x} / {unit}, 0) * {unit} END AS FLOAT)"


#: the embeddings table as single weights
W = "w AS (SELECT vec_id AS tensor, label, CAST(i AS BIGINT) AS flat_index, embedding[i + 1] AS value FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings))"

#: the 4-bit block errors of single weights
Q4 = f"""{W}, bm AS (
  SELECT tensor, flat_index // 32 AS block, CAST(arg_max(value, {{'a': abs(value), 'p': -flat_index}}) / CAST(-8 AS FLOAT) AS FLOAT) AS d FROM w GROUP BY ALL
), bs AS (SELECT *, CASE WHEN d = 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST(1 AS FLOAT) / d AS FLOAT) END AS inv, {fp16("d")} AS stored FROM bm
), qc AS (
  SELECT w.tensor, label, flat_index, block, flat_index % 32 AS pos, value AS original, d, stored, abs(stored) AS step,
         CAST(least(15, greatest(0, floor(CAST(value * inv AS FLOAT) + CAST(8.5 AS FLOAT)))) AS INTEGER) AS code
  FROM w JOIN bs ON w.tensor = bs.tensor AND w.flat_index // 32 = bs.block
), q4 AS (
  SELECT *, CAST(CAST(code - 8 AS FLOAT) * stored AS FLOAT) AS rebuilt, CAST(CAST(CAST(code - 8 AS FLOAT) * stored AS FLOAT) - original AS FLOAT) AS error FROM qc
), e AS (SELECT *, abs(error) AS abs_error FROM q4)"""


def metrics_sql(source: str, keys: str, x: str, y: str, when_zero: str = "1.0") -> str:
    """SQL of the error metrics of ``source`` by ``keys``; ``when_zero`` is the cosine of a zero vector."""
    k = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {k}n, round(sqrt(se / n), 6) AS rmse, round(ae / n, 6) AS mae, round(me, 6) AS max_abs_error, round(std, 6) AS weight_std,
  round(CASE WHEN std > 0 THEN sqrt(se / n) / std ELSE 0 END, 6) AS rmse_over_std,
  round(CASE WHEN xx = 0 OR yy = 0 THEN {when_zero} ELSE xy / sqrt(xx * yy) END, 6) AS cosine,
  round(CASE WHEN xx > 0 THEN sqrt(se) / sqrt(xx) ELSE 0 END, 6) AS relative_l2
FROM (SELECT *, sqrt(greatest(0.0, xx / n - pow(sx / n, 2))) AS std FROM (
  SELECT {k}count(*) AS n, sum((x - y) * (x - y)) AS se, sum(abs(x - y)) AS ae, max(abs(x - y)) AS me, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy, sum(x) AS sx
  FROM (SELECT *, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source}) {group}))"""
