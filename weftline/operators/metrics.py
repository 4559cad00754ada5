"""Reconstruction-error metrics as one mergeable aggregate.

Conventions differ on the cosine of a zero vector, so it is a parameter: ``when_zero`` is "one", "null",
"zero", "both" (1 if both norms are zero, else 0) or "equal" (1 if the sides are equal, else 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONVENTIONS = ("one", "null", "zero", "both", "equal")


def sums(original: Column, rebuilt: Column) -> dict[str, Column]:
    """The partial sums that all metrics derive from."""
    x, y = original.cast("double"), rebuilt.cast("double")
    e = x - y
    return {"n": F.count(e), "se": F.sum(e * e), "ae": F.sum(F.abs(e)), "me": F.max(F.abs(e)), "xx": F.sum(x * x), "yy": F.sum(y * y), "xy": F.sum(x * y), "sx": F.sum(x)}


def finish(df: DataFrame, keys: Sequence[str], when_zero: str = "one", digits: int | None = 6) -> DataFrame:
    """Metrics from a frame of partial sums."""
    if when_zero not in CONVENTIONS:
        raise ValueError(f"when_zero is one of {CONVENTIONS}")
    c = F.col
    none = (c("xx") == 0) | (c("yy") == 0)
    fallback = {
        "one": F.lit(1.0), "null": F.lit(None).cast("double"), "zero": F.lit(0.0),
        "both": F.when((c("xx") == 0) & (c("yy") == 0), 1.0).otherwise(0.0), "equal": F.when(c("se") == 0, 1.0).otherwise(0.0),
    }[when_zero]
    std = F.sqrt(F.greatest(F.lit(0.0), c("xx") / c("n") - F.pow(c("sx") / c("n"), 2)))
    rmse = F.sqrt(c("se") / c("n"))
    found = {
        "rmse": rmse, "mae": c("ae") / c("n"), "max_abs_error": c("me"), "weight_std": std,
        "rmse_over_std": F.when(std > 0, rmse / std).otherwise(0.0),
        "cosine": F.when(none, fallback).otherwise(c("xy") / F.sqrt(c("xx") * c("yy"))),
        "relative_l2": F.when(c("xx") > 0, F.sqrt(c("se")) / F.sqrt(c("xx"))).otherwise(0.0),
    }
    return df.select(*keys, c("n"), *((v if digits is None else F.round(v, digits)).alias(k) for k, v in found.items()))


def error_metrics(df: DataFrame, keys: Sequence[str], original: str, rebuilt: str, when_zero: str = "one", digits: int | None = 6) -> DataFrame:
    """One row of metrics for each key: a single partial and final aggregation."""
    parts = [v.alias(k) for k, v in sums(F.col(original), F.col(rebuilt)).items()]
    return finish(df.groupBy(*keys).agg(*parts), keys, when_zero, digits)


def threshold_counts(error: Column, thresholds: Sequence[float]) -> list[Column]:
    """Counts of errors strictly above each threshold."""
    return [F.count_if(F.abs(error) > t).alias("over_" + f"{t:g}".replace(".", "p")) for t in thresholds]
