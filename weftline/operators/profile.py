"""Profiles of weight tensors: moments, distinct bit patterns, histograms, scopes, storage costs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import numeric as N


def tensor_profile(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Count, non-finite and zero counts, extremes, mean and population deviation of the finite values; one aggregation."""
    v = F.when(N.finite("value"), F.col("value").cast("double"))
    mean = F.sum(v) / F.count(v)
    std = F.sqrt(F.greatest(F.lit(0.0), F.sum(v * v) / F.count(v) - mean * mean))
    return weights.groupBy(*keys).agg(
        F.count("*").alias("numel"), F.count(v).alias("finite"), F.count_if(~N.finite("value")).alias("nonfinite"), F.count_if(v == 0).alias("zeros"),
        F.min(v).alias("min"), F.max(v).alias("max"), mean.alias("mean"), std.alias("std"), (F.count_if(v == 0) / F.count("*")).alias("zero_fraction"))


def merged_moments(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Population mean and deviation of groups of tensors from the tensors' own."""
    n, m, s = (F.col(c) for c in ("finite", "mean", "std"))
    mean = F.sum(n * m) / F.sum(n)
    return profile.groupBy(*keys).agg(F.sum(n).alias("n"), mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum(n * (s * s + m * m)) / F.sum(n) - mean * mean)).alias("std"))


def bit_patterns(weights: DataFrame, dtype: str = "f32") -> DataFrame:
    """Adds ``bits``: the raw bits of the value as float32, or the upper half of its bfloat16 rounding, or float16.

    There is no built-in for it, so batches are viewed as integers in Arrow.
    """
    if dtype not in ("f32", "bf16", "f16"):
        raise ValueError(dtype)
    at = weights.columns.index("value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).to_numpy(zero_copy_only=False).astype(np.float32)
            if dtype == "f16":
                bits = x.astype(np.float16).view(np.uint16).astype(np.int64)
            else:
                bits = x.view(np.uint32).astype(np.int64)
                if dtype == "bf16":
                    bits = (bits + 0x7FFF + (bits >> 16 & 1)) >> 16
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits)], [*batch.schema.names, "bits"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in weights.schema.fields)
    return weights.mapInArrow(run, f"{kind}, bits long")


def capped_distinct(values: Column, cap: int) -> Column:
    """Exact distinct count, null beyond the cap."""
    n = F.count_distinct(values)
    return F.when(n <= cap, n)


def histogram(codes: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    return codes.groupBy(*keys, code).agg(F.count("*").alias("n"))


def entropy(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Shannon entropy of symbol counts, symbols used, bits at fixed width, and the possible saving."""
    total = hist.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"), F.count("*").cast("int").alias("used"))
    h = F.greatest(F.lit(0.0), F.log2(F.col("total").cast("double")) - F.col("s") / F.col("total"))
    bits = N.index_bits(F.col("used"))
    return total.select(*keys, "total", "used", h.alias("entropy"), bits.alias("fixed_bits"), F.when(bits > 0, (1 - h / bits) * 100).otherwise(0.0).alias("saving_percent"))


def runs(codes: DataFrame, keys: list[str], order: str, code: str = "code") -> DataFrame:
    """Runs of equal symbols: count, longest, average, and the share of places where the symbol changes."""
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = codes.withColumn("change", F.coalesce((F.col(code) != F.lag(code).over(w)).cast("int"), F.lit(1)))
    islands = flagged.withColumn("run", F.sum("change").over(w)).groupBy(*keys, "run").agg(F.count("*").alias("n"))
    n = F.sum("n")
    return islands.groupBy(*keys).agg(
        F.count("*").alias("runs"), F.max("n").alias("longest"), (n / F.count("*")).alias("average"), F.when(n > 1, (F.count("*") - 1) / (n - 1)).otherwise(0.0).alias("transition_rate"))


def scoped(weights: DataFrame, name: Column) -> DataFrame:
    """Each row once for each scope (global, layer, tensor) with its ``scope_key``."""
    scope = F.explode(F.array(F.lit("global"), F.lit("layer"), F.lit("tensor"))).alias("scope")
    both = weights.select("*", name.alias("name"), scope)
    return both.withColumn("scope_key", N.scope_key(F.col("name"), F.col("scope")))


def storage_cost(groups: DataFrame) -> DataFrame:
    """Index and codebook bytes of (n, k) with half-precision centres, against two bytes a weight."""
    bits = N.index_bits(F.col("k"))
    index = F.floor((F.col("n") * bits + 7) / 8)
    book = F.col("k").cast("long") * 2
    total = index + book
    return groups.select(*groups.columns, bits.alias("bits"), index.alias("index_bytes"), book.alias("codebook_bytes"), F.round(F.col("n") * 2 / total, 6).alias("ratio"), F.round((1 - total / (F.col("n") * 2)) * 100, 6).alias("saving_percent"))
