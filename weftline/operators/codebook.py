"""Scalar codebooks: seeds, Lloyd iterations, assignment, evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import numeric as N


def counted(weights: DataFrame, keys: list[str], value: str = "value", weight: Column | None = None) -> DataFrame:
    """Distinct finite values with their weights: what every later step reads."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    return weights.where(N.finite(value) & (w > 0)).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.sum(w).alias("w"))


def rank_seeds(values: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Rows (keys, centres): seeds at evenly spaced ranks of the distinct values."""
    order, every = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    ranked = values.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(every))
    hits = F.exists(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.rint(j * (F.col("n") - 1) / float(max(1, k - 1))) == F.col("i"))
    return ranked.where(hits).groupBy(*keys).agg(F.array_sort(F.collect_set("v")).alias("centres"))


def lloyd_step(values: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """One Lloyd iteration: codebooks joined to the counted values, weighted means by code; empty clusters go.

    What is shuffled is a partial sum for each key and code, not values.
    """
    bounded = centres.withColumn("bounds", N.midpoints(F.col("centres")))
    coded = values.join(bounded, keys).withColumn("code", N.nearest_code(F.col("v"), F.col("bounds")))
    means = coded.groupBy(*keys, "code").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("c"))
    return means.groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("centres"))


def assign(weights: DataFrame, centres: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds ``code`` (a value on a midpoint goes up) and ``centre``."""
    bounded = centres.withColumn("bounds", N.midpoints(F.col("centres")))
    coded = weights.join(bounded, keys).withColumn("code", N.nearest_code(F.col(value).cast("double"), F.col("bounds")))
    return coded.withColumn("centre", F.element_at("centres", F.col("code") + 1)).drop("bounds", "centres")


def cast_codebook(centres: Column, dtype: str) -> Column:
    """Centres rounded to "fp16" or "bf16", merged ones once."""
    rounded = {"fp16": N.fp16, "bf16": N.bf16}[dtype]
    return F.array_sort(F.array_distinct(F.transform(centres, lambda c: rounded(c).cast("double"))))


def weighted_kmeans(v: np.ndarray, w: np.ndarray, k: int, rounds: int = 30) -> np.ndarray:
    """Centres of a weighted 1-D k-means over sorted distinct values.

    Two seedings are tried and the one of lower error wins: weighted quantiles, filled up where the error is
    largest, and evenly spaced ranks.
    """
    k = max(1, min(k, len(v)))
    if k == 1:
        return np.array([np.average(v, weights=w)], np.float32)
    upto = np.cumsum(w)
    wanted = (np.arange(k) + 0.5) * upto[-1] / k
    seeds = np.unique(v[np.minimum(np.searchsorted(upto, wanted), len(v) - 1)])

    def code(c: np.ndarray) -> np.ndarray:
        return np.searchsorted((c[:-1] + c[1:]) / 2, v, side="right")

    while len(seeds) < k:
        error = w * (v - seeds[code(seeds)]) ** 2
        error[np.isin(v, seeds)] = -np.inf
        worst = int(np.argmax(error))
        if error[worst] == -np.inf:
            break
        seeds = np.sort(np.append(seeds, v[worst]))

    def settle(c: np.ndarray) -> tuple[float, np.ndarray]:
        for _ in range(rounds):
            at = code(c)
            mass, total = np.bincount(at, w, len(c)), np.bincount(at, w * v, len(c))
            new = total[mass > 0] / mass[mass > 0]
            done = len(new) == len(c) and np.allclose(new, c, rtol=1e-7, atol=1e-12)
            c = new
            if done:
                break
        return float(np.average((v - c[code(c)]) ** 2, weights=w)), c

    tries = [settle(seeds), settle(np.unique(v[np.rint(np.linspace(0, len(v) - 1, k)).astype(int)]))]
    return min(tries, key=lambda t: t[0])[1].astype(np.float32)


def fit_kmeans(values: DataFrame, key: str, k: int) -> DataFrame:
    """Rows (key, centres): k-means to convergence for each key, over its counted values in one task.

    The values of a key are its distinct ones (at most 65,536 for 16-bit weights); for more, iterate
    ``lloyd_step``, which never gathers a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books = []
            for at in batch.column(1).to_pylist():
                books.append(weighted_kmeans(np.array([x["v"] for x in at]), np.array([x["w"] for x in at]), k).astype(float).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(books, pa.list_(pa.float64()))], [key, "centres"])

    grouped = values.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("v", "w"))).alias("at"))
    return grouped.mapInArrow(run, f"{key} {dict(values.dtypes)[key]}, centres array<double>")


def rowwise_step(rows: DataFrame) -> DataFrame:
    """One Lloyd step for the codebook of each row (vec, centres) within the row; an empty cluster keeps its centre."""
    bounded = rows.withColumn("bounds", N.midpoints(F.col("centres")))
    coded = bounded.withColumn("codes", F.transform("vec", lambda v: N.nearest_code(v.cast("double"), F.col("bounds"))))

    def centre(old: Column, j: Column) -> Column:
        pairs = F.filter(F.arrays_zip("codes", "vec"), lambda p: p["codes"] == j)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["vec"].cast("double"))
        return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(old)

    return coded.withColumn("centres", F.array_sort(F.transform("centres", centre))).drop("bounds", "codes")


def rowwise_seeds(rows: DataFrame, k: int) -> DataFrame:
    """Seeds of each row at the middle ranks of k equal parts."""
    ordered = F.array_sort("vec")
    return rows.withColumn("centres", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.element_at(ordered, (F.floor((j + 0.5) * F.size("vec") / k) + 1).cast("int")).cast("double")))
