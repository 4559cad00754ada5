"""The engine's jobs: each reads tensors, runs operators and writes report tables below an output folder.

``python -m weftline.commands JOB --input PATH --output PATH [options]``; the input is a Safetensors file or folder, or a Parquet
table (named .parquet) of (tensor, label, vec).  Reports are Parquet (or CSV/JSON with ``--format``).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.operators import blockquant, codebook, codec, corrections, metrics, pairs, predictive, profile, spectral
from weftline.sources import safetensors
from weftline.sources.tables import blocks, weights

Reports = dict[str, DataFrame]


def numbers(text: str) -> list[float]:
    """A comma-separated list as sorted distinct positive numbers."""
    found = sorted({float(x) for x in text.split(",") if x.strip()})
    if not found or found[0] <= 0:
        raise ValueError(f"a list of positive numbers, not {text!r}")
    return found


def tensors(spark: SparkSession, path: str, row: int) -> DataFrame:
    """Rows (tensor, label, vec, name, dtype): pieces of ``row`` values of the tensors at a path.

    The number of a piece is a hash of its tensor's name and offset; ``label`` is the layer number, -1 without.
    """
    if not path.rstrip("/").endswith(".parquet"):
        found = safetensors.read(spark, path, row)
        layer = F.regexp_extract("tensor", r"(?i)(?:^|\.)(?:layers|blocks|h|layer|block)\.(\d+)(?:\.|$)", 1)
        return found.select(
            F.xxhash64("tensor", "flat_offset").alias("tensor"), F.coalesce(F.nullif(layer, F.lit("")).cast("int"), F.lit(-1)).alias("label"),
            F.transform("values", lambda x: x.cast("float")).alias("vec"), F.col("tensor").alias("name"), "dtype")
    rows = spark.read.parquet(path)
    names = {"vec_id": "tensor", "embedding": "vec"}
    rows = rows.withColumnsRenamed({a: b for a, b in names.items() if a in rows.columns})
    return rows.select("tensor", "label", "vec", F.concat(F.lit("layers."), F.col("label").cast("string"), F.lit(".t"), F.col("tensor").cast("string")).alias("name"), F.lit("F32").alias("dtype"))


def analyze(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """Tensor profiles, merged moments, and codebook error and cost for each scope and size."""
    named = rows.select("name", F.explode("vec").alias("value"))
    stats = profile.tensor_profile(named, ["name"])
    scoped = profile.scoped(named.withColumnRenamed("name", "n"), F.col("n")).select("scope", "scope_key", "value")
    values = codebook.counted(scoped, ["scope", "scope_key"])
    groups = None
    for k in (int(k) for k in numbers(a.groups)):
        keys = ["scope", "scope_key"]
        centres = codebook.rank_seeds(values, keys, k)
        for _ in range(a.steps):
            centres = codebook.lloyd_step(values, centres, keys)
        coded = codebook.assign(values, centres, keys, "v")
        e = F.col("v") - F.col("centre")
        found = coded.groupBy(*keys).agg(F.sum("w").cast("long").alias("n"), F.count_distinct("code").cast("int").alias("k"), F.sqrt(F.sum(e * e * F.col("w")) / F.sum("w")).alias("rmse"), F.max(F.abs(e)).alias("max_abs_error"))
        found = profile.storage_cost(found).withColumn("groups", F.lit(k))
        groups = found if groups is None else groups.unionByName(found)
    return {"tensor_stats": stats, "global_moments": profile.merged_moments(stats, []), "group_analysis": groups}


def compress_tensor(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """One codebook over all rows: index map, symbol statistics, error metrics."""
    w = weights(rows).withColumn("all", F.lit(0))
    values = codebook.counted(w, ["all"])
    centres = codebook.rank_seeds(values, ["all"], a.k)
    for _ in range(a.steps):
        centres = codebook.lloyd_step(values, centres, ["all"])
    coded = codebook.assign(w, centres, ["all"])
    return {
        "codebook": centres.select(F.posexplode("centres").alias("idx", "centre")), "index_map": coded.select("tensor", "flat_index", "code"),
        "symbols": profile.entropy(profile.histogram(coded, ["all"]), ["all"]), "metrics": metrics.error_metrics(coded, [], "value", "centre", "one", None),
    }


def formula(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """Uniform, logarithmic and polynomial quantisers side by side."""
    w = weights(rows)
    v = F.col("value").cast("double")
    span = w.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.percentile_approx(F.abs(v), 0.5, 10000).alias("m"), F.max(F.abs(v)).alias("top")).first()
    scale = max(span["m"] or 0.0, 1e-30)
    zmax = F.log1p(F.lit(span["top"] / scale))
    q = w.withColumn("uniform", N.uniform_value(N.uniform_code(v, F.lit(span["lo"]), F.lit(span["hi"]), a.levels), F.lit(span["lo"]), F.lit(span["hi"]), a.levels))
    q = q.withColumn("log", N.log_value(N.log_code(v, F.lit(scale), zmax, a.levels), F.lit(scale), zmax, a.levels))
    poly = spectral.polynomial_blocks(blocks(rows, 16), 16, 2).select(F.explode(F.arrays_zip("x", "y")).alias("z")).select("z.*")
    found = [metrics.error_metrics(q, [], "value", c, "both", None).withColumn("method", F.lit(c)) for c in ("uniform", "log")]
    found.append(metrics.error_metrics(poly, [], "x", "y", "both", None).withColumn("method", F.lit("polynomial")))
    return {"methods": found[0].unionByName(found[1]).unionByName(found[2])}


def low_rank(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """Balanced factors of the matrix of rows of equal length."""
    dims = rows.select(F.max(F.size("vec"))).first()[0]
    full = rows.where(F.size("vec") == dims)
    left, s, right = spectral.low_rank(full, dims, min(a.rank, dims))
    z = spectral.low_rank_values(left, right).select(F.explode(F.arrays_zip("vec", "y")).alias("z")).select(F.col("z.vec").alias("x"), "z.y")
    values = rows.sparkSession.createDataFrame([(i, float(x)) for i, x in enumerate(s)], "k int, singular_value double")
    return {"left": left.select("tensor", "u"), "singular_values": values, "metrics": metrics.error_metrics(z, [], "x", "y", "equal", None)}


def deviation(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """Where 4-bit blocks deviate: weights, blocks and tensors above a threshold, and the worst of each."""
    e = blockquant.weight_errors(rows)
    return {
        "metrics": metrics.error_metrics(e, ["label"], "original", "rebuilt", "null", None), "top_weights": blockquant.top_weights(e, a.top), "top_blocks": blockquant.top_blocks(e, a.top),
        "over_by_block": blockquant.over_by_block(e, a.threshold), "over_by_tensor": blockquant.over_by_tensor(e, a.threshold), "worst_per_tensor": blockquant.worst_per_tensor(e),
    }


def correction_map(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """Correction maps as bytes for each threshold, with statistics before and after."""
    e, t = blockquant.weight_errors(rows), numbers(a.thresholds)
    return {"maps": corrections.encoded_maps(corrections.corrections(e, t)), "stats": corrections.map_stats(e, t)}


def predictive_map(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """Index maps predicted from the row above, for rows numbered from 0."""
    span = rows.select(F.min(F.array_min("vec")).cast("double").alias("lo"), F.max(F.array_max("vec")).cast("double").alias("hi")).first()
    code = F.transform("vec", lambda x: N.uniform_code(x.cast("double"), F.lit(span["lo"]), F.lit(span["hi"]), a.k))
    cells = predictive.contexts(rows.select(F.col("tensor").alias("row_id"), code.alias("codes")), a.k)
    table = predictive.predictor(cells, a.k)
    found = predictive.residuals(cells, table, a.k)
    return {"predictor": table, "residuals": found.select("row_id", "col", "residual"), "entropy": profile.entropy(found.groupBy("residual").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"])}


def similarity(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """The most similar pairs of rows by cosine."""
    found = pairs.cosine_pairs(rows.select(F.col("tensor").alias("id"), "vec"), ["vec"], a.least)
    return {"pairs": pairs.top_pairs(found, "joint", 4, a.top, both_ways=False), "counts": found.agg(*(F.count_if(F.col("joint") >= t).alias(f"ge_{t:g}".replace(".", "p")) for t in (0.9, 0.95, 0.98, 0.99)))}


def pack(rows: DataFrame, a: argparse.Namespace) -> Reports:
    """The whole checkpoint coded, with digests, and a verification of what was coded."""
    archive = codec.compress(codec.parameters(codec.plan(rows, a.preserve)))
    return {"archive": archive, "verified": codec.verify(archive)}


JOBS: dict[str, Callable[[DataFrame, argparse.Namespace], Reports]] = {
    "analyze": analyze, "compress-tensor": compress_tensor, "formula": formula, "low-rank": low_rank, "deviation": deviation, "correction-map": correction_map,
    "predictive-map": predictive_map, "similarity": similarity, "pack": pack,
}


def options(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("job", choices=JOBS)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--format", choices=("parquet", "csv", "json"), default="parquet")
    p.add_argument("--row", type=int, default=4096, help="values of a piece of a tensor; a multiple of 32")
    p.add_argument("--groups", default="16,256")
    p.add_argument("--thresholds", default="0.005,0.01,0.02")
    for name, kind, default in (("k", int, 16), ("steps", int, 5), ("levels", int, 256), ("rank", int, 8), ("top", int, 100), ("threshold", float, 0.01), ("least", float, 0.9), ("preserve", int, 4096)):
        p.add_argument(f"--{name}", type=kind, default=default)
    return p.parse_args(args)


def main(args: list[str] | None = None) -> None:
    a = options(args)
    spark = SparkSession.builder.appName(f"weftline {a.job}").getOrCreate()
    for name, report in JOBS[a.job](tensors(spark, a.input, a.row), a).items():
        report.write.mode("overwrite").format(a.format).option("header", True).save(f"{a.output}/{name}")


if __name__ == "__main__":
    main()
