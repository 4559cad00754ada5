"""4-bit block quantisation and the location of its errors, weight by weight."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import numeric as N
from weftline.sources.tables import BLOCK, blocks, eligible


def encode(rows: DataFrame) -> DataFrame:
    """Rows (tensor, label, block, x, scale, codes) of the eligible tensors: each block within its row, no shuffle."""
    cut = blocks(eligible(rows).where("skip is null"))
    return cut.withColumn("scale", N.block_scale(F.col("x"))).withColumn("codes", N.block_codes(F.col("x"), F.col("scale")))


def decode(encoded: DataFrame) -> DataFrame:
    return encoded.withColumn("y", N.block_values(F.col("codes"), F.col("scale")))


def weight_errors(rows: DataFrame) -> DataFrame:
    """Rows (tensor, label, flat_index, block, pos, original, rebuilt, error, abs_error, step) for every weight."""
    decoded = decode(encode(rows)).select("tensor", "label", "block", F.abs(N.fp16("scale")).alias("step"), F.posexplode(F.arrays_zip("x", "y")).alias("pos", "w"))
    error = (F.col("w.y") - F.col("w.x")).cast("float")
    out = decoded.select("tensor", "label", (F.col("block") * BLOCK + F.col("pos")).alias("flat_index"), "block", "pos", F.col("w.x").alias("original"), F.col("w.y").alias("rebuilt"), error.alias("error"), "step")
    return out.withColumn("abs_error", F.abs("error"))


def records(errors: DataFrame, cols: int) -> DataFrame:
    """Detail record of a weight: coordinates, relative error, error in steps."""
    at = F.col("flat_index")
    a = F.col("abs_error").cast("double")
    return errors.select(
        "tensor", "flat_index",
        F.concat(F.lit("["), F.floor(at / cols).cast("string"), F.lit(","), F.pmod(at, F.lit(cols)).cast("string"), F.lit("]")).alias("coordinates"),
        F.floor(at / BLOCK).alias("block_index"), F.pmod(at, F.lit(BLOCK)).alias("position_in_block"),
        F.round(F.col("original").cast("double"), 6).alias("original"), (F.round(F.col("rebuilt").cast("double"), 6) + F.lit(0.0)).alias("rebuilt"),
        (F.round(F.col("error").cast("double"), 6) + F.lit(0.0)).alias("delta"), F.round(a, 6).alias("absolute_error"),
        F.round(F.when(F.col("original") != 0, a / F.abs(F.col("original").cast("double")) * 100), 4).alias("relative_error_percent"),
        F.round(F.when(F.col("step") != 0, a / F.col("step").cast("double")).otherwise(0.0), 4).alias("error_in_steps"))


def over_by_block(errors: DataFrame, threshold: float) -> DataFrame:
    """Blocks with errors above the threshold: how many, where, and the worst position (the first on ties)."""
    over = F.col("abs_error") > threshold
    key = F.struct("abs_error", -F.col("flat_index"))
    found = errors.groupBy("tensor", "block").agg(
        F.count_if(over).alias("n_over"), F.sort_array(F.collect_list(F.when(over, F.col("pos")))).alias("positions"), F.max_by("pos", key).alias("worst"), F.max("abs_error").alias("m"))
    return found.where("n_over > 0").select("tensor", "block", "n_over", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"), F.col("worst").cast("int").alias("worst"), F.round(F.col("m").cast("double"), 6).alias("max_error"))


def over_by_tensor(errors: DataFrame, threshold: float) -> DataFrame:
    """Per tensor the weights and blocks above the threshold; tensors without any are kept with zeros."""
    over = F.col("abs_error") > threshold
    return errors.groupBy("tensor").agg(F.count_if(over).alias("weights_over"), F.count_distinct(F.when(over, F.col("block"))).alias("blocks_over"))


def worst_per_tensor(errors: DataFrame) -> DataFrame:
    """The worst weight of each tensor, the first on ties."""
    best = F.max_by(F.struct("flat_index", "original", "rebuilt", "abs_error"), F.struct("abs_error", -F.col("flat_index"))).alias("w")
    return errors.groupBy("tensor").agg(best).select("tensor", "w.*")


def top_weights(errors: DataFrame, k: int, nonzero: bool = False) -> DataFrame:
    """The k largest errors in a total order; a bounded heap in each task, then a merge."""
    found = errors.where("abs_error > 0") if nonzero else errors
    return found.orderBy(F.desc("abs_error"), "tensor", "flat_index").limit(k)


def top_blocks(errors: DataFrame, k: int) -> DataFrame:
    """The k blocks with the worst single weight."""
    worst = errors.groupBy("tensor", "block").agg(F.max("abs_error").alias("worst"), F.sum(F.col("abs_error").cast("double")).alias("total"))
    return worst.orderBy(F.desc("worst"), "tensor", "block").limit(k)
