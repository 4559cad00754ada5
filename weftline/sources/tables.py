"""Weight-matrix adapters: arrays of values as tensors, blocks or single weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (tensor, label, vec) of the embeddings table seen as a weight matrix."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("tensor"), "label", F.col("embedding").alias("vec"))


def weights(rows: DataFrame) -> DataFrame:
    """Long form (tensor, label, flat_index, value); an explode, no shuffle."""
    return rows.select("tensor", "label", F.posexplode("vec").alias("flat_index", "value")).withColumn("flat_index", F.col("flat_index").cast("long"))


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Rows (tensor, label, block, x): consecutive slices of each vector; the last one may be shorter.

    A block is cut out of its row, so no shuffle is needed to gather it.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("vec") - 1) / size)).cast("int"))
    cut = rows.where(F.size("vec") > 0).select("tensor", "label", "vec", F.explode(starts).alias("block"))
    return cut.select("tensor", "label", F.col("block").cast("long").alias("block"), F.slice("vec", F.col("block") * size + 1, F.lit(size)).alias("x"))


def eligible(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """Adds ``skip``: why a row can't be cut into whole blocks, null where it can."""
    n = F.size("vec")
    return rows.withColumn("skip", F.when(n.isNull() | (n <= 0), "scalar").when(n % size != 0, "not a multiple of the block"))
