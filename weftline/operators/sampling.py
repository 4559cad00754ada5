"""Stratified sample sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: DataFrame, key: str, budget: int, least: int) -> DataFrame:
    """Adds ``n`` to strata (key, size): every stratum gets ``least`` (or all it has), the rest of the budget goes by
    largest remainder in proportion to what is left of each; if the floors exceed the budget, all of it does.

    The windows run over the strata - the inventory, one row a tensor - not over data.  Ties go to the smaller key.
    """
    every = Window.partitionBy()
    floors = sizes.withColumn("base", F.least("size", F.lit(least).cast("long")))
    base_sum, size_sum = F.sum("base").over(every), F.sum("size").over(every)
    limit = F.least(F.lit(budget).cast("long"), size_sum)
    floors = floors.withColumn("base", F.when(base_sum > limit, F.lit(0).cast("long")).otherwise(F.col("base"))).withColumn("limit", limit)
    room = F.col("size") - F.col("base")
    shares = floors.withColumn("rest", F.col("limit") - F.sum("base").over(every)).withColumn("cap", F.sum(room).over(every))
    raw = F.when(F.col("cap") > 0, F.col("rest") * room / F.col("cap").cast("double")).otherwise(0.0)
    shares = shares.withColumn("raw", raw).withColumn("whole", F.floor("raw"))
    place = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.col("raw") - F.col("whole")), key))
    shares = shares.withColumn("place", place).withColumn("left", F.col("rest") - F.sum("whole").over(every))
    extra = ((F.col("place") <= F.col("left")) & (F.col("base") + F.col("whole") < F.col("size"))).cast("long")
    return shares.withColumn("n", F.col("base") + F.col("whole") + extra).select(*sizes.columns, "n")
