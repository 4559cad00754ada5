"""Index maps predicted from the symbol directly above."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contexts(rows: DataFrame, k: int) -> DataFrame:
    """Rows (row_id, col, code, ctx) of code rows (row_id, codes); the row above joins as an array, row 0 has context k."""
    above = rows.select((F.col("row_id") + 1).alias("row_id"), F.col("codes").alias("above"))
    both = rows.join(above, "row_id", "left")
    cells = F.transform("codes", lambda c, i: F.struct(c.alias("code"), F.coalesce(F.get("above", i), F.lit(k)).alias("ctx")))
    return both.select("row_id", F.posexplode(cells).alias("col", "x")).select("row_id", "col", "x.code", "x.ctx")


def predictor(cells: DataFrame, k: int) -> DataFrame:
    """Rows (ctx, predicted) for all k + 1 contexts: the most frequent symbol, the lowest on ties, 0 where unseen."""
    counts = cells.groupBy("ctx", "code").agg(F.count("*").alias("n"))
    best = counts.groupBy("ctx").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("predicted"))
    domain = cells.sparkSession.range(k + 1).select(F.col("id").cast("int").alias("ctx"))
    return domain.join(best, "ctx", "left").select("ctx", F.coalesce("predicted", F.lit(0)).alias("predicted"))


def residuals(cells: DataFrame, table: DataFrame, k: int) -> DataFrame:
    """Adds the predicted symbol and the residual modulo k; the table has k + 1 rows."""
    both = cells.join(F.broadcast(table), "ctx")
    return both.withColumn("residual", F.pmod(F.col("code") - F.col("predicted"), F.lit(k)))


def decode(found: DataFrame, table: list[int], k: int) -> DataFrame:
    """Rows (row_id, col, code) from (row_id, col, residual): each column is a chain from its first row on.

    A column streams through its task in row order; what is held is one symbol.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = prior = None
        for batch in batches:
            out = np.empty(batch.num_rows, np.int32)
            cols, rest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for i in range(batch.num_rows):
                if cols[i] != column:
                    column, prior = cols[i], k
                prior = (table[prior] + int(rest[i])) % k
                out[i] = prior
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["row_id", "col", "code"])

    return found.select("row_id", "col", "residual").repartition("col").sortWithinPartitions("col", "row_id").mapInArrow(run, "row_id long, col int, code int")
