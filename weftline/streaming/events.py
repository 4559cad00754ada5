"""Structured Streaming forms: windowed sums, sessions, and the distance to a key's previous index.

The sources are unbounded; watermarks bound the state.  ``drain`` runs a query over what is there now.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema it has now; ``ts`` as a timestamp."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern may also be one file
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of ``value`` for each event type and window (sliding where ``slide`` is given)."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    found = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def index_deltas(events: DataFrame, key: str = "user_id", index: str = "event_id") -> DataFrame:
    """Distance of each index to the key's previous one, carried over from batch to batch; the first counts from -1."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else -1
        rows = pd.concat(list(frames)).sort_values(index)
        before = rows[index].shift(1).fillna(last).astype("int64")
        state.update((int(rows[index].iloc[-1]),))
        yield pd.DataFrame({key: group[0], index: rows[index].to_numpy(), "delta": (rows[index] - before).to_numpy()})

    kind = f"{key} long, {index} long, delta long"
    return events.select(key, index).groupBy(key).applyInPandasWithState(step, kind, "last long", "append", GroupStateTimeout.NoTimeout)


def drain(result: DataFrame, at: str, mode: str) -> DataFrame:
    """Run a streaming query over all available data; its result lies in ``at`` as Parquet."""
    spark = result.sparkSession
    if mode == "append":
        writer = result.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append")
    else:
        writer = result.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).outputMode(mode)
    writer.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{at}/out")
