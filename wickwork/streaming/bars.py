"""Bars from a stream of ticks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes", symbol: Column | None = None, time: str = "ts", price: str = "value", volume: Column | None = None) -> DataFrame:
    """Tumbling bars; a bar is final once the watermark has passed its end, later ticks are dropped."""
    rows = ticks.select((symbol if symbol is not None else F.lit("ALL")).alias("symbol"), F.col(time).cast("timestamp").alias("t"), F.col(price).cast("double").alias("p"), (volume if volume is not None else F.lit(1.0)).cast("double").alias("v")).withWatermark("t", late)
    bars = rows.groupBy("symbol", F.window("t", every).alias("w")).agg(F.min_by("p", "t").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "t").alias("Close"), F.sum("v").alias("Volume"))
    return bars.select("symbol", F.col("w.start").alias("Data"), "Open", "High", "Low", "Close", "Volume")


def stream_features(bars: DataFrame, history: Callable[[], DataFrame], feature: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Features of new bars: each batch is joined to a look-back slice of stored bars, and only its own rows are given on."""
    from ..sources.bars import with_seq

    def batch(new: DataFrame, no: int) -> None:
        marked = history().withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        sink(feature(with_seq(marked)).filter("_new").drop("_new", "seq"), no)

    return bars.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").start()
