"""Bars: (symbol, seq, Data, Open, High, Low, Close, Volume), seq numbering the rows of a symbol from 1 in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICES = ("Open", "High", "Low", "Close", "Volume")
CSV_SCHEMA = T.StructType([T.StructField("Data", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in PRICES]])
REQUIRED = ("Data", *PRICES)


def with_seq(df: DataFrame, *ties: str) -> DataFrame:
    """Number the rows of each symbol by time; ``ties`` order rows of one time."""
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit("ALL"))
    order = Window.partitionBy("symbol").orderBy("Data", *ties)
    return df.withColumn("seq", F.row_number().over(order).cast("long"))


def resample(df: DataFrame, time: Column, price: Column, volume: Column, every: Column, order: Column, symbol: Column | None = None) -> DataFrame:
    """Bars from ticks: ``every`` gives a tick's bar time, ``order`` tells the first and last tick of a bar apart.

    One shuffle; ticks are combined before it.
    """
    ticks = df.select((symbol if symbol is not None else F.lit("ALL")).alias("symbol"), every.cast("timestamp").alias("Data"), price.cast("double").alias("p"), volume.cast("double").alias("v"), order.alias("o"))
    bars = ticks.groupBy("symbol", "Data").agg(F.min_by("p", "o").alias("Open"), F.max("p").alias("High"), F.min("p").alias("Low"), F.max_by("p", "o").alias("Close"), F.sum("v").alias("Volume"))
    return with_seq(bars)


def check_columns(df: DataFrame) -> DataFrame:
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"bars need the columns {', '.join(REQUIRED)}; {', '.join(missing)} missing")
    return df


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV files with a header; columns are found by name, extra ones are left out."""
    header = spark.read.option("header", True).csv(path)
    check_columns(header)
    return with_seq(header.select(F.to_timestamp("Data").alias("Data"), *[F.col(c).cast("double").alias(c) for c in PRICES]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    df = check_columns(spark.read.parquet(path))
    return with_seq(df.withColumn("Data", F.col("Data").cast("timestamp")))


def parse_pages(pages: DataFrame, column: str = "rows") -> DataFrame:
    """Bars from pages of string arrays [epoch ms, open, high, low, close, volume, ...].

    Pages overlap by a bar, so equal rows count once; further fields are ignored.
    """
    row = pages.select(*[c for c in pages.columns if c == "symbol"], F.explode(column).alias("r"))
    bars = row.select(*[c for c in row.columns if c == "symbol"], F.timestamp_millis(F.col("r")[0].cast("long")).alias("Data"), *[F.col("r")[i + 1].cast("double").alias(c) for i, c in enumerate(PRICES)])
    return with_seq(bars.dropDuplicates(), *PRICES)


def completeness_gate(df: DataFrame, every_seconds: int, least: float = 0.7) -> DataFrame:
    """Only symbols that have at least ``least`` of the bars between their first and last; a grouped count and a semi-join."""
    spans = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), (F.unix_timestamp(F.max("Data")) - F.unix_timestamp(F.min("Data"))).alias("s"))
    good = spans.filter(F.col("n") >= least * (F.floor(F.col("s") / every_seconds) + 1)).select("symbol")
    return df.join(good, "symbol", "left_semi")


def batches(start_ms: int, end_ms: int, step_ms: int, size: int = 200) -> list[tuple[int, int]]:
    """The request windows that cover a time range, ``size`` bars each; neighbours share their boundary bar."""
    span = size * step_ms
    count = max(0, -(-(end_ms - start_ms) // span))
    return [(start_ms + i * span, min(start_ms + (i + 1) * span, end_ms)) for i in range(count)]
