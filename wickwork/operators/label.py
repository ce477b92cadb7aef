"""First-touch labels: 1 if within the rows ahead the take-profit is reached before the stop-loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import high, low, mean
from .base import OPERATORS, Feature, rsi

def touch(bars: Column, target: Column, stop: Column) -> Column:
    """1 if the first of ``bars`` (High, Low) that touches either price touches only the take-profit."""
    up, down = F.col("Close") * (1 + target), F.col("Close") * (1 - stop)
    first = F.try_element_at(F.filter(bars, lambda b: (b["Low"] <= down) | (b["High"] >= up)), F.lit(1))
    return F.coalesce((first["Low"] > down).cast("int"), F.lit(0))


def ahead(candles: int) -> Column:
    return F.collect_list(F.struct("High", "Low")).over(Window.partitionBy("symbol").orderBy("seq").rowsBetween(1, candles))


def add_target_column_mod(df: DataFrame, target_candles: int = 20, target: float = 0.04, rr_threshold: float = 2.0) -> DataFrame:
    """``target``: the label over the next ``target_candles`` rows, or as many as there are; a bar that touches both is 0."""
    return df.withColumn("target", touch(ahead(target_candles), F.lit(target), F.lit(target / rr_threshold)))


def label_grid(df: DataFrame, targets: list[float], rr_thresholds: list[float], target_candles: int = 20) -> DataFrame:
    """The label for every pair of the grid: rows times pairs, from one look at the rows ahead."""
    grid = F.array(*[F.struct(F.lit(float(r)).alias("rr_threshold"), F.lit(float(t)).alias("target_share")) for r in rr_thresholds for t in targets])
    rows = df.withColumn("_bars", ahead(target_candles)).withColumn("_g", F.explode(grid))
    rows = rows.withColumn("target", touch(F.col("_bars"), F.col("_g.target_share"), F.col("_g.target_share") / F.col("_g.rr_threshold")))
    return rows.select(*df.columns, "_g.rr_threshold", "_g.target_share", "target")


def gates(sma_length: int = 100, rsi_length: int = 14, stoch_length: int = 14, stoch_k_smooth: int = 3, stoch_threshold: float = 40, short_vol_window: int = 5, long_vol_window: int = 20) -> Feature:
    """_gate: the close is above its mean, the stochastic RSI is low and volume rises."""
    f = rsi(Feature(), "_r", rsi_length).let(_rl=low("_r", stoch_length), _rh=high("_r", stoch_length)).let(_s="100 * (_r - _rl) / nullif(_rh - _rl, 0)")
    f.let(_k=mean("_s", stoch_k_smooth), _sma=mean("Close", sma_length), _v5=mean("Volume", short_vol_window), _v20=mean("Volume", long_vol_window))
    return f.out(_gate=f"CASE WHEN Close > _sma AND _k < {stoch_threshold} AND _v5 > _v20 THEN 1 ELSE 0 END")


def add_target_column_mod_sma_stochrsi_volume_surge(df: DataFrame, target_candles: int = 20, target: float = 0.04, rr_threshold: float = 2.0, **kwargs) -> DataFrame:
    """The label where the gates are open, else 0."""
    rows = gates(**kwargs).add_to(df)
    label = touch(ahead(target_candles), F.lit(target), F.lit(target / rr_threshold))
    return rows.withColumn("target", F.when(F.col("_gate") == 1, label).otherwise(0)).drop("_gate")


for _f in (add_target_column_mod, add_target_column_mod_sma_stochrsi_volume_surge):
    OPERATORS[_f.__name__] = _f
