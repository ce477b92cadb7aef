"""RSI of a higher timeframe on the bars of a lower one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import with_seq
from .base import OPERATORS, Feature, rsi


def rsi_htf(df: DataFrame, timeframes: tuple[str, ...] = ("hour",), rsi_periods: tuple[int, ...] = (7, 14), price_col: str = "Close", causal: bool = False) -> DataFrame:
    """``RSI{p}_{tf}_norm``: RSI over the last price of each ``date_trunc`` unit, joined where a bar starts the unit.

    A unit's last price is seen from its first bar on, which looks ahead; ``causal`` takes the unit before instead. Bars
    that start no unit carry the last value on.
    """
    for tf in timeframes:
        unit = df.groupBy("symbol", F.date_trunc(tf, "Data").alias("Data")).agg(F.max_by(price_col, F.struct("Data", "seq")).alias("Close"))
        f = Feature()
        for p in rsi_periods:
            rsi(f, f"_r{p}", p)
        f.out(**{f"_v{p}": f"_r{p} / 100" for p in rsi_periods})
        if causal:
            f.out(**{f"_v{p}": f"lag(_v{p}) OVER (PARTITION BY symbol ORDER BY seq)" for p in rsi_periods})
        rows = df.join(f.add_to(with_seq(unit)).select("symbol", "Data", *[f"_v{p}" for p in rsi_periods]), ["symbol", "Data"], "left")
        upto = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        name = {"hour": "1H", "day": "1D"}.get(tf, tf)
        df = rows.select(*df.columns, *[F.last(f"_v{p}", True).over(upto).alias(f"RSI{p}_{name}_norm") for p in rsi_periods])
    return df


OPERATORS["rsi_htf"] = rsi_htf
