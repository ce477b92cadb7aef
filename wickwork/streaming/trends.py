"""Trailing levels over a stream of bars: SuperTrend and parabolic SAR, with a symbol's state carried from batch to batch.

The state of a symbol is a few numbers and its last bars, whatever has gone by. Bars of a symbol that arrive together may
be in any order; bars that are not newer than what the symbol has had are dropped, as they would change what was given out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.kernels import psar_step, super_trend_step


class Trends:
    """What is known of a symbol: the last bars, how many there were, and both recursions' states."""

    def __init__(self, period: int, multiplier: float, step: float, most: float) -> None:
        self.period, self.multiplier, self.step, self.most = period, multiplier, step, most
        self.count, self.last = 0, None
        self.bars: list[tuple[float, float, float]] = []  # high, low, close, the newest last
        self.ranges: list[float] = []
        self.means: list[float] = []
        self.bands: list[tuple[float, float]] = []
        self.trend: tuple[float, float] = (np.nan, 0.0)
        self.sar: tuple | None = None

    def add(self, high: float, low: float, close: float) -> tuple[float, float, float]:
        """The trailing level, the direction (0 before the first) and the long side's SAR (nan in down trends) at this bar."""
        before = self.bars[-1] if self.bars else None
        self.ranges.append(max(high - low, abs(high - before[2]), abs(low - before[2])) if before else high - low)
        self.ranges = self.ranges[-self.period :]
        atr = self.means[-1] if self.means else np.nan
        self.means = [float(np.mean(self.ranges)) if len(self.ranges) == self.period else np.nan]
        upper, lower = self.bands[-1] if self.bands else (np.nan, np.nan)
        middle = (high + low) / 2
        self.bands = [(middle + self.multiplier * atr, middle - self.multiplier * atr)]
        if self.count >= self.period:
            self.trend = super_trend_step(close, upper, lower, self.trend, self.count == self.period)
        self.sar, shown = psar_step(high, low, self.bars, self.sar, self.step, self.most)
        self.bars = [*self.bars[-1:], (high, low, close)]
        self.count += 1
        return (*self.trend, shown)


OUT = "symbol string, Data timestamp, Close double, super_trend double, direction int, parabolic_sar double"


def stream_trends(bars: DataFrame, period: int = 10, multiplier: float = 3.0, step: float = 0.02, most: float = 0.2) -> DataFrame:
    """(symbol, Data, Close, super_trend, direction, parabolic_sar) for a stream of bars (symbol, Data, High, Low, Close); a row for each bar, in append mode.

    The values are those of the batch kernels over all bars so far.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known: Trends = pickle.loads(state.get[0]) if state.exists else Trends(period, multiplier, step, most)
        new = pd.concat(list(frames)).sort_values("Data", kind="stable").drop_duplicates("Data")
        if known.last is not None:
            new = new[new["Data"] > known.last]
        got = [known.add(h, lo, c) for h, lo, c in zip(new["High"], new["Low"], new["Close"], strict=True)]
        if len(new):
            known.last = new["Data"].iloc[-1]
        state.update((pickle.dumps(known),))
        level, way, sar = (np.array(v, float) for v in zip(*got, strict=True)) if got else (np.zeros(0),) * 3
        yield pd.DataFrame({"symbol": key[0], "Data": new["Data"].to_numpy(), "Close": new["Close"].to_numpy(), "super_trend": level, "direction": way.astype(int), "parabolic_sar": sar})

    return bars.select("symbol", "Data", "High", "Low", "Close").groupBy("symbol").applyInPandasWithState(update, OUT, "known binary", "append", GroupStateTimeout.NoTimeout)
