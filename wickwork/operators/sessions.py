"""Trading sessions and times of day. Times are London's, with summer time where it holds there or in New York."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import clip, ffill, flag, lag
from .base import OPERATORS, Feature, operator

SESSIONS = ("Asia", "Frankfurt", "London", "NewYork", "Lunch")


def _summer(zone: str, standard_hours: int):
    """Whether a wall-clock time of ``zone`` falls into summer time: its offset to UTC is not the standard one."""
    wall = F.col("Data").cast("timestamp")
    return (F.unix_timestamp(wall) - F.unix_timestamp(F.to_utc_timestamp(wall, zone))) != standard_hours * 3600


def add_trading_sessions(df: DataFrame, time_col: str = "Data") -> DataFrame:
    """0/1 columns for the hours of each session; hours shift by one while London has summer time.

    New York's evening follows New York's own summer time.
    """
    data = df.withColumn("Data", F.col(time_col)) if time_col != "Data" else df
    h, m = F.hour("Data"), F.minute("Data")
    summer, ny = _summer("Europe/London", 0), _summer("America/New_York", -5)

    def hours(a: int, b: int):
        return F.when(summer, (h >= a - 1) & (h < b - 1)).otherwise((h >= a) & (h < b))

    # In summer New York's second half would start below hour 0, so it has none.
    cols = {
        "Asia": hours(3, 10),
        "Frankfurt": hours(10, 11),
        "London": hours(11, 13),
        "NewYork": F.when(ny, h >= 15).otherwise((h >= 16) | (h < 1)),
        "Lunch": F.when(summer, (h == 12) | ((h == 15) & (m == 0))).otherwise((h == 13) | ((h == 16) & (m == 0))),
    }
    return data.select(*df.columns, *[c.cast("int").alias(n) for n, c in cols.items()])


OPERATORS["add_trading_sessions"] = add_trading_sessions


@operator
def session_distance() -> Feature:
    """How far the price is beyond the first candle of the running session, as a share of that candle; else 0."""
    f = Feature().let(**{f"_p{s}": lag(s) for s in SESSIONS})
    start = lambda s: f"{s} = 1 AND coalesce(_p{s}, 0) <> 1"
    f.let(**{f"_h{s}": ffill(f"CASE WHEN {start(s)} THEN High END") for s in SESSIONS}, **{f"_l{s}": ffill(f"CASE WHEN {start(s)} THEN Low END") for s in SESSIONS})
    f.let(**{f"_d{s}": f"CASE WHEN {s} = 1 AND Low < _l{s} THEN (Low - _l{s}) / nullif(_h{s} - _l{s}, 0) WHEN {s} = 1 AND High > _h{s} THEN (High - _h{s}) / nullif(_h{s} - _l{s}, 0) ELSE CAST(0 AS DOUBLE) END" for s in SESSIONS})
    return f.out(**{f"{s}_Distance": clip(f"_d{s}", -1, 1) for s in SESSIONS})


@operator
def quarter_theory(levels: int = 2) -> Feature:
    """One column for each quarter of the day at every level: 4, 16, ... parts."""
    seconds = "(hour(Data) * 3600 + minute(Data) * 60 + second(Data))"
    f = Feature().let(**{f"_q{n}": f"CAST(floor({seconds} * {4**n} / 86400.0) AS INT)" for n in range(1, levels + 1)})
    return f.out(**{f"Q_L{n}_{q}": flag(f"_q{n} = {q - 1}") for n in range(1, levels + 1) for q in range(1, 4**n + 1)})
