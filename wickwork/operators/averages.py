"""Moving averages and crosses."""

from __future__ import annotations

from ..functions.sql import clip, diff, div, flag, high, lag, mean, num
from .base import Feature, ema, operator, seeded

PI = "pi()"
E8 = 1e-8


def _crossed(f: Feature, name: str, a: str, b: str, w: int = 5) -> Feature:
    """1 if a > b has changed within the last w rows, unknown counting as false; 0 on the first w - 1."""
    p = f"_{name}"
    f.let(**{f"{p}_s": flag(f"{a} > {b}")}).let(**{f"{p}_l": lag(f"{p}_s")}).let(**{f"{p}_c": flag(f"{p}_s <> coalesce({p}_l, 0)")})
    return f.out(**{name: f"coalesce({high(f'{p}_c', w)}, 0)"})


@operator
def different_MA(price_col: str = "Close", eps: float = E8) -> Feature:
    f = Feature().let(_e50=seeded(price_col, 50), _e200=seeded(price_col, 200)).let(_s100=mean(price_col, 100), _s200=mean(price_col, 200))
    f.let(_ed=div(f"_e200 - {price_col}", f"({price_col} + {num(eps)})"), _above=flag("_e50 > _e200"), _l50=lag("_e50"), _l200=lag("_e200"))
    f.let(_d50=diff("_e50"), _d200=diff("_e200"))
    f.out(
        ema200_diff=clip("_ed", -1, 1), ema50_ema200_diff="_e50 - _e200", sma100_sma200_diff="_s100 - _s200", ema50_above_ema200="_above",
        ema50_cross_up=flag("_e50 > _e200 AND _l50 <= _l200"), ema50_cross_down=flag("_e50 < _e200 AND _l50 >= _l200"),
        ema50_slope=f"atan(_d50) / {PI}", ema200_slope=f"atan(_d200) / {PI}",
    )
    return f.out(ema50_slope_vs_ema200="ema50_slope - ema200_slope")


def _raw_flags(f: Feature, price: str, spans: tuple[int, ...]) -> Feature:
    f.let(**{f"_r{n}": seeded(price, n) for n in (9, 20, 50, 100, 200)})
    f.out(**{f"price_above_ema{n}": flag(f"{price} > _r{n}") for n in spans})
    for a, b in ((9, 20), (20, 50), (50, 100), (100, 200)):
        _crossed(f, f"ema{a}_crossed_ema{b}_last5", f"_r{a}", f"_r{b}")
    return f


@operator
def different_EMA(price_col: str = "Close", eps: float = E8) -> Feature:
    """Averages of the price over its mean of 60 rows, their slopes, changes and distances; flags on the raw price."""
    spans = (20, 50, 100, 200)
    f = Feature().let(_m60=mean(price_col, 60)).let(_n=div(price_col, "_m60")).let(**{f"_e{n}": seeded("_n", n) for n in spans})
    f.let(**{f"_s{n}": diff(f"_e{n}", 5) for n in spans})
    f.out(**{f"ema{n}_norm": f"_e{n}" for n in spans}, **{f"ema{n}_slope": f"atan(_s{n}) / {PI}" for n in spans})
    f.out(ema20_ema50_diff="_e20 - _e50", ema50_ema100_diff="_e50 - _e100", ema100_ema200_diff="_e100 - _e200")
    f.out(ema20_diff=diff("_e20", 10), ema50_diff=diff("_e50", 25), ema100_diff=diff("_e100", 50), ema200_diff=diff("_e200", 100))
    return _raw_flags(f, price_col, spans)


@operator
def different_EMA_binary(price_col: str = "Close") -> Feature:
    f = _raw_flags(Feature(), price_col, (9, 20, 50, 100, 200))
    spans = (20, 50, 100, 200)
    f.let(**{f"_d{n}": diff(f"_r{n}", 5) for n in spans}, _gap="_r20 - _r50").let(**{f"_a{n}": f"atan(_d{n}) / {PI}" for n in spans}, _wider=diff("_gap", 5))
    f.let(**{f"_b{n}": lag(f"_a{n}", 5) for n in spans})
    f.out(**{f"ema{n}_slope_increased": flag(f"_a{n} > _b{n}") for n in spans})
    return f.out(ema20_and_50_rising_diverging=flag("_d20 > 0 AND _d50 > 0 AND _wider > 0"))


@operator
def TMA_Overlay(show_100_line: bool = True, show_trend_fill: bool = True, show_bullish_3_line: bool = True, show_bullish_engulfing: bool = True, eps: float = 1e-10) -> Feature:
    """Smoothed averages that build on the mean of the rows before, not on themselves; three-line and engulfing flags."""
    lines = (21, 50, 100, 200) if show_100_line else (21, 50, 200)
    f = Feature().let(_e2=ema("Close", 2)).let(**{f"_m{n}": mean("Close", n, 1, -1) for n in lines}, **{f"_o{k}": lag("Open", k) for k in (1, 2, 3)}, **{f"_c{k}": lag("Close", k) for k in (1, 2, 3)})
    norm = lambda x: div(f"({x}) - Close", f"(abs(Close) + {num(eps)})")
    f.out(**{f"smma_{n}_norm": norm(f"(_m{n} * {n - 1} + Close) / {n}") for n in lines}, ema_2_norm=norm("_e2"))
    if show_trend_fill:
        f.out(trend_fill="CASE WHEN ema_2_norm > 0 THEN 1 WHEN ema_2_norm < 0 THEN -1 ELSE 0 END")
    if show_bullish_3_line:
        f.out(bull_3_line=flag("_c3 < _o3 AND _c2 < _o2 AND _c1 < _o1 AND Close > _o1"))
    return f.out(bull_engulfing=flag("Open <= _c1 AND Open < _o1 AND Close > _o1")) if show_bullish_engulfing else f


@operator
def add_h1_trend(period: int = 12, eps: float = E8) -> Feature:
    f = Feature().let(_m=mean("Close", period, None, -1)).let(_y=div("Close - _m", f"(_m + {num(eps)})"))
    return f.out(h1_trend=clip("_y", -1, 1))
