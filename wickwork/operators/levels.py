"""Price levels and patterns."""

from __future__ import annotations

import numpy as np

from ..functions.sql import clip, div, flag, high, lag, low, num, over
from ..plans.levels import VIEWS
from .averages import add_h1_trend
from .base import Feature, K, Rec, ema, operator, true_range, wilder
from .ichimoku import add_tenkan_breakout
from .momentum import add_fisher_transform, add_rsi_divergence
from .volatility import add_atr_ratio

E8 = 1e-8
# What the kernels of this file look back.
VIEWS |= {"_first_mode": lambda window: window, "_line_distance": lambda long, *_: long, "_support": lambda window, *_: window}


@operator
def add_breakout_flags(resistance_window: int = 20, lookback: int = 5) -> Feature:
    f = Feature().let(_r=high("High", resistance_window, 1, -1)).out(breakout_now=flag("High > _r"))
    return f.out(breakout_in_5=f"max(breakout_now) {over(-lookback, 0)}")


@operator
def add_breakdown_flags(support_window: int = 20, lookback: int = 5) -> Feature:
    f = Feature().let(_s=low("Low", support_window, 1, -1)).out(breakdown_now=flag("Low < _s"))
    return f.out(breakdown_in_5=f"max(breakdown_now) {over(-lookback, 0)}")


@operator
def add_false_breakout(window: int = 10) -> Feature:
    f = Feature().out(high_prev=high("High", window, None, -1), low_prev=low("Low", window, None, -1))
    return f.out(fake_bull=flag("Low < low_prev AND Close > low_prev"))


def _first_mode(x: np.ndarray, window: int) -> np.ndarray:
    """The most frequent of the ``window`` values before each row; of several the one that occurs first in the window."""
    from collections import Counter, defaultdict, deque

    out, count, places = np.full(len(x), np.nan), Counter(), defaultdict(deque)
    best = 0
    sizes: dict[int, set[float]] = defaultdict(set)
    for i, v in enumerate(x.tolist()):
        if i >= window:
            out[i] = min(sizes[best], key=lambda u: places[u][0])
            u = x[i - window]
            sizes[count[u]].discard(u)
            if not sizes[best]:
                best -= 1
            count[u] -= 1
            places[u].popleft()
            sizes[count[u]].add(u)
        sizes[count[v]].discard(v)
        count[v] += 1
        places[v].append(i)
        sizes[count[v]].add(v)
        best = max(best, count[v])
    return out


@operator
def add_liquidity_distance(window: int = 1000, eps: float = E8) -> Feature:
    f = Feature().let(_x="round(Close, 2)").let(_m=Rec(_first_mode, ("_x",), (window,))).let(_y=div("Close - _m", f"(_m + {num(eps)})"))
    return f.out(liq_distance=clip("_y", -1, 1))


@operator
def add_all_features(fisher: str = "fisher") -> Feature:
    """Tenkan breakout, RSI divergence, Fisher transform, false breakout, trend and ATR ratio."""
    f = Feature()
    for part in (add_tenkan_breakout.feature(), add_rsi_divergence.feature(), add_fisher_transform.feature(name=fisher), add_false_breakout.feature(), add_h1_trend.feature(), add_atr_ratio.feature()):
        f.then(part)
    f.outputs = [c for c in f.outputs if c not in ("tenkan_sen", "rsi_low", "price_low", "high_prev", "low_prev")]
    return f


@operator
def sfp_fractals(lookback: int = 14, recent: int = 3) -> Feature:
    """How many of the last rows' three-bar lows are broken, and how far the price is from the lowest of them."""
    f = Feature().let(_a=lag("Low"), _b=lag("Low", -1)).let(_f="CASE WHEN Low < _a AND Low < _b THEN Low END").let(_min=f"min(_f) {over(-lookback, -1)}", _now=f"min(Low) {over(-recent, 0)}")
    f.let(**{f"_f{k}": lag("_f", k) for k in range(1, lookback + 1)}, **{f"_lo{k}": low("Low", k, 1) for k in range(1, lookback + 1)}, **{f"_hi{k}": high("High", k, 1) for k in range(1, lookback + 1)})
    f.let(_count=" + ".join(f"CASE WHEN _f{k} > _now THEN 1 ELSE 0 END" for k in range(1, lookback + 1)), _at="CASE " + " ".join(f"WHEN _f{k} = _min THEN {k}" for k in range(1, lookback + 1)) + " END")
    # Of equal lowest fractals each counts; the mean is over them.
    ratio = lambda k: f"(CASE WHEN Close > _min THEN CASE WHEN _hi{k} > _min THEN (Close - _min) / nullif(_hi{k} - _min, 0) ELSE CAST(0 AS DOUBLE) END ELSE CASE WHEN _lo{k} < _min THEN (Close - _min) / nullif(_min - _lo{k}, 0) ELSE CAST(0 AS DOUBLE) END END)"
    f.let(_sum=" + ".join(f"CASE WHEN _f{k} = _min THEN {ratio(k)} ELSE CAST(0 AS DOUBLE) END" for k in range(1, lookback + 1)), _ties=" + ".join(f"CASE WHEN _f{k} = _min THEN 1 ELSE 0 END" for k in range(1, lookback + 1)))
    f.let(_m=div("_sum", "_ties"))
    return f.out(fractals_broken_count="_count", fractals_broken_ratio=f"CASE WHEN _count = 0 THEN CAST(-1 AS DOUBLE) WHEN _min > _now THEN {clip('_m', -1, 1)} ELSE CAST(0 AS DOUBLE) END")


@operator
def add_structure_break_long(window: int = 14) -> Feature:
    """1 if within the last rows the close first rose above an earlier five-bar high; the high looks two rows ahead."""
    near = {f"_h{k}": lag("High", k) for k in (1, 2)} | {f"_g{k}": lag("High", -k) for k in (1, 2)}
    f = Feature(causal=False).let(**near).let(_f=flag("High > _h1 AND High > _h2 AND High > _g1 AND High > _g2")).let(_b=Rec(K.first_break, ("High", "Close", "_f")))
    return f.out(structure_break_long=f"CAST({high('_b', window, 1)} AS INT)")


def _line_distance(far: np.ndarray, avg: np.ndarray, long: int, short: int, seg: int, sign: float, eps: float) -> np.ndarray:
    """Distance of ``avg`` from a line through the extreme of the rows before and the extremes of the segments after it."""
    n = len(far)
    out = np.full(n, sign)
    x = far * sign  # a support is a resistance upside down
    for i in range(long, n):
        w = x[i - long : i]
        if w.max() <= w[-short:].max():
            continue
        peak = int(w.argmax())
        k = (long - peak - 1) // seg
        if peak >= long - seg or k < 2:
            continue
        y = np.concatenate([[w[peak]], w[peak + 1 : peak + 1 + k * seg].reshape(k, seg).max(1)]) * sign
        t = np.arange(k + 1) - k / 2
        at = y.mean() + (t @ y) / (t @ t) * (k / 2)
        out[i] = np.clip((avg[i] - at) / (abs(at) + eps), -1, 1)
    return out


@operator
def calculate_resistance_distance(long_window: int = 200, short_window: int = 20, segment_size: int = 20, price_col: str = "Close", ema_span: int = 9, eps: float = E8) -> Feature:
    f = Feature().let(_e=ema(price_col, ema_span))
    return f.out(resistance_slope_dist=Rec(_line_distance, ("High", "_e"), (long_window, short_window, segment_size, 1.0, eps)))


@operator
def calculate_support_distance(long_window: int = 200, short_window: int = 20, segment_size: int = 20, price_col: str = "Close", ema_span: int = 9, eps: float = E8) -> Feature:
    f = Feature().let(_e=ema(price_col, ema_span))
    return f.out(support_slope_dist=Rec(_line_distance, ("Low", "_e"), (long_window, short_window, segment_size, -1.0, eps)))


def _support(open_, high_, low_, close, volume, atr, window: int, lookback: int, vol_len: int, tolerance: float, eps: float) -> np.ndarray:
    """Four 0/1 series: near a support, near a resistance of the ``window`` rows before, within the box of a support, of a resistance."""
    n = len(close)
    out = np.zeros((4, n))
    delta = np.where(close > open_, volume, 0.0) - np.where(close < open_, volume, 0.0)
    before, after = lookback // 2, (lookback - 1) // 2
    for upper, x in enumerate((low_, high_)):
        pivot = np.zeros(n, bool)
        if n >= lookback:
            view = np.lib.stride_tricks.sliding_window_view(x, lookback)
            pivot[before : before + len(view)] = x[before : before + len(view)] == (view.max(1) if upper else view.min(1))
        pivots = np.flatnonzero(pivot)
        for i in range(window, n):
            # Pivots whose whole frame lies within the window.
            at = pivots[np.searchsorted(pivots, i - window + before) : np.searchsorted(pivots, i - after)]
            last = delta[i - vol_len : i]
            levels = x[at[delta[at] < last.min()]] if upper else x[at[delta[at] > last.max()]]
            if not len(levels):
                continue
            c = close[i]
            out[upper, i] = (np.abs(c - levels) / (levels + eps) <= tolerance).any()
            inside = (levels - atr[i] <= c) & (c <= levels) if upper else (levels <= c) & (c <= levels + atr[i])
            out[2 + upper, i] = inside.any()
    return out


@operator
def add_support_resistance_features(window: int = 1000, lookback: int = 20, vol_len: int = 2, tolerance: float = 0.01, eps: float = E8) -> Feature:
    f = true_range(Feature(), strict=True).let(_atr=wilder("_tr", 200))
    columns = ("Open", "High", "Low", "Close", "Volume", "_atr")
    names = ("near_support_level", "near_resistance_level", "in_support_box", "in_resistance_box")
    f.let(**{f"_{n}": Rec(_support, columns, (window, lookback, vol_len, tolerance, eps), i) for i, n in enumerate(names)})
    return f.out(**{n: f"CAST(_{n} AS INT)" for n in names})


