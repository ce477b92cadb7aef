"""Volatility, channels and trailing levels."""

from __future__ import annotations

from ..functions.sql import HL2, HLC3, TR, clip, diff, div, ffill, flag, high, lag, low, mean, minmax, num, over, pct, std, total
from .base import Feature, K, Rec, ema, ewm, operator, rsi_plain, seeded, true_range, wilder

E8 = 1e-8


def _atr(f: Feature, name: str, w: int, smooth: bool = True) -> Feature:
    return f.let(**{name: ewm("_tr", w) if smooth else mean("_tr", w, 1)})


@operator
def add_atr_normalized(windows: tuple[int, ...] = (14, 24, 48), ema: bool = True, normalization_window: int = 100, add_velocity: bool = True, add_acceleration: bool = True, velocity_window: int = 5, eps: float = E8) -> Feature:
    f, n, v = true_range(Feature()), normalization_window, velocity_window
    f.let(**{f"_a{w}": ewm("_tr", w) if ema else mean("_tr", w, 1) for w in windows})
    f.let(**{f"_l{w}": low(f"_a{w}", n, 1) for w in windows}, **{f"_h{w}": high(f"_a{w}", n, 1) for w in windows})
    f.out(**{f"atr_{w}_norm": minmax(f"_a{w}", f"_l{w}", f"_h{w}", eps) for w in windows})
    if add_velocity:
        f.out(**{f"atr_{w}_norm_velocity": f"{diff(f'atr_{w}_norm', v)} / {v}" for w in windows})
        if add_acceleration:
            f.out(**{f"atr_{w}_norm_acceleration": f"{diff(f'atr_{w}_norm_velocity', v)}" for w in windows})
    return f


@operator
def add_atr_normalized_rsi_weight(windows: tuple[int, ...] = (14, 24, 48), ema: bool = True, normalize: bool = True, add_velocity: bool = True, add_acceleration: bool = True, rsi_period: int = 14, slope_window: int = 5, eps: float = E8) -> Feature:
    """ATR, in percent of the price and weighted by RSI over its slope if ``normalize``, with velocity and acceleration.

    The RSI is 100 where nothing fell, and null where nothing moved.
    """
    f = true_range(Feature())
    rsi_plain(f, "_r0", rsi_period, 0.0, least=1)
    f.let(_r="CASE WHEN _r0_ml = 0 AND _r0_mg > 0 THEN CAST(100 AS DOUBLE) ELSE _r0 END")
    f.let(_rs=diff("_r", slope_window)).let(_w=div("_r", f"(_rs / {slope_window} + {num(eps)})"))
    f.let(**{f"_a{w}": ewm("_tr", w) if ema else mean("_tr", w, 1) for w in windows})
    name = lambda w: f"atr_{w}_norm" if normalize else f"atr_{w}"
    f.out(**{name(w): f"100 * {div(f'_a{w}', 'Close')}" if normalize else f"_a{w}" for w in windows})
    if normalize:
        f.out(**{f"{name(w)}_rsi_weight": f"{name(w)} * _w" for w in windows})
    if not add_velocity:
        return f
    f.out(**{f"{name(w)}_velocity": div(diff(name(w)), lag(name(w))) for w in windows})
    return f.out(**{f"{name(w)}_acceleration": diff(f"{name(w)}_velocity") for w in windows}) if add_acceleration else f


@operator
def calculate_atr_slope(length: int = 14, lookback: int = 5, slope_coeff: float = 5) -> Feature:
    """tanh of the slope of a line through the ATR of the rows before."""
    frame = over(-lookback, -1)
    f = true_range(Feature()).let(_a=ewm("_tr", length)).let(_x="CAST(seq AS DOUBLE)")
    return f.out(atr_slope=f"CASE WHEN count(_a) {frame} = {lookback} THEN tanh(regr_slope(_a, _x) {frame} * {num(slope_coeff)}) END")


@operator
def calculate_atr_ema_normalized(length_atr: int = 14, length_ema: int = 20, eps: float = 1e-5) -> Feature:
    f = true_range(Feature()).let(_a=ewm("_tr", length_atr)).let(_e=seeded("_a", length_ema)).let(_y=div("_e - _a", f"(_a + {num(eps)})"))
    return f.out(atr_ema_norm=clip("_y", -1, 1))


def _with_atr(f: Feature, col: str) -> Feature:
    """The normalised ATR of 24 rows, where the column asked for is that one."""
    return f.then(add_atr_normalized.feature((24,), add_velocity=False)) if col == "atr_24_norm" else f


def _dynamics(f: Feature, col: str) -> Feature:
    f.out(**{f"{col}_rolling_std_10": std(col, 10), f"{col}_rolling_std_30": std(col, 30), f"{col}_diff_1": diff(col), f"{col}_pct_change": pct(col)})
    return f.out(**{f"{col}_rolling_diff_mean_10": mean(f"{col}_diff_1", 10), f"{col}_pct_change_rolling_mean_10": mean(f"{col}_pct_change", 10), f"{col}_diff2": diff(f"{col}_diff_1")})


@operator
def add_atr_24_norm_dynamics(col: str = "atr_24_norm") -> Feature:
    return _dynamics(_with_atr(Feature(), col), col)


@operator
def atr_local_extremes(atr_col: str = "atr_24_norm", window: int = 14) -> Feature:
    return _with_atr(Feature(), atr_col).out(**{f"{atr_col}_low": f"coalesce({atr_col} = ({low(atr_col, window)}), false)", f"{atr_col}_high": f"coalesce({atr_col} = ({high(atr_col, window)}), false)"})


@operator
def add_atr_features(atr_col: str = "atr_24_norm", compress_window: int = 5, expansion_threshold: int = 2) -> Feature:
    f = _with_atr(Feature(), atr_col).let(_m=mean(atr_col, compress_window), _p=lag(atr_col, expansion_threshold)).out(**{f"{atr_col}_compress": f"coalesce({atr_col} < _m, false)"})
    f.let(_c=lag(f"{atr_col}_compress"))
    return f.out(**{f"{atr_col}_expansion": f"coalesce({atr_col} > _p AND _c, false)"})


@operator
def add_atr_regimes(atr_col: str = "atr_24_norm", regime_window: int = 50, low_multiplier: float = 0.5, high_multiplier: float = 1.5) -> Feature:
    f = _with_atr(Feature(), atr_col).let(_m=mean(atr_col, regime_window))
    return f.out(**{f"{atr_col}_regime": f"CASE WHEN {atr_col} < {num(low_multiplier)} * _m THEN -1 WHEN {atr_col} > {num(high_multiplier)} * _m THEN 1 ELSE 0 END"})


@operator
def add_price_atr_interaction(atr_col: str = "atr_24_norm", amplitude_window: int = 3, ratio_threshold: float = 0.8, use_regime: bool = False, debug: bool = False) -> Feature:
    f = _with_atr(Feature(), atr_col).out(candle_atr_ratio=div("High - Low", f"({atr_col} * Close / 100)")).out(candle_atr_ratio_ma=mean("candle_atr_ratio", amplitude_window))
    f.let(_a1=lag(atr_col))
    conds = ["Close > Open", f"candle_atr_ratio > {num(ratio_threshold)}", f"{atr_col} < _a1"] + ([f"{atr_col}_regime = -1"] if use_regime else [])
    f.out(atr_breakout_signal=flag(" AND ".join(conds)))
    return f.out(**{f"breakout_cond_{i}": flag(c) for i, c in enumerate(conds)}) if debug else f


@operator
def compute_atr_trailing(atr_period: int = 14, multiplier: float = 3) -> Feature:
    """A trailing stop below the close; missing values are filled forward in these columns only."""
    f = true_range(Feature(), strict=True).let(_a=mean("_tr", atr_period, 1)).let(_s=f"Close - {num(multiplier)} * _a").let(_s1=lag("_s")).let(_g="CASE WHEN Close > _s1 THEN 1 ELSE -1 END")
    return f.out(TrailingStop=ffill("_s"), ATR_Signal="_g", ATR_Signal_Norm="(_g + 1) / CAST(2 AS DOUBLE)", ATR_x10=ffill("_a * 10"))


@operator
def Keltner_func(base_atr_period: int = 40, base_multiplier: float = 2, alt_atr_period: int = 100, alt_multiplier: float = 1.5, alt_ema_shift: int = 5, eps: float = E8) -> Feature:
    f = true_range(Feature()).let(_p=HLC3).let(_ps=lag("_p", alt_ema_shift))
    f.let(_t5=ema("_tr", 5), _p5=ema("_p", 5), _tb=ema("_tr", base_atr_period), _pb=ema("_p", base_atr_period), _ta=ema("_tr", 2 * alt_atr_period), _pa=ema("_ps", alt_atr_period))
    f.let(_k5=f"2 * {div('_t5', f'(_p5 + {num(eps)})')}", _v2=f"2 * {num(base_multiplier)} * {div('_tb', f'(_pb + {num(eps)})')}", _v3=f"{num(alt_multiplier)} * {div('_ta', f'(_pa + {num(eps)})')}")
    return f.out(KeltnerWidth_v2_norm=div("_v2 - _k5", f"(_v2 + {num(eps)})"), KeltnerWidth_v3_norm=div("_v3 - _k5", f"(_v3 + {num(eps)})"))


@operator
def super_trend(period: int = 10, multiplier: float = 3.0, eps: float = E8) -> Feature:
    f = true_range(Feature()).let(_m=mean("_tr", period), _hl=HL2).let(_a=lag("_m")).let(_u=f"_hl + {num(multiplier)} * _a", _l=f"_hl - {num(multiplier)} * _a").let(_u=lag("_u"), _l=lag("_l"))
    f.let(_st=Rec(K.super_trend, ("Close", "_u", "_l"), (period,), 0), _w=Rec(K.super_trend, ("Close", "_u", "_l"), (period,), 1))
    f.let(_q=div("_a", f"(abs(Close - _st) + {num(eps)})")).let(_y=f"_w * (1 - ({clip('_q', 0, 1)}))")
    return f.out(**{f"super_trend_{period}_{multiplier}": "least(greatest(coalesce(_y, 0), -1), 1)"})


@operator
def add_bollinger_features(period: int = 20, std_mult: float = 2, eps: float = E8) -> Feature:
    f = Feature().let(_m=mean("Close", period), _s=std("Close", period))
    return f.out(**{f"bb_z_{period}": div("Close - _m", f"(_s + {num(eps)})"), f"bb_width_{period}": f"2 * {num(std_mult)} * {div('_s', f'(_m + {num(eps)})')}"})


@operator
def add_choppiness_index(period: int = 14, eps: float = E8) -> Feature:
    f = true_range(Feature()).let(_t=total("_tr", period), _lo=low("Low", period), _hi=high("High", period))
    f.let(_c=f"100 * log10((_t + {num(eps)}) / (_hi - _lo + {num(eps)})) / log10({num(period + eps)})").let(_y="(_c - 20) / CAST(41.8 AS DOUBLE)")
    return f.out(**{f"choppiness_index_{period}": clip("_y", 0, 1)})


@operator
def add_parabolic_sar_feature(step: float = 0.02, max_step: float = 0.2, eps: float = E8) -> Feature:
    f = Feature().let(_p=Rec(K.psar_long, ("High", "Low"), (step, max_step)))
    return f.out(parabolic_sar_norm=div("_p - Low", f"(High - Low + {num(eps)})"))


@operator
def add_atr_ratio(short_period: int = 14, long_period: int = 12, eps: float = E8) -> Feature:
    f = true_range(Feature(), strict=True).let(_a=wilder("_tr", short_period)).let(_m=mean("_a", long_period, None, -1)).let(_y=div("_a", f"(_m + {num(eps)})"))
    return f.out(atr_ratio=f"({clip('_y', 0, 2)}) / 2")


@operator
def atr_position(lookback: int = 700, atr_window: int = 14, price_col: str = "Close", eps: float = E8) -> Feature:
    f = Feature().let(_pc=lag(price_col)).let(_tr=TR).let(_m=mean(price_col, lookback), _a=mean("_tr", atr_window)).let(_y=div(f"{price_col} - _m", f"(2 * _a + {num(eps)})"))
    return f.out(atr_position=clip("_y", -1, 1))
