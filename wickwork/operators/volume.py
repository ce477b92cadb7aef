"""Volume and VWAP."""

from __future__ import annotations

from ..functions.sql import HLC3, clip, diff, div, flag, high, low, mean, median, minmax, num, pct, std, total, upto, whole
from .base import Feature, ema, ewm, operator, rsi_plain
from .momentum import compute_combined_indicators
from .volatility import _dynamics, add_atr_normalized

E8, E10 = 1e-8, 1e-10


def _z(f: Feature, name: str, x: str, w: int) -> Feature:
    f.let(**{f"{name}_m": mean(x, w), f"{name}_s": std(x, w)})
    return f.let(**{name: div(f"{x} - {name}_m", f"{name}_s")})


@operator
def add_normalized_volume_profile(window: int = 20, lag: int = 0, change_window: int = 5, sma_window: int = 10) -> Feature:
    from ..functions import sql

    f = Feature().let(_pv=f"{HLC3} * Volume").let(_a=total("_pv", window), _b=total("Volume", window)).let(_p=div("_a", "_b")).let(_sm=mean("_p", sma_window), _ch=pct("_p", change_window))
    for name, x in (("VP_Norm", "_p"), ("VP_SMA_Norm", "_sm"), ("VP_Change_Norm", "_ch")):
        _z(f, f"_{name}", x, sma_window).out(**{name: f"_{name}"})
    return f.out(VP_Norm_Lag=sql.lag("VP_Norm", lag)) if lag > 0 else f


@operator
def add_volume_filter(use_ema: bool = False, window_short: int = 20, window_long: int = 100) -> Feature:
    if window_short >= window_long:
        raise ValueError("window_short is below window_long")
    f = Feature().let(_a=ewm("Volume", window_short), _b=ewm("Volume", window_long)) if use_ema else Feature().let(_a=mean("Volume", window_short, 1), _b=mean("Volume", window_long, 1))
    return f.out(volume_filter=f"100 * coalesce({div('_a', '_b')} - 1, 0)")


@operator
def volume_base_indicators(length: int = 28, short_window: int = 5) -> Feature:
    """Rows of the warm-up stay, with nulls; ``df.na.drop()`` removes them."""
    f = Feature().let(_d=diff("Close"), _vm=mean("Volume", length)).let(_v="sign(_d) * Volume", _ad=f"{div('(Close - Low) - (High - Close)', '(High - CASE WHEN Low = 0 THEN CAST(0.0001 AS DOUBLE) ELSE Low END)')} * Volume", _fi="_d * Volume").let(_obv=upto("sum", "_v"), _ads=total("_ad", length))
    _z(f, "_z1", "_obv", length)
    _z(f, "_z2", "_fi", length)
    return f.out(obv_zscore="_z1", volume_ma_ratio=div("Volume", "_vm"), ad_cum_pct_change=pct("_ads", short_window), force_index_z="_z2")


@operator
def volume_base_indicators_binary(obv_ema_period: int = 20, ad_ema_period: int = 20, force_ema_period: int = 13, vol_ma_period: int = 20, vol_ma_type: str = "ema") -> Feature:
    f = Feature().let(_d=diff("Close")).let(_v="coalesce(sign(_d), 0) * Volume", _ad=f"((Close - Low) - (High - Close)) / CASE WHEN High = Low THEN {num(E8)} ELSE High - Low END * Volume", _fi="_d * Volume").let(_obv=upto("sum", "_v"), _ads=upto("sum", "_ad"))
    f.let(_e1=ema("_obv", obv_ema_period), _e2=ema("_ads", ad_ema_period), _e3=ema("_fi", force_ema_period), **({"_e4": ema("Volume", vol_ma_period)} if vol_ma_type == "ema" else {}))
    if vol_ma_type != "ema":
        f.let(_e4=mean("Volume", vol_ma_period))
    return f.out(**{f"obv_gt_ema{obv_ema_period}": flag("_obv > _e1"), f"ad_gt_ema{ad_ema_period}": flag("_ads > _e2"), f"force_gt_ema{force_ema_period}": flag("_fi > _e3"), f"volume_gt_{vol_ma_type}{vol_ma_period}": flag("Volume > _e4")})


@operator
def bullish_volume_dominance_binary(window: int = 10) -> Feature:
    f = Feature().let(_u="CASE WHEN Close > Open THEN Volume ELSE CAST(0 AS DOUBLE) END", _d="CASE WHEN Close < Open THEN Volume ELSE CAST(0 AS DOUBLE) END").let(_a=total("_u", window), _b=total("_d", window))
    return f.out(**{f"bullish_volume_dominance_{window}": flag("_a > _b")})


def _vwap(f: Feature, price: str = "Close") -> Feature:
    """Helper _w: the day's volume-weighted price so far (days in UTC)."""
    day = "OVER (PARTITION BY symbol, CAST(Data AS DATE) ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f.let(_w=f"sum({price} * Volume) {day} / CASE WHEN sum(Volume) {day} = 0 THEN {num(E8)} ELSE sum(Volume) {day} END")


@operator
def VWAP(slope_period: int = 28, slope_column_name: str = "VWAP_slope", eps: float = E8) -> Feature:
    f = _vwap(Feature()).let(_e6=ema("_w", 360), _e5=ema("_w", 5))
    norm = lambda x: div(f"{x} - _e5", f"({x} + {num(eps)})")
    return f.out(vwap_intraday_norm=norm("_w"), vwap_ema6h_norm=norm("_e6"), **{slope_column_name: f"100 * coalesce({pct('_w', slope_period)}, 0)"})


@operator
def VWAP_binary() -> Feature:
    f = _vwap(Feature()).let(_e6=ema("_w", 360))
    return f.out(price_above_vwap_intraday=flag("Close > _w"), price_above_vwap_ema6h=flag("Close > _e6"))


@operator
def add_vwap_features_with_norm(ema_span: int = 9, vwap_ema_span: int = 360, zscore_window: int = 100, rsi_period: int = 14) -> Feature:
    """The day's weighted price of an average: its own slow against its own fast average, and the average's distance from it over 100 rows."""
    f = _vwap(Feature().let(_e=ema("Close", ema_span)), "_e").let(_v6=ema("_w", vwap_ema_span), _v5=ema("_w", 5)).out(vwap_ema6h_norm=div("_v6 - _v5", f"(_v6 + {num(E8)})"))
    f.let(_m=mean("vwap_ema6h_norm", zscore_window), _s=std("vwap_ema6h_norm", zscore_window), _dist="_e - _v6", _cs=std("Close", 100))
    f.out(vwap_ema6h_zscore=f"(vwap_ema6h_norm - _m) / CASE WHEN _s = 0 THEN {num(E8)} ELSE _s END", vwap_price_distance_direct=f"CASE WHEN _cs IS NOT NULL THEN _dist / greatest(_cs, {num(E8)}) END")
    f.let(_dm=mean("_dist", 100), _ds=std("_dist", 100)).out(vwap_price_distance=f"(_dist - _dm) / (_ds + {num(E8)})")
    rsi_plain(f, "_r", rsi_period, E8, "_e", first_row=False)
    return f.out(RSI_vwap_divergence="(_r - 50) / 50 - sign(vwap_ema6h_norm)")


@operator
def add_liquidity_imbalance(period: int = 20) -> Feature:
    f = Feature().let(_x=f"{div('2 * Close - High - Low', f'(High - Low + {num(E10)})')} * ln(1 + Volume)").let(_m=high("abs(_x)", period))
    return f.out(liq_imb=div("_x", f"(_m + {num(E10)})"))


@operator
def calculate_LISS(profile_window: int = 20) -> Feature:
    """A liquidity score of volume profile, ATR and trend cycle, scaled to 0..1; computes what it needs."""
    f = Feature(causal=False)
    for part in (add_normalized_volume_profile.feature(profile_window), add_atr_normalized.feature((14,), add_velocity=False), compute_combined_indicators.feature()):
        f.levels += part.levels
    f.let(_vm=high("Volume", 20)).let(_q="Volume / CASE WHEN _vm = 0 THEN CAST(1 AS DOUBLE) ELSE _vm END").let(_qc=clip("_q", 1e-7 - 1, 1 - 1e-7)).let(_fv="ln((1 + _qc) / (1 - _qc)) / 2")
    f.let(_y="2 * VP_Norm / (1 + 1 / (1 + exp(atr_14_norm))) - STC * _fv").let(_a=whole("min", "_y"), _b=whole("max", "_y"))
    return f.out(LISS=div("_y - _a", f"(_b - _a + {num(E10)})"))


@operator
def add_volume_dynamics(col: str = "Volume", spike_sigma: float = 1.5) -> Feature:
    """Changes, spikes and clusters of a column, each scaled to -1..1 over the last 100 rows."""
    f = Feature()
    g = _dynamics(Feature(), col)
    names = {c: f"_n{c}" for c in g.outputs}

    def renamed(text: str) -> str:
        for c in sorted(names, key=len, reverse=True):
            text = text.replace(c, names[c])
        return text

    for level in g.levels:
        f.let(**{names[k]: renamed(v) for k, v in level.items()})
    f.let(_sm=mean(col, 20), _ss=std(col, 20), _up=f"CASE WHEN Close > Open THEN {col} ELSE CAST(0 AS DOUBLE) END", _dn=f"CASE WHEN Close < Open THEN {col} ELSE CAST(0 AS DOUBLE) END").let(_sp=flag(f"{col} > _sm + {num(spike_sigma)} * _ss"))
    f.let(**{f"_n{col}_spike": total("_sp", 10), f"_n{col}_up_cluster": total("_up", 10), f"_n{col}_down_cluster": total("_dn", 10)}).let(**{f"_n{col}_volume_cluster_diff": f"_n{col}_up_cluster - _n{col}_down_cluster"})
    every = [*names, f"{col}_spike", f"{col}_up_cluster", f"{col}_down_cluster", f"{col}_volume_cluster_diff"]
    f.let(**{f"_lo{c}": low(f"_n{c}", 100) for c in every}, **{f"_hi{c}": high(f"_n{c}", 100) for c in every})
    return f.out(**{c: minmax(f"_n{c}", f"_lo{c}", f"_hi{c}", E8) for c in every})


@operator
def add_volume_features(window: int = 20, eps: float = 1e-9) -> Feature:
    """Skewness (bias-corrected), relative deviation, and distance from the median."""
    w = window
    f = Feature().let(_m=mean("Volume", w), _md=median("Volume", w), _s=std("Volume", w), _s2=total("Volume * Volume", w), _s3=total("Volume * Volume * Volume", w))
    f.let(_m2=f"_s2 / {w} - _m * _m", _m3=f"_s3 / {w} - 3 * _m * _s2 / {w} + 2 * _m * _m * _m")
    f.let(_sk=f"CASE WHEN _m2 > {num(1e-9)} THEN {num((w * (w - 1)) ** 0.5 / (w - 2))} * _m3 / power(_m2, CAST(1.5 AS DOUBLE)) ELSE CASE WHEN _m2 IS NOT NULL THEN CAST(0 AS DOUBLE) END END", _cv=div("_s", f"(_m + {num(eps)})"), _sp=div("Volume - _md", f"(_md + {num(eps)})"))
    return f.out(**{f"volume_skew_{w}": f"({clip('_sk', -5, 5)}) / 5", f"volume_volatility_{w}": f"({clip('_cv', 0, 5)}) / 5", f"volume_spike_{w}": f"({clip('_sp', 0, 3)}) / 3"})


@operator
def add_candle_vol_size_features(window: int = 20, eps: float = E8) -> Feature:
    f = Feature().let(_b="abs(Close - Open)", _r="High - Low", _vm=mean("Volume", window), _vd=median("Volume", window)).let(_p="_b * _r", _h=div("_b * _r", f"(_b + _r + {num(eps)})"))
    f.let(_pm=mean("_p", window), _hm=mean("_h", window), _v=div("Volume", f"(_vm + _vd + {num(eps)})"))
    f.out(**{f"candle_vol_size_{n}": div(div(f"_{n[0]}", f"(_{n[0]}m + {num(eps)})"), f"(_v + {num(eps)})") for n in ("prod", "hmean")})
    return f.out(**{f"candle_vol_size_{n}_tanh": f"tanh(candle_vol_size_{n})" for n in ("prod", "hmean")}, **{f"candle_vol_size_{n}_log": f"sign(candle_vol_size_{n}) * ln(1 + abs(candle_vol_size_{n}))" for n in ("prod", "hmean")})

