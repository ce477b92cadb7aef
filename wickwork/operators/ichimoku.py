"""Ichimoku lines, the Kagi conversion line, Fibonacci levels and volume channels."""

from __future__ import annotations

from ..functions.sql import HL2, HLC3, bfill, clip, div, ffill, flag, high, lag, low, num, over, roll, std, total
from .base import Feature, K, Rec, middle, operator, rsi, true_range

E8, E10 = 1e-8, 1e-10


def _ichimoku(f: Feature, hi: str, lo: str, tenkan: int, kijun: int, senkou: int, base: str, names: tuple[str, ...], fill: bool) -> Feature:
    f.let(_t=middle(hi, lo, tenkan, 1), _k=middle(hi, lo, kijun, 1), _b=middle(hi, lo, senkou, 1)).let(_ab="(_t + _k) / 2").let(_a1=lag("_ab"), _b1=lag("_b"))
    f.let(**{f"_n{i}": div(x, base) for i, x in enumerate(("_t", "_k", "_a1", "_b1"))})
    return f.out(**{n: ffill(f"_n{i}") if fill else f"_n{i}" for i, n in enumerate(names)})


@operator
def add_normalized_ichimoku(tenkan_period: int = 9, kijun_period: int = 26, senkou_period: int = 52, normalization_base: str = "Close", fill_na: bool = True) -> Feature:
    """Lines over the base column; a base of zero gives null, filled forward."""
    return _ichimoku(Feature(), "High", "Low", tenkan_period, kijun_period, senkou_period, normalization_base, ("tenkan_sen_norm", "kijun_sen_norm", "senkou_span_a_norm", "senkou_span_b_norm"), fill_na)


@operator
def add_normalized_ichimoku_htf(tenkan_period: int = 108, kijun_period: int = 312, senkou_period: int = 624, normalization_base: str = "Close", fill_na: bool = True) -> Feature:
    return _ichimoku(Feature(), "High", "Low", tenkan_period, kijun_period, senkou_period, normalization_base, ("tenkan_sen_norm_htf", "kijun_sen_norm_htf", "senkou_span_a_norm_htf", "senkou_span_b_norm_htf"), fill_na)


@operator
def add_normalized_ichimoku_on_rsi(rsi_period: int = 14, tenkan_period: int = 9, kijun_period: int = 26, senkou_period: int = 52, fill_na: bool = True, prefix: str = "rsi14_ichimoku") -> Feature:
    r = f"RSI_{rsi_period}"
    f = rsi(Feature(), "_r", rsi_period).out(**{r: "_r"})
    return _ichimoku(f, r, r, tenkan_period, kijun_period, senkou_period, r, tuple(f"{prefix}_{x}" for x in ("tenkan_norm", "kijun_norm", "senkou_a_norm", "senkou_b_norm")), fill_na)


@operator
def add_tenkan_breakout(period: int = 9) -> Feature:
    f = Feature().out(tenkan_sen=f"(({high('High', period, None, -1)}) + ({low('Low', period, None, -1)})) / 2").let(_t=lag("tenkan_sen"), _c=lag("Close"))
    return f.out(tenkan_breakout=flag("Close > tenkan_sen AND _c <= _t"))


@operator
def kagi_conversion_line(conversion_period: int = 9, baseline_period: int = 26, vortex_period: int = 14) -> Feature:
    """Kagi line, drifting baseline and vortex difference, each scaled over 100 rows; looks ahead when smoothing."""
    w = 100
    f = true_range(Feature(causal=False), strict=True).let(_hl=HL2, _th=f"{num(1.5)} * ({roll('avg', 'High - Low', conversion_period)})", _vp=f"abs(High - {lag('Low')})", _vn=f"abs(Low - {lag('High')})")
    f.let(_kagi=Rec(K.kagi, ("Close", "_th"), (conversion_period,)), _theta=Rec(K.theta, ("_hl",), (baseline_period,)))
    f.let(_a=total("_vp", vortex_period), _b=total("_vn", vortex_period), _c=total("_tr", vortex_period)).let(_vortex=f"{div('_a', '_c')} - {div('_b', '_c')}", _diff="_kagi - _theta")
    parts = {"kagi_conversion": "_kagi", "phase_baseline": "_theta", "vortex_cloud": "_vortex", "kagi_phase_diff": "_diff"}
    f.let(**{f"{x}_l": low(x, w) for x in parts.values()}, **{f"{x}_h": high(x, w) for x in parts.values()})
    f.let(**{f"{x}_n": div(f"{x} - {x}_l", f"({x}_h - {x}_l + {num(E10)})") for x in parts.values()})
    return f.out(**{n: bfill(f"{x}_n" if n == "phase_baseline" else f"2 * {x}_n - 1") for n, x in parts.items()})


@operator
def get_fibonacci_flags(window: int = 300, threshold: float = 0.003) -> Feature:
    """Distance to five retracement levels; the trend is up if the high came after the low within the rows before."""
    f = Feature().let(_hi=high("High", window), _lo=low("Low", window), _ph=high("High", window, None, -1), _pl=low("Low", window, None, -1))
    # Of equal extremes the first.
    f.let(_ah=f"max_by(seq, named_struct('x', High, 's', -seq)) {over(-window, -1)}", _al=f"min_by(seq, named_struct('x', Low, 's', seq)) {over(-window, -1)}")
    f.let(_ok=f"seq > {window} AND (_hi - _lo) / nullif(_lo, 0) >= {num(threshold)}", _up="_ah > _al", _r="_hi - _lo")
    level = lambda r: f"CASE WHEN _up THEN _hi - {num(r)} * _r ELSE _lo + {num(r)} * _r END"
    return f.out(**{f"fib_dist_{round(r * 1000)}": f"CASE WHEN _ok THEN (Close - ({level(r)})) / (Close + {num(E10)}) END" for r in (0.236, 0.382, 0.5, 0.618, 0.786)})


@operator
def fib_dist_050_last50(window: int = 50, threshold: float = 0.03) -> Feature:
    f = Feature().let(_hi=high("High", window, None, -1), _lo=low("Low", window, None, -1)).let(_r="_hi - _lo", _m="(_hi + _lo) / 2").let(_y=div("Close - _m", "_r"))
    return f.out(fib_dist_050_last50=f"CASE WHEN seq > {window} AND _r / nullif(_lo, 0) >= {num(threshold)} THEN {clip('_y', -1, 1)} ELSE CAST(-1 AS DOUBLE) END")


@operator
def fibo_dinamic(period: int = 300, eps: float = E8) -> Feature:
    f = Feature().let(_hi=high("High", period), _lo=low("Low", period)).let(_y=div("Close - (_hi + _lo) / 2", f"(_hi - _lo + {num(eps)})"))
    return f.out(**{f"fibo_dinamic_{period}": clip("_y", -1, 1)})


@operator
def fibo_3_lines_dinamic(length: int = 200, src: str = "hlc3", mult: float = 3.0, lines_to_use: tuple[float, float, float] = (0.236, 0.5, 1.0), eps: float = E10) -> Feature:
    """Where the price stands against three lines around a basis; the basis divides by the sum of prices."""
    up, _, dn = lines_to_use
    source = {"hlc3": HLC3, "close": "Close", "open": "Open", "high": "High", "low": "Low"}[src]
    f = Feature().let(_p=source).let(_a=total("_p * Volume", length), _b=total("_p", length), _s=std("_p", length)).let(_m=div("_a", f"(_b + {num(eps)})"), _d=f"{num(mult)} * _s").let(_u=f"_m + {num(up)} * _d", _l=f"_m - {num(dn)} * _d")
    f.let(_hi=f"CASE WHEN Close >= _u THEN CAST(-1 AS DOUBLE) WHEN Close > _m AND _u > _m THEN {div('Close - _m', f'(_u - _m + {num(eps)})')} ELSE CAST(0 AS DOUBLE) END")
    f.let(_lo=f"CASE WHEN Close <= _l THEN CAST(-1 AS DOUBLE) WHEN Close < _m AND _m > _l THEN {div('_l - Close', f'(_l - _m + {num(eps)})')} ELSE CAST(0 AS DOUBLE) END")
    return f.out(fibo_upper=clip("_hi", -1, 1), fibo_basis=div("Close - _m", f"(_d + {num(eps)})"), fibo_lower=clip("_lo", -1, 1))
