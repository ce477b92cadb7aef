"""Momentum and oscillators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import HL2, HLC3, bfill, clip, diff, div, ffill, fires_within, flag, high, lag, low, mean, minmax, num, over, pct, roll, std, total, upto, whole
from .base import OPERATORS, Feature, ema, operator, rsi, rsi_plain, seeded, true_range, zscore_all

E8, E10 = 1e-8, 1e-10


@operator
def compute_rsi(period: int = 14, eps: float = E8) -> Feature:
    f = rsi_plain(Feature(), "_rsi", period, eps)
    return f.out(rsi_manual="_rsi")


@operator
def ta_rsi(period: int = 14) -> Feature:
    return rsi(Feature(), "_r", period).out(**{f"RSI_{period}": "_r"})


@operator
def add_rsi_level_signal(rsi_period: int = 14, lookback_window: int = 200, tolerance: float = 0.03, min_touch_count: int = 2) -> Feature:
    """1 on a symbol's last row if its RSI is near a density cluster of the local extremes of the last rows."""
    f = rsi(Feature(causal=False), "rsi", rsi_period)
    f.outputs.append("rsi")
    f.let(_n="count(*) OVER (PARTITION BY symbol)", _a=lag("rsi"), _b=lag("rsi", -1))
    inner = f"seq > _n - {lookback_window} + 1 AND seq < _n AND _a IS NOT NULL"
    f.let(_x=f"CASE WHEN {inner} AND ((rsi > _a AND rsi > _b) OR (rsi < _a AND rsi < _b)) THEN rsi END")
    f.let(_eps=f"avg(_x) OVER (PARTITION BY symbol) * {num(tolerance)}", _has=flag("_x IS NOT NULL"), _last="max(CASE WHEN seq = _n THEN rsi END) OVER (PARTITION BY symbol)")
    # In units of the reach: a core has enough points within 1, cores within 1 of each other are one cluster, named by its first core in time.
    f.let(_z=div("_x", "_eps")).let(_near="count(_z) OVER (PARTITION BY symbol, _has ORDER BY _z RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
    f.let(_core=f"CASE WHEN _has = 1 AND _near >= {min_touch_count} THEN _z END").let(_is=flag("_core IS NOT NULL")).let(_gap="_core - lag(_core) OVER (PARTITION BY symbol, _is ORDER BY _core, seq)")
    f.let(_no="sum(CASE WHEN _gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, _is ORDER BY _core, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    f.let(_first="CASE WHEN _is = 1 THEN min(seq) OVER (PARTITION BY symbol, _is, _no) END")
    # The other points join the cluster of a core within reach, of two the earlier.
    side = lambda fn, x, rows: f"{fn}({x}) IGNORE NULLS OVER (PARTITION BY symbol, _has ORDER BY _z, seq ROWS BETWEEN {rows})"
    below, above = "UNBOUNDED PRECEDING AND CURRENT ROW", "CURRENT ROW AND UNBOUNDED FOLLOWING"
    f.let(_pz=side("last_value", "_core", below), _pf=side("last_value", "_first", below), _nz=side("first_value", "_core", above), _nf=side("first_value", "_first", above))
    f.let(_own="CASE WHEN _has = 1 THEN coalesce(_first, least(CASE WHEN _z - _pz <= 1 THEN _pf END, CASE WHEN _nz - _z <= 1 THEN _nf END)) END")
    f.let(_level="CASE WHEN _own IS NOT NULL THEN avg(_x) OVER (PARTITION BY symbol, _own) END")
    f.let(_hit=whole("max", flag(f"abs(_last - _level) / nullif(_level, 0) <= {tolerance}")))
    return f.out(rsi_near_level=flag("seq = _n AND _hit = 1"))


@operator
def calculate_rsi_slope(length: int = 50, lookback: int = 10, slope_coeff: float = 10) -> Feature:
    """tanh of the slope of a line through the RSI of the rows before."""
    frame = over(-lookback, -1)
    f = rsi(Feature(), "_r", length).let(_x="CASE WHEN _r IS NOT NULL THEN CAST(seq AS DOUBLE) END")
    return f.out(rsi_slope=f"CASE WHEN count(_r) {frame} = {lookback} THEN tanh(regr_slope(_r, _x) {frame} * {num(slope_coeff)}) END")


@operator
def compute_cmf(length: int = 20, eps: float = E8) -> Feature:
    f = Feature().let(_mf=f"({div('(Close - Low) - (High - Close)', f'(High - Low + {num(eps)})')} * Volume)")
    return f.let(_a=total("_mf", length), _b=total("Volume", length)).out(cmf_manual=div("_a", f"(_b + {num(eps)})"))


@operator
def calc_stochastic_rsi(rsi_period: int = 14, stoch_period: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> Feature:
    f = rsi_plain(Feature(), "_r", rsi_period, E10, first_row=False)
    f.let(_lo=low("_r", stoch_period), _hi=high("_r", stoch_period)).let(_s=div("_r - _lo", f"(_hi - _lo + {num(E10)})"))
    f.out(stoch_rsi_k=mean("_s", smooth_k)).out(stoch_rsi_d=mean("stoch_rsi_k", smooth_d))
    f.let(_k1=lag("stoch_rsi_k"), _d1=lag("stoch_rsi_d")).let(_c=flag("_k1 < _d1 AND stoch_rsi_k >= stoch_rsi_d"))
    return f.out(stoch_cross_bull=fires_within("_c", 3))


@operator
def find_bullish_rsi_divergence(rsi_period: int = 7, lookback: int = 5) -> Feature:
    """Divergence between the lows of price and RSI; pivots look lookback // 2 rows ahead."""
    frame = over(-(lookback // 2), (lookback - 1) // 2)
    f = rsi(Feature(causal=False), "_r", rsi_period)
    pivot = lambda x: f"coalesce(count({x}) {frame} = {lookback} AND min({x}) {frame} = {x}, false)"
    f.out(**{f"price_low_{lookback}": pivot("Low"), f"rsi_low_{lookback}": pivot("_r")})
    p, q = f"price_low_{lookback}", f"rsi_low_{lookback}"
    f.let(_at=f"max(CASE WHEN {p} THEN seq END) {over(1 - 2 * lookback, -1)}")
    f.let(**{f"_l{k}": lag("Low", k) for k in range(1, 2 * lookback)}, **{f"_r{k}": lag("_r", k) for k in range(1, 2 * lookback)})
    pick = lambda x: "CASE seq - _at " + " ".join(f"WHEN {k} THEN _{x}{k}" for k in range(1, 2 * lookback)) + " END"
    span = lambda fn: "CASE seq - _at " + " ".join(f"WHEN {k} THEN {fn}(_r, {', '.join(f'_r{j}' for j in range(1, k + 1))})" for k in range(1, 2 * lookback)) + " END"
    f.let(_pl=pick("l"), _pr=pick("r"), _top=span("greatest"), _bot=span("least"))
    kind = "((Low < _pl AND _r > _pr) OR (Low > _pl AND _r < _pr) OR (abs(Low - _pl) < CAST(0.01 AS DOUBLE) * _pl AND _r > _pr))"
    f.let(_fire=flag(f"{p} AND {q} AND seq > {2 * lookback} AND _at IS NOT NULL AND {kind}"))
    power = f"CASE WHEN _fire = 1 AND _top > _bot THEN round({div('_r - _pr', '(_top - _bot)')}, 3) ELSE CAST(0 AS DOUBLE) END"
    return f.out(**{f"has_divergence_{lookback}": "_fire", f"divergence_power_{lookback}": power})


@operator
def rsi_divergence(length: int = 14, lbL: int = 5, lbR: int = 5, signal_duration: int = 5) -> Feature:
    """Lows of price and RSI in the middle of lbL + lbR + 1 rows against the nearest such pair before."""
    w = lbL + lbR + 1
    frame = over(-lbL, lbR)
    f = rsi(Feature(), "rsi", length)
    f.outputs.append("rsi")
    f.let(_p=f"coalesce(count(rsi) {frame} = {w} AND min(Low) {frame} = Low AND min(rsi) {frame} = rsi, false)")
    f.let(_pl=ffill("CASE WHEN _p THEN Low END", -lbR - 1), _pr=ffill("CASE WHEN _p THEN rsi END", -lbR - 1))
    f.let(_b=flag("_p AND Low < _pl AND rsi > _pr"), _h=flag("_p AND Low > _pl AND rsi < _pr"))
    f.let(_b=f"coalesce({lag('_b', lbR)}, 0)", _h=f"coalesce({lag('_h', lbR)}, 0)")
    return f.out(bull_signal=fires_within("_b", signal_duration - 1), hidden_bull_signal=fires_within("_h", signal_duration - 1))


@operator
def calculate_smooth_divergence(window: int = 14) -> Feature:
    """A weighted divergence of RSI, stochastic, MACD and OBV, scaled by its largest value."""
    f = rsi(Feature(causal=False), "_rsi", 14)
    f.let(_lo=low("Low", 3), _hi=high("High", 3)).let(_k0=f"100 * {div('Close - _lo', '(_hi - _lo)')}").let(_k=mean("_k0", 3))
    f.let(_fast=seeded("Close", 12), _slow=seeded("Close", 26)).let(_m="_fast - _slow")
    f.let(_dir=diff("Close")).let(_v="CASE WHEN _dir < 0 THEN -Volume WHEN _dir = 0 THEN 0 ELSE Volume END").let(_obv=upto("sum", "_v"))
    f.let(_om=mean("_obv", window), _os=std("_obv", window), _ml=low("_m", window, 1, -1), _mh=high("_m", window, 1, -1))
    f.let(
        _v1="(_rsi - 30) / 40", _v2="(_k - 20) / 60",
        _v3="CASE WHEN _m IS NULL THEN NULL WHEN _mh IS NULL THEN NULL WHEN _mh <> _ml THEN (_m - _ml) / nullif(_mh - _ml, 0) * 2 - 1 ELSE CAST(-1 AS DOUBLE) END",
        _v4=f"tanh({div('_obv - _om', f'(_os + {num(E10)})')})",
    )
    f.let(_way="((_v2 - _v1) * CAST(0.35 AS DOUBLE) + (_v3 - _v2) * CAST(0.25 AS DOUBLE) + (_v4 - _v3) * CAST(0.25 AS DOUBLE)) / CAST(0.85 AS DOUBLE)", _ok=flag("_v1 IS NOT NULL AND _v2 IS NOT NULL AND _v3 IS NOT NULL AND _v4 IS NOT NULL"))
    spread = div("greatest(_v1, _v2, _v3, _v4) - least(_v1, _v2, _v3, _v4)", f"((abs(_v1) + abs(_v2) + abs(_v3) + abs(_v4)) / 4 + {num(E10)})")
    f.let(_raw=f"CASE WHEN seq <= {window} THEN CAST(0 AS DOUBLE) WHEN _ok = 1 THEN _way * {spread} END").let(_top=whole("max", "abs(_raw)"))
    return f.out(divergence="CASE WHEN _top > 0 THEN _raw / nullif(_top, 0) ELSE _raw END")


@operator
def add_hidden_divergence(rsi_period: int = 14) -> Feature:
    f = rsi_plain(Feature(), "_r", rsi_period, E10).let(_dc=diff("Close"), _dr=diff("_r"))
    return f.out(hidden_div=f"{flag('_dc > 0 AND _dr < 0')} - {flag('_dc < 0 AND _dr > 0')}")


@operator
def add_rsi_divergence(window: int = 14, lookback: int = 5) -> Feature:
    f = rsi(Feature(), "_r", window).out(rsi_low=low("_r", lookback, None, -1), price_low=low("Low", lookback, None, -1))
    f.let(_a=diff("rsi_low"), _b=diff("price_low"))
    return f.out(bullish_div=flag("_a > 0 AND _b < 0"))


@operator
def rsi_stochastic_hybrid(rsi_window: int = 14, stoch_window: int = 14, smooth: int = 3, price_col: str = "Close") -> Feature:
    f = rsi_plain(Feature(), "_r", rsi_window, E8, price_col, first_row=False)
    f.let(_lo=low("Low", stoch_window), _hi=high("High", stoch_window)).let(_k=f"100 * {div(f'{price_col} - _lo', f'(_hi - _lo + {num(E8)})')}").let(_ks=mean("_k", smooth))
    return f.let(_y="CAST(0.5 AS DOUBLE) * (_r / 50 - 1) + CAST(0.5 AS DOUBLE) * (_ks / 50 - 1)").out(rsi_stoch_hybrid=clip("_y", -1, 1))


def adaptive_rsi(df: DataFrame, rsi_period: int = 14, atr_period: int = 14, normalize: bool = True) -> DataFrame:
    """RSI of the mean gain against the mean loss over one window for each symbol, scaled to 0..1 over the whole series.

    Every row asks for a period, clip(rsi_period / (atr / mean atr), 5, 30), or ``rsi_period`` while the ATR is short; the
    longest of a symbol's periods is its window. Windows without a gain or without a loss are null.
    """
    some = lambda x: f"CASE WHEN {x} = 0 THEN {num(E10)} ELSE {x} END"
    f = true_range(Feature()).let(_d=diff("Close"), _a=mean("_tr", atr_period)).let(_atr=some("_a")).let(_b=mean("_atr", atr_period)).let(_avg=some("_b"))
    f.let(_p=clip(div(str(rsi_period), div("_atr", "_avg")), 5, 30)).let(_q=f"coalesce(floor(_p), {rsi_period})").out(_n=f"CAST({whole('max', '_q')} AS INT)", _last=f"collect_list(_d) {over(1 - max(30, rsi_period), 0)}")
    window = F.slice("_last", -F.col("_n"), F.col("_n"))
    part = lambda keep: F.filter(window, keep)
    average = lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x)), F.size(xs))
    up, down = average(part(lambda x: x > 0)), average(part(lambda x: x < 0))
    rows = f.add_to(df).withColumn("_y", F.when(F.size("_last") >= F.col("_n"), 100 - 100 / (1 + up / (down + E10))))
    if normalize:
        every = Window.partitionBy("symbol")
        low_, high_ = F.min("_y").over(every), F.max("_y").over(every)
        rows = rows.withColumn("_y", F.when(high_ > low_, F.try_divide(F.col("_y") - low_, high_ - low_)).when(F.col("_y").isNotNull(), 0.0))
    return rows.select(*[c for c in df.columns if c != "adaptive_rsi"], F.col("_y").alias("adaptive_rsi"))


OPERATORS["adaptive_rsi"] = adaptive_rsi


@operator
def compute_trix_elder(trix_period: int = 30, ema_period: int = 50, eps: float = E8) -> Feature:
    """TRIX and Elder's powers, each divided by its largest absolute value."""
    f = Feature(causal=False).let(_1=ema("Close", trix_period), _e=ema("Close", ema_period)).let(_2=ema("_1", trix_period)).let(_3=ema("_2", trix_period))
    f.let(_t=f"100 * {pct('_3')}", _bull="High - _e", _bear="Low - _e")
    f.let(**{f"_{x}f": f"coalesce({ffill(f'_{x}')}, {bfill(f'_{x}')}, 0)" for x in ("t", "bull", "bear")})
    f.let(**{f"_{x}m": whole("max", f"abs(_{x}f)") for x in ("t", "bull", "bear")})
    scaled = lambda x: f"_{x}f / (_{x}m + {num(eps)})"
    return f.out(TRIX=scaled("t"), BullPower=scaled("bull"), BearPower=scaled("bear"))


@operator
def compute_combined_indicators(stc_fast: int = 23, stc_slow: int = 50, stc_cycle: int = 10, fisher_length: int = 10, keltner_atr_period: int = 20, keltner_multiplier: float = 2) -> Feature:
    """Trend cycle, Fisher transform and Keltner width, cut at their 1 % and 99 % quantiles and standardised."""
    f = true_range(Feature(causal=False)).let(_hl=HL2, _hlc=HLC3)
    f.let(_ef=ema("Close", stc_fast), _es=ema("Close", stc_slow), _etr=ema("_tr", keltner_atr_period), _eh=ema("_hlc", keltner_atr_period))
    f.let(_macd="_ef - _es", _lo=low("_hl", fisher_length, 1), _hi=high("_hl", fisher_length, 1)).let(_sig=ema("_macd", stc_cycle))
    f.let(_s0=f"CASE WHEN abs(_sig) < {num(E10)} THEN CAST(0 AS DOUBLE) ELSE (_macd - _sig) / nullif(_sig, 0) END", _x0=f"CASE WHEN abs(_hi - _lo) < {num(E10)} THEN CAST(0 AS DOUBLE) ELSE 2 * ((_hl - _lo) / nullif(_hi - _lo, 0)) - 1 END")
    f.let(_s1=clip("_s0", -1, 1), _x1=clip("_x0", -0.999, 0.999)).let(_x2="ln((1 + _x1) / (1 - _x1)) / 2")
    f.let(_STC=ema("_s1", stc_cycle), _Fisher=ema("_x2", fisher_length)).let(_KeltnerWidth=f"2 * {num(keltner_multiplier)} * {div('_etr', '_eh')}")
    for name in ("STC", "Fisher", "KeltnerWidth"):
        f.let(**{f"_{name}q1": f"percentile(_{name}, 0.01D) OVER (PARTITION BY symbol)", f"_{name}q9": f"percentile(_{name}, 0.99D) OVER (PARTITION BY symbol)"})
        f.let(**{f"_{name}c": f"least(greatest(_{name}, _{name}q1), _{name}q9)"})
        zscore_all(f, f"_{name}z", f"_{name}c", E10).out(**{name: f"_{name}z"})
    return f


@operator
def add_macd(fast: int = 12, slow: int = 26, signal: int = 9, window_norm: int = 100, eps: float = E8) -> Feature:
    f = Feature().let(_a=ema("Close", fast), _b=ema("Close", slow)).let(_m="_a - _b").let(_s=ema("_m", signal)).let(_h="_m - _s")
    return f.let(_lo=low("_h", window_norm), _hi=high("_h", window_norm)).out(macd_norm=minmax("_h", "_lo", "_hi", eps))


@operator
def ppo(source_col: str = "Close", div_lookback_period: int = 55, fast: int = 12, slow: int = 26, smoother: int = 2, signal_duration: int = 3, long_term_div: bool = True) -> Feature:
    """PPO and its bullish divergence signal: troughs of the oscillator against troughs of price."""
    f = Feature().let(_a=ema(source_col, fast), _b=ema(source_col, slow)).let(_p=f"100 * {div('_a - _b', '_b')}").out(PPO=mean("_p", smoother))
    f.let(**{f"_p{k}": lag("PPO", k) for k in (1, 2)}, **{f"_l{k}": lag("Low", k) for k in range(1, 6)})
    f.let(_lowest=low("Low", div_lookback_period, 1, -1), _pmin=low("PPO", div_lookback_period, 1), _low5=low("Low", 5, 1, -1))
    f.let(_trough=flag("PPO > _p1 AND _p1 < _p2"), _pmin1=lag("_pmin"))
    low_turn = "(Low > _l1 AND _l1 < _l2) OR (Low > _l1 AND _l1 = _l2 AND _l2 < _l3) OR (Low > _l1 AND _l1 = _l2 AND _l2 = _l3 AND _l3 < _l4) OR (Low > _l1 AND _l1 = _l2 AND _l2 = _l3 AND _l3 = _l4 AND _l4 < _l5)"
    f.let(_pt=flag(low_turn)).let(_pt1=lag("_pt"), _tc=total("_trough", 3, None, -1))
    when = lambda cond, x: ffill(f"CASE WHEN {cond} = 1 THEN {x} END")
    f.let(_w0=when("_trough", "_p1"), _c0=when("_pt", "_l1"), _y0=when("_trough", "CAST(_pt1 AS DOUBLE) * _low5"), _t0=when("_pt", "_lowest"))
    f.let(_cppo=lag("_w0", 1), _pppo=lag("_w0", 2), _cpb=lag("_c0", 1), _y6=lag("_y0", 2), _ltf=lag("_t0", 2), _delayed="CASE WHEN _pt = 1 AND _tc > 0 THEN _l1 ELSE CAST(0 AS DOUBLE) END")
    f.let(_i4=flag("_cppo > _pmin1"))
    fire = "(_cpb < _y6 AND _trough = 1 AND _cppo > _pppo) OR (_delayed < _y6 AND _cppo > _pppo)"
    if long_term_div:
        fire += " OR (_trough = 1 AND _i4 = 1 AND _cpb < _ltf) OR (_i4 = 1 AND _delayed < _ltf)"
    return f.let(_fire=flag(fire)).out(bullish_signal=fires_within("_fire", signal_duration))


@operator
def VW_MACD(fast: int = 12, slow: int = 26, signal: int = 9, normalize: bool = True, eps: float = E8) -> Feature:
    f = Feature(causal=False).let(_cv="Close * Volume")
    f.let(**{f"_n{n}": total("_cv", n) for n in (fast, slow)}, **{f"_v{n}": total("Volume", n) for n in (fast, slow)})
    vwma = lambda n: f"(_n{n} / CASE WHEN _v{n} = 0 THEN {num(eps)} ELSE _v{n} END)"
    f.let(_m=f"{vwma(fast)} - {vwma(slow)}").let(_s=ema("_m", signal)).let(_h="_m - _s")
    f.let(**{f"_{x}f": f"coalesce({ffill(f'_{x}')}, {bfill(f'_{x}')}, 0)" for x in "msh"})
    if not normalize:
        return f.out(vw_macd="_mf", vw_signal="_sf", vw_hist="_hf")
    f.let(**{f"_{x}x": whole("max", f"abs(_{x}f)") for x in "msh"})
    return f.out(**{n: f"_{x}f / (_{x}x + {num(eps)})" for n, x in (("vw_macd", "m"), ("vw_signal", "s"), ("vw_hist", "h"))})


@operator
def EWO(src_col: str = "Close", sma1length: int = 5, sma2length: int = 35, UsePercent: bool = True) -> Feature:
    f = Feature().let(_a=mean(src_col, sma1length, 1), _b=mean(src_col, sma2length, 1))
    return f.out(EWO=f"100 * {div('_a - _b', src_col)}" if UsePercent else "_a - _b")


@operator
def bollinger_awesome_alert(bb_use_ema: bool = False, bb_filter: bool = False, sqz_filter: bool = False, bb_length: int = 20, bb_mult: float = 2.0, fast_ma_len: int = 3, nLengthSlow: int = 34, nLengthFast: int = 5, sqz_length: int = 100, sqz_threshold: float = 50) -> Feature:
    f = true_range(Feature()).let(_hl=HL2)
    f.let(fast_ma=ema("Close", fast_ma_len), **({"bb_basis": ema("Close", bb_length)} if bb_use_ema else {}))
    f.outputs += ["fast_ma", "bb_basis"]
    if not bb_use_ema:
        f.let(bb_basis=mean("Close", bb_length))
    f.let(_dev=f"{num(bb_mult)} * ({std('Close', bb_length)})", _s1=mean("_hl", nLengthFast), _s2=mean("_hl", nLengthSlow)).out(xSMA1_SMA2="_s1 - _s2")
    f.let(_x1=lag("xSMA1_SMA2"), _f1=lag("fast_ma"), _b1=lag("bb_basis"), _spread="2 * _dev").let(_ms=mean("_spread", sqz_length))
    f.out(AO="CASE WHEN xSMA1_SMA2 >= 0 THEN CASE WHEN xSMA1_SMA2 > _x1 THEN 1 ELSE 2 END ELSE CASE WHEN xSMA1_SMA2 > _x1 THEN -1 ELSE -2 END END", bb_squeeze=f"100 * {div('_spread', '_ms')}", atr=mean("_tr", 14))
    up, dn = "fast_ma > bb_basis AND _f1 <= _b1 AND Close > bb_basis AND abs(AO) = 1", "fast_ma < bb_basis AND _f1 >= _b1 AND Close < bb_basis AND abs(AO) = 2"
    if bb_filter:
        up, dn = f"{up} AND Close < bb_basis + _dev", f"{dn} AND Close > bb_basis - _dev"
    if sqz_filter:
        up, dn = f"{up} AND bb_squeeze > {sqz_threshold}", f"{dn} AND bb_squeeze > {sqz_threshold}"
    return f.out(BA_Signal=f"CASE WHEN {up} THEN 1 WHEN {dn} THEN -1 ELSE 0 END")


@operator
def safe_fisher_transform(column: str = "Close", epsilon: float = 1e-7) -> Feature:
    f = Feature().let(_x=clip(column, epsilon - 1, 1 - epsilon))
    return f.out(**{f"{column}_fisher": "ln((1 + _x) / (1 - _x)) / 2"})


@operator
def add_fisher_transform(period: int = 10, eps: float = E8, name: str = "fisher") -> Feature:
    f = Feature().let(_hl=HL2).let(_lo=low("_hl", period, None, -1), _hi=high("_hl", period, None, -1))
    f.let(_x=div("_hl - _lo", f"(_hi - _lo + {num(eps)})")).let(_q=div("1 + _x", f"(1 - _x + {num(eps)})")).let(_y="CASE WHEN _q > 0 THEN ln(_q) / 2 END")
    return f.out(**{name: clip("_y", -1, 1)})


@operator
def add_price_acceleration(window: int = 5) -> Feature:
    f = Feature(causal=False).let(_d=diff("Close"), _p=pct("Close")).let(_dd=diff("_d"), _s=whole("stddev_samp", "_p")).let(_m=mean("_dd", window))
    return f.out(Acceleration="CASE WHEN _s > 0 THEN tanh(_m / nullif(_s, 0)) ELSE _m * 0 END")
