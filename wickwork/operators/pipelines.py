"""Feature sets: single features of the full set, and the sets that models are trained on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sql import diff, div, lag, mean, num, over, total, upto
from .averages import different_EMA, different_MA
from .base import OPERATORS, Feature, ema, operator, rsi, rsi_plain
from .ichimoku import add_normalized_ichimoku, add_normalized_ichimoku_htf, add_normalized_ichimoku_on_rsi, fib_dist_050_last50, fibo_dinamic
from .label import add_target_column_mod
from .levels import add_all_features, add_breakdown_flags, add_breakout_flags
from .momentum import add_price_acceleration, calc_stochastic_rsi, compute_combined_indicators, compute_trix_elder
from .sessions import quarter_theory
from .stats import rolling_statistics, rolling_wasserstein
from .volatility import Keltner_func, add_atr_normalized, super_trend
from .volume import VWAP, add_liquidity_imbalance, add_normalized_volume_profile, add_volume_features, add_volume_filter, calculate_LISS, volume_base_indicators

E8 = 1e-8
# The columns that models keep.
SELECTED = (
    "target", "Data", "Volume", "Open", "Close", "High", "Low",
    "senkou_span_a_norm", "senkou_span_b_norm", "KeltnerWidth", "atr_14_norm", "breakout_in_5", "rsi50_ichimoku_senkou_a_norm", "RSI7_1H_norm",
    "kijun_sen_norm", "dist_to_fib_786", "tenkan_sen_norm_htf", "linreg", "TRIX", "vwma20", "volume_filter",
)
# The columns that are dropped for their low importance.
UNIMPORTANT = (
    "lower_low_count", "AD", "body_signed", "bull_inside_bar", "MFI", "breakout_now", "bull_hammer_manual", "impulse_candle_detected",
    "order_block_volume", "bull_morning_star_manual", "bull_pin_bar", "OBV", "volume_ratio", "bull_three_white_manual", "dist_to_fib_500",
    "stoch_cross_bull", "accel_volume", "accel_volume_fast", "higher_high_count", "VP_Change_Norm", "weighted_direction", "rsi_low_5", "divergence_power_20",
    "has_divergence_20", "divergence_power_5", "has_divergence_5", "rsi_low_20", "price_low_20", "weighted_supertrend",
    "price_low_5", "Close_lag1_z", "dynamic_direction", "dynamic_supertrend", "supertrend_direction",
    "fib_touch_count_786", "CMF", "stoch_rsi_k", "sma10", "bos", "dist_to_fib_382", "fib_touch_count_618", "hybrid_supertrend", "hybrid_direction", "supertrend",
    "sma20", "dist_to_fib_618", "VP_SMA_Norm", "EFI", "stoch_rsi_d", "norm_adx", "RSI7_lag", "RSI21_lag", "VP_Norm_Lag", "optimized_direction",
    "ADX_20", "atr_14", "STC", "senkou_span_a_norm", "Fisher",
)


@operator
def lag_features(price_col: str = "Close", ratio_lags: tuple[int, ...] = (1, 3, 8), log_lags: tuple[int, ...] = (1, 5, 8)) -> Feature:
    f = Feature().let(_m20=mean(price_col, 20), _m100=mean(price_col, 100))
    lags = sorted({*ratio_lags, *[k + 1 for k in ratio_lags], *log_lags})
    f.let(**{f"_x{k}": lag(price_col, k) for k in lags}, **{f"_a{k}": lag("_m20", k + 1) for k in ratio_lags}, **{f"_b{k}": lag("_m100", k) for k in log_lags})
    return f.out(
        **{f"{price_col}_lag{k}_diff_ratio": div(f"_x{k} - _x{k + 1}", f"(_a{k} + {num(E8)})") for k in ratio_lags},
        **{f"{price_col}_log_lag{k}": f"ln(nullif(abs({div(f'_x{k}', f'(_b{k} + {num(E8)})')}), 0))" for k in log_lags},
    )


@operator
def linear_regression(length: int = 20) -> Feature:
    """The line through the last rows, at the last one, against the close; and as it was ``length`` rows ago."""
    frame = over(1 - length, 0)
    f = Feature().let(_x="CAST(seq AS DOUBLE)").let(_l=f"CASE WHEN count(Close) {frame} >= {length} THEN regr_slope(Close, _x) {frame} * seq + regr_intercept(Close, _x) {frame} END").out(linreg=f"{div('_l', f'(Close + {num(E8)})')} - 1")
    return f.out(linreg_lag=lag("linreg", length))


@operator
def volume_acceleration() -> Feature:
    f = Feature().let(_d5=diff("Volume", 5), _d1=diff("Volume"), _m=mean("Volume", 20))
    return f.out(accel_volume=div(diff("_d5"), f"(_m + {num(E8)})"), accel_volume_fast=div(diff("_d1"), f"(_m + {num(E8)})"))


@operator
def rsi_set(length: int = 20) -> Feature:
    f = Feature()
    for n in (7, 21, 100):
        rsi(f, f"_rsi{n}", n)
    return f.out(**{f"RSI{n}": f"_rsi{n}" for n in (7, 21, 100)}).out(RSI21_diff=diff("RSI21", length // 2))


@operator
def volume_indicators(length: int = 20) -> Feature:
    """Changes of on-balance volume and accumulation, force index, money flow and money flow index.

    The force index is an average of 13 rows that starts at the 13th with the mean of the changes so far.
    """
    f = Feature().let(_d=diff("Close"), _tp="(High + Low + Close) / 3").let(_td=diff("_tp"))
    f.let(_ov="CASE WHEN _d < 0 THEN -Volume WHEN _d = 0 THEN 0 ELSE Volume END", _av=f"coalesce({div('2 * Close - High - Low', '(High - Low)')}, 0) * Volume", _fi="_d * Volume")
    f.let(_obv=upto("sum", "_ov"), _ad=upto("sum", "_av")).let(_fs=f"CASE WHEN seq = 13 THEN {upto('avg', '_fi')} WHEN seq > 13 THEN _fi END").let(_e=ema("_fs", 13))
    f.let(_pos="CASE WHEN _td > 0 THEN _tp * Volume ELSE CAST(0 AS DOUBLE) END", _neg="CASE WHEN _td < 0 THEN _tp * Volume ELSE CAST(0 AS DOUBLE) END", _v10=mean("Volume", 10), _sa=total("_av", length), _sv=total("Volume", length)).let(_p=total("_pos", length), _n=total("_neg", length))
    return f.out(OBV=div(diff("_obv"), f"(Volume + {num(E8)})"), AD=div(diff("_ad"), f"(Volume + {num(E8)})"), EFI=div("_e", f"(_v10 + {num(E8)})"), CMF=div("_sa", "_sv"), MFI=f"100 * {div('_p', '(_p + _n)')}")


@operator
def rsi_manual_features(period: int = 14, length: int = 20) -> Feature:
    f = rsi_plain(Feature(causal=False), "_r", period, E8).out(RSI_14_manual="_r").let(_m="avg(_r) OVER (PARTITION BY symbol)", _s="stddev_pop(_r) OVER (PARTITION BY symbol)")
    f.out(RSI_14_zscore=f"coalesce((_r - _m) / (_s + {num(E8)}), 0)", RSI_14_ma=mean("_r", 20)).out(RSI_dist_from_mean="_r - RSI_14_ma")
    f.let(_mf=f"({div('(Close - Low) - (High - Close)', f'(High - Low + {num(E8)})')} * Volume)").let(_a=total("_mf", length), _b=total("Volume", length)).out(cmf_manual=div("_a", f"(_b + {num(E8)})"))
    # Changes below 1e-12 are rounding.
    f.let(_dc=diff("Close"), _df=f"round({diff('cmf_manual')}, 12)", _dr=diff("_r"))
    return f.out(cmf_price_div="CASE WHEN _df > 0 AND _dc < 0 THEN 1 ELSE 0 END", rsi_price_div="CASE WHEN _dr > 0 AND _dc < 0 THEN 1 ELSE 0 END")


@operator
def apply_main_indicators(length: int = 20) -> Feature:
    f = rsi(rsi(Feature(), "_r21", 21), "_r50", 50).out(RSI21="_r21 / 100").out(RSI21_diff=diff("RSI21", 5), RSI_50_21_diff="_r50 / 100 - RSI21")
    return f.then(different_EMA.feature()).then(fib_dist_050_last50.feature())


@operator
def apply_add_indicators(length: int = 20) -> Feature:
    return add_atr_normalized.feature((24,), normalization_window=200).then(volume_base_indicators.feature())


@operator
def apply_indicators(length: int = 20) -> Feature:
    """The full set, every step with its parameters: one copy of each column, and the ATR of 14 rows, which the liquidity score takes.

    Spark takes names that differ in case only for one, so beside ``Fisher`` the other transform is ``fisher_transform``.
    """
    f = Feature()
    for part in (
        lag_features.feature(), add_price_acceleration.feature(), linear_regression.feature(length), add_volume_features.feature(20), volume_acceleration.feature(), add_breakout_flags.feature(50, length // 2),
        rsi_set.feature(length), volume_indicators.feature(length), calc_stochastic_rsi.feature(14, 14, 3, 5), add_normalized_volume_profile.feature(100, 3, 5, 10), add_volume_filter.feature(use_ema=True),
        add_atr_normalized.feature((7, 24, 72)), add_atr_normalized.feature((14,), add_velocity=False, add_acceleration=False),
        add_normalized_ichimoku.feature(), add_normalized_ichimoku_htf.feature(), *[add_normalized_ichimoku_on_rsi.feature(n, prefix=f"rsi{n}_ichimoku") for n in (9, 14, 50)],
        compute_trix_elder.feature(), compute_combined_indicators.feature(), different_MA.feature(), different_EMA.feature(), VWAP.feature(), add_liquidity_imbalance.feature(), calculate_LISS.feature(100),
        add_all_features.feature("fisher_transform"), quarter_theory.feature(), add_breakdown_flags.feature(50, length // 2),
        rolling_wasserstein.feature(100, 50), rolling_wasserstein.feature(20, 10), rolling_statistics.feature(), Keltner_func.feature(), rsi_manual_features.feature(14, length),
        *[super_trend.feature(p, m) for p, m in ((50, 1.3), (50, 5.0), (7, 1.5), (7, 5.0))], fibo_dinamic.feature(300),
    ):
        f.then(part)
    return f


def keep_selected_features(df: DataFrame, names: tuple[str, ...] = SELECTED) -> DataFrame:
    """The columns of ``names`` that ``df`` has."""
    return df.select(*[F.col(f"`{c}`") for c in names if c in df.columns])


def drop_low_importance_features(df: DataFrame, names: tuple[str, ...] = UNIMPORTANT) -> DataFrame:
    """``df`` without ``names``; names are told apart by case, so ``Fisher`` doesn't take ``fisher`` along."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])


def labelled_features(bars: DataFrame, length: int = 20, target_candles: int = 50, target: float = 0.025, rr_threshold: float = 2) -> DataFrame:
    """Main features and label, rows of the warm-up removed: what the CSV entry point gives."""
    return add_target_column_mod(apply_main_indicators(bars, length), target_candles, target, rr_threshold).na.drop()


OPERATORS |= {f.__name__: f for f in (keep_selected_features, drop_low_importance_features)}
