"""Features against SQL written from their formulas, at other settings than the registered queries have."""

import numpy as np
import pytest
from helpers import SF, bars, same
from pyspark.sql import functions as F

from wickwork import plain_sql, queries
from wickwork.operators import OPERATORS

DAILY, HOURLY = queries.DAILY, queries.HOURLY

CASES = {
    "add_breakout_flags": ((50, 10), plain_sql.breakout(DAILY, 50, 10)),
    "add_breakdown_flags": ((7, 2), plain_sql.breakout(DAILY, 7, 2, down=True)),
    "rsi_set": ((9,), plain_sql.rsi_set(DAILY, 9)),
    "compute_combined_indicators": ((12, 40, 7, 15, 30, 1.5), plain_sql.combined(DAILY, 12, 40, 7, 15, 30, 1.5)),
    "add_fisher_transform": ((25,), plain_sql.fisher(DAILY, 25)),
    "add_normalized_volume_profile": ((100, 3, 7, 20), plain_sql.volume_profile(DAILY, 100, 3, 7, 20)),
    "add_close_window_columns": ((12,), plain_sql.close_windows(DAILY, 12)),
    "add_atr_normalized_rsi_weight": (((9, 30), False, False, True, False, 7, 3), plain_sql.atr_rsi_weight(DAILY, (9, 30), False, False, True, False, 7, 3)),
    "atr_position": ((90, 20, "Open"), plain_sql.atr_position(DAILY, 90, 20, "Open")),
    "add_price_acceleration": ((9,), plain_sql.price_acceleration(DAILY, 9)),
    "add_structural_features": ((40,), plain_sql.structural(DAILY, 40)),
    "add_liquidity_distance": ((60,), plain_sql.liquidity_distance(DAILY, 60)),
    "calculate_resistance_distance": ((90, 12, 8, "Close", 5), plain_sql.line_distance(DAILY, 90, 12, 8, 5)),
    "calculate_support_distance": ((90, 12, 8, "Close", 5), plain_sql.line_distance(DAILY, 90, 12, 8, 5, support=True)),
    "add_support_resistance_features": ((120, 9, 3, 0.05), plain_sql.support_resistance(DAILY, 120, 9, 3, 0.05)),
    "kagi_conversion_line": ((7, 11, 9), plain_sql.kagi(DAILY, 7, 11, 9)),
    "compute_rsi": ((9,), plain_sql.rsi_of_means(DAILY, 9)),
    "compute_cmf": ((7,), plain_sql.money_flow(DAILY, 7)),
    "add_liquidity_imbalance": ((6,), plain_sql.liquidity_imbalance(DAILY, 6)),
    "add_tenkan_breakout": ((4,), plain_sql.tenkan_breakout(DAILY, 4)),
    "add_false_breakout": ((3,), plain_sql.false_breakout(DAILY, 3)),
    "add_h1_trend": ((30,), plain_sql.trend_of_mean(DAILY, 30)),
    "add_macd": ((5, 11, 4, 30), plain_sql.macd(DAILY, 5, 11, 4, 30)),
    "VW_MACD": ((5, 9, 3, False), plain_sql.volume_macd(DAILY, 5, 9, 3, False)),
    "EWO": (("Close", 3, 14, False), plain_sql.oscillator_of_means(DAILY, 3, 14, False)),
    "add_volume_features": ((8,), plain_sql.volume_features(DAILY, 8)),
    "add_candle_vol_size_features": ((7,), plain_sql.candle_volume(DAILY, 7)),
    "add_choppiness_index": ((25,), plain_sql.choppiness(DAILY, 25)),
    "add_bollinger_features": ((11, 3.0), plain_sql.bollinger(DAILY, 11, 3.0)),
    "calculate_rsi_slope": ((9, 6, 3), plain_sql.rsi_slope(DAILY, 9, 6, 3)),
    "fib_dist_050_last50": ((20, 0.1), plain_sql.middle_of_range(DAILY, 20, 0.1)),
    "fibo_dinamic": ((40,), plain_sql.fibo(DAILY, 40)),
    "compute_trix_elder": ((7, 12), plain_sql.trix_elder(DAILY, 7, 12)),
    "compute_atr_trailing": ((5, 1.5), plain_sql.atr_trailing(DAILY, 5, 1.5)),
    "add_hidden_divergence": ((6,), plain_sql.hidden_divergence(DAILY, 6)),
    "add_rsi_divergence": ((7, 12), plain_sql.divergence_of_lows(DAILY, 7, 12)),
    "Keltner_func": ((12, 1.25, 20, 2.5, 3), plain_sql.keltner(DAILY, 12, 1.25, 20, 2.5, 3)),
    "bullish_volume_dominance_binary": ((4,), plain_sql.volume_dominance(DAILY, 4)),
    "ta_rsi": ((5,), plain_sql.wilder_rsi(DAILY, 5)),
    "calc_stochastic_rsi": ((9, 20, 4, 2), plain_sql.stochastic_rsi(DAILY, 9, 20, 4, 2)),
    "rsi_stochastic_hybrid": ((6, 25, 5), plain_sql.rsi_and_range(DAILY, 6, 25, 5)),
    "add_atr_normalized": (((5, 30), False, 40, True, True, 3), plain_sql.atr_normalized(DAILY, (5, 30), False, 40, 3)),
    "volume_base_indicators_binary": ((5, 9, 30, 12, "sma"), plain_sql.volume_flags(DAILY, 5, 9, 30, 12, "sma")),
    "add_normalized_ichimoku": ((4, 11, 23), plain_sql.ichimoku(DAILY, 4, 11, 23)),
    "add_normalized_ichimoku_htf": ((15, 40, 90), plain_sql.ichimoku(DAILY, 15, 40, 90, "_htf")),
    "lag_features": (("Open", (2, 6), (3, 4)), plain_sql.lagged(DAILY, "Open", (2, 6), (3, 4))),
    "linear_regression": ((7,), plain_sql.line_end(DAILY, 7)),
    "calculate_atr_slope": ((6, 9, 2), plain_sql.atr_slope(DAILY, 6, 9, 2)),
    "calculate_atr_ema_normalized": ((5, 12), plain_sql.atr_from_mean(DAILY, 5, 12)),
    "atr_local_extremes": (("atr_24_norm", 6), plain_sql.atr_extremes(DAILY, 6)),
    "add_atr_features": (("atr_24_norm", 9, 4), plain_sql.atr_squeeze(DAILY, 9, 4)),
    "add_atr_regimes": (("atr_24_norm", 20, 0.8, 1.2), plain_sql.atr_regimes(DAILY, 20, 0.8, 1.2)),
    "add_fft_phase_position": (("Close", 48), plain_sql.fft_phase(DAILY, 48)),
    "TMA_Overlay": ((False,), plain_sql.smoothed_averages(DAILY, (21, 50, 200))),
    "add_normalized_ichimoku_on_rsi": ((9, 5, 12, 30, True, "rsi9"), plain_sql.ichimoku_on_rsi(DAILY, 9, 5, 12, 30, "rsi9")),
    "get_fibonacci_flags": ((40, 0.5), plain_sql.retracements(DAILY, 40, 0.5)),
    "fibo_3_lines_dinamic": ((30, "open", 2.0, (0.5, 0.5, 0.7)), plain_sql.three_lines(DAILY, 30, '"Open"', 2.0, 0.5, 0.7)),
    "add_rsi_level_signal": ((5, 60, 0.05, 4), plain_sql.rsi_levels(DAILY, 5, 60, 0.05, 4)),
    "find_bullish_rsi_divergence": ((5, 4), plain_sql.lows_against_rsi(DAILY, 5, 4)),
    "rsi_divergence": ((9, 3, 2, 4), plain_sql.pivots_against_rsi(DAILY, 9, 3, 2, 4)),
    "calculate_smooth_divergence": ((9,), plain_sql.smooth_divergence(DAILY, 9)),
    "ppo": (("Open", 20, 5, 13, 3, 1, False), plain_sql.price_oscillator(DAILY, "Open", 20, 5, 13, 3, 1, False)),
    "bollinger_awesome_alert": ((True, True, True, 12, 1.5, 4, 21, 7, 30, 40.0), plain_sql.bands_and_awesome(DAILY, 12, 1.5, 4, 21, 7, 30, True, True, 40.0)),
    "add_price_atr_interaction": (("atr_24_norm", 5, 1.2, False, True), plain_sql.range_against_atr(DAILY, 5, 1.2, True)),
    "add_atr_ratio": ((7, 20), plain_sql.atr_ratio(DAILY, 7, 20)),
    "sfp_fractals": ((20, 5), plain_sql.broken_lows(DAILY, 20, 5)),
    "rolling_wasserstein": ((40, 20), plain_sql.halves(DAILY, 40)),
    "add_volume_filter": ((True, 10, 50), plain_sql.volume_filter(DAILY, True, 10, 50)),
    "volume_base_indicators": ((12, 3), plain_sql.volume_base(DAILY, 12, 3)),
    "calculate_LISS": ((45,), plain_sql.liquidity_score(DAILY, 45)),
    "add_volume_dynamics": (("Close", 0.5), plain_sql.volume_dynamics(DAILY, "Close", 0.5)),
    "volume_indicators": ((9,), plain_sql.money_flows(DAILY, 9)),
    "rsi_manual_features": ((10, 15), plain_sql.rsi_and_flow(DAILY, 10, 15)),
}


@pytest.mark.parametrize("name", CASES)
def test_other_settings(spark, name):
    args, sql = CASES[name]
    feature = OPERATORS[name].feature(*args)
    same(spark, SF, lambda s, d: queries._plain(feature.add_to(queries.daily_bars(s, d)), feature.outputs), sql)


@pytest.mark.parametrize("name", ["different_MA", "different_EMA", "different_EMA_binary", "add_all_features", "apply_main_indicators", "add_vwap_features_with_norm", "rolling_statistics", "add_parabolic_sar_feature", "VWAP", "VWAP_binary", "volume_acceleration", "add_atr_24_norm_dynamics"])
def test_registered_setting(spark, name):
    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_vwap_features_at_other_settings(spark):
    feature = OPERATORS["add_vwap_features_with_norm"].feature(5, 60, 40, 9)
    same(spark, SF, lambda s, d: queries._plain(feature.add_to(queries.hourly_bars(s, d)), feature.outputs), plain_sql.vwap_features(HOURLY, 5, 60, 40, 9))


#: Features over hourly bars, most of which have a range and several trades.
HOURS = {
    "quarter_theory": ((3,), plain_sql.quarters(HOURLY, 3)),
    "volume_base_indicators": ((28, 5), plain_sql.volume_base(HOURLY, 28, 5)),
    "volume_indicators": ((20,), plain_sql.money_flows(HOURLY, 20)),
    "calculate_smooth_divergence": ((14,), plain_sql.smooth_divergence(HOURLY, 14)),
    "sfp_fractals": ((14, 3), plain_sql.broken_lows(HOURLY, 14, 3)),
    "TMA_Overlay": ((), plain_sql.smoothed_averages(HOURLY)),
}


@pytest.mark.parametrize("name", HOURS)
def test_over_hours(spark, name):
    args, sql = HOURS[name]
    feature = OPERATORS[name].feature(*args)
    same(spark, SF, lambda s, d: queries._plain(feature.add_to(queries.hourly_bars(s, d)), feature.outputs), sql)


def test_fisher_of_a_share(spark):
    """Shares of a candle, its ends included, which are cut off."""
    share = "CASE WHEN {h} > {l} THEN 2 * ({c} - {l}) / ({h} - {l}) - 1 ELSE 0 END"
    bars = f"""SELECT *, {share.format(h='"High"', l='"Low"', c='"Close"')} AS share FROM ({HOURLY})"""
    feature = OPERATORS["safe_fisher_transform"].feature("share", 1e-3)
    rows = lambda s, d: feature.add_to(queries.hourly_bars(s, d).withColumn("share", F.expr(share.format(h="High", l="Low", c="Close"))))
    same(spark, SF, lambda s, d: queries._plain(rows(s, d), feature.outputs), plain_sql.fisher_of(bars, "share", 1e-3))


def _near_a_level(r, back, tolerance, touches):
    """Density clustering by a plain loop: 1 if the last value is near the mean of a cluster of turning points."""
    r = np.asarray(r)[-back:]
    x = np.array([r[i] for i in range(1, len(r) - 1) if (r[i] > r[i - 1] and r[i] > r[i + 1]) or (r[i] < r[i - 1] and r[i] < r[i + 1])])
    if not len(x):
        return 0, 0
    near = np.abs(x[:, None] - x) <= x.mean() * tolerance
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(near.sum(1) >= touches):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = n
                    if near[j].sum() >= touches:
                        todo += list(np.flatnonzero(near[j]))
            n += 1
    return int(any(abs(r[-1] - x[label == k].mean()) / x[label == k].mean() <= tolerance for k in range(n))), n


@pytest.mark.parametrize(("touches", "tolerance", "back"), [(1, 0.005, 60), (2, 0.012, 60), (3, 0.015, 60), (4, 0.015, 140), (5, 0.02, 140)])
def test_levels_are_density_clusters(spark, touches, tolerance, back):
    _, df = bars(spark, 150, symbols=[f"s{i}" for i in range(40)])
    feature = OPERATORS["add_rsi_level_signal"].feature(7, back, tolerance, touches)
    got = feature.add_to(df).select("symbol", "seq", "rsi", "rsi_near_level").toPandas().sort_values(["symbol", "seq"])
    marks, clusters = 0, 0
    for _, g in got.groupby("symbol"):
        want, n = _near_a_level(g.rsi.dropna(), back, tolerance, touches)
        assert g.rsi_near_level.iloc[-1] == want and g.rsi_near_level.iloc[:-1].sum() == 0
        marks, clusters = marks + want, clusters + n
    assert 0 < marks < 40 and clusters > marks


#: The steps of the full set, in their order, with their parameters.
STEPS = [
    ("lag_features", {}), ("add_price_acceleration", {}), ("linear_regression", {"length": 20}), ("add_volume_features", {"window": 20}), ("volume_acceleration", {}),
    ("add_breakout_flags", {"resistance_window": 50, "lookback": 10}), ("rsi_set", {"length": 20}), ("volume_indicators", {"length": 20}),
    ("calc_stochastic_rsi", {"rsi_period": 14, "stoch_period": 14, "smooth_k": 3, "smooth_d": 5}), ("add_normalized_volume_profile", {"window": 100, "lag": 3, "change_window": 5, "sma_window": 10}),
    ("add_volume_filter", {"use_ema": True}), ("add_atr_normalized", {"windows": (7, 24, 72)}), ("add_normalized_ichimoku", {}), ("add_normalized_ichimoku_htf", {}),
    ("add_normalized_ichimoku_on_rsi", {"rsi_period": 9, "prefix": "rsi9_ichimoku"}), ("compute_trix_elder", {}), ("compute_combined_indicators", {}), ("different_EMA", {}), ("VWAP", {}),
    ("add_liquidity_imbalance", {}), ("calculate_LISS", {"profile_window": 100}), ("quarter_theory", {}), ("add_breakdown_flags", {"support_window": 50, "lookback": 10}),
    ("rolling_statistics", {}), ("Keltner_func", {}), ("super_trend", {"period": 50, "multiplier": 1.3}), ("fibo_dinamic", {"period": 300}),
]


def test_the_full_set_has_every_step(spark):
    """Each column of the full set is what its step gives alone, so no step's helpers reach another's."""
    feature = OPERATORS["apply_indicators"].feature(20)
    parts = [OPERATORS[name].feature(**kwargs) for name, kwargs in STEPS]
    missing = {c for p in parts for c in p.outputs} - set(feature.outputs)
    assert not missing
    rows = queries.daily_bars(spark, SF).filter("symbol = 'F'").limit(400)
    whole = feature.add_to(rows)
    checked = ["Acceleration", "LISS", "VP_Norm_Lag", "breakdown_in_5", "breakout_in_5", "stoch_rsi_d", "volume_filter", "volume_skew_20", "Q_L1_Q1", "entropy", "RSI21_diff", "ema50_norm"]
    checked = [c for c in checked if c in feature.outputs] + [c for c in OPERATORS["Keltner_func"].feature().outputs]
    owner = {c: p for p in parts for c in p.outputs}
    got = {r["seq"]: r for r in whole.select("seq", *[F.col(c) for c in checked]).collect()}
    for c in checked:
        for r in owner[c].add_to(rows).select("seq", c).collect():
            a, b = got[r["seq"]][c], r[c]
            assert (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1, abs(b))), (c, r["seq"], a, b)
