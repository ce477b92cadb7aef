"""Operators against plain pandas and numpy on made-up series."""

import numpy as np
import pandas as pd
import pytest
from helpers import bars, close_to, column

from wickwork.functions import kernels as K
from wickwork.operators import OPERATORS
from wickwork.operators import stats as S
from wickwork.operators.label import add_target_column_mod, label_grid


def test_rolling_means_and_deviations(spark):
    p, df = bars(spark)
    out = OPERATORS["add_bollinger_features"](df)
    m, s = p.Close.rolling(20).mean(), p.Close.rolling(20).std()
    close_to(column(out, "bb_z_20"), (p.Close - m) / (s + 1e-8), 1e-7)
    close_to(column(out, "bb_width_20"), 4 * s / (m + 1e-8), 1e-7)


def test_volume_skew_and_median(spark):
    p, df = bars(spark)
    out = OPERATORS["add_volume_features"](df)
    v = p.Volume.rolling(20)
    close_to(column(out, "volume_skew_20"), v.skew().clip(-5, 5) / 5, 1e-6)
    close_to(column(out, "volume_spike_20"), ((p.Volume - v.median()) / (v.median() + 1e-9)).clip(0, 3) / 3, 1e-7)


def test_normalised_atr_uses_weights_from_the_first_row(spark):
    p, df = bars(spark)
    out = OPERATORS["add_atr_normalized"](df, (14,))
    pc = p.Close.shift()
    tr = pd.concat([p.High - p.Low, (p.High - pc).abs(), (p.Low - pc).abs()], axis=1).max(axis=1)
    a = tr.ewm(span=14).mean()
    lo, hi = a.rolling(100, min_periods=1).min(), a.rolling(100, min_periods=1).max()
    close_to(column(out, "atr_14_norm"), 2 * (a - lo) / (hi - lo + 1e-8) - 1, 1e-6)


def test_ewm_variance():
    x = np.random.default_rng(1).normal(size=200)
    close_to(K.ewm_var(x, 2 / 101), pd.Series(x).ewm(span=100).var(), 1e-9)


def test_rsi_first_rows(spark):
    _, df = bars(spark, 40)
    wilder, plain = column(OPERATORS["ta_rsi"](df, 14), "RSI_14"), column(OPERATORS["compute_rsi"](df, 14), "rsi_manual")
    assert np.flatnonzero(~np.isnan(wilder))[0] == 14 and np.flatnonzero(~np.isnan(plain))[0] == 13


def test_seeded_average():
    y = K.seeded(np.arange(10.0), 4)
    assert np.isnan(y[:3]).all() and y[3] == 1.5 and y[4] == pytest.approx(1.5 + 0.4 * 2.5)


def first_touch(p, n, target, rr):
    out = []
    for i in range(len(p)):
        up, down, y = p.Close[i] * (1 + target), p.Close[i] * (1 - target / rr), 0
        for j in range(i + 1, min(i + n + 1, len(p))):
            if p.Low[j] <= down or p.High[j] >= up:
                y = int(p.Low[j] > down)
                break
        out.append(y)
    return out


def test_first_touch_label(spark):
    p, df = bars(spark)
    out = add_target_column_mod(df, 20, 0.02, 2.0)
    want = first_touch(p, 20, 0.02, 2.0)
    assert column(out, "target").tolist() == want and 0 < sum(want) < len(want)
    grid = label_grid(df, [0.02, 0.03], [2.0], 20)
    assert column(grid.filter("target_share = 0.02"), "target").tolist() == want
    assert add_target_column_mod(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["add_choppiness_index", "super_trend", "calc_stochastic_rsi", "different_MA", "kagi_conversion_line", "calculate_resistance_distance"])
def test_symbols_do_not_touch(spark, name):
    _, one = bars(spark, 250)
    _, two = bars(spark, 250, symbols=("A", "B"))
    a = OPERATORS[name](one)
    new = [c for c in a.columns if c not in one.columns]
    b = OPERATORS[name](two).filter("symbol = 'A'")
    for c in new:
        close_to(column(a, c), column(b, c))


CAUSAL = [n for n, op in OPERATORS.items() if hasattr(op, "feature") and op.feature().causal and n not in ("session_distance", "apply_indicators", "add_support_resistance_features")]


def test_features_do_not_look_ahead(spark):
    _, df = bars(spark, 260)
    past = df.filter("seq <= 230")
    for name in CAUSAL[::4]:
        feature = OPERATORS[name].feature()
        a, b = feature.add_to(df).filter("seq <= 230"), feature.add_to(past)
        for c in feature.outputs[:3]:
            close_to(column(a, c), column(b, c), 1e-7)


def test_short_and_empty_series(spark):
    _, df = bars(spark, 3)
    for name in ("super_trend", "kagi_conversion_line", "add_macd", "rolling_statistics", "sfp_fractals", "add_parabolic_sar_feature"):
        assert OPERATORS[name](df).count() == 3
        assert OPERATORS[name](df.limit(0)).count() == 0


def test_flat_series_divide_by_nothing(spark):
    _, df = bars(spark, 60, Open=5.0, High=5.0, Low=5.0, Close=5.0, Volume=0.0)
    for name in ("add_choppiness_index", "volume_base_indicators", "EWO", "calc_stochastic_rsi", "add_normalized_ichimoku", "add_candle_vol_size_features", "calculate_LISS"):
        assert OPERATORS[name](df).count() == 60


def test_super_trend_by_a_plain_loop(spark):
    p, df = bars(spark)
    got = column(OPERATORS["super_trend"](df, 7, 1.5), "super_trend_7_1.5")
    pc = p.Close.shift()
    tr = pd.concat([p.High - p.Low, (p.High - pc).abs(), (p.Low - pc).abs()], axis=1).max(axis=1)
    atr = tr.rolling(7).mean().shift()
    mid = (p.High + p.Low) / 2
    up, lo = (mid + 1.5 * atr).shift(), (mid - 1.5 * atr).shift()
    level, way, want = np.nan, 0, []
    for i in range(len(p)):
        if i == 7:
            level, way = (up[i], -1) if p.Close[i] < up[i] else (lo[i], 1)
        elif i > 7 and way > 0:
            at = max(lo[i], level) if not np.isnan(level) else lo[i]
            level, way = (up[i], -1) if p.Close[i] < at else (at, 1)
        elif i > 7:
            at = min(up[i], level) if not np.isnan(level) else up[i]
            level, way = (lo[i], 1) if p.Close[i] > at else (at, -1)
        q = atr[i] / (abs(p.Close[i] - level) + 1e-8)
        want.append(0.0 if np.isnan(q) else float(np.clip(way * (1 - np.clip(q, 0, 1)), -1, 1)))
    close_to(got, want, 1e-7)


def test_window_functions():
    x = np.sin(np.arange(64) * 2 * np.pi / 16)
    assert S.dominant_frequency(x) == pytest.approx(1 / 16)
    assert S.trend_stability(np.arange(100.0)) == pytest.approx(1)
    assert S.sample_entropy(np.ones(50)) == 0
    assert S.wasserstein_distance(np.r_[np.zeros(50), np.ones(50)]) == pytest.approx(1)
    assert 0.3 < S.hurst_exponent(np.cumsum(np.random.default_rng(0).normal(size=2000))) < 0.7
    assert abs(S.nar_residual(np.arange(30.0))) < 0.5
    assert 0 < S.spectral_entropy(np.random.default_rng(0).normal(size=100)) < 1


def test_first_mode():
    from wickwork.operators.levels import _first_mode

    x = np.array([1, 2, 2, 1, 3, 3, 3, 1.0])
    from collections import Counter

    want = [np.nan] * 4
    for i in range(4, len(x)):
        c = Counter(x[i - 4 : i].tolist())
        want.append(next(v for v in x[i - 4 : i] if c[v] == max(c.values())))
    close_to(_first_mode(x, 4), want)


def test_names_replace_and_helpers_go(spark):
    _, df = bars(spark, 60, bb_z_20=7.0)
    out = OPERATORS["add_bollinger_features"](df)
    assert out.columns.count("bb_z_20") == 1 and not [c for c in out.columns if c.startswith("_")]


def test_plan_has_one_shuffle(spark):
    _, df = bars(spark, 60)
    plan = OPERATORS["add_volume_dynamics"](df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_flat_kagi_line_has_the_last_bits_of_its_sql():
    """Where the line is flat, nothing but the order of the smoothing's sums decides the scaled values: it is that of ``plain_sql.kagi``."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        line = np.repeat(rng.uniform(1e5, 4e5, 2), (10, 20))
        got = K.kagi(line, np.zeros(30), 9)
        fit = np.linalg.pinv(np.vander(np.arange(-4, 5), 3))
        for i in range(30):
            mid = min(max(i, 4), 25)
            want = 0.0
            for w, x in zip((np.vander([i - mid], 3) @ fit)[0].tolist(), line[mid - 4 : mid + 5].tolist(), strict=True):
                want += w * x
            assert got[i] == want, (seed, i)
