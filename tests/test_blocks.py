"""Kernels over blocks against the same kernels over whole symbols."""

import numpy as np
import pytest
from helpers import SF, bars, close_to, column, same
from pyspark.sql import functions as F

from wickwork import queries
from wickwork.functions import kernels as K
from wickwork.operators import OPERATORS
from wickwork.operators.base import ema, ewm, seeded, wilder
from wickwork.plans import blocks
from wickwork.plans.levels import Feature


def with_gaps(rng, n):
    x = rng.normal(100, 5, n)
    x[rng.random(n) < 0.15] = np.nan
    x[: n // 20] = np.nan
    return x


@pytest.mark.parametrize("rec", [ema("x", 9), ewm("x", 30), wilder("x", 14), seeded("x", 50), seeded("x", 3)])
@pytest.mark.parametrize("size", [1, 7, 64, 5000])
def test_states_carry_a_recursion(rec, size):
    from wickwork.plans.levels import _linear

    x = with_gaps(np.random.default_rng(0), 900)
    how, state, parts = _linear(rec), [], []
    for lo in range(0, len(x), size):
        part = x[lo : lo + size]
        parts.append(how.run(part, state))
        good = part[~np.isnan(part)]
        if len(good):
            state = how.fold(state, len(good), blocks.decayed_sum(good, how.keep), good[: how.head].tolist())
    close_to(np.concatenate(parts), rec.kernel(x, *rec.args))


def test_one_long_symbol_is_many_tasks(spark):
    rng = np.random.default_rng(1)
    pdf, _ = bars(spark, 2000, symbols=("A",))
    pdf["x"] = with_gaps(rng, 2000)
    df = spark.createDataFrame(pdf.replace({np.nan: None})).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    feature = Feature().out(e=ema("x", 20), w=wilder("x", 14), s=seeded("x", 200)).out(t=ema("e", 5))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = feature.add_to(df, block_rows=100)
        assert got.select(F.spark_partition_id()).distinct().count() >= 8
        for name in ("e", "w", "s", "t"):
            close_to(column(got, name), column(feature.add_to(df), name))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_blocks_by_the_session_and_symbols_apart(spark):
    _, df = bars(spark, 150, symbols=("A", "B", "C"))
    plain = column(OPERATORS["different_MA"](df), "ema50_ema200_diff"), column(OPERATORS["compute_trix_elder"](df), "TRIX")
    spark.conf.set("wickwork.blockRows", "40")
    try:
        close_to(column(OPERATORS["different_MA"](df), "ema50_ema200_diff"), plain[0])
        close_to(column(OPERATORS["compute_trix_elder"](df), "TRIX"), plain[1], 1e-7)
    finally:
        spark.conf.unset("wickwork.blockRows")


VIEWING = {
    "add_structural_features": (30,), "rolling_statistics": (), "add_fft_phase_position": ("Close", 40), "quantile_position": (50,), "add_liquidity_distance": (60,),
    "calculate_resistance_distance": (80, 10, 8), "calculate_support_distance": (80, 10, 8), "add_support_resistance_features": (90, 8, 2, 0.02), "add_wave_phase_position": (60, 6),
}


@pytest.mark.parametrize("name", VIEWING)
def test_bounded_views_in_blocks(spark, monkeypatch, name):
    """Blocks of a few rows give what one block gives, and there are more groups than symbols."""
    _, df = bars(spark, 420, seed=3, symbols=("A", "B"))
    feature = OPERATORS[name].feature(*VIEWING[name])
    monkeypatch.setattr(blocks, "VIEW_ROWS", 10_000)
    whole = {c: column(feature.add_to(df), c) for c in feature.outputs}
    monkeypatch.setattr(blocks, "VIEW_ROWS", 1)
    small = feature.add_to(df)
    for c in feature.outputs:
        np.testing.assert_array_equal(column(small, c), whole[c])
        assert not np.isnan(whole[c]).all()


def test_rows_with_gaps_in_seq(spark, monkeypatch):
    """The rows before are counted, not their numbers."""
    monkeypatch.setattr(blocks, "VIEW_ROWS", 1)
    pdf, df = bars(spark, 300)
    thin = pdf[pdf.seq % 3 != 0]
    got = column(OPERATORS["quantile_position"](df.filter("seq % 3 <> 0"), 20), "quantile_position")
    from wickwork.operators.stats import _rank

    close_to(got, 2 * (_rank(thin.Close.to_numpy(), 20) - 0.5))


def test_query_matches_sql(spark):
    same(spark, SF, queries.queries()["different_EMA_in_blocks"], queries.oracle_sql()["different_EMA_in_blocks"])


def test_empty_table(spark):
    _, df = bars(spark, 5)
    assert OPERATORS["different_MA"](df.filter("seq < 0"), block_rows=10).count() == 0
    assert OPERATORS["quantile_position"](df.filter("seq < 0"), 3).count() == 0
    assert np.isnan(K.ema(np.array([np.nan]), 0.5)).all()
