"""A part of the registered queries against their SQL; the driver runs all of them."""

import pytest
from helpers import SF, same

from wickwork import queries

NAMES = ["bars_daily", "api_pages", "label_first_touch", "label_first_touch_gated", "rsi_htf_hour", "sessions_and_distance", "roc_auc", "class_balance", "different_EMA_binary", "ppo", "sfp_fractals", "get_fibonacci_flags", "rolling_wasserstein", "main_features_labelled", "adaptive_rsi", "stochastic_rsi_smoothed", "wave_phase_short", "super_trend_fast"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    same(spark, SF, queries.queries()[name], queries.oracle_sql()[name])


def test_every_query_is_registered_once():
    names = list(queries.queries())
    assert len(names) == len(set(names)) and set(queries.oracle_sql()) <= set(names)


def test_the_full_set_can_be_written(spark, tmp_path):
    """No two columns differ in case only, and every one reaches a file."""
    queries.queries()["apply_indicators"](spark, SF).write.parquet(str(tmp_path / "full"))
    back = spark.read.parquet(str(tmp_path / "full"))
    names = [c.lower() for c in back.columns]
    assert len(names) == len(set(names)) > 120 and {"Fisher", "fisher_transform"} <= set(back.columns)
