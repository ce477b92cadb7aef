"""Registered queries over bars made from the test tables, and the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plain_sql
from .operators import OPERATORS, evaluate
from .operators.label import add_target_column_mod, add_target_column_mod_sma_stochrsi_volume_surge, label_grid
from .operators.resampled import rsi_htf
from .operators.sessions import add_trading_sessions
from .plans.levels import Feature
from .sources import bars as B

Query = Callable[[SparkSession, str], DataFrame]


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of orders, a symbol for each order status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return B.resample(o, F.col("o_orderdate"), F.col("o_totalprice"), F.lit(1.0), F.date_trunc("day", F.col("o_orderdate").cast("timestamp")), F.col("o_orderkey"), F.col("o_orderstatus"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events, a symbol for each event type."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return B.resample(e, ts, F.col("value"), F.lit(1.0), F.date_trunc("hour", ts), ts, F.col("event_type"))


def quarter_hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return B.resample(e, ts, F.col("value"), F.lit(1.0), F.window(ts, "15 minutes")["start"], ts)


_BARS = """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY "Data") AS seq FROM (
  SELECT {symbol} AS symbol, {every} AS "Data", arg_min({price}::DOUBLE, {order}) AS "Open", max({price}::DOUBLE) AS "High", min({price}::DOUBLE) AS "Low",
    arg_max({price}::DOUBLE, {order}) AS "Close", count(*)::DOUBLE AS "Volume" FROM {table} GROUP BY ALL)"""
DAILY = _BARS.format(symbol="o_orderstatus", every="date_trunc('day', o_orderdate)::TIMESTAMP", price="o_totalprice", order="o_orderkey", table="orders")
HOURLY = _BARS.format(symbol="event_type", every="date_trunc('hour', ts)::TIMESTAMP", price="value", order="ts", table="events")
QUARTERS = _BARS.format(symbol="'ALL'", every="time_bucket(INTERVAL '15 minutes', ts)::TIMESTAMP", price="value", order="ts", table="events")

#: Queries over features: the bars they run on and the feature. Long look-backs need the daily bars.
FEATURES: dict[str, tuple[str, Feature]] = {}
_HOURLY = {"VWAP", "VWAP_binary", "add_vwap_features_with_norm", "quarter_theory"}
_SKIP = {"session_distance", "add_trading_sessions", "add_target_column_mod", "add_target_column_mod_sma_stochrsi_volume_surge", "keep_selected_features", "drop_low_importance_features", "rsi_htf", "apply_indicators"}
for _name, _op in OPERATORS.items():
    if _name not in _SKIP and hasattr(_op, "feature"):
        FEATURES[_name] = ("hourly" if _name in _HOURLY else "daily", _op.feature())
_SOURCES = {"daily": (daily_bars, DAILY), "hourly": (hourly_bars, HOURLY)}


def _plain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every result as a double of six decimals (three for large ones), so that engines with other summation orders agree."""
    return df.select("symbol", "seq", *[(F.round(F.col(f"`{c}`").cast("double"), 3 if c in plain_sql.COARSE else 6) + F.lit(0.0)).alias(c) for c in columns])


def add_parabolic_sar_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat bars divide by the epsilon alone; their values are told apart to a million."""
    rows = OPERATORS["add_parabolic_sar_feature"](daily_bars(spark, sf_dir))
    y = F.col("parabolic_sar_norm")
    return rows.select("symbol", "seq", (F.when(F.abs(y) >= 1e9, F.round(y, -6)).otherwise(F.round(y, 6)) + F.lit(0.0)).alias("parabolic_sar_norm"))


def _feature_query(kind: str, feature: Feature) -> Query:
    return lambda spark, sf_dir: _plain(feature.add_to(_SOURCES[kind][0](spark, sf_dir)), feature.outputs)


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir)


def bars_hourly_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_bars(spark, sf_dir)


def bars_quarter_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarter_hour_bars(spark, sf_dir)


def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.completeness_gate(daily_bars(spark, sf_dir), 86_400, 0.876).groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))


def label_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_target_column_mod(daily_bars(spark, sf_dir), 20, 0.04, 2.0).select("symbol", "seq", "target")


def label_first_touch_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_target_column_mod_sma_stochrsi_volume_surge(daily_bars(spark, sf_dir), 20, 0.04, 2.0).select("symbol", "seq", "target")


GRID_TARGETS, GRID_RR = [0.001 + 0.0005 * i for i in range(11)], [1.5, 2.0, 2.5, 3.0, 3.5, 4.0]


def label_grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_grid(daily_bars(spark, sf_dir), GRID_TARGETS, GRID_RR)
    return rows.groupBy("rr_threshold", "target_share").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("target").cast("long")).alias("positive"))


def rsi_htf_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(rsi_htf(quarter_hour_bars(spark, sf_dir)), ["RSI7_1H_norm", "RSI14_1H_norm"])


def sessions_and_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.sessions import SESSIONS, session_distance

    return _plain(session_distance(add_trading_sessions(hourly_bars(spark, sf_dir))), [*SESSIONS, *[f"{s}_Distance" for s in SESSIONS]])


def scored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars, labelled, split by time, with a feature as the score."""
    rows = add_target_column_mod(OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)), 20, 0.04, 2.0).filter("bb_z_20 IS NOT NULL")
    split = F.when(F.col("seq") <= 1200, "train").when(F.col("seq") <= 1800, "valid").otherwise("test")
    return rows.select(split.alias("split"), "target", (F.floor((F.least(F.greatest("bb_z_20", F.lit(-3.0)), F.lit(3.0)) + 3) / 6 * 50) / 50).alias("proba"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.threshold_sweep(scored_rows(spark, sf_dir))
    return out.select("split", "threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_thresholds(evaluate.threshold_sweep(scored_rows(spark, sf_dir)))


def balanced_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.best_thresholds(evaluate.threshold_sweep(scored_rows(spark, sf_dir)), balanced=True)


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.roc_auc(scored_rows(spark, sf_dir)).select("split", F.round("roc_auc", 6).alias("roc_auc"))


def final_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.final_metrics(scored_rows(spark, sf_dir), 0.4).select("split", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "roc_auc")])


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.show_class_balance(scored_rows(spark, sf_dir))


_CORRELATED = ["Close", "Volume", "bb_z_20", "bb_width_20", "choppiness_index_14"]


def top_correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = OPERATORS["add_choppiness_index"](OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)))
    return evaluate.get_top_correlated_pairs(rows, _CORRELATED, 5).select("a", "b", F.round("r", 6).alias("r"))


def linear_shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.select import linear_shap

    rows = OPERATORS["add_choppiness_index"](OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir))).na.drop()
    table = evaluate.importance_table(linear_shap(rows, ["bb_z_20", "bb_width_20", "choppiness_index_14"], [0.5, -2.0, 1.0]))
    return table.select("Feature", *[F.round(c, 5).alias(n) for c, n in (("SHAP_Importance", "shap"), ("SHAP_%", "percent"), ("Cumulative_SHAP_%", "cumulative"))], F.col("Rank").alias("rank"))


SHAP_FEATURES = ["bb_z_20", "bb_width_20", "RSI_14", "Volume"]
#: Splits of two trees, (feature, threshold, left, right) or None for a leaf; covers and leaf values come from the data.
SHAP_SPLITS = (
    ((0, 0.4, 1, 2), (1, 2.3, 3, 4), (2, 52.0, 5, 6), None, (0, -0.6, 7, 8), None, (3, 1.5, 9, 10), None, None, None, None),
    ((3, 1.5, 1, 2), (2, 49.0, 3, 4), (0, 0.0, 5, 6), None, None, None, None),
)


GRID_CUTS = {"bb_z_20": [k / 4 for k in range(-7, 8)], "bb_width_20": [1.5 + k / 8 for k in range(13)], "RSI_14": [40.0 + k for k in range(21)]}


def grid_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of a tree for each of the 66 labels, all from one scan."""
    import numpy as np

    from .operators import grid

    pairs, names = grid.grid_of(GRID_RR, GRID_TARGETS), list(GRID_CUTS)
    bars = OPERATORS["ta_rsi"](OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)))
    rows = grid.binned(bars, names, list(GRID_CUTS.values()), pairs)
    settings = grid.Settings(subsample=None, share=1.0)
    best = grid.best_splits(rows, grid.Forests(len(pairs), range(1)), 0, len(names), 1 + max(map(len, GRID_CUTS.values())), np.zeros(0), settings)
    cut = F.array(*[F.array(*map(F.lit, c)) for c in GRID_CUTS.values()])
    named = F.array(*[F.struct(F.lit(rr).alias("rr_threshold"), F.lit(t).alias("target_share")) for rr, t in pairs])[F.col("tree")]
    best = best.filter("feature >= 0").select(named.alias("g"), F.array(*map(F.lit, names))[F.col("feature")].alias("feature"), F.round(cut[F.col("feature")][F.col("cut")], 6).alias("threshold"), F.round("gain", 6).alias("gain"), "n", "n_left", F.round("value", 6).alias("value"))
    return best.select("g.*", "feature", "threshold", "gain", "n", "n_left", "value")


def grid_of_forests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forests of eight trees for all 66 labels, scored on the rows after the first 1,200."""
    from .operators import grid

    bars = OPERATORS["ta_rsi"](OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)))
    out = grid.evaluate_parameters(bars, ["bb_z_20", "bb_width_20", "RSI_14", "Volume"], 1200, 1800, trees=8, settings=grid.Settings(depth=5))
    return out.select("rr_threshold", F.col("target").alias("target_share"), *[F.round(c, 6).alias(c) for c in ("f1", "precision", "recall", "positive_ratio")])


def _shap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_target_column_mod(OPERATORS["ta_rsi"](OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir))), 20, 0.04, 2.0)


def tree_shap_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapley values of every row under two trees whose covers and leaves are those of the data, as a table of importance."""
    import numpy as np

    from .operators import trees

    made = []
    for nodes in SHAP_SPLITS:
        column = lambda k, empty, of=nodes: np.array([empty if n is None else n[k] for n in of])
        made.append(trees.Tree(column(0, -1), column(1, 0.0), column(2, -1), column(3, -1), np.ones(len(nodes)), np.zeros(len(nodes))))
    rows = _shap_rows(spark, sf_dir)
    forest = trees.recounted(rows, SHAP_FEATURES, trees.Forest(tuple(made), (0.5, 0.5)), "target")
    table = trees.shap_table(trees.tree_shap(rows, SHAP_FEATURES, forest), SHAP_FEATURES)
    return table.select("Feature", F.col("Rank").alias("rank"), F.col("Direction").alias("direction"), *[F.round(c, 6).alias(n) for c, n in (("SHAP_Importance", "importance"), ("SHAP_%", "percent"), ("Cumulative_SHAP_%", "cumulative"))])


def main_features_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, main features, label, warm-up dropped, class shares and means: the flagship."""
    from .operators.pipelines import labelled_features

    rows = labelled_features(daily_bars(spark, sf_dir))
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), *[(F.round(F.avg(c), 6) + F.lit(0.0)).alias(c) for c in ("RSI21", "ema50_norm", "fib_dist_050_last50")])


def pca_of_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.stats import add_close_window_norm_pca

    return _plain(add_close_window_norm_pca(daily_bars(spark, sf_dir), window=60, n_components=3), ["close_pca_0", "close_pca_1", "close_pca_2"])


def add_close_window_norm_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(OPERATORS["add_close_window_norm_pca"](daily_bars(spark, sf_dir)), [f"close_pca_{k}" for k in range(5)])


PAIRPLOT = ["bb_z_20", "bb_width_20", "Volume"]


def feature_pairplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = add_target_column_mod(OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)), 20, 0.04, 2.0)
    return evaluate.plot_feature_pairplot(rows, PAIRPLOT, bins=12)


def csv_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars written as CSV and loaded as the CSV entry point does: main features, label of 50 rows, rows of the warm-up removed."""
    from .operators.pipelines import labelled_features
    from .plans.tables import shared_path

    path = shared_path(spark, "bars-csv")
    bars = daily_bars(spark, sf_dir)
    bars.filter("symbol = 'F'").select("Data", *B.PRICES).write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    rows = labelled_features(B.read_csv(spark, path))
    return rows.select("seq", "target", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("RSI21", "ema50_norm", "fib_dist_050_last50")])


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.select import explain_model_mutual_info

    rows = add_target_column_mod(OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)))
    return explain_model_mutual_info(rows, ["bb_z_20", "bb_width_20"]).select("Feature", F.round("MI", 6).alias("MI"))


def granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.select import explain_model_granger

    rows = add_target_column_mod(OPERATORS["add_bollinger_features"](daily_bars(spark, sf_dir)))
    return explain_model_granger(rows, ["bb_z_20", "bb_width_20"])


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars as overlapping pages of string arrays, parsed back into bars."""
    bars = daily_bars(spark, sf_dir)
    row = F.array(F.unix_millis("Data").cast("string"), *[F.col(c).cast("string") for c in B.PRICES], F.lit("x"))
    page = bars.select("symbol", F.explode(F.array(F.floor((F.col("seq") - 1) / 200), F.floor(F.col("seq") / 200))).alias("page"), row.alias("r"))
    return B.parse_pages(page.groupBy("symbol", "page").agg(F.collect_list("r").alias("rows")))


def apply_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    feature = OPERATORS["apply_indicators"].feature()
    return _plain(feature.add_to(daily_bars(spark, sf_dir)), feature.outputs)


def adaptive_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(OPERATORS["adaptive_rsi"](daily_bars(spark, sf_dir)), ["adaptive_rsi"])


def stochastic_rsi_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(OPERATORS["calc_stochastic_rsi"](daily_bars(spark, sf_dir), 10, 12, 5, 4), ["stoch_rsi_k", "stoch_rsi_d", "stoch_cross_bull"])


def wave_phase_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(OPERATORS["add_wave_phase_position"](daily_bars(spark, sf_dir), 120, 21), ["wave_phase", "phase_divergence"])


def different_EMA_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The averages carried over blocks of 300 rows."""
    feature = OPERATORS["different_EMA"].feature()
    return _plain(feature.add_to(daily_bars(spark, sf_dir), block_rows=300), feature.outputs)


def super_trend_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(OPERATORS["super_trend"](daily_bars(spark, sf_dir), 7, 1.5), ["super_trend_7_1.5"])


_PLAIN = (
    bars_daily, bars_hourly_by_type, bars_quarter_hour, completeness_gate, label_first_touch, label_first_touch_gated, label_grid_summary, rsi_htf_hour, sessions_and_distance,
    threshold_sweep, best_threshold, balanced_threshold, roc_auc, final_metrics, class_balance, top_correlated_pairs, linear_shap_importance, tree_shap_importance, grid_first_splits, grid_of_forests, main_features_labelled,
    pca_of_windows, mutual_information, granger, api_pages, apply_indicators, adaptive_rsi, stochastic_rsi_smoothed, wave_phase_short, super_trend_fast, different_EMA_in_blocks, add_parabolic_sar_feature, add_close_window_norm_pca, feature_pairplot, csv_features,
)


def queries() -> dict[str, Query]:
    return {name: _feature_query(*x) for name, x in FEATURES.items()} | {f.__name__: f for f in _PLAIN}


# DuckDB ------------------------------------------------------------------------------------------------------------


def _label_sql(bars: str, target: str, stop: str, extra: str = "") -> str:
    """Labels by a join with the 20 rows ahead; ``target`` and ``stop`` may name columns of ``extra``."""
    return f"""
first AS (
  SELECT b.symbol, b.seq{extra}, min(a.seq) FILTER (WHERE a."Low" <= b."Close" * (1 - {stop})) AS sl, min(a.seq) FILTER (WHERE a."High" >= b."Close" * (1 + {target})) AS tp
  FROM {bars} AS b LEFT JOIN bars AS a ON a.symbol = b.symbol AND a.seq > b.seq AND a.seq <= b.seq + 20 GROUP BY ALL
),
labels AS (SELECT symbol, seq{extra}, CASE WHEN tp IS NOT NULL AND (sl IS NULL OR tp < sl) THEN 1 ELSE 0 END AS target FROM first)"""


def _bollinger_scored() -> str:
    return f"""WITH bars AS ({DAILY}), bb AS ({plain_sql.inputs(DAILY)}), {_label_sql("bars", "0.04::DOUBLE", "0.02::DOUBLE")},
scored AS (
  SELECT CASE WHEN seq <= 1200 THEN 'train' WHEN seq <= 1800 THEN 'valid' ELSE 'test' END AS split, target, floor((least(greatest(bb_z_20, -3.0::DOUBLE), 3.0::DOUBLE) + 3) / 6 * 50) / 50 AS proba
  FROM bb JOIN labels USING (symbol, seq) WHERE bb_z_20 IS NOT NULL
)"""


_SWEEP = """,
sweep AS (
  SELECT split, t / 100.0::DOUBLE AS threshold, sum(CASE WHEN proba >= t / 100.0::DOUBLE THEN target ELSE 0 END) AS tp,
    sum(CASE WHEN proba >= t / 100.0::DOUBLE THEN 1 - target ELSE 0 END) AS fp, sum(CASE WHEN proba >= t / 100.0::DOUBLE THEN 0 ELSE target END) AS fn
  FROM scored, range(1, 100) AS r(t) GROUP BY ALL
),
rates AS (SELECT split, threshold, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM sweep)"""
_AUC = """,
ranked AS (SELECT split, target, rank() OVER (PARTITION BY split ORDER BY proba) + (count(*) OVER (PARTITION BY split, proba) - 1) / 2.0 AS r FROM scored),
auc AS (SELECT split, (sum(r) FILTER (WHERE target = 1) - sum(target) * (sum(target) + 1) / 2.0) / nullif(sum(target) * sum(1 - target), 0) AS roc_auc FROM ranked GROUP BY split)"""


def _chopped() -> str:
    return f"WITH rows AS ({plain_sql.inputs(DAILY)})"


def _sessions_sql() -> str:
    # The test events lie in January, when neither London nor New York has summer time.
    h, m = 'hour("Data")', 'minute("Data")'
    flags = {"Asia": f"{h} >= 3 AND {h} < 10", "Frankfurt": f"{h} = 10", "London": f"{h} >= 11 AND {h} < 13", "NewYork": f"{h} >= 16 OR {h} < 1", "Lunch": f"{h} = 13 OR ({h} = 16 AND {m} = 0)"}
    return plain_sql.session_distances(HOURLY, flags)


def _main_sql() -> str:
    there = " AND ".join(f'"{c}" IS NOT NULL' for c in OPERATORS["apply_main_indicators"].feature().outputs)
    label = _label_sql("bars", "0.025::DOUBLE", "0.0125::DOUBLE").replace("b.seq + 20", "b.seq + 50")
    return f"""WITH bars AS ({DAILY}), rows AS ({plain_sql.main_indicators(DAILY, False)}), {label}
SELECT target, count(*) AS n, {", ".join(f'round(avg("{c}"), 6) + 0.0 AS "{c}"' for c in ("RSI21", "ema50_norm", "fib_dist_050_last50"))} FROM rows JOIN labels USING (symbol, seq) WHERE {there} GROUP BY target"""


def _csv_sql() -> str:
    there = " AND ".join(f'"{c}" IS NOT NULL' for c in OPERATORS["apply_main_indicators"].feature().outputs)
    label = _label_sql("bars", "0.025::DOUBLE", "0.0125::DOUBLE").replace("b.seq + 20", "b.seq + 50")
    bars = f"SELECT * FROM ({DAILY}) WHERE symbol = 'F'"
    return f"""WITH bars AS ({bars}), rows AS ({plain_sql.main_indicators(bars)}), {label}
SELECT seq, target, "RSI21", ema50_norm, fib_dist_050_last50 FROM rows JOIN labels USING (symbol, seq) WHERE {there}"""


def _gated_sql() -> str:
    return f"""WITH bars AS ({DAILY}), g AS ({plain_sql.open_gates(DAILY)}), {_label_sql("bars", "0.04::DOUBLE", "0.02::DOUBLE")}
SELECT labels.symbol, labels.seq, CASE WHEN g.seq IS NOT NULL THEN target ELSE 0 END AS target FROM labels LEFT JOIN g USING (symbol, seq)"""


def _grid_sql() -> str:
    pairs = ", ".join(f"({r!r}::DOUBLE, {t!r}::DOUBLE)" for r in GRID_RR for t in GRID_TARGETS)
    return f"""WITH bars AS ({DAILY}), grid(rr_threshold, target_share) AS (VALUES {pairs}), cells AS (SELECT * FROM bars, grid),
{_label_sql("cells", "b.target_share", "b.target_share / b.rr_threshold", ", b.rr_threshold, b.target_share").replace("labels AS (SELECT symbol, seq, b.rr_threshold, b.target_share", "labels AS (SELECT symbol, seq, rr_threshold, target_share")}
SELECT rr_threshold, target_share, count(*) AS n, sum(target)::BIGINT AS positive FROM labels GROUP BY ALL"""


def _first_splits_sql() -> str:
    pairs = ", ".join(f"({r!r}::DOUBLE, {t!r}::DOUBLE)" for r in GRID_RR for t in GRID_TARGETS)
    cuts = ", ".join(f"({i}, '{c}', {k}, {t!r}::DOUBLE)" for i, (c, ts) in enumerate(GRID_CUTS.items()) for k, t in enumerate(ts))
    entropy = lambda p, w: f"CASE WHEN {w} > 0 AND {p} > 0 AND {p} < {w} THEN -({p} / {w} * log2({p} / {w}) + (1 - {p} / {w}) * log2(1 - {p} / {w})) ELSE 0 END"
    each = "CASE feature " + " ".join(f"WHEN '{c}' THEN \"{c}\"" for c in GRID_CUTS) + " END"
    return f"""WITH bars AS ({DAILY}), grid(rr_threshold, target_share) AS (VALUES {pairs}), cells AS (SELECT * FROM bars, grid),
{_label_sql("cells", "b.target_share", "b.target_share / b.rr_threshold", ", b.rr_threshold, b.target_share").replace("labels AS (SELECT symbol, seq, b.rr_threshold, b.target_share", "labels AS (SELECT symbol, seq, rr_threshold, target_share")},
x AS MATERIALIZED (SELECT symbol, seq, {", ".join(f'"{c}"' for c in GRID_CUTS)} FROM ({plain_sql.inputs(DAILY)}) WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in GRID_CUTS)}),
cuts(i, feature, k, threshold) AS (VALUES {cuts}),
s AS (SELECT rr_threshold, target_share, i, feature, k, threshold, count(*) AS n, count(*) FILTER (WHERE {each} <= threshold) AS n_left, 5.0::DOUBLE * sum(target) AS p, 5.0::DOUBLE * sum(target) FILTER (WHERE {each} <= threshold) AS lp
  FROM labels JOIN x USING (symbol, seq), cuts GROUP BY ALL),
w AS (SELECT *, n + p / 5 * 4 AS w, n_left + coalesce(lp, 0) / 5 * 4 AS lw FROM s WHERE n_left >= 6 AND n - n_left >= 6),
g AS (SELECT *, {entropy("p", "w")} - (lw * {entropy("lp", "lw")} + (w - lw) * {entropy("(p - lp)", "(w - lw)")}) / w AS gain FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY rr_threshold, target_share ORDER BY round(gain, 12) DESC, i, k) AS no FROM g)
SELECT rr_threshold, target_share, feature, threshold, round(gain, 6) AS gain, n, n_left, round(p / w, 6) AS value FROM b WHERE no = 1 AND gain >= 2e-4"""


def _tree_shap_sql() -> str:
    """The definition: over all subsets of the other features, how the expected prediction changes with the feature."""
    from itertools import combinations
    from math import factorial

    n = len(SHAP_FEATURES)
    sums, terms = [], {k: [] for k in range(n)}

    def walk(t: int, node: int, here: str) -> None:
        sums.append(f"count(*) FILTER (WHERE {here})::DOUBLE AS c{t}_{node}, avg(target) FILTER (WHERE {here}) AS v{t}_{node}")
        if (split := SHAP_SPLITS[t][node]) is not None:
            left = f'"{SHAP_FEATURES[split[0]]}" <= {split[1]}::DOUBLE'
            walk(t, split[2], f"{here} AND {left}")
            walk(t, split[3], f"{here} AND NOT ({left})")

    def mean(t: int, node: int, known: set[int]) -> str:
        if (split := SHAP_SPLITS[t][node]) is None:
            return f"coalesce(v{t}_{node}, 0)"
        a, b = (mean(t, c, known) for c in split[2:])
        if split[0] in known:
            return f'CASE WHEN "{SHAP_FEATURES[split[0]]}" <= {split[1]}::DOUBLE THEN {a} ELSE {b} END'
        return f"(c{t}_{split[2]} * ({a}) + c{t}_{split[3]} * ({b})) / c{t}_{node}"

    for t in range(len(SHAP_SPLITS)):
        walk(t, 0, "true")
    for k in range(n):
        for size in range(n):
            for known in combinations([j for j in range(n) if j != k], size):
                weight = factorial(size) * factorial(n - size - 1) / factorial(n) / len(SHAP_SPLITS)
                terms[k] += [f"{weight!r}::DOUBLE * (({mean(t, 0, {*known, k})}) - ({mean(t, 0, set(known))}))" for t in range(len(SHAP_SPLITS))]
    there = " AND ".join(f'"{c}" IS NOT NULL' for c in SHAP_FEATURES)
    values = ", ".join(f"{' + '.join(x)} AS s{k}" for k, x in terms.items())
    rows = " UNION ALL ".join(f"SELECT '{c}' AS f, avg(abs(s{k})) AS a, avg(s{k}) AS m FROM s" for k, c in enumerate(SHAP_FEATURES))
    return f"""WITH bars AS ({DAILY}), {_label_sql("bars", "0.04::DOUBLE", "0.02::DOUBLE")}, rows AS MATERIALIZED (SELECT * FROM ({plain_sql.inputs(DAILY)}) JOIN labels USING (symbol, seq) WHERE {there}),
counts AS MATERIALIZED (SELECT {", ".join(sums)} FROM rows), s AS MATERIALIZED (SELECT {values} FROM rows, counts), t AS ({rows})
SELECT f AS "Feature", row_number() OVER (ORDER BY a DESC, f)::INT AS rank, CASE WHEN m > 0 THEN 'Positive' ELSE 'Negative' END AS direction, round(a, 6) AS importance, round(100 * a / max(a) OVER (), 6) AS percent,
  round(sum(100 * a / (SELECT max(a) FROM t)) OVER (ORDER BY a DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumulative FROM t"""


def _mutual_info_sql(k: int = 3) -> str:
    """All pairs of rows: the k-th nearest of the class, then how many of any class are nearer."""
    psi = lambda n: f"(ln({n} + 8) - 1 / (2 * ({n} + 8)) - 1 / (12 * pow({n} + 8, 2)) + 1 / (120 * pow({n} + 8, 4)) - 1 / (252 * pow({n} + 8, 6)) + 1 / (240 * pow({n} + 8, 8)) - list_sum(list_transform(range(0, 8), lambda i: 1 / ({n} + i))))"
    names = ("bb_z_20", "bb_width_20")
    long = " UNION ALL ".join(f"SELECT '{c}' AS f, symbol, seq, target, \"{c}\" AS x FROM r WHERE \"{c}\" IS NOT NULL" for c in names)
    return f"""WITH bars AS ({DAILY}), {_label_sql("bars", "0.04::DOUBLE", "0.02::DOUBLE")},
r AS (SELECT * FROM ({plain_sql.inputs(DAILY)}) JOIN labels USING (symbol, seq)),
l AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY f, symbol, seq) AS id, count(*) OVER (PARTITION BY f, target) AS size FROM ({long})),
d AS (SELECT a.f, a.id, list_sort(min(abs(a.x - b.x), {k}))[least({k}, any_value(a.size) - 1)] AS radius FROM l AS a JOIN l AS b ON a.f = b.f AND a.target = b.target AND a.id <> b.id GROUP BY a.f, a.id),
m AS (SELECT a.f, a.id, any_value(a.size)::DOUBLE AS size, least({k}, any_value(a.size) - 1)::DOUBLE AS k, count(*) FILTER (WHERE CASE WHEN radius > 0 THEN abs(a.x - b.x) < radius ELSE a.x = b.x END)::DOUBLE AS m
  FROM l AS a JOIN d USING (f, id) JOIN l AS b ON a.f = b.f WHERE b.size > 1 GROUP BY a.f, a.id)
SELECT f AS "Feature", round(greatest({psi("any_value(n)")} + avg({psi("k")}) - avg({psi("size")}) - avg({psi("m")}), 0), 6) AS "MI" FROM (SELECT *, (count(*) OVER (PARTITION BY f))::DOUBLE AS n FROM m) GROUP BY f"""


def _pairplot_sql() -> str:
    at = lambda c: f'least(coalesce(floor((x."{c}" - r."lo_{c}") / nullif(r."hi_{c}" - r."lo_{c}", 0) * 12), 0), 11)::INT'
    pairs = [(a, b) for i, a in enumerate(PAIRPLOT) for b in PAIRPLOT[i:]]
    each = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, target, {at(a)} AS bin_a, {at(b)} AS bin_b FROM x, r" for a, b in pairs)
    ranges = ", ".join(f'min("{c}") AS "lo_{c}", max("{c}") AS "hi_{c}"' for c in PAIRPLOT)
    return f"""WITH bars AS ({DAILY}), {_label_sql("bars", "0.04::DOUBLE", "0.02::DOUBLE")},
x AS MATERIALIZED (SELECT * FROM ({plain_sql.inputs(DAILY)}) JOIN labels USING (symbol, seq) WHERE {" AND ".join(f'"{c}" IS NOT NULL' for c in PAIRPLOT)}), r AS (SELECT {ranges} FROM x)
SELECT a, b, target, bin_a, bin_b, count(*) AS n FROM ({each}) GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    scored = _bollinger_scored()
    corr = " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, abs(corr("{a}", "{b}")) AS r FROM rows""" for i, a in enumerate(_CORRELATED) for b in _CORRELATED[i + 1 :])
    shares = ", ".join(f"""coalesce(round(sum((split = '{s}')::INT * n) / nullif(sum(sum((split = '{s}')::INT * n)) OVER (), 0), 3), 0)::DOUBLE AS "{s}" """ for s in ("train", "valid", "test"))
    parts = ", ".join(f"avg(abs({w} * ({c} - m_{c}))) AS s_{c}" for c, w in (("bb_z_20", 0.5), ("bb_width_20", -2.0), ("choppiness_index_14", 1.0)))
    three = ("bb_z_20", "bb_width_20", "choppiness_index_14")
    out = {
        "bars_daily": DAILY,
        "bars_hourly_by_type": HOURLY,
        "bars_quarter_hour": QUARTERS,
        "api_pages": DAILY,
        "completeness_gate": f"""SELECT symbol, count(*) AS bars FROM ({DAILY}) GROUP BY symbol HAVING count(*) >= 0.876 * (floor(epoch(max("Data") - min("Data")) / 86400) + 1)""",
        "label_first_touch": f"""WITH bars AS ({DAILY}), {_label_sql("bars", "0.04::DOUBLE", "0.02::DOUBLE")} SELECT * FROM labels""",
        "label_first_touch_gated": _gated_sql(),
        "label_grid_summary": _grid_sql(),
        "rsi_htf_hour": plain_sql.hourly_rsi(QUARTERS),
        "sessions_and_distance": _sessions_sql(),
        "threshold_sweep": f"{scored}{_SWEEP} SELECT split, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rates",
        "best_threshold": f"{scored}{_SWEEP} SELECT split, threshold FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f1 DESC, threshold) AS no FROM rates) WHERE no = 1",
        "balanced_threshold": f"{scored}{_SWEEP} SELECT split, threshold FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY abs(precision - recall), threshold) AS no FROM rates WHERE threshold >= 0.095 AND threshold <= 0.905) WHERE no = 1",
        "roc_auc": f"{scored}{_AUC} SELECT split, round(roc_auc, 6) AS roc_auc FROM auc",
        "final_metrics": f"{scored}{_SWEEP}{_AUC} SELECT split, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(roc_auc, 6) AS roc_auc FROM rates JOIN auc USING (split) WHERE threshold = 0.4",
        "class_balance": f"""{scored} SELECT target, round(sum(n) / sum(sum(n)) OVER (), 3)::DOUBLE AS "all", {shares} FROM (SELECT split, target, count(*) AS n FROM scored GROUP BY ALL) GROUP BY target""",
        "top_correlated_pairs": f"""{_chopped()} SELECT a, b, round(r, 6) AS r FROM ({corr}) WHERE r IS NOT NULL ORDER BY r DESC, a, b LIMIT 5""",
        "linear_shap_importance": f"""{_chopped()}, full_rows AS (SELECT * FROM rows WHERE {" AND ".join(f"{c} IS NOT NULL" for c in three)}), means AS (SELECT {", ".join(f"avg({c}) AS m_{c}" for c in three)} FROM full_rows),
s AS (SELECT {parts} FROM full_rows, means), t AS ({" UNION ALL ".join(f"SELECT '{c}' AS f, s_{c} AS x FROM s" for c in three)})
SELECT f AS "Feature", round(x, 5) AS shap, round(100 * x / max(x) OVER (), 5) AS percent, round(sum(100 * x / (SELECT max(x) FROM t)) OVER (ORDER BY x DESC, f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 5) AS cumulative, row_number() OVER (ORDER BY x DESC, f)::INT AS rank FROM t""",
        "tree_shap_importance": _tree_shap_sql(),
        "feature_pairplot": _pairplot_sql(),
        "mutual_information": _mutual_info_sql(),
        "csv_features": _csv_sql(),
        "grid_first_splits": _first_splits_sql(),
        "main_features_labelled": _main_sql(),
        "adaptive_rsi": plain_sql.adaptive_rsi(DAILY, 14, 14),
        "stochastic_rsi_smoothed": plain_sql.stochastic_rsi(DAILY, 10, 12, 5, 4),
        "wave_phase_short": plain_sql.wave_phase(DAILY, 120, 21),
        "super_trend": plain_sql.super_trend(DAILY, 10, 3.0),
        "add_wave_phase_position": plain_sql.wave_phase(DAILY, 700, 21),
        "adaptive_zscore": plain_sql.adaptive_zscore(DAILY, 700, 100),
        "super_trend_fast": plain_sql.super_trend(DAILY, 7, 1.5),
        "add_breakout_flags": plain_sql.breakout(DAILY, 20, 5),
        "add_breakdown_flags": plain_sql.breakout(DAILY, 20, 5, down=True),
        "rsi_set": plain_sql.rsi_set(DAILY, 20),
        "different_MA": plain_sql.different_ma(DAILY),
        "different_EMA": plain_sql.different_ema(DAILY),
        "different_EMA_in_blocks": plain_sql.different_ema(DAILY),
        "different_EMA_binary": plain_sql.different_ema_binary(DAILY),
        "apply_main_indicators": plain_sql.main_indicators(DAILY),
        "add_vwap_features_with_norm": plain_sql.vwap_features(HOURLY, 9, 360, 100, 14),
        "compute_combined_indicators": plain_sql.combined(DAILY, 23, 50, 10, 10, 20, 2.0),
        "add_fisher_transform": plain_sql.fisher(DAILY, 10),
        "add_all_features": plain_sql.all_features(DAILY),
        "add_normalized_volume_profile": plain_sql.volume_profile(DAILY, 20, 0, 5, 10),
        "add_close_window_columns": plain_sql.close_windows(DAILY, 60),
        "add_atr_normalized_rsi_weight": plain_sql.atr_rsi_weight(DAILY, (14, 24, 48), True, True, True, True, 14, 5),
        "atr_position": plain_sql.atr_position(DAILY, 700, 14, "Close"),
        "compute_rsi": plain_sql.rsi_of_means(DAILY, 14),
        "compute_cmf": plain_sql.money_flow(DAILY, 20),
        "add_liquidity_imbalance": plain_sql.liquidity_imbalance(DAILY, 20),
        "add_tenkan_breakout": plain_sql.tenkan_breakout(DAILY, 9),
        "add_false_breakout": plain_sql.false_breakout(DAILY, 10),
        "add_h1_trend": plain_sql.trend_of_mean(DAILY, 12),
        "add_macd": plain_sql.macd(DAILY, 12, 26, 9, 100),
        "VW_MACD": plain_sql.volume_macd(DAILY, 12, 26, 9, True),
        "EWO": plain_sql.oscillator_of_means(DAILY, 5, 35, True),
        "add_volume_features": plain_sql.volume_features(DAILY, 20),
        "add_candle_vol_size_features": plain_sql.candle_volume(DAILY, 20),
        "add_choppiness_index": plain_sql.choppiness(DAILY, 14),
        "add_bollinger_features": plain_sql.bollinger(DAILY, 20, 2),
        "calculate_rsi_slope": plain_sql.rsi_slope(DAILY, 50, 10, 10),
        "fib_dist_050_last50": plain_sql.middle_of_range(DAILY, 50, 0.03),
        "fibo_dinamic": plain_sql.fibo(DAILY, 300),
        "compute_trix_elder": plain_sql.trix_elder(DAILY, 30, 50),
        "compute_atr_trailing": plain_sql.atr_trailing(DAILY, 14, 3),
        "add_hidden_divergence": plain_sql.hidden_divergence(DAILY, 14),
        "add_rsi_divergence": plain_sql.divergence_of_lows(DAILY, 14, 5),
        "Keltner_func": plain_sql.keltner(DAILY, 40, 2, 100, 1.5, 5),
        "bullish_volume_dominance_binary": plain_sql.volume_dominance(DAILY, 10),
        "VWAP": plain_sql.day_prices(HOURLY, 28, "VWAP_slope"),
        "VWAP_binary": plain_sql.above_day_prices(HOURLY),
        "ta_rsi": plain_sql.wilder_rsi(DAILY, 14),
        "calc_stochastic_rsi": plain_sql.stochastic_rsi(DAILY, 14, 14, 3, 3),
        "rsi_stochastic_hybrid": plain_sql.rsi_and_range(DAILY, 14, 14, 3),
        "add_atr_normalized": plain_sql.atr_normalized(DAILY, (14, 24, 48), True, 100, 5),
        "volume_base_indicators_binary": plain_sql.volume_flags(DAILY, 20, 20, 13, 20, "ema"),
        "add_normalized_ichimoku": plain_sql.ichimoku(DAILY, 9, 26, 52),
        "add_normalized_ichimoku_htf": plain_sql.ichimoku(DAILY, 108, 312, 624, "_htf"),
        "lag_features": plain_sql.lagged(DAILY, "Close", (1, 3, 8), (1, 5, 8)),
        "linear_regression": plain_sql.line_end(DAILY, 20),
        "calculate_atr_slope": plain_sql.atr_slope(DAILY, 14, 5, 5),
        "calculate_atr_ema_normalized": plain_sql.atr_from_mean(DAILY, 14, 20),
        "volume_acceleration": plain_sql.volume_acceleration(DAILY),
        "add_atr_24_norm_dynamics": plain_sql.atr_changes(DAILY),
        "atr_local_extremes": plain_sql.atr_extremes(DAILY, 14),
        "add_atr_features": plain_sql.atr_squeeze(DAILY, 5, 2),
        "add_atr_regimes": plain_sql.atr_regimes(DAILY, 50, 0.5, 1.5),
        "add_price_acceleration": plain_sql.price_acceleration(DAILY, 5),
        "rolling_statistics": plain_sql.rolling_statistics(DAILY),
        "add_structural_features": plain_sql.structural(DAILY, 100),
        "add_liquidity_distance": plain_sql.liquidity_distance(DAILY, 1000),
        "calculate_resistance_distance": plain_sql.line_distance(DAILY, 200, 20, 20, 9),
        "calculate_support_distance": plain_sql.line_distance(DAILY, 200, 20, 20, 9, support=True),
        "add_support_resistance_features": plain_sql.support_resistance(DAILY, 1000, 20, 2, 0.01),
        "add_parabolic_sar_feature": plain_sql.parabolic_sar(DAILY, 0.02, 0.2),
        "kagi_conversion_line": plain_sql.kagi(DAILY, 9, 26, 14),
        "TMA_Overlay": plain_sql.smoothed_averages(DAILY),
        "add_normalized_ichimoku_on_rsi": plain_sql.ichimoku_on_rsi(DAILY, 14, 9, 26, 52, "rsi14_ichimoku"),
        "get_fibonacci_flags": plain_sql.retracements(DAILY, 300, 0.003),
        "fibo_3_lines_dinamic": plain_sql.three_lines(DAILY, 200, '("High" + "Low" + "Close") / 3', 3.0, 0.236, 1.0),
        "add_rsi_level_signal": plain_sql.rsi_levels(DAILY, 14, 200, 0.03, 2),
        "find_bullish_rsi_divergence": plain_sql.lows_against_rsi(DAILY, 7, 5),
        "rsi_divergence": plain_sql.pivots_against_rsi(DAILY, 14, 5, 5, 5),
        "calculate_smooth_divergence": plain_sql.smooth_divergence(DAILY, 14),
        "ppo": plain_sql.price_oscillator(DAILY, "Close", 55, 12, 26, 2, 3),
        "bollinger_awesome_alert": plain_sql.bands_and_awesome(DAILY, 20, 2.0, 3, 34, 5, 100),
        "safe_fisher_transform": plain_sql.fisher_of(DAILY, "Close", 1e-7),
        "add_price_atr_interaction": plain_sql.range_against_atr(DAILY, 3, 0.8),
        "add_atr_ratio": plain_sql.atr_ratio(DAILY, 14, 12),
        "sfp_fractals": plain_sql.broken_lows(DAILY, 14, 3),
        "quarter_theory": plain_sql.quarters(HOURLY, 2),
        "rolling_wasserstein": plain_sql.halves(DAILY, 100),
        "add_volume_filter": plain_sql.volume_filter(DAILY, False, 20, 100),
        "volume_base_indicators": plain_sql.volume_base(DAILY, 28, 5),
        "calculate_LISS": plain_sql.liquidity_score(DAILY, 20),
        "add_volume_dynamics": plain_sql.volume_dynamics(DAILY, "Volume", 1.5),
        "volume_indicators": plain_sql.money_flows(DAILY, 20),
        "rsi_manual_features": plain_sql.rsi_and_flow(DAILY, 14, 20),
        "apply_add_indicators": plain_sql.added_indicators(DAILY),
    }
    pos = "count(*) FILTER (WHERE a.\"Close\" < b.\"Close\") + (count(*) FILTER (WHERE a.\"Close\" = b.\"Close\") + 1) / 2.0"
    out["quantile_position"] = f"""WITH bars AS ({DAILY}) SELECT b.symbol, b.seq, CASE WHEN count(*) = 700 THEN round(2 * (({pos}) / 700 - 0.5), 6) + 0.0 END AS quantile_position
FROM bars AS b JOIN bars AS a ON a.symbol = b.symbol AND a.seq > b.seq - 700 AND a.seq <= b.seq GROUP BY ALL"""
    out["add_structure_break_long"] = f"""WITH bars AS ({DAILY}),
f AS (SELECT symbol, seq, "High" AS h FROM (SELECT *, greatest(lag("High", 1) OVER w, lag("High", 2) OVER w, lead("High", 1) OVER w, lead("High", 2) OVER w) AS n, lag("High", 2) OVER w IS NOT NULL AND lead("High", 2) OVER w IS NOT NULL AS ok
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq)) WHERE ok AND "High" > n),
breaks AS (SELECT DISTINCT symbol, hit FROM (SELECT f.symbol, f.seq, min(b.seq) AS hit FROM f JOIN bars AS b ON b.symbol = f.symbol AND b.seq > f.seq AND b."Close" > f.h GROUP BY ALL))
SELECT b.symbol, b.seq, CASE WHEN EXISTS (SELECT 1 FROM breaks AS k WHERE k.symbol = b.symbol AND k.hit <= b.seq AND k.hit > b.seq - 14) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS structure_break_long FROM bars AS b"""
    return out
