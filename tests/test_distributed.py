"""Sums and states that come together from many tasks: Granger tests, window components, histograms of pairs, streams of trends."""

import numpy as np
import pandas as pd
import pytest
from helpers import SF, bars, close_to, column, same
from pyspark.sql import functions as F

from wickwork import queries
from wickwork.functions import kernels as K
from wickwork.operators import OPERATORS, evaluate, select, stats


def test_granger_from_sums_as_from_series(spark):
    rng = np.random.default_rng(0)
    frames = []
    for s, n in (("A", 300), ("B", 40), ("C", 4)):
        x, z = rng.normal(size=(2, n)).cumsum(1) * 1000 + 5e5
        y = np.r_[0, (np.diff(x) > 0)].astype(int)
        y = np.r_[0, 0, y[:-2]]
        x[rng.random(n) < 0.1] = np.nan
        frames.append(pd.DataFrame({"symbol": s, "seq": np.arange(n), "x": x, "z": z, "c": 1.0, "target": y}))
    pdf = pd.concat(frames)
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(5)
    got = {r["Feature"]: r["p_value"] for r in select.explain_model_granger(df, ["x", "z"]).collect()}
    for c in ("x", "z"):
        want = []
        for s in "ABC":
            part = pdf[pdf.symbol == s].dropna(subset=[c])
            v, y = part[c].to_numpy(), part.target.to_numpy(float)
            if y.std() and v.std():
                want.append(select.granger_p((v - v.mean()) / v.std(), (y - y.mean()) / y.std()))
        assert got[c] == pytest.approx(np.nanmin(want), rel=1e-6, abs=1e-12)
    assert got["x"] < 1e-6 < got["z"]
    short = select.explain_model_granger(df.filter("symbol = 'C'"), ["z"]).collect()
    assert [r["p_value"] for r in short] == [None]


def plain_pca(x, window, components):
    w = np.array([x[i - window : i] for i in range(window, len(x))])
    low, high = w.min(1, keepdims=True), w.max(1, keepdims=True)
    w = 2 * (w - low) / (high - low + 1e-8) - 1
    w = w - w.mean(0)
    axes = np.linalg.svd(w, full_matrices=False)[2][:components]
    axes = axes * np.sign(axes[np.arange(components), np.abs(axes).argmax(1)])[:, None]
    return np.vstack([np.full((window, components), np.nan), w @ axes.T])


@pytest.mark.parametrize("size", [1, 10_000])
def test_components_of_windows(spark, monkeypatch, size):
    monkeypatch.setattr(stats, "PCA_ROWS", size)
    pdf, df = bars(spark, 500, seed=2, symbols=("A", "B", "C"))
    df = df.filter("symbol <> 'C' OR seq <= 20")
    out = OPERATORS["add_close_window_norm_pca"](df, 20, 3)
    assert out.columns == [*df.columns, "close_pca_0", "close_pca_1", "close_pca_2"] and out.count() == 1020
    for s in "AB":
        want = plain_pca(pdf[pdf.symbol == s].Close.to_numpy(), 20, 3)
        for k in range(3):
            close_to(column(out.filter(F.col("symbol") == s), f"close_pca_{k}"), want[:, k], 1e-6)
    assert np.isnan(column(out.filter("symbol = 'C'"), "close_pca_0")).all()


def test_pairplot(spark):
    rows = [(0.0, 1.0, 0), (1.0, 1.0, 1), (0.49, 1.0, 1), (None, 1.0, 1), (0.1, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, target int")
    got = {(r["a"], r["b"], r["target"], r["bin_a"], r["bin_b"]): r["n"] for r in evaluate.plot_feature_pairplot(df, ["a", "b"], bins=2).collect()}
    assert got == {("a", "a", 0, 0, 0): 1, ("a", "a", 1, 0, 0): 1, ("a", "a", 1, 1, 1): 1, ("a", "b", 0, 0, 0): 1, ("a", "b", 1, 0, 0): 1, ("a", "b", 1, 1, 0): 1, ("b", "b", 0, 0, 0): 1, ("b", "b", 1, 0, 0): 2}
    assert evaluate.plot_feature_pairplot(df.filter("a > 5"), ["a", "b"]).count() == 0


def test_pairplot_matches_sql(spark):
    same(spark, SF, queries.queries()["feature_pairplot"], queries.oracle_sql()["feature_pairplot"])


def test_streamed_trends_are_those_of_the_batch(spark, tmp_path):
    from wickwork.streaming.trends import stream_trends

    pdf, df = bars(spark, 240, seed=6, symbols=("A", "B"))
    for k in range(4):  # batches of uneven lengths, the last one repeats old bars
        lo, hi = ((0, 7), (7, 90), (90, 91), (60, 240))[k]
        df.filter(f"seq > {lo} AND seq <= {hi}").orderBy(F.desc("seq")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = stream_trends(stream, 10, 2.0).writeStream.format("memory").queryName("trends_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = spark.table("trends_out").toPandas()
    assert len(got) == 480 and got.groupby("symbol").Data.nunique().tolist() == [240, 240]
    for s in "AB":
        part, own = pdf[pdf.symbol == s], got[got.symbol == s].sort_values("Data")
        h, lo, c = (part[x].to_numpy() for x in ("High", "Low", "Close"))
        tr = np.r_[h[0] - lo[0], np.maximum(h[1:] - lo[1:], np.maximum(abs(h[1:] - c[:-1]), abs(lo[1:] - c[:-1])))]
        atr = pd.Series(tr).rolling(10).mean().shift(1)
        upper, lower = ((h + lo) / 2 + 2 * atr).shift(1).to_numpy(), ((h + lo) / 2 - 2 * atr).shift(1).to_numpy()
        level, way = K.super_trend(c, upper, lower, 10)
        close_to(own.super_trend, level)
        assert own.direction.tolist() == way.astype(int).tolist() and set(way) == {-1, 0, 1}
        close_to(own.parabolic_sar, K.psar_long(h, lo, 0.02, 0.2))
