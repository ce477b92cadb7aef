"""Made-up bars, and queries against their SQL."""

import glob
import os

import numpy as np
import pandas as pd

SF = "/root/testdata/sf0.001"


def bars(spark, n=300, seed=0, symbols=("A",), **columns):
    frames = []
    for k, s in enumerate(symbols):
        rng = np.random.default_rng(seed + k)
        close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 1)
        open_ = np.r_[close[:1], close[:-1]]
        high, low = np.maximum(open_, close) + rng.random(n), np.minimum(open_, close) - rng.random(n)
        frames.append(pd.DataFrame({"symbol": s, "seq": np.arange(1, n + 1), "Data": pd.date_range("2024-01-01", periods=n, freq="h"), "Open": open_, "High": high, "Low": low, "Close": close, "Volume": np.round(rng.random(n) * 1000)}))
    df = pd.concat(frames)
    for c, v in columns.items():
        df[c] = v
    return df, spark.createDataFrame(df)


def column(out, name):
    """A result column in time order as floats, null as nan."""
    return np.array([np.nan if r[0] is None else float(r[0]) for r in out.orderBy("symbol", "seq").select(f"`{name}`").collect()])


def close_to(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=tol, atol=tol)


def same(spark, sf, query, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(sf + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = query(spark, sf).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: "null" if pd.isna(v) else repr(float(v)) if isinstance(v, (int, float, np.number)) else str(v)
    rows = lambda d: sorted(tuple(map(text, r)) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(got) == rows(want)
