"""Statistics, spectra and model-like features over trailing windows.

Kernels take a whole symbol's series once and slide over it with numpy views, so a window is never copied to Python
objects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sql import clip, div, median, num, over
from ..plans.blocks import BLOCK, ROW, numbered
from ..plans.levels import VIEWS
from ..plans.tables import written
from .base import OPERATORS, Feature, K, Rec, ewm, operator

E10 = 1e-10
# What the kernels of this file look back.
VIEWS |= {"_windowed": lambda window, name, end=0: window - 1 + end, "_mad": lambda window: window - 1, "_rank": lambda window: window - 1, "_phase": lambda window: window}


def hurst_exponent(x: np.ndarray, max_lag: int = 100) -> float:
    """Slope of the log deviation of lagged differences on the log lag; nan below 20 values."""
    n = len(x)
    if n < 20:
        return np.nan
    lags = np.arange(2, min(max_lag, n - 1))
    tau = np.array([np.std(x[k:] - x[:-k]) for k in lags])
    ok = tau > 0
    return float(np.polyfit(np.log(lags[ok]), np.log(tau[ok]), 1)[0]) if ok.sum() > 1 else np.nan


def sample_entropy(x: np.ndarray, m: int = 2, r: float = 0.2) -> float:
    """-ln of close pairs of m-templates over their number; 0 where there is none."""
    n, s = len(x), np.std(x)
    if n <= m or s == 0:
        return 0.0
    t = np.lib.stride_tricks.sliding_window_view(x, m)
    near = np.abs(t[:, None] - t[None, :]).max(2) <= r * s
    count = (near.sum() - len(t)) // 2
    return float(-np.log(count / (n - m))) if count else 0.0


def dominant_frequency(x: np.ndarray) -> float:
    """Cycles a row of the largest bin of the spectrum, mean removed."""
    return float(np.fft.rfftfreq(len(x))[np.abs(np.fft.rfft(x - x.mean())).argmax()])


def nar_residual(x: np.ndarray, lag: int = 5) -> float:
    """Last residual of a ridge regression of each value on the ``lag`` before."""
    if len(x) <= lag:
        return np.nan
    a = np.lib.stride_tricks.sliding_window_view(x, lag)[:-1]
    y = x[lag:]
    am, ym = a.mean(0), y.mean()
    w = np.linalg.solve((a - am).T @ (a - am) + np.eye(lag), (a - am).T @ (y - ym))
    return float(y[-1] - ym - (a[-1] - am) @ w)


def wasserstein_distance(x: np.ndarray, compare: int = 50) -> float:
    """Distance between the distributions of the last ``compare`` values and those before."""
    a, b = np.sort(x[:-compare]), np.sort(x[-compare:])
    every = np.sort(np.concatenate([a, b]))
    steps = np.diff(every)
    return float((np.abs(np.searchsorted(a, every[:-1], "right") / len(a) - np.searchsorted(b, every[:-1], "right") / len(b)) * steps).sum())


def spectral_entropy(x: np.ndarray) -> float:
    """Normalised entropy of the power spectrum under a Hann window."""
    n = len(x)
    y = x - x.mean()
    p = np.abs(np.fft.rfft((y - y.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))) ** 2
    p[1 : len(p) - (n % 2 == 0)] *= 2
    p = p / (p.sum() + E10)
    return float(-(p * np.log2(p + E10)).sum() / np.log2(len(p)))


def trend_stability(x: np.ndarray) -> float:
    """1 less the share of sign changes of the differences."""
    s = np.sign(np.diff(x))
    return float(1 - (s[1:] != s[:-1]).sum() / (len(x) - 2 + E10))


def higuchi_fd(x: np.ndarray, k_max: int = 5) -> float:
    """Slope of the log curve length on the log step."""
    n = len(x)
    if n <= k_max:
        return np.nan
    steps = np.arange(1, k_max + 1)
    lengths = [np.mean([np.abs(np.diff(x[m::k])).sum() * (n - 1) / ((n - m) // k * k + E10) for m in range(k)]) for k in steps.tolist()]
    if min(lengths) <= 0:
        return np.nan
    return float(np.polyfit(np.log(steps), np.log(lengths), 1)[0])


FUNCTIONS = {f.__name__: f for f in (hurst_exponent, sample_entropy, dominant_frequency, nar_residual, spectral_entropy, trend_stability, higuchi_fd)}


def _windowed(x: np.ndarray, window: int, name: str, end: int = 0) -> np.ndarray:
    """A function of the ``window`` values that end ``end`` rows before each row; nan where one is missing.

    The fractal dimension takes what rows there are while the window is short.
    """
    out = np.full(len(x), np.nan)
    if name == "higuchi_fd":
        for i in range(min(window - 1, len(x))):
            if not np.isnan(x[: i + 1]).any():
                out[i] = higuchi_fd(x[: i + 1])
    if len(x) < window:
        return out
    f = FUNCTIONS[name]
    for i, w in enumerate(np.lib.stride_tricks.sliding_window_view(x, window), window - 1 + end):
        if i < len(x) and not np.isnan(w).any():
            out[i] = f(w)
    return out


def rolling(name: str, column: str, window: int) -> Rec:
    return Rec(_windowed, (column,), (window, name))


@operator
def rolling_statistics(price_col: str = "Close") -> Feature:
    """Hurst exponent, sample entropy, dominant frequency and residual over 100, 50, 64 and 20 rows."""
    return Feature().out(hurst=rolling("hurst_exponent", price_col, 100), entropy=rolling("sample_entropy", price_col, 50), fft_freq=rolling("dominant_frequency", price_col, 64), nar_res=rolling("nar_residual", price_col, 20))


@operator
def rolling_wasserstein(window: int = 100, compare: int = 50, price_col: str = "Close") -> Feature:
    """Distance between the older and the newer half of a window: mean gap of their sorted values."""
    if window != 2 * compare:
        raise ValueError("the halves are equally long")
    frame = lambda lo, hi: f"collect_list({price_col}) {over(lo, hi)}"
    f = Feature().let(_a=frame(1 - window, -compare), _b=frame(1 - compare, 0))
    return f.out(**{f"wasserstein_{window}": f"CASE WHEN seq >= {window} THEN aggregate(zip_with(array_sort(_a), array_sort(_b), (p, q) -> abs(p - q)), 0D, (s, v) -> s + v) / {compare} END"})


@operator
def add_structural_features(window: int = 100, price_col: str = "Close") -> Feature:
    f = Feature().out(**{f"spectral_entropy_{window}": rolling("spectral_entropy", price_col, window), f"trend_stability_{window}": rolling("trend_stability", price_col, window), f"fractal_dim_{window}": rolling("higuchi_fd", price_col, window)})
    return f.out(**{f"signal_complexity_{window}": f"spectral_entropy_{window} * trend_stability_{window} * (fractal_dim_{window} - 1)"})


def _mad(x: np.ndarray, window: int) -> np.ndarray:
    """Median distance from the window's median."""
    out = np.full(len(x), np.nan)
    if len(x) >= window:
        view = np.lib.stride_tricks.sliding_window_view(x, window)
        for lo in range(0, len(view), 256):
            v = view[lo : lo + 256]
            out[window - 1 + lo : window - 1 + lo + len(v)] = np.median(np.abs(v - np.median(v, axis=1, keepdims=True)), axis=1)
    return out


@operator
def add_wave_phase_position(lookback: int = 700, smooth_window: int = 21, price_col: str = "Close") -> Feature:
    """Smoothed robust distance from the median; windows of smoothing are at most a tenth of the look-back."""
    slow = min(smooth_window, lookback // 10)
    f = Feature().let(_m=median(price_col, lookback)).let(_d=Rec(_mad, (price_col,), (lookback,))).let(_z=div(f"{price_col} - _m", f"({num(1.4826)} * _d + {num(1e-8)})")).let(_c=f"({clip('_z', -4, 4)}) / 4")
    return f.let(_a=ewm("_c", slow), _b=ewm("_c", slow // 3)).out(wave_phase="_a", phase_divergence="_b - _a")


def _phase(x: np.ndarray, window: int) -> np.ndarray:
    """Phase over pi of the strongest positive frequency of the rows before."""
    out = np.full(len(x), np.nan)
    for i in range(window, len(x)):
        s = np.fft.fft(x[i - window : i])
        half = s[1 : window // 2]
        out[i] = np.angle(half[np.abs(half).argmax()]) / np.pi
    return out


@operator
def add_fft_phase_position(price_col: str = "Close", window: int = 700) -> Feature:
    return Feature().out(fft_phase_position=Rec(_phase, (price_col,), (window,)))


@operator
def adaptive_zscore(lookback: int = 700, vol_span: int = 100, price_col: str = "Close") -> Feature:
    f = Feature().let(_m=median(price_col, lookback), _x=f"CAST({price_col} AS DOUBLE)").let(_v=Rec(K.ewm_var, ("_x",), (2 / (vol_span + 1),)))
    return f.out(adaptive_zscore=div(f"{price_col} - _m", f"(sqrt(_v) + {num(1e-8)})"))


def _rank(x: np.ndarray, window: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if len(x) >= window:
        view = np.lib.stride_tricks.sliding_window_view(x, window)
        last = view[:, -1:]
        out[window - 1 :] = ((view < last).sum(1) + ((view == last).sum(1) + 1) / 2) / window
    return out


@operator
def quantile_position(lookback: int = 700, price_col: str = "Close") -> Feature:
    """Average rank of the price among the last rows, from -1 to 1."""
    return Feature().let(_q=Rec(_rank, (price_col,), (lookback,))).out(quantile_position="2 * (_q - CAST(0.5 AS DOUBLE))")


@operator
def add_close_window_columns(window: int = 60, price_col: str = "Close") -> Feature:
    """The rows before, scaled to -1..1 over themselves (-1 where they are all equal); rows of the warm-up stay, with nulls."""
    from ..functions.sql import high, lag, low

    f = Feature().let(_lo=low(price_col, window, None, -1), _hi=high(price_col, window, None, -1), **{f"_x{k}": lag(price_col, window - k) for k in range(window)})
    return f.out(**{f"close_win_{k}": f"2 * ((_x{k} - _lo) / (_hi - _lo + {num(1e-8)})) - 1" for k in range(window)})


#: Rows of a block of windows; each block leaves the sums of its windows' products.
PCA_ROWS = 8192


def _scaled_windows(x: np.ndarray, window: int):
    """Blocks of the windows before each row from row ``window`` on, each window scaled to -1..1."""
    view = np.lib.stride_tricks.sliding_window_view(x[:-1], window) if len(x) > window else np.zeros((0, window))
    for lo in range(0, len(view), 512):
        v = view[lo : lo + 512]
        low, high = v.min(1, keepdims=True), v.max(1, keepdims=True)
        yield lo, 2 * (v - low) / (high - low + 1e-8) - 1


def add_close_window_norm_pca(df: DataFrame, window: int = 700, n_components: int = 5, price_col: str = "Close") -> DataFrame:
    """``close_pca_0`` and on: the first components of a symbol's scaled windows, fitted to all of them (it looks ahead); null while a window is short.

    Windows are taken by blocks of rows, each with the rows before it. A block leaves the sums of its windows and of their
    products, row by row of the matrix; what comes together for a symbol is one matrix of window by window. A component's
    largest weight is positive.
    """
    names = [f"close_pca_{i}" for i in range(n_components)]
    size = max(PCA_ROWS, 4 * window)
    kept = [f for f in df.schema.fields if f.name not in names]
    rows = numbered(df.select(*[f"`{f.name}`" for f in kept]).withColumn("__x", F.col(f"`{price_col}`").cast("double")))
    rows = written(rows.withColumn(BLOCK, F.explode(F.expr(f"sequence({ROW} div {size}, ({ROW} + {window}) div {size})"))), "windows")
    kind = df.schema["symbol"].dataType.simpleString()

    def ordered(table: pa.Table) -> tuple[np.ndarray, int]:
        """The block's values after those before it, and how many come before."""
        at = table.column(ROW).to_numpy()
        return table.column("__x").to_numpy(), int((at < table.column(BLOCK)[0].as_py() * size).sum())

    def moments(table: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        x, _ = ordered(table)
        n, total, gram = 0, np.zeros(window), np.zeros((window, window))
        for _, v in _scaled_windows(x, window):
            n, total, gram = n + len(v), total + v.sum(0), gram + v.T @ v
        some = window if n else 0
        return pa.table({"symbol": pa.array([table.column("symbol")[0].as_py()] * some, table.schema.field("symbol").type), "i": pa.array(range(some), pa.int32()), "n": pa.array([n] * some, pa.int64()), "total": pa.array(total[:some]), "line": pa.array(gram[:some].tolist(), pa.list_(pa.float64()))})

    def summed(table: pa.Table) -> pa.Table:
        line = np.array(table.column("line").to_pylist()).sum(0)
        return pa.table({"symbol": table.column("symbol").slice(0, 1), "i": table.column("i").slice(0, 1), "n": pa.array([pc.sum(table.column("n")).as_py()], pa.int64()), "total": pa.array([pc.sum(table.column("total")).as_py()]), "line": pa.array([line.tolist()], pa.list_(pa.float64()))})

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        n, mean = table.column("n")[0].as_py(), table.column("total").to_numpy() / table.column("n")[0].as_py()
        axes = np.linalg.eigh(np.array(table.column("line").to_pylist()) - n * np.outer(mean, mean))[1][:, ::-1][:, :n_components]
        axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
        enough = n >= 2
        return pa.table({"symbol": table.column("symbol").slice(0, int(enough)), "mean": pa.array([mean.tolist()][: int(enough)], pa.list_(pa.float64())), "axes": pa.array([axes.T.ravel().tolist()][: int(enough)], pa.list_(pa.float64()))})

    sums = f"symbol {kind}, i int, n long, total double, line array<double>"
    parts = rows.select("symbol", ROW, BLOCK, "__x").groupBy("symbol", BLOCK).applyInArrow(moments, sums)
    fit = written(parts.groupBy("symbol", "i").applyInArrow(summed, sums).groupBy("symbol").applyInArrow(fitted, f"symbol {kind}, mean array<double>, axes array<double>"), "window-axes")
    begin = rows.select(F.col("symbol").alias("of"), F.col(BLOCK).alias("no")).distinct().join(fit, F.col("of") == fit["symbol"]).drop("symbol")

    def projected(table: pa.Table, given: pa.Table) -> pa.Table:
        table = table.sort_by(ROW)
        x, before = ordered(table)
        out = np.full((n_components, len(x)), np.nan)
        if given.num_rows:
            mean, axes = np.array(given.column("mean")[0].as_py()), np.array(given.column("axes")[0].as_py()).reshape(-1, window)
            for lo, v in _scaled_windows(x, window):
                out[: len(axes), window + lo : window + lo + len(v)] = axes @ (v - mean).T
        table = table.select([f.name for f in kept])
        for name, y in zip(names, out, strict=True):
            table = table.append_column(name, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return table.slice(before)

    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])
    return rows.groupBy("symbol", BLOCK).cogroup(begin.groupBy("of", "no")).applyInArrow(projected, schema)


OPERATORS["add_close_window_norm_pca"] = add_close_window_norm_pca
