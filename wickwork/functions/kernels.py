"""Recursions over one series, in numpy. Each gives an array as long as its inputs; nan where undefined."""

from __future__ import annotations

import numpy as np


def _valid(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~np.isnan(x))


def ema(x: np.ndarray, alpha: float, state: list[float] = ()) -> np.ndarray:
    """y = alpha * x + (1 - alpha) * y, from the first value on; nulls are passed over. ``state``: y so far."""
    out, at = np.full(len(x), np.nan), _valid(x)
    y = state[0] if state else None
    for i, v in zip(at.tolist(), x[at].tolist(), strict=True):
        y = v if y is None else alpha * v + (1 - alpha) * y
        out[i] = y
    return out


def ema_after(state: list[float], n: int, s: float, head: list[float], alpha: float) -> list[float]:
    """The state after n values whose sum, decayed by 1 - alpha, is ``s``."""
    return [(1 - alpha) ** n * (state or head)[0] + alpha * s]


def ewm(x: np.ndarray, alpha: float, least: int = 1, state: list[float] = ()) -> np.ndarray:
    """The mean of all values so far, weighted by powers of (1 - alpha); null before ``least`` values. ``state``: their number, sum and weight so far."""
    out, at = np.full(len(x), np.nan), _valid(x)
    before, a, b = state or (0, 0.0, 0.0)
    keep = 1 - alpha
    for n, (i, v) in enumerate(zip(at.tolist(), x[at].tolist(), strict=True), int(before) + 1):
        a, b = v + keep * a, 1 + keep * b
        if n >= least:
            out[i] = a / b
    return out


def ewm_after(state: list[float], n: int, s: float, head: list[float], alpha: float) -> list[float]:
    before, a, b = state or (0, 0.0, 0.0)
    fade = (1 - alpha) ** n
    return [before + n, fade * a + s, fade * b + (1 - fade) / alpha]


def ewm_var(x: np.ndarray, alpha: float) -> np.ndarray:
    """The variance under the weights of ``ewm``, bias-corrected; null for a single value."""
    out, at = np.full(len(x), np.nan), _valid(x)
    w = w2 = m = s = 0.0
    keep = 1 - alpha
    for i, v in zip(at.tolist(), x[at].tolist(), strict=True):
        w, w2, s = keep * w, keep * keep * w2, keep * s
        d = v - m
        w, w2 = w + 1, w2 + 1
        m += d / w
        s += d * (v - m)
        bias = w * w - w2
        if bias > 1e-12:
            out[i] = s / w * (w * w / bias)
    return out


def seeded(x: np.ndarray, n: int, state: list[float] = ()) -> np.ndarray:
    """The mean of the first n values at the n-th, then an ema of span n. ``state``: y so far, or all values if they are fewer than n."""
    out, at = np.full(len(x), np.nan), _valid(x)
    alpha, values = 2 / (n + 1), x[at]
    if state and state[0] == 1:
        y = state[1]
    else:
        first = list(state[1:])
        missing = n - len(first)
        if len(at) < missing:
            return out
        y = float(np.mean([*first, *values[:missing]]))
        out[at[missing - 1]] = y
        at, values = at[missing:], values[missing:]
    for i, v in zip(at.tolist(), values.tolist(), strict=True):
        y = alpha * v + (1 - alpha) * y
        out[i] = y
    return out


def seeded_after(state: list[float], count: int, s: float, head: list[float], n: int) -> list[float]:
    """(1, y), or before the n-th value (0, all values)."""
    alpha, keep = 2 / (n + 1), 1 - 2 / (n + 1)
    if state and state[0] == 1:
        return [1, keep**count * state[1] + alpha * s]
    first = state[1:]
    missing = n - len(first)
    if count < missing:
        return [0, *first, *head[:count]]
    start = float(np.mean([*first, *head[:missing]]))
    early = sum(v * keep ** (missing - 1 - k) for k, v in enumerate(head[:missing]))
    fade = keep ** (count - missing)
    return [1, fade * start + alpha * (s - fade * early)]


def super_trend_step(close: float, up: float, lo: float, state: tuple[float, float], first: bool) -> tuple[float, float]:
    """The trailing level and the direction after a bar, from those before it."""
    if first:
        return (lo, 1.0) if not close < up else (up, -1.0)
    last, way = state
    if way > 0:
        at = lo if not last > lo else last
        return (up, -1.0) if close < at else (at, 1.0)
    at = up if not last < up else last
    return (lo, 1.0) if close > at else (at, -1.0)


def super_trend(close: np.ndarray, upper: np.ndarray, lower: np.ndarray, period: int) -> np.ndarray:
    """The trailing level and the direction, +1 or -1 (0 before the first), as two rows."""
    n = len(close)
    level, way = np.full(n, np.nan), np.zeros(n)
    state = (np.nan, 0.0)
    for i, (c, up, lo) in enumerate(zip(close[period:].tolist(), upper[period:].tolist(), lower[period:].tolist(), strict=True), period):
        level[i], way[i] = state = super_trend_step(c, up, lo, state, i == period)
    return np.stack([level, way])


def kagi(close: np.ndarray, threshold: np.ndarray, taps: int = 9) -> np.ndarray:
    """A reversal line, smoothed by a quadratic over ``taps`` rows; at either end the outermost quadratic goes on.

    Every row is a sum of weights times values from left to right: where the line is flat, its scaled range is the last bits
    of these sums, so their order is part of the result.
    """
    n = len(close)
    line, up = np.empty(n), True
    for i in range(n):
        if i == 0:
            line[0] = close[0]
            continue
        move = close[i] - line[i - 1]
        if (move > 0) if up else (move < 0):
            line[i] = line[i - 1] + move
        elif abs(move) >= threshold[i]:
            up, line[i] = not up, line[i - 1] + move
        else:
            line[i] = line[i - 1]
    if n < taps:
        return np.full(n, np.nan)
    half = taps // 2
    at = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(at, 3))

    def smooth(place: int, rows: np.ndarray) -> np.ndarray:
        out = 0.0
        for k, w in enumerate((np.vander([place], 3) @ fit)[0].tolist()):
            out = out + w * rows[..., k]
        return out

    out = np.empty(n)
    out[half : n - half] = smooth(0, np.lib.stride_tricks.sliding_window_view(line, taps))
    for place in range(1, half + 1):
        out[half - place], out[n - 1 - half + place] = smooth(-place, line[:taps]), smooth(place, line[-taps:])
    return out


def theta(x: np.ndarray, period: int) -> np.ndarray:
    """A baseline that drifts to the mean of the rows before and takes half of the change over ``period`` rows."""
    out = np.full(len(x), np.nan)
    if len(x) < period:
        return out
    out[period - 1] = y = x[:period].mean()
    for i in range(period, len(x)):
        y += (x[i - period : i].mean() - y) / period + 0.5 * (x[i] - x[i - period])
        out[i] = y
    return out


def psar_step(high: float, low: float, before: list[tuple], state: tuple | None, step: float, most: float) -> tuple[tuple | None, float]:
    """(up, sar, extreme point, step size) after a bar, and the stop if the trend is up, else nan.

    ``before`` are the last bars (high, low, ...), the newest last; the first bar only waits for the second.
    """
    if not before:
        return None, np.nan
    h1, l1 = before[-1][:2]
    h2, l2 = before[-2][:2] if len(before) > 1 else (h1, l1)
    if state is None:
        up = not (l1 - low > max(0.0, high - h1))
        state = (True, l1, h1, step) if up else (False, h1, l1, step)
    up, sar, ep, af = state
    sar += af * (ep - sar)
    if up:
        turn = low < sar
        if high > ep:
            ep, af = high, min(most, af + step)
        sar = min(sar, l1, l2)
    else:
        turn = high > sar
        if low < ep:
            ep, af = low, min(most, af + step)
        sar = max(sar, h1, h2)
    if turn:
        up, sar, af = not up, ep, step
        ep = high if up else low
    return (up, sar, ep, af), sar if up else np.nan


def psar_long(high: np.ndarray, low: np.ndarray, step: float, most: float) -> np.ndarray:
    """Parabolic SAR where the trend is up, else null."""
    out, state, before = np.full(len(high), np.nan), None, []
    for i, (h, lo) in enumerate(zip(high.tolist(), low.tolist(), strict=True)):
        state, out[i] = psar_step(h, lo, before, state, step, most)
        before = [*before[-1:], (h, lo)]
    return out


def first_break(high: np.ndarray, close: np.ndarray, fractal: np.ndarray) -> np.ndarray:
    """1 on rows whose close is the first above an earlier fractal high, else 0; a stack keeps the unbroken highs."""
    out, open_ = np.zeros(len(high)), []
    for i in range(len(high)):
        while open_ and open_[-1] < close[i]:
            open_.pop()
            out[i] = 1
        if fractal[i] == 1:
            # The stack falls from bottom to top, so the lowest open high is on top.
            at = len(open_)
            while at and open_[at - 1] < high[i]:
                at -= 1
            open_.insert(at, high[i])
    return out
