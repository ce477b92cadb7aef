"""What operators have in common: registration, and the pieces that many of them start from."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions import kernels as K
from ..functions.sql import PC, TR, TR_STRICT, clip, diff, div, flag, high, lag, low, mean, num, whole
from ..plans.levels import Feature, Rec

OPERATORS: dict[str, Callable[..., DataFrame]] = {}


def operator(build: Callable[..., Feature]) -> Callable[..., DataFrame]:
    """Register a feature: called with bars and its parameters (and ``block_rows``, for long symbols) it returns the bars with the feature's columns.

    ``.feature(...)`` is the feature itself, for combining or for writing it as SQL.
    """

    @functools.wraps(build)
    def apply(df: DataFrame, *args, block_rows: int | None = None, **kwargs) -> DataFrame:
        return build(*args, **kwargs).add_to(df, block_rows)

    apply.feature = build
    OPERATORS[build.__name__] = apply
    return apply


def ema(x: str, span: int) -> Rec:
    """Starts at the first value."""
    return Rec(K.ema, (x,), (2 / (span + 1),))


def ewm(x: str, span: int) -> Rec:
    """Normalised weights."""
    return Rec(K.ewm, (x,), (2 / (span + 1),))


def wilder(x: str, n: int) -> Rec:
    return Rec(K.ewm, (x,), (1 / n, n))


def seeded(x: str, n: int) -> Rec:
    """Starts at the n-th value with the mean of the first n."""
    return Rec(K.seeded, (x,), (n,))


def gains(f: Feature, src: str = "Close", p: str = "") -> Feature:
    """Helpers: gain and loss against the row before, null on the first row."""
    f.let(**{f"_{p}d": diff(src)})
    d = f"_{p}d"
    return f.let(**{f"_{p}up": f"CASE WHEN {d} > 0 THEN {d} WHEN {d} IS NOT NULL THEN 0 END", f"_{p}dn": f"CASE WHEN {d} < 0 THEN -{d} WHEN {d} IS NOT NULL THEN 0 END"})


def rsi(f: Feature, name: str, n: int, src: str = "Close") -> Feature:
    """Wilder's RSI, 0..100, from row n on; null where nothing moved."""
    p = f"{name.strip('_')}_"
    gains(f, src, p).let(**{f"_{p}g": wilder(f"_{p}up", n), f"_{p}l": wilder(f"_{p}dn", n)})
    return f.let(**{name: f"100 * {div(f'_{p}g', f'(_{p}g + _{p}l)')}"})


def rsi_plain(f: Feature, name: str, n: int, eps: float, src: str = "Close", first_row: bool = True, least: int | None = None) -> Feature:
    """RSI of plain means; with ``first_row`` the first row counts as no move, so it starts at row n - 1."""
    p = f"{name.strip('_')}_"
    gains(f, src, p)
    up, dn = f"_{p}up", f"_{p}dn"
    if first_row:
        f.let(**{f"_{p}up0": f"coalesce({up}, 0)", f"_{p}dn0": f"coalesce({dn}, 0)"})
        up, dn = f"_{p}up0", f"_{p}dn0"
    f.let(**{f"_{p}mg": mean(up, n, least), f"_{p}ml": mean(dn, n, least)})
    bottom = f"(_{p}ml + {num(eps)})" if eps else f"_{p}ml"
    return f.let(**{name: f"100 - {div('100', f'(1 + {div(f"_{p}mg", bottom)})')}"})


def true_range(f: Feature, strict: bool = False) -> Feature:
    """Helper _tr; ``strict`` leaves the first row null."""
    return f.let(**PC).let(_tr=TR_STRICT if strict else TR)


def zscore_all(f: Feature, name: str, x: str, eps: float) -> Feature:
    return f.let(_zm=whole("avg", x), _zs=whole("stddev_samp", x)).let(**{name: div(f"{x} - _zm", f"(_zs + {num(eps)})")})


def middle(hi: str, lo: str, w: int, least: int | None = None) -> str:
    """Half of highest plus lowest."""
    return f"(({high(hi, w, least)}) + ({low(lo, w, least)})) / 2"


__all__ = ["OPERATORS", "Feature", "K", "Rec", "clip", "diff", "div", "ema", "ewm", "flag", "gains", "lag", "middle", "operator", "rsi", "rsi_plain", "seeded", "true_range", "wilder", "zscore_all"]
