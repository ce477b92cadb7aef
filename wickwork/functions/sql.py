"""Expressions over the rows of a symbol, as Spark SQL text.

Every function takes and gives SQL. Rows are addressed by position: frames are ROWS frames over the rows of a symbol in
the order of ``seq``. An average over w rows is null until w values are there, unless ``least`` says otherwise.
Division by zero is null.
"""

from __future__ import annotations

BY = "PARTITION BY symbol ORDER BY seq"


def over(lo: int | None, hi: int | None = 0) -> str:
    """A frame from row ``lo`` to row ``hi`` relative to the current one; None is unbounded."""
    edge = lambda n, word: f"UNBOUNDED {word}" if n is None else "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"
    return f"OVER ({BY} ROWS BETWEEN {edge(lo, 'PRECEDING')} AND {edge(hi, 'FOLLOWING')})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY})" if k >= 0 else f"lead({x}, {-k}) OVER ({BY})"


def diff(x: str, k: int = 1) -> str:
    return f"({x} - {lag(x, k)})"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def pct(x: str, k: int = 1) -> str:
    """Relative change against k rows ago."""
    return f"({div(x, lag(x, k))} - 1)"


def roll(fn: str, x: str, w: int, least: int | None = None, end: int = 0) -> str:
    """``fn`` over the ``w`` rows up to the one ``end`` rows away, null with fewer than ``least`` (w) values."""
    frame = over(end - w + 1, end)
    least = w if least is None else least
    body = f"{fn}({x}) {frame}"
    return body if least <= 1 else f"CASE WHEN count({x}) {frame} >= {least} THEN {body} END"


def mean(x: str, w: int, least: int | None = None, end: int = 0) -> str:
    return roll("avg", x, w, least, end)


def total(x: str, w: int, least: int | None = None, end: int = 0) -> str:
    return roll("sum", x, w, least, end)


def low(x: str, w: int, least: int | None = None, end: int = 0) -> str:
    return roll("min", x, w, least, end)


def high(x: str, w: int, least: int | None = None, end: int = 0) -> str:
    return roll("max", x, w, least, end)


def std(x: str, w: int, end: int = 0) -> str:
    return roll("stddev_samp", x, w, None, end)


def median(x: str, w: int) -> str:
    """The middle of w values."""
    frame = over(1 - w, 0)
    return f"CASE WHEN count({x}) {frame} >= {w} THEN percentile({x}, 0.5D) {frame} END"


def whole(fn: str, x: str) -> str:
    """``fn`` over all rows of the symbol."""
    return f"{fn}({x}) OVER (PARTITION BY symbol)"


def upto(fn: str, x: str) -> str:
    """``fn`` over all rows so far."""
    return f"{fn}({x}) {over(None, 0)}"


def ffill(x: str, hi: int = 0) -> str:
    """The last value that isn't null, as of ``hi`` rows away."""
    return f"last_value({x}) IGNORE NULLS {over(None, hi)}"


def bfill(x: str) -> str:
    return f"first_value({x}) IGNORE NULLS {over(0, None)}"


def clip(x: str, a: float, b: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {num(a)}), {num(b)}) END"


def flag(cond: str) -> str:
    """1 or 0; an unknown condition counts as 0."""
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END"


def num(x: float) -> str:
    """A double literal."""
    return f"CAST({x!r} AS DOUBLE)"


def fires_within(x: str, k: int) -> str:
    """A 0/1 column, or 1 if it was 1 in one of the k rows before."""
    return f"coalesce(max({x}) {over(-k, 0)}, 0)"


def minmax(x: str, lo: str, hi: str, eps: float) -> str:
    """2 * (x - lo) / (hi - lo + eps) - 1."""
    return f"(2 * {div(f'{x} - {lo}', f'({hi} - {lo} + {num(eps)})')} - 1)"


TR = "greatest(High - Low, abs(High - _pc), abs(Low - _pc))"
#: As TR, but null where there is no row before.
TR_STRICT = f"CASE WHEN _pc IS NOT NULL THEN {TR} END"
PC = {"_pc": lag("Close")}
HLC3, HL2 = "((High + Low + Close) / 3)", "((High + Low) / 2)"
