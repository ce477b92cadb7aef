"""Kernels over blocks of a symbol's rows, so that a long symbol is many tasks.

A kernel that sees only the rows around one gets these rows with its block. A linear recursion is summed up by block; the
sums, a row for each block, are folded into what each block starts from; then every block goes on from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

ROW, BLOCK = "__row", "__block"
#: Rows of a block of a kernel with a bounded view; at least four times the view.
VIEW_ROWS = 4096


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with the row's number within its symbol, from 0; the order that window levels have already."""
    return df.withColumn(ROW, F.expr("row_number() OVER (PARTITION BY symbol ORDER BY seq) - 1"))


def _append(table: pa.Table, series: dict[str, np.ndarray]) -> pa.Table:
    for name, y in series.items():
        table = table.append_column(name, pa.array(y, pa.float64(), mask=np.isnan(y)))
    return table


def with_view(df: DataFrame, names: list[str], inputs: list[str], before: int, compute: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with the series ``names``: ``compute`` over the ``inputs`` of each block and of the ``before`` rows in front of it."""
    size = max(VIEW_ROWS, 4 * before)
    kept = [f for f in df.schema.fields if f.name not in names]
    rows = numbered(df.select(*[f"`{f.name}`" for f in kept]))
    rows = rows.withColumn(BLOCK, F.explode(F.expr(f"sequence({ROW} div {size}, ({ROW} + {before}) div {size})")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        got = compute({c: table.column(c).to_numpy() for c in inputs})
        own = pc.equal(pc.divide(table.column(ROW), size), table.column(BLOCK))
        return _append(table.select([f.name for f in kept]), got).filter(own)

    return rows.groupBy("symbol", BLOCK).applyInArrow(run, T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]]))


@dataclass(frozen=True)
class Linear:
    """A recursion y = keep * y + gain * x over the values that aren't null, by block.

    ``head`` is how many of a symbol's first values the start takes. ``fold`` gives the state after a block from the state
    before it, the block's number of values, their decayed sum and its first values; ``run`` goes on from a state.
    """

    keep: float
    head: int
    fold: Callable[[list[float], int, float, list[float]], list[float]]
    run: Callable[[np.ndarray, list[float]], np.ndarray]


def decayed_sum(x: np.ndarray, keep: float) -> float:
    """The values' sum, each times ``keep`` to the number of values after it."""
    return float(x @ keep ** np.arange(len(x) - 1, -1, -1, dtype=float)) if len(x) else 0.0


def with_carry(df: DataFrame, recursions: dict[str, tuple[str, Linear]], rows_per_block: int) -> DataFrame:
    """``df`` with a series for each recursion (its input column, how it goes on); every block of ``rows_per_block`` rows is a group of its own.

    Rows are written down once, since they are read twice. The states of a symbol's blocks are folded in one group: a row
    for each block, with the first values of the block where a start needs them.
    """
    kept = [f for f in df.schema.fields if f.name not in recursions]
    rows = written(numbered(df.select(*[f"`{f.name}`" for f in kept])).withColumn(BLOCK, F.expr(f"{ROW} div {rows_per_block}")), "blocks")
    inputs = sorted({c for c, _ in recursions.values()})
    order = list(recursions)

    def summed(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        series = {c: (v := table.column(c).to_numpy())[~np.isnan(v)] for c in inputs}
        out: dict[str, list] = {"symbol": [table.column("symbol")[0].as_py()], BLOCK: [table.column(BLOCK)[0].as_py()], "n": [[]], "s": [[]], "head": [[]]}
        for name in order:
            column, how = recursions[name]
            x = series[column]
            out["n"][0].append(len(x))
            out["s"][0].append(decayed_sum(x, how.keep))
            out["head"][0].append(x[: how.head].tolist())
        return pa.table(out, schema=pa.schema([("symbol", table.schema.field("symbol").type), (BLOCK, pa.int64()), ("n", pa.list_(pa.int64())), ("s", pa.list_(pa.float64())), ("head", pa.list_(pa.list_(pa.float64())))]))

    kind = df.schema["symbol"].dataType.simpleString()
    sums = rows.select("symbol", "seq", BLOCK, *[f"`{c}`" for c in inputs]).groupBy("symbol", BLOCK)
    sums = written(sums.applyInArrow(summed, f"symbol {kind}, {BLOCK} long, n array<long>, s array<double>, head array<array<double>>"), "block-sums")

    def folded(table: pa.Table) -> pa.Table:
        table = table.sort_by(BLOCK)
        states: list[list[float]] = [[] for _ in order]
        starts = []
        for n, s, head in zip(*[table.column(c).to_pylist() for c in ("n", "s", "head")], strict=True):
            starts.append(list(states))
            states = [recursions[name][1].fold(state, *each) if each[0] else state for name, state, each in zip(order, states, zip(n, s, head, strict=True), strict=True)]
        return pa.table({"symbol": table.column("symbol"), BLOCK: table.column(BLOCK), "states": pa.array(starts, pa.list_(pa.list_(pa.float64())))})

    states = sums.groupBy("symbol").applyInArrow(folded, f"symbol {kind}, {BLOCK} long, states array<array<double>>")

    def run(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        begin = start.column("states")[0].as_py()
        got = {name: recursions[name][1].run(table.column(recursions[name][0]).to_numpy(), state) for name, state in zip(order, begin, strict=True)}
        return _append(table.select([f.name for f in kept]), got)

    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in order]])
    return rows.groupBy("symbol", BLOCK).cogroup(states.groupBy("symbol", BLOCK)).applyInArrow(run, schema)
