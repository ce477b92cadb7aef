"""Features in levels: what reads only earlier results is computed together.

A level is either a set of SQL expressions, which become one projection over one window partitioning, or a set of
recursions, which become one grouped-map call per symbol. A feature lists the columns it leaves; those whose names begin
with an underscore are helpers and go.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from .blocks import Linear, with_carry, with_view

@dataclass(frozen=True)
class Rec:
    """A recursion: a kernel over columns; of a kernel that gives several series, ``pick`` is the one meant.

    Recursions that differ in ``pick`` only are computed once.
    """

    kernel: Callable[..., np.ndarray]
    columns: tuple[str, ...]
    args: tuple = ()
    pick: int | None = None


@dataclass
class Feature:
    """Levels and the columns they leave."""

    levels: list[dict[str, str | Rec]] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    causal: bool = True

    def let(self, **columns: str | Rec) -> Feature:
        """Add a level of helpers."""
        if columns:
            self.levels.append(columns)
        return self

    def out(self, **columns: str | Rec) -> Feature:
        """Add a level of results."""
        self.outputs += [c for c in columns if c not in self.outputs]
        return self.let(**columns)

    def then(self, other: Feature) -> Feature:
        """Append another feature's levels; its results stay."""
        self.levels += other.levels
        self.outputs += [c for c in other.outputs if c not in self.outputs]
        self.causal &= other.causal
        return self

    def add_to(self, df: DataFrame, block_rows: int | None = None) -> DataFrame:
        """``df`` with the results; columns of the same names are replaced.

        With ``block_rows``, or the session's ``wickwork.blockRows``, averages of long symbols are carried over blocks of so
        many rows, each a group of its own; otherwise a symbol's averages are one group.
        """
        block_rows = block_rows or int(df.sparkSession.conf.get("wickwork.blockRows", "0")) or None
        steps, final = self.schedule()
        kept = [c for c in df.columns if c not in self.outputs]
        for step in steps:
            if isinstance(next(iter(step.values())), Rec):
                df = run_kernels(df, step, block_rows)
            else:
                df = df.withColumns({k: F.expr(v) for k, v in step.items()})
        return df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(final[c]).alias(c) for c in self.outputs])

    def schedule(self) -> tuple[list[dict[str, str | Rec]], dict[str, str]]:
        """The levels in as few steps as their dependencies allow, and the name under which each result is found.

        Every definition gets a name of its own, so features that use the same helper names can be taken together:
        all expressions that are ready are one step, and all recursions that are ready one grouped map, however many
        features they come from.
        """
        now: dict[str, str] = {}
        todo: dict[str, tuple[str | Rec, set[str]]] = {}
        known: dict[str | Rec, str] = {}
        for level in self.levels:
            fresh: dict[str, str] = {}
            for name, x in level.items():
                if isinstance(x, Rec):
                    x = Rec(x.kernel, tuple(now.get(c, c) for c in x.columns), x.args, x.pick)
                    needs = set(x.columns)
                else:
                    x = _NAME.sub(lambda m: now.get(m[0], m[0]), x)
                    needs = set(_NAME.findall(x))
                if x not in known:
                    known[x] = f"__{len(todo)}_{re.sub(r'[^0-9A-Za-z_]', '_', name)}"
                    todo[known[x]] = (x, needs)
                fresh[name] = known[x]
            now |= fresh
        steps: list[dict[str, str | Rec]] = []
        while todo:
            ready = {k: x for k, (x, needs) in todo.items() if not needs & todo.keys()}
            step = {k: x for k, x in ready.items() if not isinstance(x, Rec)} or ready
            steps.append(step)
            for k in step:
                del todo[k]
        return steps, now


_NAME = re.compile(r"[A-Za-z_]\w*")


#: How many rows before a row a kernel looks at, by its arguments; kernels that look further back, or ahead, aren't here.
VIEWS: dict[str, Callable[..., int]] = {}


def _linear(r: Rec) -> Linear | None:
    """How a recursion is carried from block to block."""
    name, args = r.kernel.__name__, r.args
    if name == "ema":
        return Linear(1 - args[0], 1, lambda *s: K.ema_after(*s, args[0]), lambda x, state: K.ema(x, args[0], state))
    if name == "ewm":
        return Linear(1 - args[0], 0, lambda *s: K.ewm_after(*s, args[0]), lambda x, state: K.ewm(x, *(args if len(args) > 1 else (*args, 1)), state))
    if name == "seeded":
        return Linear(1 - 2 / (args[0] + 1), args[0], lambda *s: K.seeded_after(*s, args[0]), lambda x, state: K.seeded(x, args[0], state))
    return None


def _computed(recs: dict[str, Rec]) -> Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]:
    """All series of ``recs`` from the input series; a kernel that gives several is called once."""

    def run(series: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        done, out = {}, {}
        for name, r in recs.items():
            call = (r.kernel, r.columns, r.args)
            if call not in done:
                done[call] = r.kernel(*[series[c] for c in r.columns], *r.args)
            out[name] = done[call] if r.pick is None else done[call][r.pick]
        return out

    return run


def run_kernels(df: DataFrame, recs: dict[str, Rec], block_rows: int | None = None) -> DataFrame:
    """All recursions of a level: kernels with a bounded view by blocks, averages by blocks if asked for, and all others in one grouped map.

    Only the order and the inputs enter the kernels; the other columns pass through the Arrow table unread.
    """
    dotted = {c: f"__dot{i}" for i, c in enumerate(df.columns) if "." in c}
    if dotted:  # a grouped map takes no names with dots
        out = run_kernels(df.toDF(*[dotted.get(c, c) for c in df.columns]), recs, block_rows)
        back = {v: k for k, v in dotted.items()}
        return out.toDF(*[back.get(c, c) for c in out.columns])
    inputs = {c for r in recs.values() for c in r.columns}
    df = df.withColumns({c: F.col(c).cast("double") for c in inputs if df.schema[c].dataType != T.DoubleType()})
    viewing = {k: r for k, r in recs.items() if r.kernel.__name__ in VIEWS}
    if viewing:
        before = max(VIEWS[r.kernel.__name__](*r.args) for r in viewing.values())
        df = with_view(df, list(viewing), sorted({c for r in viewing.values() for c in r.columns}), before, _computed(viewing))
    carried = {k: (r.columns[0], how) for k, r in recs.items() if block_rows and (how := _linear(r))}
    if carried:
        df = with_carry(df, carried, block_rows)
    whole = {k: r for k, r in recs.items() if k not in viewing and k not in carried}
    if not whole:
        return df
    schema = T.StructType([f for f in df.schema.fields if f.name not in whole] + [T.StructField(k, T.DoubleType()) for k in whole])
    keep, compute = [f.name for f in schema.fields if f.name not in whole], _computed(whole)
    inputs = sorted({c for r in whole.values() for c in r.columns})

    def run(table):
        table = table.sort_by("seq")
        out = table.select(keep)
        for name, y in compute({c: table.column(c).to_numpy() for c in inputs}).items():
            out = out.append_column(name, pa.array(y, pa.float64(), mask=np.isnan(y)))
        return out

    return df.groupBy("symbol").applyInArrow(run, schema)
