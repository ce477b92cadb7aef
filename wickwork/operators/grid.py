"""Random forests for a whole grid of labels, grown together.

Features are cut into bins once and every row carries its label under each pair of the grid, so the forests of all pairs
grow over one table. A level of all trees is one scan: rows find their node in every tree, tasks add up rows and positives
by (tree, node, feature, bin), and the best split of a node follows from its sums. What reaches the driver is a split for
each node. Bootstrap counts and the features that a node may use come from hashes, so a forest doesn't depend on how rows
are spread, nor on which other labels grow beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import written
from .label import ahead, touch

#: Sums that a task holds before it hands them on.
CELLS = 1 << 19
#: Nodes of a tree that are split in one group.
NODES = 64


@dataclass(frozen=True)
class Settings:
    """How trees grow. ``subsample`` is the mean of a row's count in a tree (None: every row once), ``share`` that of features tried at a node."""

    depth: int = 13
    subsample: float | None = 0.7
    share: float = 0.8
    least_leaf: int = 6
    least_split: int = 5
    least_gain: float = 2e-4
    positive_weight: float = 5.0
    seed: int = 3


def quantile_cuts(df: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Thresholds for each feature, at most ``bins`` - 1, from approximate quantiles; one pass."""
    row = df.agg(*[F.percentile_approx(f"`{c}`", [k / bins for k in range(1, bins)], 10_000).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [sorted(set(row[f"q{k}"] or [])) for k in range(len(features))]


def grid_of(rr_thresholds, targets) -> list[tuple[float, float]]:
    return [(float(rr), float(t)) for rr in rr_thresholds for t in targets]


def labels_of(grid: list[tuple[float, float]], target_candles: int) -> Column:
    """An array with the first-touch label of each (rr_threshold, target), from one look at the rows ahead."""
    pairs = F.array(*[F.struct(F.lit(t).alias("up"), F.lit(t / rr).alias("down")) for rr, t in grid])
    return F.transform(pairs, lambda g: touch(F.col("_ahead"), g["up"], g["down"]).cast("tinyint"))


def binned(bars: DataFrame, features: list[str], cuts: list[list[float]], grid: list[tuple[float, float]], target_candles: int = 20) -> DataFrame:
    """(symbol, seq, key, bins, labels): the number of cuts below each feature's value, and the labels; rows with a null feature are left out."""
    bin_of = lambda c, at: F.size(F.filter(F.array(*map(F.lit, at)), lambda t: t < F.col(f"`{c}`"))).cast("smallint") if at else F.lit(0).cast("smallint")
    rows = bars.withColumn("_ahead", ahead(target_candles)).na.drop(subset=features)
    return rows.select("symbol", "seq", F.xxhash64("symbol", "seq").alias("key"), F.array(*[bin_of(c, at) for c, at in zip(features, cuts, strict=True)]).alias("bins"), labels_of(grid, target_candles).alias("labels"))


def _mixed(*parts) -> np.ndarray:
    """A hash of whole numbers, spread over 64 bits."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = h ^ np.asarray(p).astype(np.uint64)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            h = h ^ h >> np.uint64(31)
    return h


def row_counts(key: np.ndarray, trees: np.ndarray, s: Settings) -> np.ndarray:
    """(rows, trees): how often each row counts in each tree, a Poisson number."""
    if s.subsample is None:
        return np.ones((len(key), len(trees)), np.int64)
    steps, p = [], np.exp(-s.subsample)
    for k in range(1, 16):
        steps.append(p + (steps[-1] if steps else 0.0))
        p *= s.subsample / k
    u = (_mixed(key[:, None], trees[None, :], s.seed) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(np.array(steps), u, "right")


class Forests:
    """The trees of all labels: arrays by (label * trees + tree, node). The root is node 1, the children of n are 2n and 2n + 1."""

    def __init__(self, n_labels: int, trees: range) -> None:
        self.n_labels, self.trees = n_labels, trees
        self.feature = np.full((n_labels * len(trees), 2), -1, np.int16)
        self.cut = np.full(self.feature.shape, -1, np.int16)
        self.value = np.full(self.feature.shape, np.nan, np.float32)

    def deeper(self) -> None:
        """Room for another level."""
        for name, empty in (("feature", -1), ("cut", -1), ("value", np.nan)):
            old = getattr(self, name)
            setattr(self, name, np.concatenate([old, np.full(old.shape, empty, old.dtype)], axis=1))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """(rows, trees of all labels): the node in which each row stands."""
        at = np.ones((len(bins), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(bins))[:, None]
        while True:
            f = self.feature[tree, at]
            on = f >= 0
            if not on.any():
                return at
            right = bins[row, np.maximum(f, 0)] > self.cut[tree, at]
            at = np.where(on, 2 * at + right, at)

    def votes(self, bins: np.ndarray) -> np.ndarray:
        """(rows, labels): the sum of the trees' shares of positives."""
        value = self.value[np.arange(len(self.feature))[None, :], self.nodes(bins)]
        return value.reshape(len(bins), self.n_labels, len(self.trees)).astype(float).sum(2)


def _lists(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(n, -1).astype(np.int64)


CELL = "tree int, node long, feature int, bin int, n long, positive long"


def _cells(forests: Forests, level: int, s: Settings):
    """Rows and positives by (tree, node, feature, bin) over the nodes of one level."""
    trees = np.array(forests.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, int]] = {}

        def give() -> pa.RecordBatch:
            keys = np.array(list(sums), np.int64)
            both = np.array(list(sums.values()), np.int64).reshape(-1, 2)
            sums.clear()
            names = [c.split()[0] for c in CELL.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array((keys >> 38).astype(np.int32)), pa.array(keys >> 22 & 0xFFFF), pa.array((keys >> 11 & 0x7FF).astype(np.int32)), pa.array((keys & 0x7FF).astype(np.int32)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=names)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            bins, labels = _lists(b.column("bins"), n), _lists(b.column("labels"), n)
            count = np.tile(row_counts(b.column("key").to_numpy(), trees, s), (1, forests.n_labels))
            label = np.repeat(labels, len(trees), axis=1)
            at = forests.nodes(bins)
            row, tree = np.nonzero((at >= 1 << level) & (count > 0))
            if not len(row):
                continue
            w = count[row, tree]
            positive = w * label[row, tree]
            for f in range(bins.shape[1]):
                key = tree.astype(np.int64) << 38 | at[row, tree] << 22 | f << 11 | bins[row, f]
                cells, place = np.unique(key, return_inverse=True)
                for k, x, y in zip(cells.tolist(), np.bincount(place, w).astype(np.int64).tolist(), np.bincount(place, positive).astype(np.int64).tolist(), strict=True):
                    old = sums.get(k, (0, 0))
                    sums[k] = old[0] + x, old[1] + y
            if len(sums) > CELLS:
                yield give()
        if sums:
            yield give()

    return run


def _entropy(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    p = np.divide(positive, total, out=np.zeros_like(total), where=total > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return -(np.where(p > 0, p * np.log2(p), 0) + np.where(p < 1, (1 - p) * np.log2(1 - p), 0))


SPLIT = "tree int, node long, feature int, cut int, gain double, value double, weight double, n long, n_left long"


def _best(n_features: int, n_bins: int, first_tree: int, n_trees: int, roots: np.ndarray, s: Settings):
    """The best split of each node, feature -1 where none is good enough; of equal ones the first by feature and cut."""
    tried = max(1, int(s.share * n_features))

    def run(table: pa.Table) -> pa.Table:
        tree = int(table.column("tree")[0].as_py())
        node, place = np.unique(table.column("node").to_numpy(), return_inverse=True)
        n, positive = np.zeros((2, len(node), n_features, n_bins))
        at = place, table.column("feature").to_numpy(), table.column("bin").to_numpy()
        n[at], positive[at] = table.column("n").to_numpy(), table.column("positive").to_numpy()
        n, positive = n.cumsum(2), positive.cumsum(2)
        all_n, all_p = n[:, :1, -1:], positive[:, :1, -1:]
        weigh = lambda k, p: k - p + s.positive_weight * p
        w, whole = weigh(n, positive), weigh(all_n, all_p)
        left, right = s.positive_weight * positive, s.positive_weight * (all_p - positive)
        inner = (w * _entropy(left, w) + (whole - w) * _entropy(right, whole - w)) / whole
        root = roots[tree] if len(roots) else whole[0, 0, 0]
        gain = whole / root * (_entropy(s.positive_weight * all_p, whole) - inner)
        order = _mixed((first_tree + tree % n_trees), node[:, None], np.arange(n_features)[None, :], s.seed).argsort(1).argsort(1)
        ok = (n >= s.least_leaf) & (all_n - n >= s.least_leaf) & (all_n >= s.least_split) & (order < tried)[:, :, None]
        gain = np.where(ok, gain, -1.0).reshape(len(node), -1)
        best = gain.argmax(1)
        found = gain[np.arange(len(node)), best]
        split = found >= s.least_gain
        f, c = np.where(split, best // n_bins, -1), np.where(split, best % n_bins, -1)
        n_left = np.where(split, n[np.arange(len(node)), f, c], 0)
        value = (s.positive_weight * all_p / whole)[:, 0, 0]
        cols = ([tree] * len(node), node, f, c, found, value, whole[:, 0, 0], all_n[:, 0, 0], n_left)
        return pa.table({d.split()[0]: pa.array(x).cast({"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[d.split()[1]]) for d, x in zip(SPLIT.split(", "), cols, strict=True)})

    return run


def best_splits(rows: DataFrame, forests: Forests, level: int, n_features: int, n_bins: int, roots: np.ndarray, s: Settings) -> DataFrame:
    """``SPLIT`` for every node of ``level`` that has rows: one scan of ``rows`` and one aggregate for all labels and trees."""
    cells = rows.select("key", "bins", "labels").mapInArrow(_cells(forests, level, s), CELL)
    cells = cells.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
    best = _best(n_features, n_bins, forests.trees.start, len(forests.trees), roots, s)
    return cells.groupBy("tree", F.floor(F.col("node") / NODES).alias("lot")).applyInArrow(best, SPLIT)


def grow(rows: DataFrame, n_labels: int, n_features: int, n_bins: int, trees: range, s: Settings) -> Forests:
    """Trees ``trees`` of every label, level by level; ``rows`` should be a written table."""
    if s.depth > 15 or n_features > 2047 or n_bins > 2047:
        raise ValueError("at most 15 levels, 2047 features and 2047 bins")
    forests = Forests(n_labels, trees)
    roots = np.zeros(0)
    for level in range(s.depth + 1):
        got = best_splits(rows, forests, level, n_features, n_bins, roots, s).toPandas()
        if level == 0:
            roots = np.ones(len(forests.feature))
            roots[got["tree"]] = got["weight"]
        forests.value[got["tree"], got["node"]] = got["value"]
        got = got[got["feature"] >= 0]
        if level == s.depth or not len(got):
            break
        forests.feature[got["tree"], got["node"]], forests.cut[got["tree"], got["node"]] = got["feature"], got["cut"]
        forests.deeper()
    return forests


def _with_votes(forests: Forests):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            votes = forests.votes(_lists(b.column("bins"), b.num_rows)) + b.column("votes").flatten().to_numpy().reshape(b.num_rows, -1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(votes) + 1) * votes.shape[1], pa.int32()), pa.array(votes.ravel()))
            at = b.schema.get_field_index("votes")
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return run


def evaluate_parameters(bars: DataFrame, features: list[str], train_to: int, valid_to: int, target_candles: int = 20, rr_thresholds=(1.5, 2.0, 2.5, 3.0, 3.5, 4.0), targets=tuple(0.001 + 0.0005 * i for i in range(11)), trees: int = 400, at_once: int = 8, bins: int = 32, settings: Settings | None = None) -> DataFrame:
    """rr_threshold, target, f1, precision, recall and positive_ratio for every pair whose valid rows have both classes.

    Rows with a seq up to ``train_to`` train, those up to ``valid_to`` are scored. ``at_once`` trees of each label grow at
    a time; their arrays are what tasks and driver hold.
    """
    s = settings or Settings()
    grid = grid_of(rr_thresholds, targets)
    train_bars = bars.filter(F.col("seq") <= train_to)
    cuts = quantile_cuts(train_bars, features, bins)
    rows = written(binned(bars, features, cuts, grid, target_candles).filter(F.col("seq") <= valid_to), "grid-rows")
    train, valid = rows.filter(F.col("seq") <= train_to), rows.filter(F.col("seq") > train_to)
    n_bins = max((len(c) for c in cuts), default=0) + 1
    votes = written(valid.withColumn("votes", F.array_repeat(F.lit(0.0), len(grid))), "grid-votes")
    for first in range(0, trees, at_once):
        forests = grow(train, len(grid), len(features), n_bins, range(first, min(trees, first + at_once)), s)
        votes = written(votes.mapInArrow(_with_votes(forests), votes.schema), "grid-votes")
    share = train.select(F.posexplode("labels").alias("no", "y")).groupBy("no").agg(F.avg("y").alias("positive_ratio"))
    each = votes.select(F.posexplode(F.arrays_zip("labels", "votes")).alias("no", "x")).select("no", F.col("x.labels").cast("long").alias("y"), (F.col("x.votes") / trees > 0.5).cast("long").alias("p"))
    sums = each.groupBy("no").agg(F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum("p").alias("pp"), F.sum("y").alias("yy"), F.count(F.lit(1)).alias("n")).filter("yy > 0 AND yy < n")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    named = F.array(*[F.struct(F.lit(rr).alias("rr_threshold"), F.lit(t).alias("target")) for rr, t in grid])[F.col("no")]
    return sums.join(share, "no").select(named["rr_threshold"].alias("rr_threshold"), named["target"].alias("target"), ratio(2 * F.col("tp"), F.col("pp") + F.col("yy")).alias("f1"), ratio(F.col("tp"), F.col("pp")).alias("precision"), ratio(F.col("tp"), F.col("yy")).alias("recall"), "positive_ratio")
