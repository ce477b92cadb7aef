"""Decision trees as arrays, and what each feature adds to their predictions.

The Shapley values are those of the trees' own paths: where a feature is unknown, both branches count by the weight of the
rows that took them in training. A leaf is reached if every feature on its path lies in one interval, so a leaf is a list
of (feature, interval, share of the weight that stays inside). Its value is shared out among these features by an integral
over the share of known features, which Gauss's quadrature gives exactly. Rows are independent, so they are spread over
tasks and taken in Arrow batches; a forest whose leaves take more than ``LEAF_BYTES`` goes over the rows in several passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import shared_path, written

#: Bytes of leaves that go to the tasks at a time.
LEAF_BYTES = 32 << 20
#: Numbers that a batch of rows and leaves holds at a time.
BLOCK = 1 << 21


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first. ``left`` is -1 for leaves; other nodes send x[feature] <= threshold to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    def leaves(self) -> Iterator[tuple[float, list[int], list[float], list[float], list[float]]]:
        """(value, features, lower ends, upper ends, shares) of each leaf; an interval is open below and closed above."""
        todo: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(0, {})]
        while todo:
            node, path = todo.pop()
            if self.left[node] < 0:
                yield float(self.value[node]), list(path), *([p[k] for p in path.values()] for k in range(3))
                continue
            f, at = int(self.feature[node]), float(self.threshold[node])
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, ends in ((self.left[node], (low, min(high, at))), (self.right[node], (max(low, at), high))):
                todo.append((int(child), path | {f: (*ends, share * self.cover[child] / self.cover[node])}))


@dataclass(frozen=True)
class Forest:
    """Trees whose values are summed up, each times its weight."""

    trees: tuple[Tree, ...]
    weights: tuple[float, ...]

    @property
    def undefined(self) -> bool:
        """Whether a split was reached by no row: then it has no expected value, and neither have the trees above it."""
        return any(bool((t.cover[t.left >= 0] == 0).any()) for t in self.trees)

    @property
    def base(self) -> float:
        """The mean prediction: what is known without any feature; NaN if it is undefined."""
        if self.undefined:
            return float("nan")
        return sum(w * sum(v * float(np.prod(s)) for v, _, _, _, s in t.leaves()) for t, w in zip(self.trees, self.weights, strict=True))

    def parts(self) -> Iterator[list[tuple[np.ndarray, ...]]]:
        """The leaves, by the number of features on their paths, in lots of about ``LEAF_BYTES``."""
        lot: dict[int, list[tuple]] = {}
        size = 0
        for tree, weight in zip(self.trees, self.weights, strict=True):
            for value, *path in tree.leaves():
                if path[0]:
                    lot.setdefault(len(path[0]), []).append((weight * value, *path))
                    size += 8 + 32 * len(path[0])
            if size > LEAF_BYTES:
                yield _arrays(lot)
                lot, size = {}, 0
        if lot:
            yield _arrays(lot)


def _arrays(lot: dict[int, list[tuple]]) -> list[tuple[np.ndarray, ...]]:
    kinds = (float, np.int64, float, float, float)
    return [tuple(np.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)) for rows in lot.values()]


def shap_values(x: np.ndarray, part: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """(rows, features): what each feature adds, summed over the leaves of ``part``."""
    out = np.zeros(x.shape)
    for value, feature, low, high, share in part:
        depth = feature.shape[1]
        # Products of depth - 1 linear factors: so many points make the quadrature exact.
        at, weight = np.polynomial.legendre.leggauss((depth + 1) // 2)
        at, weight = (at + 1) / 2, weight / 2
        many = max(1, 4096 // depth)
        for lo in range(0, len(value), many):
            v, f, a, b, s = (c[lo : lo + many] for c in (value, feature, low, high, share))
            step = max(1, BLOCK // (s.size * len(at)))
            for top in range(0, len(x), step):
                own = x[top : top + step][:, f]
                known = ((own > a) & (own <= b)).astype(float)
                factor = s[None, :, :, None] * (1 - at) + known[..., None] * at
                # The product of the others, without a division: a branch that no row took has a share of 0.
                others = np.ones_like(factor)
                np.cumprod(factor[:, :, :-1], axis=2, out=others[:, :, 1:])
                others[:, :, :-1] *= np.cumprod(factor[:, :, :0:-1], axis=2)[:, :, ::-1]
                added = v[:, None] * (known - s) * (others @ weight)
                np.add.at(out[top : top + step].T, f.T, added.transpose(2, 1, 0))
    return out


def forest_of(spark, model) -> Forest:
    """A fitted tree model of Spark as a forest: probabilities of class 1 averaged over the trees, or for boosted trees their weighted sum.

    The model's own tables are read back, so no node is fetched from the JVM one by one. Categorical splits are an error.
    """
    path = shared_path(spark, "model")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
        weights = [r[1] for r in spark.read.parquet(f"{path}/treesMetadata").select("_1", "_3").orderBy("_1").collect()]
    else:
        nodes, weights = nodes.withColumn("treeID", F.lit(0)), [1.0]
    boosted = hasattr(model, "treeWeights") and type(model).__name__.startswith("GBT")
    classes = type(model).__name__.endswith("ClassificationModel") and not boosted
    if nodes.filter("size(split.leftCategoriesOrThreshold) > 0 AND split.numCategories >= 0").head(1):
        raise ValueError("splits by categories have no thresholds")
    stats = F.col("impurityStats")
    cover = F.aggregate(stats, F.lit(0.0), lambda a, b: a + b) if classes else stats[0]
    value = F.try_divide(stats[1], cover) if classes else F.col("prediction")
    rows = nodes.select("treeID", "id", F.col("split.featureIndex").alias("f"), F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("t"), "leftChild", "rightChild", cover.alias("c"), value.alias("v"))
    # A model is on the driver already, so its trees fit there.
    table = rows.orderBy("treeID", "id").toPandas()
    trees = []
    for _, t in table.groupby("treeID", sort=True):
        place = {n: k for k, n in enumerate(t["id"])}
        child = lambda c: np.array([place.get(k, -1) for k in c])  # noqa: B023, E731
        trees.append(Tree(t["f"].to_numpy(), t["t"].to_numpy(float), child(t["leftChild"]), child(t["rightChild"]), t["c"].to_numpy(float), t["v"].to_numpy(float)))
    return Forest(tuple(trees), tuple(weights) if boosted else (1 / len(trees),) * len(trees))


def recounted(df: DataFrame, features: list[str], forest: Forest, target: str | None = None) -> Forest:
    """The same splits with the covers of ``df``, and with its mean ``target`` in the leaves if that is given; one aggregate for all nodes.

    Nodes without rows keep their value and get a cover of 0; a split without rows makes the forest ``undefined``.
    """
    sums = []
    for k, tree in enumerate(forest.trees):
        todo = [(0, F.lit(True))]
        while todo:
            node, here = todo.pop()
            y = F.col(target).cast("double") if target else F.lit(0.0)
            sums += [F.count(F.when(here, 1)).cast("double").alias(f"c{k}_{node}"), F.avg(F.when(here, y)).alias(f"v{k}_{node}")]
            if tree.left[node] >= 0:
                left = F.col(features[int(tree.feature[node])]) <= float(tree.threshold[node])
                todo += [(int(tree.left[node]), here & left), (int(tree.right[node]), here & ~left)]
    row = df.na.drop(subset=features).agg(*sums).first()
    out = []
    for k, t in enumerate(forest.trees):
        cover = np.array([row[f"c{k}_{n}"] for n in range(len(t.left))])
        value = np.array([t.value[n] if not target or row[f"v{k}_{n}"] is None else row[f"v{k}_{n}"] for n in range(len(t.left))])
        out.append(Tree(t.feature, t.threshold, t.left, t.right, cover, value))
    return Forest(tuple(out), forest.weights)


def tree_shap(df: DataFrame, features: list[str], forest: Forest, column: str = "shap") -> DataFrame:
    """``df`` with an array of Shapley values, one for each of ``features``; with ``forest.base`` they add up to the prediction.

    Rows with a null feature are left out, as in training. An empty table stays empty. Every value starts from what is expected
    without any feature, so all are NaN if the forest is ``undefined``.
    """
    rows = df.na.drop(subset=features).withColumn(column, F.array([F.col(f"`{c}`").cast("double") for c in features]))
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.ArrayType(T.DoubleType()))])
    sums = f"{column}_sum"
    rows = rows.withColumn(sums, F.transform(column, lambda _: F.lit(float("nan") if forest.undefined else 0.0)))
    schema = schema.add(sums, T.ArrayType(T.DoubleType()))
    for part in () if forest.undefined else forest.parts():
        rows = rows.select(*schema.names).mapInArrow(_adding(part, column, sums), schema)
    return rows.withColumn(column, F.col(sums)).select(*df.columns, column)


def _adding(part: list[tuple[np.ndarray, ...]], features: str, sums: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(features).flatten().to_numpy().reshape(b.num_rows, -1)
            total = b.column(sums).flatten().to_numpy().reshape(x.shape) + shap_values(x, part)
            at = b.schema.get_field_index(sums)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([lists if k == at else c for k, c in enumerate(b.columns)], names=b.schema.names)

    return run


def shap_table(explained: DataFrame, features: list[str], model_importance: list[float] | None = None, column: str = "shap", top_n: int | None = 20) -> DataFrame:
    """Rank, Feature, mean absolute value, direction of the mean, percent of the highest and their running sum; one pass over the rows."""
    sums = explained.agg(*[f(F.col(column)[k]).alias(f"{n}{k}") for k in range(len(features)) for n, f in (("a", lambda c: F.avg(F.abs(c))), ("m", F.avg))])
    given = model_importance or [None] * len(features)
    rows = sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("Feature"), F.col(f"a{k}").alias("SHAP_Importance"), F.when(F.col(f"m{k}") > 0, "Positive").otherwise("Negative").alias("Direction"), F.lit(given[k]).cast("double").alias("Model_Importance"))
        for k, c in enumerate(features)
    ])).alias("r")).select("r.*")
    every = Window.partitionBy()  # a row for each feature
    rows = rows.withColumn("Model_%", 100 * F.try_divide("Model_Importance", F.max("Model_Importance").over(every))).withColumn("SHAP_%", 100 * F.try_divide("SHAP_Importance", F.max("SHAP_Importance").over(every)))
    order = Window.orderBy(F.desc("SHAP_Importance"), "Feature")
    rows = rows.withColumn("Rank", F.row_number().over(order)).withColumn("Cumulative_SHAP_%", F.sum("SHAP_%").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    if not model_importance:
        rows = rows.drop("Model_Importance", "Model_%")
    return rows.filter(F.col("Rank") <= top_n) if top_n else rows


def explain_model_shap(df: DataFrame, features: list[str], model, sample_size: int | None = 2000, top_n: int | None = 20, seed: int = 3) -> DataFrame:
    """The importance table of a fitted tree model over a sample of ``sample_size`` rows (None: all rows).

    The sample is the rows of smallest hash, so it is the same in every run.
    """
    rows = df.na.drop(subset=features).select("symbol", "seq", *features)
    if sample_size:
        rows = written(rows.orderBy(F.xxhash64("symbol", "seq", F.lit(seed)), "symbol", "seq").limit(sample_size), "shap-sample").repartition(rows.sparkSession.sparkContext.defaultParallelism)
    importance = model.featureImportances.toArray().tolist()
    return shap_table(tree_shap(rows, features, forest_of(df.sparkSession, model)), features, importance, top_n=top_n)
