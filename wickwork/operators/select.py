"""Feature importance, feature selection and grid search with Spark ML models.

A model is anything with ``fit`` giving a transformer that adds ``probability``; drivers loop over fits, the fits and
the scoring run on the cluster.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import grid
from .evaluate import threshold_sweep
from .neighbours import neighbour_mutual_info
from .label import add_target_column_mod


def forest(trees: int = 400, depth: int = 13, seed: int = 3) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="target", weightCol="weight", numTrees=trees, maxDepth=depth, impurity="entropy", featureSubsetStrategy="0.8", subsamplingRate=0.7, minInstancesPerNode=6, minInfoGain=2e-4, seed=seed)


def assemble(df: DataFrame, features: list[str], positive_weight: float = 5.0) -> DataFrame:
    rows = df.na.drop(subset=[*features, "target"]).withColumn("weight", F.when(F.col("target") == 1, positive_weight).otherwise(1.0))
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows)


def score(model, rows: DataFrame, split: str) -> DataFrame:
    return model.transform(rows).select(F.lit(split).alias("split"), F.col("target").cast("int").alias("target"), vector_to_array("probability")[1].alias("proba"))


def f1_of(model, rows: DataFrame, threshold: float = 0.5) -> float:
    got = threshold_sweep(score(model, rows, "x"), [threshold]).first()
    return got["f1"] if got else 0.0


def time_folds(df: DataFrame, n_splits: int = 3):
    """Expanding train folds by time: (train, valid), the valid folds being of equal length and in order."""
    n = df.agg(F.max("seq")).first()[0] or 0
    size = n // (n_splits + 1)
    for i in range(n_splits):
        cut = n - (n_splits - i) * size
        yield df.filter(F.col("seq") <= cut), df.filter((F.col("seq") > cut) & (F.col("seq") <= cut + size))


def shuffled(df: DataFrame, column: str, seed: int) -> DataFrame:
    """``df`` with one column permuted: values are dealt anew by joining two orders on their positions within buckets.

    Rows go to buckets by hash, and both the rows and the values of a bucket are numbered, each in its own order.
    """
    key = F.xxhash64("symbol", "seq", F.lit(seed))
    bucket = F.pmod(key, F.lit(64))
    rows = df.withColumn("_b", bucket).withColumn("_n", F.row_number().over(Window.partitionBy(bucket).orderBy("symbol", "seq")))
    deal = df.select(bucket.alias("_b"), F.col(column).alias("_v"), F.row_number().over(Window.partitionBy(bucket).orderBy(key, "symbol", "seq")).alias("_n"))
    return rows.join(deal, ["_b", "_n"]).withColumn(column, F.col("_v")).drop("_b", "_n", "_v")


def explain_model_permutation(df: DataFrame, features: list[str], model, n_repeats: int = 5, top_n: int = 20, random_state: int = 3) -> list[dict]:
    """How much F1 falls when a feature is shuffled: mean, deviation, whether mean - 2 std > 0, and rank."""
    base = f1_of(model, assemble(df, features))
    out = []
    for c in features:
        falls = np.array([base - f1_of(model, assemble(shuffled(df, c, random_state + i), features)) for i in range(n_repeats)])
        out.append({"Feature": c, "Mean Importance": float(falls.mean()), "Std": float(falls.std()), "Significant": bool(falls.mean() - 2 * falls.std() > 0)})
    out.sort(key=lambda r: (-r["Mean Importance"], r["Feature"]))
    return [r | {"Rank": i} for i, r in enumerate(out[:top_n], 1)]


def linear_shap(df: DataFrame, features: list[str], coefficients: list[float]) -> DataFrame:
    """(Feature, SHAP_Importance): mean absolute coefficient * (x - mean), the exact SHAP values of a linear model."""
    means = df.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)])
    row = df.crossJoin(F.broadcast(means)).agg(*[F.avg(F.abs(F.lit(w) * (F.col(c) - F.col(f"_m{i}")))).alias(f"_s{i}") for i, (c, w) in enumerate(zip(features, coefficients, strict=True))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("Feature"), F.col(f"_s{i}").alias("SHAP_Importance")) for i, c in enumerate(features)])).alias("x")).select("x.*")


def show_rfecv_results(df: DataFrame, features: list[str], estimator=None, step: int = 1, n_splits: int = 3) -> tuple[list[str], list[tuple[int, float]]]:
    """Recursive elimination by model importance under time folds: the best set, and the mean F1 for each size."""
    estimator = estimator or forest(20, 5)
    left, curve, sets = list(features), [], {}
    while left:
        scores = [f1_of(estimator.fit(assemble(a, left)), assemble(b, left)) for a, b in time_folds(df, n_splits)]
        curve.append((len(left), float(np.mean(scores))))
        sets[len(left)] = list(left)
        importance = estimator.fit(assemble(df, left)).featureImportances.toArray()
        drop = set(np.argsort(importance, kind="stable")[:step].tolist())
        left = [c for i, c in enumerate(left) if i not in drop]
    best = max(curve, key=lambda x: (x[1], -x[0]))[0]
    return sets[best], curve


def binomial_tail(hits: int, n: int) -> float:
    return sum(math.comb(n, k) for k in range(hits, n + 1)) / 2**n


def explain_model_boruta(df: DataFrame, features: list[str], estimator=None, max_iter: int = 20, n_splits: int = 3, random_state: int = 3, alpha: float = 0.05) -> list[str]:
    """Features that beat the best shuffled shadow more often than chance allows, in every train fold."""
    estimator = estimator or forest(20, 5)
    kept = set(features)
    for train, _ in time_folds(df, n_splits):
        hits = dict.fromkeys(features, 0)
        for it in range(max_iter):
            rows = train
            for i, c in enumerate(features):
                rows = shuffled(rows.withColumn(f"_shadow{i}", F.col(c)), f"_shadow{i}", random_state + it * len(features) + i)
            names = [*features, *[f"_shadow{i}" for i in range(len(features))]]
            importance = estimator.fit(assemble(rows, names)).featureImportances.toArray()
            for c, x in zip(features, importance, strict=False):
                hits[c] += bool(x > importance[len(features) :].max())
        kept &= {c for c, h in hits.items() if binomial_tail(h, max_iter) < alpha / len(features)}
    return [c for c in features if c in kept]


def explain_model_mutual_info(df: DataFrame, features: list[str], bins: int | None = None, top_n: int | None = 20) -> DataFrame:
    """(Feature, MI): mutual information of the target and each feature in nats, from nearest neighbours; with ``bins``, from features cut at their quantiles."""
    if bins is None:
        out = neighbour_mutual_info(df, features)
        return out.limit(top_n) if top_n else out
    cuts = df.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in features]).first()

    def bin_of(c: str):
        met = F.filter(F.array(*map(F.lit, cuts[c] or [0.0])), lambda b: b < F.col(c))
        return F.when(F.col(c).isNotNull(), F.size(met))

    binned = F.explode(F.array(*[F.struct(F.lit(c).alias("Feature"), bin_of(c).alias("bin")) for c in features]))
    n = df.select(binned.alias("x"), "target").filter("x.bin IS NOT NULL").groupBy("x.Feature", "x.bin", "target").agg(F.count(F.lit(1)).alias("n"))
    # At most features * bins * classes rows from here on.
    total = lambda *by: F.sum("n").over(Window.partitionBy("Feature", *by))
    p = F.col("n") / total()
    return n.withColumn("t", p * F.log(F.col("n") * total() / (total("bin") * total("target")))).groupBy("Feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("MI")).orderBy(F.desc("MI"), "Feature")


def _chi2_tail(x: float, k: int) -> float:
    """P(chi2 with k degrees > x)."""
    if k % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, k // 2):
            term *= x / 2 / i
            total += term
        return min(1.0, total)
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, (k - 1) // 2 + 1):
        total += term
        term *= x / (2 * i + 1)
    return min(1.0, total)


def granger_p(x: np.ndarray, y: np.ndarray, max_lag: int = 5) -> float:
    """The smallest p-value over lags of the chi-square test that lags of x help predict y."""
    best = np.nan
    for lag in range(1, max_lag + 1):
        n = len(y) - lag
        if n <= 3 * lag + 1:
            break
        past = lambda v: np.column_stack([v[lag - k : len(v) - k] for k in range(1, lag + 1)])
        own = np.c_[past(y), np.ones(n)]
        full = np.c_[past(y), past(x), np.ones(n)]
        ssr = [((y[lag:] - a @ np.linalg.lstsq(a, y[lag:], rcond=None)[0]) ** 2).sum() for a in (own, full)]
        p = _chi2_tail(n * max(0.0, ssr[0] - ssr[1]) / ssr[1], lag) if ssr[1] > 0 else 0.0
        best = p if np.isnan(best) else min(best, p)
    return float(best)


def _granger_of_sums(n: list[int], grams: list[np.ndarray], max_lag: int) -> float:
    """``granger_p`` from the sums of products of (y, its lags, x's lags, 1), by how many lags the rows have."""
    best = np.nan
    for lag in range(1, max_lag + 1):
        rows = sum(n[lag - 1 :])
        if rows <= 3 * lag + 1:
            break
        gram = sum(grams[lag - 1 :])
        own = [*range(1, lag + 1), 2 * max_lag + 1]
        full = [*range(1, lag + 1), *range(max_lag + 1, max_lag + lag + 1), 2 * max_lag + 1]
        ssr = [gram[0, 0] - gram[0, at] @ np.linalg.lstsq(gram[np.ix_(at, at)], gram[at, 0], rcond=1e-12)[0] for at in (own, full)]
        p = _chi2_tail(rows * max(0.0, ssr[0] - ssr[1]) / ssr[1], lag) if ssr[1] > 1e-12 * gram[0, 0] else 0.0
        best = p if np.isnan(best) else min(best, p)
    return float(best)


def explain_model_granger(df: DataFrame, features: list[str], target_name: str = "target", max_lag: int = 5) -> DataFrame:
    """(Feature, p_value), smallest first: the smallest p of a feature's lags and symbols counts; null where a series is too short.

    The regressions need only sums of products of the values and their lags, so these are one aggregate over all series;
    what is solved afterwards is a few numbers for each. Series are standardised first, which changes no p-value.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("Feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in features]))
    long = df.select("symbol", "seq", F.col(target_name).cast("double").alias("y"), each.alias("f")).select("symbol", "seq", "y", "f.*").na.drop()
    series, order = Window.partitionBy("symbol", "Feature"), Window.partitionBy("symbol", "Feature").orderBy("seq")
    scaled = lambda c: F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(series), F.stddev_pop(c).over(series)), F.lit(0.0))
    rows = long.select("symbol", "Feature", "seq", scaled("y").alias("y"), scaled("x").alias("x"))
    lags = {f"{c}{k}": F.lag(c, k).over(order) for c in ("y", "x") for k in range(1, max_lag + 1)}
    rows = rows.withColumns(lags | {"have": F.least(F.row_number().over(order) - 1, F.lit(max_lag))}).filter("have > 0").na.fill(0.0, list(lags))
    terms = ["y", *lags, "1.0D"]
    places = [(i, j) for i in range(len(terms)) for j in range(i, len(terms))]
    sums = rows.groupBy("symbol", "Feature", "have").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(F.expr(f"{terms[i]} * {terms[j]}")) for i, j in places]).alias("s"))
    parts = sums.groupBy("symbol", "Feature").agg(F.collect_list(F.struct("have", "n", "s")).alias("parts"))  # at most max_lag of them

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for given in b.column("parts").to_pylist():
                n, grams = [0] * max_lag, [np.zeros((len(terms), len(terms))) for _ in range(max_lag)]
                for part in given:
                    n[part["have"] - 1] = part["n"]
                    for (i, j), v in zip(places, part["s"], strict=True):
                        grams[part["have"] - 1][i, j] = grams[part["have"] - 1][j, i] = v
                out.append(_granger_of_sums(n, grams, max_lag))
            yield pa.RecordBatch.from_arrays([b.column("Feature"), pa.array(out, pa.float64(), mask=np.isnan(np.array(out, float)))], names=["Feature", "p_value"])

    got = parts.select("Feature", "parts").mapInArrow(solve, "Feature string, p_value double")
    return got.groupBy("Feature").agg(F.min("p_value").alias("p_value")).orderBy("p_value", "Feature")


def plot_f1_vs_n_estimators(df: DataFrame, features: list[str], sizes: range = range(100, 1001, 50), n_splits: int = 3) -> list[tuple[int, float]]:
    """Mean F1 over time folds for each number of trees; the table behind the plot."""
    return [(n, float(np.mean([f1_of(forest(n).fit(assemble(a, features)), assemble(b, features)) for a, b in time_folds(df, n_splits)]))) for n in sizes]


def evaluate_parameters(bars: DataFrame, features: list[str], train_to: int, valid_to: int, target_candles: int = 20, rr_thresholds=(1.5, 2.0, 2.5, 3.0, 3.5, 4.0), targets=tuple(0.001 + 0.0005 * i for i in range(11)), estimator=None) -> list[dict]:
    """Label, fit and score for every pair of the grid; pairs whose valid rows have one class are left out.

    The forests of all pairs grow together (``grid``); with an ``estimator`` of one's own each pair is fitted by itself.
    """
    if estimator is None:
        got = grid.evaluate_parameters(bars, features, train_to, valid_to, target_candles, rr_thresholds, targets)
        return [r.asDict() for r in got.orderBy("rr_threshold", "target").collect()]
    out = []
    for rr in rr_thresholds:
        for target in targets:
            rows = assemble(add_target_column_mod(bars, target_candles, target, rr), features)
            train, valid = rows.filter(F.col("seq") <= train_to), rows.filter((F.col("seq") > train_to) & (F.col("seq") <= valid_to))
            if valid.select("target").distinct().count() < 2:
                continue
            got = threshold_sweep(score(estimator.fit(train), valid, "valid"), [0.5]).first()
            out.append({"rr_threshold": rr, "target": target, "f1": got["f1"], "precision": got["precision"], "recall": got["recall"], "positive_ratio": train.agg(F.avg("target")).first()[0]})
    return out
