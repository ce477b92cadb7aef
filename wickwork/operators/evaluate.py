"""Evaluation of scored rows, correlations and class shares, as grouped aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 99 thresholds from 0.01 to 0.99.
THRESHOLDS = [i / 100 for i in range(1, 100)]


def threshold_counts(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(split, threshold, tp, fp, fn) of predicting 1 from a score on.

    A score meets all thresholds up to itself, so rows are counted once, by the highest threshold they meet, before
    the few sums are accumulated: the input is not multiplied by the number of thresholds.
    """
    ts = sorted(thresholds or THRESHOLDS)
    met = F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col("proba")))
    sums = scored.groupBy("split", met.alias("met")).agg(F.sum(F.col("target").cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    # At most one row for each split and threshold from here on.
    totals = sums.groupBy("split").agg(F.sum("pos").alias("all_pos"))
    grid = totals.withColumn("no", F.explode(F.sequence(F.lit(1), F.lit(len(ts))))).withColumn("threshold", F.element_at(F.array(*map(F.lit, ts)), F.col("no")))
    got = grid.join(sums, "split").filter(F.col("met") >= F.col("no")).groupBy("split", "no").agg(F.sum("pos").alias("tp"), F.sum("n").alias("predicted"))
    out = grid.join(got, ["split", "no"], "left").na.fill(0, ["tp", "predicted"])
    return out.select("split", "threshold", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def threshold_sweep(scored: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall and F1 for each split and threshold; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return threshold_counts(scored, thresholds).select("split", "threshold", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_thresholds(sweep: DataFrame, balanced: bool = False) -> DataFrame:
    """A threshold for each split: the first of highest F1, or with the smallest gap of precision and recall.

    The balanced choice leaves out the outer tenth of thresholds on either side.
    """
    if balanced:
        rank = F.row_number().over(Window.partitionBy("split").orderBy("threshold"))
        n = F.count(F.lit(1)).over(Window.partitionBy("split"))
        inner = sweep.withColumn("_r", rank).withColumn("_n", n).filter((F.col("_r") > F.floor(F.col("_n") * 0.1)) & (F.col("_r") <= F.col("_n") - F.floor(F.col("_n") * 0.1)))
        return inner.groupBy("split").agg(F.min_by("threshold", F.struct(F.abs(F.col("precision") - F.col("recall")), "threshold")).alias("threshold"))
    return sweep.groupBy("split").agg(F.min_by("threshold", F.struct(-F.col("f1"), "threshold")).alias("threshold"))


def optimal_threshold(best: DataFrame) -> float:
    """The mean of the best thresholds of train and valid."""
    return best.filter(F.col("split").isin("train", "valid")).agg(F.avg("threshold")).first()[0]


def roc_auc(scored: DataFrame, by: str = "split") -> DataFrame:
    """The area under the ROC curve by average ranks, for each split; null if a class is missing.

    Scores are grouped first, so ranks are sums over distinct scores.
    """
    sums = scored.groupBy(by, "proba").agg(F.sum(F.col("target").cast("double")).alias("p"), F.sum((1 - F.col("target")).cast("double")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(by).orderBy("proba").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    won = sums.withColumn("w", F.col("p") * (below + F.col("n") / 2)).groupBy(by).agg(F.sum("w").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return won.select(by, F.try_divide("w", F.col("p") * F.col("n")).alias("roc_auc"))


def final_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """F1, precision, recall and ROC AUC of each split at one threshold."""
    return threshold_sweep(scored, [threshold]).join(roc_auc(scored), "split")


def show_class_balance(labelled: DataFrame, digits: int = 3) -> DataFrame:
    """The share of each class, overall and by split, one column each; 0 where a class is missing."""
    both = labelled.select("split", "target").unionByName(labelled.select(F.lit("all").alias("split"), "target"))
    counts = both.groupBy("split", "target").agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("split")), digits))
    return shares.groupBy("target").pivot("split", ["all", "train", "valid", "test"]).agg(F.first("share")).na.fill(0.0)


def _correlation(a: str, b: str) -> Column:
    """``F.corr`` is an error where a column does not vary."""
    spread = F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))) * F.stddev_pop(F.when(F.col(a).isNotNull(), F.col(b)))
    return F.when(spread == 0, F.lit(float("nan"))).otherwise(F.try_divide(F.covar_pop(a, b), spread))


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns, over the rows where both are there; one pass, one row of sums.

    Where a column does not vary there is no correlation: r is NaN, as DuckDB's ``corr`` gives it, and null without rows.
    """
    pairs = list(itertools.combinations(columns, 2))
    row = df.agg(*[_correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


def get_top_correlated_pairs(df: DataFrame, columns: list[str], top_n: int = 20) -> DataFrame:
    """The pairs with the highest absolute correlation; NaN, of columns that do not vary, ranks above all numbers, as in DuckDB."""
    return correlation_pairs(df, columns).withColumn("r", F.abs("r")).filter("r IS NOT NULL").orderBy(F.desc("r"), "a", "b").limit(top_n)


def importance_table(importance: DataFrame) -> DataFrame:
    """(Feature, SHAP_Importance) with percent of the highest, rank and the running sum of these percents."""
    order = Window.orderBy(F.desc("SHAP_Importance"), "Feature")  # one row a feature
    every = Window.partitionBy()
    out = importance.withColumn("SHAP_%", 100 * F.col("SHAP_Importance") / F.max("SHAP_Importance").over(every)).withColumn("Rank", F.row_number().over(order))
    return out.withColumn("Cumulative_SHAP_%", F.sum("SHAP_%").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def plot_feature_pairplot(df: DataFrame, features: list[str], target: str = "target", bins: int = 20) -> DataFrame:
    """(a, b, target, bin_a, bin_b, n): how many rows of each class lie where, for every pair of features; what a plot of pairs shows.

    A feature with itself is its own histogram (bin_a = bin_b). Bins are equally wide between a feature's least and
    greatest value; a constant feature has one bin. Rows with a null in a feature or the target are left out. The ranges are
    one pass, and all pairs one aggregate over rows that carry their bins only.
    """
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)], F.col(target).alias("target")).na.drop()
    ranges = rows.agg(*[f(f"x{k}").alias(f"{n}{k}") for k in range(len(features)) for n, f in (("lo", F.min), ("hi", F.max))])
    # One row of ranges.
    place = lambda k: F.least(F.coalesce(F.floor(F.try_divide(F.col(f"x{k}") - F.col(f"lo{k}"), F.col(f"hi{k}") - F.col(f"lo{k}")) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    placed = rows.crossJoin(F.broadcast(ranges)).select("target", *[place(k).alias(f"b{k}") for k in range(len(features))])
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    each = F.explode(F.array(*[F.struct(F.lit(features[i]).alias("a"), F.lit(features[j]).alias("b"), F.col(f"b{i}").alias("bin_a"), F.col(f"b{j}").alias("bin_b")) for i, j in pairs]))
    return placed.select("target", each.alias("p")).groupBy("p.a", "p.b", "target", "p.bin_a", "p.bin_b").agg(F.count(F.lit(1)).alias("n"))
