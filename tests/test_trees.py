"""Shapley values of trees against all subsets of features, and trees of a whole grid of labels against single ones."""

import itertools
import math

import numpy as np
import pytest
from helpers import SF, same
from pyspark.sql import functions as F

from wickwork import queries
from wickwork.operators import grid, select, trees


def expected(tree, x, known, node=0):
    if tree.left[node] < 0:
        return tree.value[node]
    f, sides = tree.feature[node], (tree.left[node], tree.right[node])
    if f in known:
        return expected(tree, x, known, sides[0] if x[f] <= tree.threshold[node] else sides[1])
    return sum(tree.cover[c] / tree.cover[node] * expected(tree, x, known, c) for c in sides)


def by_subsets(tree, x, n):
    out = np.zeros(n)
    for k in range(n):
        others = [j for j in range(n) if j != k]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for known in itertools.combinations(others, size):
                out[k] += weight * (expected(tree, x, {*known, k}) - expected(tree, x, set(known)))
    return out


def random_tree(rng, n_features, depth):
    rows = []

    def grow(level, cover):
        at = len(rows)
        rows.append([int(rng.integers(n_features)), float(rng.normal()), -1, -1, cover, float(rng.random())])
        if level and (level == depth or rng.random() < 0.85):
            share = rng.uniform(0.1, 0.9)
            rows[at][2] = grow(level - 1, cover * share)
            rows[at][3] = grow(level - 1, cover * (1 - share))
        return at

    grow(depth, 1000.0)
    return trees.Tree(*[np.array(c) for c in zip(*rows, strict=True)])


def random_frame(spark, rng, n, features):
    x = rng.normal(size=(n, len(features)))
    rows = [("A", k + 1, int(r[0] + r[1] * r[2] > 0.2), *map(float, r)) for k, r in enumerate(x)]
    return x, spark.createDataFrame(rows, f"symbol string, seq int, target int, {', '.join(f'{c} double' for c in features)}")


def test_values_equal_those_of_all_subsets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        forest = trees.Forest((random_tree(rng, 6, 6), random_tree(rng, 6, 4)), (0.5, -2.0))
        x = rng.normal(size=(7, 6))
        got = sum(trees.shap_values(x, part) for part in forest.parts())
        want = np.array([sum(w * by_subsets(t, r, 6) for t, w in zip(forest.trees, forest.weights, strict=True)) for r in x])
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_deep_paths_add_up():
    rng = np.random.default_rng(1)
    forest = trees.Forest((random_tree(rng, 40, 13),), (1.0,))
    x = rng.normal(size=(50, 40))
    got = forest.base + sum(trees.shap_values(x, part) for part in forest.parts()).sum(1)
    np.testing.assert_allclose(got, [expected(forest.trees[0], r, set(range(40))) for r in x], atol=1e-10)


@pytest.mark.parametrize("kind", ["forest", "boosted", "single"])
def test_values_and_base_add_up_to_the_prediction(spark, kind, monkeypatch):
    from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
    from pyspark.ml.functions import vector_to_array

    monkeypatch.setattr(trees, "LEAF_BYTES", 4000)  # several passes
    features = ["a", "b", "c", "d"]
    _, df = random_frame(spark, np.random.default_rng(2), 400, features)
    estimator = {"forest": select.forest(6, 5), "boosted": GBTClassifier(labelCol="target", maxIter=4, stepSize=0.3), "single": DecisionTreeClassifier(labelCol="target")}[kind]
    model = estimator.fit(select.assemble(df, features))
    forest = trees.forest_of(spark, model)
    assert kind == "single" or len(list(forest.parts())) > 1
    got = {r["seq"]: forest.base + sum(r["shap"]) for r in trees.tree_shap(df, features, forest).collect()}
    scored = model.transform(select.assemble(df, features))
    if kind == "boosted":  # the margin is half of the log odds
        want = {r[0]: math.log(r[1] / (1 - r[1])) / 2 for r in scored.select("seq", vector_to_array("probability")[1]).collect()}
    else:
        want = {r[0]: r[1] for r in scored.select("seq", vector_to_array("probability")[1]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_importance_table_of_a_model(spark):
    features = ["a", "b", "c", "d"]
    _, df = random_frame(spark, np.random.default_rng(3), 300, features)
    model = select.forest(5, 4).fit(select.assemble(df, features))
    table = trees.explain_model_shap(df, features, model, sample_size=100).orderBy("Rank").collect()
    assert [r["Rank"] for r in table] == [1, 2, 3, 4] and table[0]["SHAP_%"] == 100 and table[0]["Feature"] in ("a", "b", "c")
    assert table[-1]["Cumulative_SHAP_%"] == pytest.approx(sum(r["SHAP_%"] for r in table)) and max(r["Model_%"] for r in table) == 100
    assert trees.explain_model_shap(df, features, model, sample_size=None, top_n=2).count() == 2
    nulls = df.selectExpr("symbol", "seq", "CAST(NULL AS DOUBLE) AS a", "b", "c", "d")
    assert trees.tree_shap(nulls, features, trees.forest_of(spark, model)).count() == 0


def test_query_matches_sql_of_all_subsets(spark):
    same(spark, SF, queries.queries()["tree_shap_importance"], queries.oracle_sql()["tree_shap_importance"])


@pytest.mark.parametrize("cut", [2.3, -1.0])
def test_a_split_without_rows_matches_sql_of_all_subsets(spark, monkeypatch, cut):
    """The left side of the second tree's root is a split; with a cut below all volumes no row gets there."""
    (root, *others), first = queries.SHAP_SPLITS[1], queries.SHAP_SPLITS[0]
    monkeypatch.setattr(queries, "SHAP_SPLITS", (first, ((root[0], cut, *root[2:]), *others)))
    same(spark, SF, queries.tree_shap_importance, queries._tree_shap_sql())
    features = ["a", "b", "c"]
    _, df = random_frame(spark, np.random.default_rng(4), 50, features)
    made = trees.Tree(np.array([0, 1, -1, -1, -1]), np.array([cut * 100, 0.0, 0, 0, 0]), np.array([1, 3, -1, -1, -1]), np.array([2, 4, -1, -1, -1]), np.ones(5), np.zeros(5))
    forest = trees.recounted(df, features, trees.Forest((made,), (1.0,)), "target")
    values = np.array([r["shap"] for r in trees.tree_shap(df, features, forest).collect()])
    assert values.shape == (50, 3) and forest.undefined == (cut < 0) == bool(np.isnan(forest.base)) and np.isnan(values).all() == (cut < 0)


def plain_tree(bins, y, counts, s, tried, node=1, level=0, root=None):
    """{node: (feature, cut) or None} by trying every split; ``tried(node)`` are the features a node may use."""
    rows = [k for k in range(len(y)) if counts[k]]
    n, p = sum(counts[k] for k in rows), sum(counts[k] * y[k] for k in rows)
    weight = lambda n, p: n - p + s.positive_weight * p
    root = root or weight(n, p)

    def entropy(n, p):
        w = weight(n, p)
        return -sum(q * math.log2(q) for q in ((s.positive_weight * p) / w, (n - p) / w) if q > 0) if w else 0.0

    best = None
    if level < s.depth and n >= s.least_split:
        for f in tried(node):
            for cut in sorted({bins[k][f] for k in rows}):
                left = [k for k in rows if bins[k][f] <= cut]
                ln, lp = sum(counts[k] for k in left), sum(counts[k] * y[k] for k in left)
                if ln < s.least_leaf or n - ln < s.least_leaf:
                    continue
                w, lw, rw = weight(n, p), weight(ln, lp), weight(n - ln, p - lp)
                gain = w / root * (entropy(n, p) - lw / w * entropy(ln, lp) - rw / w * entropy(n - ln, p - lp))
                if gain >= s.least_gain and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, cut
    out = {node: best and (best[1], best[2])}
    if best:
        for side in (0, 1):
            own = [c if (bins[k][best[1]] > best[2]) == side else 0 for k, c in enumerate(counts)]
            out |= plain_tree(bins, y, own, s, tried, 2 * node + side, level + 1, root)
    return out


def grid_rows(spark, n=240, seed=5):
    rng = np.random.default_rng(seed)
    bins = rng.integers(0, 9, (n, 4))
    noise = rng.normal(size=(n, 3))
    labels = np.stack([bins[:, 0] + noise[:, 0] > 5, (bins[:, 1] > 4) ^ (bins[:, 2] > 6) ^ (noise[:, 1] > 1.5), noise[:, 2] > 0], axis=1).astype(int)
    rows = [("A", k, int(rng.integers(-(2**62), 2**62)), bins[k].tolist(), labels[k].tolist()) for k in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, seq int, key long, bins array<smallint>, labels array<tinyint>").repartition(3)


@pytest.mark.parametrize("sampled", [False, True])
def test_trees_of_all_labels_as_by_trying_every_split(spark, sampled):
    rows, df = grid_rows(spark)
    s = grid.Settings(depth=4, subsample=0.7 if sampled else None, share=0.6 if sampled else 1.0, least_leaf=4)
    got = grid.grow(df, 3, 4, 9, range(5, 7), s)
    counts = grid.row_counts(np.array([r[2] for r in rows]), np.array([5, 6]), s)
    splits = 0
    for label, tree in itertools.product(range(3), range(2)):
        tried = lambda node, t=tree: sorted(np.argsort(grid._mixed(5 + t, node, np.arange(4), s.seed))[: max(1, int(s.share * 4))].tolist())
        want = plain_tree([r[3] for r in rows], [r[4][label] for r in rows], counts[:, tree].tolist(), s, tried)
        k = label * 2 + tree
        for node, split in want.items():
            assert (got.feature[k, node], got.cut[k, node]) == (split or (-1, -1))
            assert not np.isnan(got.value[k, node])
            splits += split is not None
    assert splits > 20


def test_a_label_alone_gets_the_same_trees(spark):
    _, df = grid_rows(spark)
    s = grid.Settings(depth=3)
    every = grid.grow(df, 3, 4, 9, range(2), s)
    for label in range(3):
        one = grid.grow(df.selectExpr("key", "bins", f"array(labels[{label}]) AS labels"), 1, 4, 9, range(2), s)
        part = slice(2 * label, 2 * label + 2)
        n = one.feature.shape[1]
        assert (every.feature[part, :n] == one.feature).all() and (every.cut[part, :n] == one.cut).all()


def test_a_level_is_one_scan(spark, tmp_path):
    _, df = grid_rows(spark)
    df.write.parquet(str(tmp_path / "rows"))
    back = spark.read.parquet(str(tmp_path / "rows"))
    level = grid.best_splits(back, grid.Forests(3, range(4)), 0, 4, 9, np.zeros(0), grid.Settings())
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1


def test_grid_scores_against_the_trees_themselves(spark):
    from helpers import bars

    _, raw = bars(spark, 500, seed=4)
    features = ["Volume", "Close"]
    s, pairs = grid.Settings(depth=3, least_leaf=3), grid.grid_of((1.5, 3.0), (0.01, 0.02, 0.5))
    got = {(r["rr_threshold"], r["target"]): r for r in grid.evaluate_parameters(raw, features, 300, 450, 10, (1.5, 3.0), (0.01, 0.02, 0.5), trees=3, at_once=2, bins=8, settings=s).collect()}
    assert {k[1] for k in got} == {0.01, 0.02}  # nothing ever rises by half
    cuts = grid.quantile_cuts(raw.filter("seq <= 300"), features, 8)
    rows = grid.binned(raw, features, cuts, pairs, 10).orderBy("seq").collect()
    train, valid = spark.createDataFrame([r for r in rows if r["seq"] <= 300]), [r for r in rows if 300 < r["seq"] <= 450]
    train = train.select("key", F.col("bins").cast("array<smallint>"), F.col("labels").cast("array<tinyint>"))
    forests = grid.grow(train, len(pairs), 2, max(map(len, cuts)) + 1, range(3), s)
    votes = forests.votes(np.array([r["bins"] for r in valid])) / 3
    for k, pair in enumerate(pairs):
        if pair in got:
            y, p = np.array([r["labels"][k] for r in valid]), votes[:, k] > 0.5
            tp = (y * p).sum()
            assert got[pair]["precision"] == pytest.approx(tp / p.sum() if p.sum() else 0) and got[pair]["recall"] == pytest.approx(tp / y.sum())
            assert got[pair]["positive_ratio"] == pytest.approx(np.mean([r["labels"][k] for r in rows if r["seq"] <= 300]))
        one = select.add_target_column_mod(raw, 10, pair[1], pair[0]).orderBy("seq").collect()
        assert [r["target"] for r in one] == [r["labels"][k] for r in rows]


def test_first_splits_match_sql(spark):
    same(spark, SF, queries.queries()["grid_first_splits"], queries.oracle_sql()["grid_first_splits"])
