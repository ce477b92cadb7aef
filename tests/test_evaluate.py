import numpy as np
import pytest
from helpers import bars, column

from wickwork.operators import OPERATORS, evaluate, select
from wickwork.operators.label import add_target_column_mod


def scored(spark):
    rng = np.random.default_rng(0)
    rows = []
    for split, n in (("train", 300), ("valid", 200)):
        y = rng.integers(0, 2, n)
        p = np.clip(np.round(0.3 * y + rng.random(n) * 0.7, 2), 0, 1)
        rows += [(split, int(a), float(b)) for a, b in zip(y, p, strict=True)]
    return rows, spark.createDataFrame(rows, "split string, target int, proba double")


def test_threshold_sweep_and_choice(spark):
    rows, df = scored(spark)
    got = {(r.split, round(r.threshold, 2)): r for r in evaluate.threshold_sweep(df).collect()}
    assert len(got) == 198
    for split in ("train", "valid"):
        f1 = {}
        for t in evaluate.THRESHOLDS:
            own = [(y, p >= t) for s, y, p in rows if s == split]
            tp = sum(y and q for y, q in own)
            fp, fn = sum(q and not y for y, q in own), sum(y and not q for y, q in own)
            f1[t] = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0
            assert got[split, t].f1 == pytest.approx(f1[t])
        best = {r.split: r.threshold for r in evaluate.best_thresholds(evaluate.threshold_sweep(df)).collect()}
        assert best[split] == max(f1, key=lambda t: (f1[t], -t))


def test_roc_auc_with_ties(spark):
    rows, df = scored(spark)
    for r in evaluate.roc_auc(df).collect():
        pos, neg = ([p for s, y, p in rows if s == r.split and y == k] for k in (1, 0))
        assert r.roc_auc == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]))
    one = spark.createDataFrame([("train", 1, 0.5)], "split string, target int, proba double")
    assert evaluate.roc_auc(one).first().roc_auc is None


def test_class_balance_fills_missing_splits(spark):
    _, df = scored(spark)
    got = evaluate.show_class_balance(df).orderBy("target").collect()
    assert got[0].test == 0.0 and got[0].all + got[1].all == pytest.approx(1, abs=2e-3)


def test_models_train_score_and_persist(spark, tmp_path):
    from pyspark.ml import Pipeline

    from wickwork.operators import store

    _, raw = bars(spark, 400)
    df = add_target_column_mod(OPERATORS["add_choppiness_index"](OPERATORS["add_bollinger_features"](raw)), 20, 0.02, 2.0)
    names = ["bb_z_20", "choppiness_index_14"]
    model = select.forest(5, 3).fit(select.assemble(df, names))
    table = select.explain_model_permutation(df, names, model, n_repeats=2)
    assert [r["Rank"] for r in table] == [1, 2] and {r["Feature"] for r in table} == set(names)
    grid = select.evaluate_parameters(raw.join(df.select("symbol", "seq", *names), ["symbol", "seq"]), names, 250, 350, rr_thresholds=(2.0,), targets=(0.01,), estimator=select.forest(3, 3))
    assert len(grid) == 1 and 0 <= grid[0]["f1"] <= 1
    pipe = Pipeline(stages=[]).fit(df)
    store.save_model_with_threshold(spark, str(tmp_path), "m", pipe, {"a": 1}, 0.4, names)
    assert store.load_model_with_threshold(spark, str(tmp_path), "m")["threshold"] == 0.4
    with pytest.raises(FileNotFoundError, match="m"):
        store.load_model_with_threshold(spark, str(tmp_path), "other")


def test_shuffling_keeps_the_values(spark):
    _, df = bars(spark, 200)
    out = select.shuffled(df, "Close", 1)
    a, b = column(df, "Close"), column(out, "Close")
    assert len(a) == len(b) and (a != b).any() and sorted(a) == sorted(b)


def test_granger_finds_the_leader():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = np.r_[0, x[:-1]] + 0.1 * rng.normal(size=400)
    assert select.granger_p(x, y) < 1e-6 < select.granger_p(rng.normal(size=400), y)
    assert select._chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-5) and select._chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-5) and select._chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-5)


def test_a_column_that_does_not_vary_correlates_as_in_duckdb(spark):
    import duckdb

    rows = [(float(k), 2.0 * k + k % 3, 0.1, None if k == 3 else -float(k), None if k else 5.0, None) for k in range(7)]
    schema = "a double, b double, flat double, gap double, one double, none double"
    names = [c.split()[0] for c in schema.split(", ")]
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t ({schema})")
    con.executemany(f"INSERT INTO t VALUES ({', '.join('?' * len(names))})", rows)
    got = evaluate.correlation_pairs(spark.createDataFrame(rows, schema).repartition(3), names).collect()
    assert len(got) == 15
    for a, b, r in got:
        want = con.execute(f"SELECT corr({a}, {b}) FROM t").fetchone()[0]
        assert (r is None) == (want is None) and (r is None or r == pytest.approx(want, abs=1e-12, nan_ok=True)), (a, b)
    top = evaluate.get_top_correlated_pairs(spark.createDataFrame(rows, schema), ["a", "b", "flat"], 3).collect()
    assert [(r[0], r[1]) for r in top] == [("a", "flat"), ("b", "flat"), ("a", "b")] and np.isnan(top[0]["r"]) and top[2]["r"] < 1
