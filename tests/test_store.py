"""Models written and read back, and the fixed choices of columns."""

import pytest
from helpers import SF, bars, same

from wickwork import queries
from wickwork.operators import OPERATORS, select, store
from wickwork.operators.label import add_target_column_mod
from wickwork.operators.pipelines import SELECTED, UNIMPORTANT, drop_low_importance_features, keep_selected_features


def labelled(spark, n=240):
    _, raw = bars(spark, n)
    return add_target_column_mod(OPERATORS["ta_rsi"](OPERATORS["add_bollinger_features"](raw)), 20, 0.02, 2.0)


def test_a_fitted_model_scores_alike_after_loading(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    names = ["bb_z_20", "RSI_14"]
    rows = labelled(spark).na.drop().withColumn("weight", F.lit(1.0))
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), select.forest(4, 3)]).fit(rows)
    store.save_model_with_threshold(spark, str(tmp_path), "rf", model, {"trees": 4}, 0.37, names)
    back = store.load_model_with_threshold(spark, str(tmp_path), "rf")
    assert back["threshold"] == 0.37 and back["features"] == names and back["params"] == {"trees": 4}
    proba = lambda m: [r[0] for r in m.transform(rows).orderBy("seq").select(vector_to_array("probability")[1]).collect()]
    assert proba(back["model"]) == proba(model)
    with pytest.raises(FileNotFoundError, match="rf"):
        store.load_model_with_threshold(spark, str(tmp_path), "other")


def test_fixed_choices_of_columns(spark):
    _, df = bars(spark, 5)
    df = df.selectExpr("*", "1 AS target", "1.0 AS linreg", "2.0 AS AD", "5.0 AS mine")
    assert keep_selected_features(df).columns == [c for c in SELECTED if c in df.columns]
    assert drop_low_importance_features(df).columns == [c for c in df.columns if c not in UNIMPORTANT] and "AD" not in drop_low_importance_features(df).columns


def test_elimination_and_shadows_find_the_informative_feature(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 401).select(F.lit("A").alias("symbol"), F.col("id").alias("seq"), F.rand(1).alias("good"), F.rand(2).alias("noise"), F.rand(3).alias("more"))
    rows = rows.withColumn("target", (F.col("good") > 0.5).cast("int")).cache()
    best, curve = select.show_rfecv_results(rows, ["noise", "good", "more"], select.forest(5, 3), n_splits=2)
    assert "good" in best and [n for n, _ in curve] == [3, 2, 1] and curve[-1][1] > 0.9
    assert select.explain_model_boruta(rows, ["noise", "good"], select.forest(5, 3), max_iter=6, n_splits=1) == ["good"]
    assert [n for n, f in select.plot_f1_vs_n_estimators(rows, ["good"], range(2, 5, 2), 1) if f > 0.9] == [2, 4]


def test_csv_query_matches_sql(spark):
    same(spark, SF, queries.queries()["csv_features"], queries.oracle_sql()["csv_features"])
