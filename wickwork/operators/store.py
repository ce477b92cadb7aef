"""Saved models: a Spark ML model, and beside it its parameters, threshold and features as JSON."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

REQUIRED = ("params", "threshold")


def save_model_with_threshold(spark: SparkSession, folder: str, name: str, model: PipelineModel, params: dict, threshold: float, features: list[str]) -> None:
    model.write().overwrite().save(f"{folder}/{name}/model")
    text = json.dumps({"params": params, "threshold": threshold, "features": features})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}/metadata")


def load_model_with_threshold(spark: SparkSession, folder: str, name: str) -> dict:
    """The model and what was saved with it; names what there is if there is no such model."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/metadata")):
        found = sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []
        raise FileNotFoundError(f"no model {name} in {folder}; there are: {', '.join(found) or 'none'}")
    data = json.loads(spark.read.text(f"{folder}/{name}/metadata").first()[0])
    if missing := [k for k in REQUIRED if k not in data]:
        raise KeyError(f"{name} lacks {', '.join(missing)}")
    return data | {"model": PipelineModel.load(f"{folder}/{name}/model")}
