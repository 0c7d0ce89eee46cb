"""Forests: the studies' settings in terms of MLlib.

No counterpart in MLlib: ``min_samples_split`` (folded into the leaf size) and
depth beyond 30. ``altered`` says which settings run otherwise than given; the
trial log carries it.
"""

from __future__ import annotations

import math
from typing import Any, Mapping

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame

MAX_DEPTH = 30  # MLlib's own limit


def effective(params: Mapping[str, Any]) -> dict[str, Any]:
    """The settings MLlib can run: a depth up to its limit, and the split size as a leaf size."""
    features = params.get("max_features", "auto")
    if features not in ("sqrt", "auto"):
        raise ValueError(f"no rule {features!r} for features per node")
    leaf = max(int(params.get("min_samples_leaf", 1)), math.ceil(int(params.get("min_samples_split", 2)) / 2))
    return {"n_estimators": int(params["n_estimators"]), "max_depth": min(int(params["max_depth"]), MAX_DEPTH),
            "min_samples_leaf": leaf, "max_features": features}


def altered(params: Mapping[str, Any]) -> str | None:
    """What of the settings is not run as given, in words; None if all is."""
    runs = effective(params)
    notes = [f"{name} {params[name]} runs as {value}" for name, value in runs.items() if name in params and params[name] != value]
    if int(params.get("min_samples_split", 2)) > 2:
        notes.append(f"min_samples_split {params['min_samples_split']} counts as a leaf size")
    return "; ".join(notes) or None


def forest(params: Mapping[str, Any], label: str = "y", seed: int = 73) -> RandomForestRegressor:
    runs = effective(params)
    return RandomForestRegressor(
        featuresCol="vector", labelCol=label, predictionCol="pred_mean", seed=seed,
        numTrees=runs["n_estimators"], maxDepth=runs["max_depth"], minInstancesPerNode=runs["min_samples_leaf"],
        featureSubsetStrategy="sqrt" if runs["max_features"] == "sqrt" else "all",
    )


def with_vector(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="vector", handleInvalid="error").transform(df)
