"""Saving the best model and loading it before scoring.

Array models become Parquet rows (name, shape, block of values), so any executor
can read them; MLlib models use their own writer.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nestfold.models.gp import Covariance, LinearMean, SparseGP
from nestfold.models.net import Fitted, Net

BLOCK = 65536


def save_arrays(spark: SparkSession, path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    rows = [("_meta", json.dumps(meta), 0, [])]
    for name, a in arrays.items():
        flat = np.asarray(a, dtype=np.float64).ravel()
        rows += [(name, json.dumps(np.shape(a)), i // BLOCK, flat[i:i + BLOCK].tolist()) for i in range(0, max(len(flat), 1), BLOCK)]
    spark.createDataFrame(rows, "name string, info string, block int, data array<double>").write.mode("overwrite").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> tuple[dict[str, np.ndarray], dict]:
    parts: dict[str, list] = {}
    meta: dict = {}
    for row in spark.read.parquet(path).collect():  # as large as the model
        if row["name"] == "_meta":
            meta = json.loads(row["info"])
        else:
            parts.setdefault(row["name"], []).append(row)
    arrays = {
        name: np.concatenate([np.array(r["data"]) for r in sorted(rows, key=lambda r: r["block"])]).reshape(json.loads(rows[0]["info"]))
        for name, rows in parts.items()
    }
    return arrays, meta


def save_net(spark: SparkSession, path: str, fitted: Fitted) -> None:
    save_arrays(spark, path, {"members": fitted.members}, {"sizes": fitted.net.sizes, "head": fitted.net.head})


def load_net(spark: SparkSession, path: str) -> Fitted:
    arrays, meta = load_arrays(spark, path)
    return Fitted(Net(tuple(meta["sizes"]), meta["head"]), arrays["members"], [], 0.0)


def save_gp(spark: SparkSession, path: str, gp: SparseGP) -> None:
    arrays = {"points": gp.points, "alpha": gp.alpha, "shrink": gp.shrink}
    if gp.covariance.lengthscales is not None:
        arrays["lengthscales"] = gp.covariance.lengthscales
    if gp.covariance.mixture is not None:
        arrays |= dict(zip(("weights", "means", "scales"), gp.covariance.mixture))
    if gp.mean.slopes is not None:
        arrays["slopes"] = gp.mean.slopes
    save_arrays(spark, path, arrays, {
        "kind": gp.covariance.kind, "intercept": gp.mean.intercept, "outputscale": gp.outputscale, "noise": gp.noise, "bound": gp.bound})


def load_gp(spark: SparkSession, path: str) -> SparseGP:
    a, meta = load_arrays(spark, path)
    mixture = (a["weights"], a["means"], a["scales"]) if "weights" in a else None
    return SparseGP(a["points"], Covariance(meta["kind"], a.get("lengthscales"), mixture), LinearMean(meta["intercept"], a.get("slopes")),
                    meta["outputscale"], meta["noise"], meta["bound"], a["alpha"], a["shrink"])
