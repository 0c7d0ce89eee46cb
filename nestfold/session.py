"""Session settings the jobs expect; a caller's own session works as well."""

from __future__ import annotations

import tempfile
import threading
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPING = threading.Lock()


def get_session(app: str = "nestfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution with skew splitting, and Arrow.

    ``master`` is left to spark-submit unless given, so the same code runs on a
    cluster. Extra settings are passed as ``spark__sql__x="..."``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Workers do not share the driver's import path; Spark's own file
    distribution brings them the package, whatever way the job was started.
    """
    context = spark.sparkContext
    with _SHIPPING:
        if any("nestfold-package" in name for name in context.listFiles):
            return
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="nestfold-")) / "nestfold-package.zip"
        with zipfile.ZipFile(target, "w") as archive:
            for source in sorted([*root.rglob("*.py"), *root.rglob("*.txt")]):
                archive.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
