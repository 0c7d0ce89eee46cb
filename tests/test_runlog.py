"""The run log under reruns, failures between files and compaction; scopes; a study that goes on."""

import os

import pytest
from pyspark.sql import functions as F

from nestfold.operators.encode import assemble
from nestfold.plans import nested
from nestfold.sources import runlog, storage
from nestfold.sources.results import RESULT_SCHEMA


def rows(spark, run, values):
    return spark.createDataFrame([("d", "RF", run, v) for v in values], "dataset_name string, model string, outer_run int, mse double")


def told(log):
    return sorted((r.outer_run, r.mse) for r in log.read().collect())


def test_writing_twice_leaves_one_copy(spark):
    log = runlog.RunLog(spark, storage.fresh_path(spark, "log"))
    assert told(log) == [] and log.read().schema.names == RESULT_SCHEMA.names and not log.has("a")
    log.write("a", rows(spark, 1, [0.5, 0.6]))
    log.write("b", rows(spark, 2, [0.7]))
    log.write("a", rows(spark, 1, [0.5]))
    assert told(log) == [(1, 0.5), (2, 0.7)] and log.has("a")
    log.write("b", rows(spark, 2, []))
    assert told(log) == [(1, 0.5)] and log.has("b")


def test_failing_between_the_files_leaves_the_old_rows(spark, monkeypatch):
    log = runlog.RunLog(spark, storage.fresh_path(spark, "log"))
    log.write("a", rows(spark, 1, [0.5]))

    def fails(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(log, "_commit", fails)
        with pytest.raises(OSError):
            log.write("a", rows(spark, 1, [9.0]))
        with pytest.raises(OSError):
            log.write("new", rows(spark, 3, [9.0]))
        with pytest.raises(OSError):
            log.compact()
    assert told(log) == [(1, 0.5)] and not log.has("new")
    log.compact()
    log.write("a", rows(spark, 1, [0.25]))
    log.compact()
    log.compact()
    assert told(log) == [(1, 0.25)]


def test_scope_removes_what_was_made_inside(spark):
    outside = storage.materialize(spark.range(3).toDF("x"), "kept")
    with storage.scope(spark):
        inside = storage.materialize(spark.range(5).toDF("x"), "gone")
        with pytest.raises(KeyError), storage.scope(spark):
            inner = storage.fresh_path(spark, "inner")
            spark.range(1).write.parquet(inner)
            raise KeyError
        assert not os.path.exists(inner) and inside.count() == 5
        path = inside.inputFiles()[0].removeprefix("file:")
    assert not os.path.exists(path) and outside.count() == 3


def test_a_study_goes_on_from_its_logs(spark, monkeypatch):
    df = spark.range(300).select("id", ((F.col("id") * 37 % 300) / 300).alias("a"), ((F.col("id") * 61 % 300) / 300).alias("b"))
    df = assemble(df.withColumn("y", F.sin(6 * F.col("a")) + F.col("b")), ["a", "b"], keep=["id", "a", "b", "y"]).drop("features")
    study = nested.prepare(df, ["id"], ["a", "b"], "curve", k_outer=3, k_inner=2)
    configs = [{"n_estimators": 2, "max_depth": 2, "max_features": "auto"}, {"n_estimators": 4, "max_depth": 40, "max_features": "auto"}]
    path, real, searched = storage.fresh_path(spark, "study"), nested.search, []

    def counted(study, model, run, *args, **options):
        searched.append(run)
        if len(searched) == 2:
            raise OSError("driver lost")
        return real(study, model, run, *args, **options)

    monkeypatch.setattr(nested, "search", counted)
    with pytest.raises(OSError):
        nested.nested_study(study, "RF", configs, path)
    log, results = nested.nested_study(study, "RF", configs, path)
    assert log.count() == 6 and results.count() == 3 and len(searched) in (4, 5)
    assert log.filter("params['max_depth'] = '40'").select("message").distinct().collect()[0].message == "max_depth 40 runs as 30"
    before, n = sorted(map(str, results.collect())), len(searched)
    _, again = nested.nested_study(study, "RF", configs, path)
    assert sorted(map(str, again.collect())) == before and len(searched) == n
