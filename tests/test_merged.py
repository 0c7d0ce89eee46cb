"""Mergeable metrics against numpy: odd rows, many tasks, states that grow, and the exact median."""

import numpy as np
import pytest

from nestfold.functions import merged

SCHEMA = "g string, pred_mean double, y double"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [("hot", float(a), float(b)) for a, b in zip(rng.normal(size=400), 1e6 + rng.normal(size=400))]
    out += [("ties", 1.0, float(i % 3)) for i in range(31)] + [("even", 0.0, v) for v in (1.0, 2.0, 4.0, 1e30)]
    return out + [(None, 1.0, 3.0), (None, 2.0, 2.5), ("one", 5.0, 5.0), ("null", None, 1.0), ("null", 2.0, None), ("far", 0.0, float("inf"))]


def errors(rows):
    out = {}
    for g, a, b in rows:
        if a is not None and b is not None:
            out.setdefault(g, []).append((a, b))
    return {g: np.array(v) for g, v in out.items()}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_r_squared(spark, rows, parts):
    df = spark.createDataFrame([r for r in rows if r[0] != "far"], SCHEMA).repartition(parts)
    got = {r.g: r.r2 for r in merged.score(df, ["g"], {"r2": merged.r_squared()}).collect()}
    want = {g: 1 - ((v[:, 0] - v[:, 1]) ** 2).sum() / ((v[:, 1] - v[:, 1].mean()) ** 2).sum() if len(set(v[:, 1])) > 1 else None
            for g, v in errors([r for r in rows if r[0] != "far"]).items()}
    assert got.keys() == want.keys() and "null" not in got
    assert all(got[g] is None if w is None else got[g] == pytest.approx(w, rel=1e-9) for g, w in want.items())


def test_exact_median(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = {g: float(np.median(np.abs(v[:, 0] - v[:, 1]))) for g, v in errors(rows).items()}
    for ranges in (1024, 3):  # few ranges take many passes
        monkeypatch.setattr(merged, "RANGES", ranges)
        got = {r.g: r.median_error for r in merged.exact_median_error(df.filter("g = 'hot' or g is null") if ranges == 3 else df, ["g"]).collect()}
        assert got == {g: w for g, w in want.items() if ranges > 3 or g in ("hot", None)}
    monkeypatch.setattr(merged, "MAX_GROUPS", 2)
    with pytest.raises(ValueError, match="groups"):
        merged.exact_median_error(df, ["g"])


def test_empty_tables_and_states_that_grow(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert merged.score(df.limit(0), ["g"], {"r2": merged.r_squared()}).count() == 0
    assert merged.exact_median_error(df.limit(0), ["g"]).columns == ["g", "median_error"]
    grows = merged.Merged(list, lambda s, p, y: s + [bytes(merged.MAX_STATE)], lambda a, b: a + b, len)
    with pytest.raises(Exception, match="grow with the rows"):
        merged.score(df, ["g"], {"x": grows}).collect()
