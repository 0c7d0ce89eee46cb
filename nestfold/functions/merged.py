"""User metrics as mergeable states: start, add, merge and finish, in Arrow batches.

Every task adds its rows to one state per group and hands out the states alone,
so a group of any size is combined before the shuffle and no task gets a
group's rows. States are merged in two steps, first by (group, a few buckets), then by group:
a group whose states come from very many tasks is not merged by one task from all of them.

``exact_median_error`` is the example that needs more than one state: counts
over equal ranges narrow down the ranks in the middle, a pass at a time.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from typing import Any, Callable, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from nestfold.session import ship_package

BUCKETS = 16  # in which the states of a group are merged first
MAX_STATE = 1 << 20  # bytes; a state must not grow with the rows
RANGES = 1024  # into which a pass of the median cuts what is left
MAX_GROUPS = 10_000  # of the median, whose ranges lie on the driver


@dataclass(frozen=True)
class Merged:
    """A metric by its state: ``add(state, pred, y)`` takes arrays, ``merge`` two states, ``finish`` gives a number or None.

    States must stay below ``MAX_STATE`` bytes pickled, and must not depend on the order of
    rows but for rounding. Rows with a null prediction or truth are not added.
    """

    start: Callable[[], Any]
    add: Callable[[Any, np.ndarray, np.ndarray], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def _pack(state: Any) -> bytes:
    out = pickle.dumps(state)
    if len(out) > MAX_STATE:
        raise ValueError(f"a metric's state has {len(out)} bytes; it must not grow with the rows")
    return out


def _groups(df: DataFrame, by: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*by).schema.fields)


def _rows_of(batch: pa.RecordBatch | pa.Table, by: Sequence[str]):
    """(key, row numbers) of each group in a batch."""
    found: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(*[batch.column(c).to_pylist() for c in by])):
        found.setdefault(k, []).append(i)
    return found.items()


def states(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Merged], pred: str, y: str) -> DataFrame:
    """(*by, _state, _bucket): one row per task and group, with the states of all metrics."""
    ship_package(df.sparkSession)
    by, kinds = list(by), df.select(*by).schema
    arrow = [f.name for f in kinds.fields]

    def task(stream):
        held: dict[tuple, list] = {}
        types = None
        for batch in stream:
            types = types or [batch.schema.field(c).type for c in arrow]
            p, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("_p", "_y"))
            for k, rows in _rows_of(batch, by):
                state = held.setdefault(k, [m.start() for m in metrics.values()])
                for i, m in enumerate(metrics.values()):
                    state[i] = m.add(state[i], p[rows], t[rows])
        if held:
            # A group's states are dealt to buckets by what they hold, which a rerun repeats.
            packed = [_pack(s) for s in held.values()]
            yield pa.record_batch([*[pa.array([k[i] for k in held], types[i]) for i in range(len(by))], pa.array(packed, pa.binary())], [*by, "_state"])

    rows = df.select(*by, F.col(pred).cast("double").alias("_p"), F.col(y).cast("double").alias("_y")).filter("_p is not null and _y is not null")
    out = rows.mapInArrow(task, f"{_groups(df, by)}, _state binary")
    return out.withColumn("_bucket", F.pmod(F.xxhash64("_state"), F.lit(BUCKETS)).cast("int"))


def _merge(table: pa.Table, ms: Sequence[Merged]) -> list:
    total = None
    for cell in table.column("_state"):
        state = pickle.loads(cell.as_py())
        total = state if total is None else [m.merge(a, b) for m, a, b in zip(ms, total, state)]
    return total


def score(df: DataFrame, by: Sequence[str], metrics: Mapping[str, Merged], pred: str = "pred_mean", y: str = "y") -> DataFrame:
    """(*by, one column per metric): groups without a usable row are absent; an empty table gives no rows."""
    by, names, ms = list(by), list(metrics), list(metrics.values())
    if not by:
        raise ValueError("a score needs a column to group by")

    def part(table: pa.Table) -> pa.Table:
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "_state": pa.array([_pack(_merge(table, ms))], pa.binary())})

    def whole(table: pa.Table) -> pa.Table:
        ends = [m.finish(s) for m, s in zip(ms, _merge(table, ms))]
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, **{n: pa.array([e], pa.float64()) for n, e in zip(names, ends)}})

    first = states(df, by, metrics, pred, y).groupBy(*by, "_bucket").applyInArrow(part, f"{_groups(df, by)}, _state binary")
    return first.groupBy(*by).applyInArrow(whole, ", ".join([_groups(df, by), *[f"`{n}` double" for n in names]]))


def exact_median_error(df: DataFrame, by: Sequence[str], pred: str = "pred_mean", y: str = "y", name: str = "median_error") -> DataFrame:
    """(*by, name): the median of |prediction - truth|, the average of the middle two for even counts.

    Each pass counts the errors of all groups within ``RANGES`` equal parts of what
    is left of their ranges; after a few, each wanted rank's range holds one value. Errors
    that are null or NaN do not count; infinite ones are largest. The driver holds a
    range per group, for at most ``MAX_GROUPS``. Column names that begin with an underscore are taken.
    """
    by = list(by)
    error = F.abs(F.col(pred).cast("double") - F.col(y).cast("double"))
    rows = df.select(*by, error.alias("_e")).filter("_e is not null and not isnan(_e)")
    ends = rows.groupBy(*by).agg(F.count("_e").alias("_n"), F.min("_e").alias("_lo"), F.max("_e").alias("_hi")).limit(MAX_GROUPS + 1).collect()
    if len(ends) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    spark, found = df.sparkSession, {}
    # Ranges are of the numbers' bit patterns, whose order is that of the values: no rank needs more than seven passes.
    bits = lambda v: int(np.float64(v + 0.0).view(np.int64))
    wanted = {}
    for r in ends:
        key = tuple(r[c] for c in by)
        for rank in {(r["_n"] - 1) // 2, r["_n"] // 2}:
            wanted[key, rank] = (bits(r["_lo"]), bits(r["_hi"]), rank)  # the rank counts from the range's start
    types = _groups(df, by)
    while wanted:
        for k in [k for k, (lo, hi, _) in wanted.items() if lo == hi]:
            found[k] = float(np.int64(wanted.pop(k)[0]).view(np.float64))
        if not wanted:
            break
        table = spark.createDataFrame(
            [(*k, rank, lo, hi, max(1, -(-(hi - lo + 1) // RANGES))) for (k, rank), (lo, hi, _) in wanted.items()], f"{types}, _rank long, _lo long, _hi long, _step long")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by]
        as_bits = rows.withColumn("_b", _double_bits("_e"))
        near = as_bits.alias("r").join(F.broadcast(table).alias("w"), same, "inner").filter("_b between _lo and _hi")  # MAX_GROUPS x 2 rows at most
        counts = near.groupBy(*[F.col(f"w.{c}").alias(c) for c in by], "_rank", F.expr("(_b - _lo) div _step").alias("_part")).count().collect()
        cells: dict = {}
        for c in counts:
            cells.setdefault((tuple(c[x] for x in by), c["_rank"]), {})[c["_part"]] = c["count"]
        for k, (lo, hi, rank) in list(wanted.items()):
            step = max(1, -(-(hi - lo + 1) // RANGES))
            for part, n in sorted(cells[k].items()):
                if rank < n:
                    wanted[k] = (lo + part * step, min(hi, lo + (part + 1) * step - 1), rank)
                    break
                rank -= n
    out = [(*(r[c] for c in by), (found[k, (r["_n"] - 1) // 2] + found[k, r["_n"] // 2]) / 2) for r in ends for k in [tuple(r[c] for c in by)]]
    return spark.createDataFrame(out, f"{types}, `{name}` double")


def _double_bits(column: str) -> Column:
    """The bit pattern of a double that is zero or more, as a long; Spark's own functions have none."""
    def bits(values: pd.Series) -> pd.Series:
        return pd.Series((values.to_numpy(np.float64) + 0.0).view(np.int64))

    return F.pandas_udf(bits, "long")(F.col(column))


def r_squared() -> Merged:
    """1 - squared errors / squared distances from the mean, from (n, mean, distances, errors) merged pairwise; None for a constant truth."""
    def merge(a, b):
        n, gap = a[0] + b[0], b[1] - a[1]
        return a if not b[0] else b if not a[0] else (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n, a[3] + b[3])

    def add(state, pred, y):
        return merge(state, (len(y), float(y.mean()), float(((y - y.mean()) ** 2).sum()), float(((pred - y) ** 2).sum())))

    return Merged(lambda: (0, 0.0, 0.0, 0.0), add, merge, lambda s: 1 - s[3] / s[2] if s[2] > 0 else None)
