"""Synchronous mini-batch steps: the same for any partitioning, and equal to steps taken in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nestfold.models import net
from nestfold.sources.storage import materialize


@pytest.fixture(scope="module")
def curve(spark):
    df = spark.range(300).select("id", ((F.col("id") * 37 % 300) / 300).alias("a"), ((F.col("id") * 61 % 300) / 300).alias("b"))
    return materialize(df.select("id", F.array("a", "b").alias("features"), (F.sin(6 * F.col("a")) * 0.4 + F.col("b") * 0.3).alias("y")), "curve")


def trained(rows, shards, **more):
    shape = net.mean_variance_net(2, 8, 3)
    return net.fit(rows, shape, n_members=2, lr=0.01, epochs=2, batch_size=100, sync="steps", key=["id"], shards=shards, **more)


def test_partitions_change_nothing_but_rounding(curve):
    fits = [trained(materialize(curve.repartition(parts), "parts"), shards) for parts, shards in ((1, 1), (4, 3), (16, 8))]
    for other in fits[1:]:
        assert np.allclose(fits[0].members, other.members, rtol=1e-8, atol=1e-10)
        assert np.allclose(fits[0].losses, other.losses)


def test_equals_steps_taken_in_one_place(curve):
    shape, size = net.mean_variance_net(2, 8, 3), net.mean_variance_net(2, 8, 3).n_params
    fitted = trained(curve, 4)
    for member in range(2):
        state, best = np.concatenate([shape.init(73 + member), np.zeros(2 * size)]), None
        steps, losses = 0, []
        for epoch in range(2):
            drawn = F.pmod(F.xxhash64("id", F.lit(73), F.lit(epoch)), F.lit(1 << 40)) / F.lit(float(1 << 40))
            rows = curve.withColumn("batch", F.floor(drawn * 3)).orderBy("id").collect()
            x, y, batch = np.array([r.features for r in rows]), np.array([r.y for r in rows]), np.array([r.batch for r in rows])
            found = []
            for b in range(3):
                own = batch == b
                loss, g = shape.loss_and_gradient(state[:size], x[own], y[own])
                steps += 1
                net.adamw(state[:size], g / own.sum(), state[size:2 * size], state[2 * size:], steps, 0.01, 0.01)
                found.append(loss / own.sum())
            losses.append(np.mean(found))
            if best is None or losses[-1] <= best[0]:
                best = losses[-1], state[:size].copy()
        assert np.allclose(fitted.losses[member], losses) and np.allclose(fitted.members[member], best[1], rtol=1e-8, atol=1e-10)


def test_refuses_what_it_cannot_do(curve, monkeypatch):
    with pytest.raises(ValueError, match="key"):
        net.fit(curve, net.mean_variance_net(2, 8, 3), sync="steps")
    monkeypatch.setattr(net, "MAX_EXCHANGE", 10)
    with pytest.raises(ValueError, match="exchange"):
        trained(curve, 2)


def test_shared_and_own_batches_take_the_same_steps(curve, monkeypatch):
    """Small batches are not exchanged step by step, and give what the exchange gives."""
    own = trained(curve, 3)
    monkeypatch.setattr(net, "SHARED_BATCH", 100)
    shared = trained(curve, 3)
    assert np.allclose(own.members, shared.members, rtol=1e-8, atol=1e-10) and np.allclose(own.losses, shared.losses)


def test_messages_follow_from_tasks_not_batches(spark):
    """150 steps an epoch; each exchange takes a second at least."""
    rows = materialize(spark.range(600).select("id", F.array(F.col("id") / 600).alias("features"), (F.col("id") / 600).alias("y")), "line")
    fitted = net.fit(rows, net.mean_variance_net(1, 4, 2), lr=0.01, epochs=1, batch_size=4, sync="steps", key=["id"], shards=2)
    assert fitted.seconds < 60


@pytest.mark.parametrize("head", ["gaussian", "mse"])
def test_members_together_have_the_losses_and_gradients_of_each(head):
    rng = np.random.default_rng(5)
    shape = net.Net((3, 6, 4, 2 if head == "gaussian" else 1), head)
    params, x, y = np.stack([shape.init(s) for s in range(4)]), rng.normal(size=(4, 9, 3)), rng.normal(size=(4, 9))
    losses, grads = shape.losses_and_gradients(params, x, y)
    for i in range(4):
        loss, grad = shape.loss_and_gradient(params[i], x[i], y[i])
        assert losses[i] == pytest.approx(loss, rel=1e-12) and np.allclose(grads[i], grad, rtol=1e-12, atol=1e-14)
