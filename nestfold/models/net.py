"""Mean-and-variance networks, their ensembles, and feature extractors.

Data-parallel training over partitions. ``sync="average"`` lets every task take
mini-batch steps on its own rows and averages the results once per epoch (one
job per epoch); ``sync="gradient"`` takes one exact full-gradient step per job;
``sync="steps"`` takes synchronous mini-batch steps: a row's batch follows from its
key, and the result does not depend on how the rows are partitioned. The tasks of a barrier
stage share a large batch and exchange their gradients for every step; small batches each
lie in one task, and the tasks hand the weights on, one message for all the batches of a task. All members of an ensemble share each pass over the data.
"""

from __future__ import annotations

import base64
import time
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, functions as F

from nestfold.models.passes import append_columns, batches_of, matrix, sum_over_rows
from nestfold.session import ship_package

VAR_FLOOR = 1e-6
# Rows below which pretraining takes that many epochs; else 5.
PRETRAIN_EPOCHS = ((10_000, 25), (100_000, 10))
PRETRAIN_LAST = 5
SMALLEST_BATCH = 32  # rows a task takes per step at least
SHARED_BATCH = 100_000  # rows of a batch that tasks share; computing a smaller one's gradient takes less than an exchange
MAX_EXCHANGE = 64 << 20  # bytes that the tasks of a barrier stage send for one step


def layer_widths(n_in: int, n_max: int, n_layers: int, n_out: int) -> list[int]:
    """Sizes from input to output, tapering evenly from ``n_max`` to ``n_out``."""
    step = (n_max - n_out) / (n_layers - 1)
    return [n_in, *(round(n_max - i * step) for i in range(n_layers))]


@dataclass(frozen=True)
class Net:
    """Shape and loss of a ReLU network whose parameters are one flat vector.

    ``head`` is ``gaussian`` (mean and softplus variance, Gaussian NLL) or
    ``mse`` (one output, squared error).
    """

    sizes: tuple[int, ...]
    head: str = "gaussian"

    @property
    def n_params(self) -> int:
        return sum(a * b + b for a, b in zip(self.sizes, self.sizes[1:]))

    def init(self, seed: int) -> np.ndarray:
        """Uniform within 1/sqrt(inputs), weights and offsets alike."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(self.sizes, self.sizes[1:]):
            bound = 1 / np.sqrt(a)
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return np.concatenate(parts)

    def layers(self, params: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((params[at:at + a * b].reshape(a, b), params[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def outputs(self, params: np.ndarray, x: np.ndarray, upto: int | None = None) -> list[np.ndarray]:
        """Activations of every layer; the last one is linear."""
        layers, acts = self.layers(params)[:upto], [x]
        for i, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if i + 1 < len(self.sizes) - 1 and i + 1 < len(layers) else z)
        return acts

    def predict(self, params: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = self.outputs(params, x)[-1]
        if self.head == "mse":
            return out[:, 0], np.zeros(len(x))
        return out[:, 0], np.logaddexp(0, out[:, 1]) + VAR_FLOOR

    def loss_and_gradient(self, params: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
        """Sums over the rows given."""
        acts = self.outputs(params, x)
        out = acts[-1]
        d = np.zeros_like(out)
        err = out[:, 0] - y
        if self.head == "mse":
            loss = float((err ** 2).sum())
            d[:, 0] = 2 * err
        else:
            var = np.logaddexp(0, out[:, 1]) + VAR_FLOOR
            loss = float(0.5 * (np.log(var) + err ** 2 / var).sum())
            d[:, 0] = err / var
            d[:, 1] = 0.5 * (1 / var - err ** 2 / var ** 2) * 0.5 * (1 + np.tanh(out[:, 1] / 2))
        grads: list[np.ndarray] = []
        layers = self.layers(params)
        for i in range(len(layers) - 1, -1, -1):
            grads[:0] = [(acts[i].T @ d).ravel(), d.sum(0)]
            if i:
                d = (d @ layers[i][0].T) * (acts[i] > 0)
        return loss, np.concatenate(grads)

    def losses_and_gradients(self, params: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``loss_and_gradient`` for (members, parameters), (members, rows, features) and (members, rows) in the same array operations."""
        layers, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            layers.append((params[:, at:at + a * b].reshape(len(params), a, b), params[:, None, at + a * b:at + a * b + b]))
            at += a * b + b
        acts = [x]
        for i, (w, b) in enumerate(layers):
            z = acts[-1] @ w + b
            acts.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
        out = acts[-1]
        d = np.zeros_like(out)
        err = out[..., 0] - y
        if self.head == "mse":
            loss = (err ** 2).sum(-1)
            d[..., 0] = 2 * err
        else:
            var = np.logaddexp(0, out[..., 1]) + VAR_FLOOR
            loss = 0.5 * (np.log(var) + err ** 2 / var).sum(-1)
            d[..., 0] = err / var
            d[..., 1] = 0.5 * (1 / var - err ** 2 / var ** 2) * 0.5 * (1 + np.tanh(out[..., 1] / 2))
        grads = np.empty_like(params)
        for i in range(len(layers) - 1, -1, -1):
            a, b = self.sizes[i], self.sizes[i + 1]
            at -= a * b + b
            grads[:, at:at + a * b] = (acts[i].transpose(0, 2, 1) @ d).reshape(len(params), -1)
            grads[:, at + a * b:at + a * b + b] = d.sum(1)
            if i:
                d = (d @ layers[i][0].transpose(0, 2, 1)) * (acts[i] > 0)
        return loss, grads


def adamw(w: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, t: int, lr: float, decay: float) -> None:
    """One step in place (Loshchilov and Hutter, 2019)."""
    w *= 1 - lr * decay
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    w -= lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)


@dataclass
class Stopper:
    """The early stopping rule for a running fit; keeps the best parameters."""

    patience: int
    delta: float = 0.0
    best: float | None = None
    params: np.ndarray | None = None
    bad: int = 0

    def update(self, loss: float, params: np.ndarray) -> bool:
        if self.best is None or -loss >= -self.best + self.delta:
            self.best, self.params, self.bad = loss, params.copy(), 0
        else:
            self.bad += 1
        return self.bad >= self.patience


@dataclass
class Fitted:
    """Parameters of all members, and what the fit reported."""

    net: Net
    members: np.ndarray
    losses: list[list[float]]
    seconds: float

    def predict(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        """Mean and variance of the equal-weight mixture of members, row by row."""
        bc, net = df.sparkSession.sparkContext.broadcast(self.members), self.net

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            means, variances = map(np.stack, zip(*[net.predict(p, x) for p in bc.value]))
            mean = means.mean(0)
            return {"pred_mean": mean, "pred_var": (variances + means ** 2).mean(0) - mean ** 2}

        return append_columns(df, features, keep, compute, "pred_mean double, pred_var double")

    def components(self, df: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
        """One row per member: the long form the mixture operators take."""
        bc, net = df.sparkSession.sparkContext.broadcast(self.members), self.net

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            means, variances = map(np.stack, zip(*[net.predict(p, x) for p in bc.value]))
            return {"means": means.T, "vars": variances.T}

        wide = append_columns(df, features, keep, compute, "means array<double>, vars array<double>")
        return wide.select(*keep, F.posexplode(F.arrays_zip("means", "vars")).alias("component", "_c")).select(
            *keep, "component", F.col("_c.means").alias("mean"), F.col("_c.vars").alias("var"))

    def transform(self, df: DataFrame, keep: Sequence[str], features: str = "features", out: str = "features") -> DataFrame:
        """Outputs of the last layer before the head (a feature extractor)."""
        bc, net = df.sparkSession.sparkContext.broadcast(self.members), self.net

        def compute(x: np.ndarray) -> dict[str, np.ndarray]:
            return {out: net.outputs(bc.value[0], x, upto=len(net.sizes) - 2)[-1]}

        return append_columns(df, features, keep, compute, f"`{out}` array<double>")


def _average_pass(df, net, states, active, lr, decay, batch_size, epoch, steps, seed, features, target):
    """Every task steps through its rows; returns row-weighted sums of states."""
    size = net.n_params
    bc = df.sparkSession.sparkContext.broadcast(states)
    width = 3 * size + 2  # weights, two moments, loss of batches, number of batches

    def task(stream):
        local, rows, steps_done = bc.value, 0, 0
        stats = np.zeros((len(local), 2))
        part = TaskContext.get().partitionId()
        w, m, v = (local[:, at:at + size].copy() for at in (0, size, 2 * size))
        for i, (x, y) in enumerate(batches_of(stream, features, target)):
            rows += len(x)
            order = np.stack([np.random.default_rng((seed, epoch, part, i, member)).permutation(len(x)) for member in active])
            for k, s in enumerate(range(0, len(x), batch_size)):
                pick = order[:, s:s + batch_size]
                loss, g = net.losses_and_gradients(w, x[pick], y[pick])
                stats += np.stack([loss / pick.shape[1], np.ones(len(loss))], axis=1)
                adamw(w, g / pick.shape[1], m, v, steps + steps_done + k + 1, lr, decay)
            steps_done += -(-len(x) // batch_size)
        if not rows:
            return None
        sums = np.concatenate([w * rows, m * rows, v * rows, stats], axis=1).ravel()
        return np.append(sums, [rows, steps_done, 1])

    total = sum_over_rows(df, [features, target], task, len(active) * width + 3, bc)
    rows, done, tasks = total[-3:]
    body = total[:-3].reshape(len(active), width)
    return body[:, :-2] / rows, body[:, -2] / body[:, -1], max(1, round(done / tasks))


def _steps_pass(df, net, states, active, lr, decay, batch_size, epoch, steps, seed, features, target, key, shards):
    """One epoch of synchronous steps; a task streams its rows in the order of their batches.

    Tasks that share batches take the same steps with the same summed gradients, so each ends
    with the same weights. Tasks that own batches take their steps in turn, each from the
    weights that the one before sent. The last of the stage's tasks returns them.
    """
    import pyarrow as pa

    n_batches = max(1, -(-df.count() // batch_size))
    size = net.n_params
    if shards * len(active) * (size + 1) * 11 > MAX_EXCHANGE or len(active) * (3 * size + 2) * 11 > MAX_EXCHANGE:
        raise ValueError("the gradients of all tasks are too large to exchange at every step")
    drawn = F.pmod(F.xxhash64(*key, F.lit(seed), F.lit(epoch)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    dealt = df.select(features, target, F.floor(drawn * n_batches).cast("int").alias("_batch"))
    shared_batches = batch_size >= SHARED_BATCH
    if shared_batches:
        dealt = dealt.repartition(shards)
    else:  # consecutive batches to each task
        dealt = dealt.repartitionById(shards, F.floor(F.col("_batch") * F.lit(shards) / F.lit(n_batches)).cast("int"))
    dealt = dealt.sortWithinPartitions("_batch")
    shared = df.sparkSession.sparkContext.broadcast(states)

    def task(stream):
        context = BarrierTaskContext.get()
        local = shared.value.copy()
        losses, taken, at = np.zeros(len(local)), 0, 0
        sums = np.zeros((len(local), size + 1))
        rows = 0

        def told(numbers):
            return [np.frombuffer(base64.b64decode(x)) for x in context.allGather(base64.b64encode(numbers.tobytes()).decode())]

        def step():
            nonlocal taken, rows
            own = np.append(sums.ravel(), rows)
            total = sum(told(own)) if shared_batches else own
            n, body = total[-1], total[:-1].reshape(sums.shape)
            if n:
                taken += 1
                for j in range(len(local)):
                    w, m, v = local[j, :size], local[j, size:2 * size], local[j, 2 * size:]
                    adamw(w, body[j, :size] / n, m, v, steps + taken, lr, decay)
                losses[:] += body[:, size] / n
            sums[:] = 0
            rows = 0

        part, n_tasks = context.partitionId(), len(context.getTaskInfos())
        turns = 1 if shared_batches else n_tasks
        for turn in range(turns):
            if shared_batches or turn == part:
                for batch in stream:
                    if not batch.num_rows:
                        continue
                    x, y = matrix(batch.column(features)), batch.column(target).to_numpy(zero_copy_only=False)
                    number = batch.column("_batch").to_numpy()
                    for b in np.unique(number):
                        while at < b:
                            step()
                            at += 1
                        own = number == b
                        rows += int(own.sum())
                        for j in range(len(local)):
                            loss, g = net.loss_and_gradient(local[j, :size], x[own], y[own])
                            sums[j] += np.append(g, loss)
                while at < n_batches:  # a step without rows changes nothing
                    step()
                    at += 1
            if turn + 1 < turns:
                given = told(np.concatenate([local.ravel(), losses, [taken]]) if turn == part else np.zeros(0))[turn]
                local[:], losses[:], taken = given[:local.size].reshape(local.shape), given[local.size:-1], int(given[-1])
        if part == n_tasks - 1:
            yield pa.RecordBatch.from_pydict({
                "state": pa.array([one.tobytes() for one in local], pa.binary()),
                "loss": pa.array(losses / max(1, taken)), "steps": pa.array([taken] * len(local), pa.int64())})

    ship_package(df.sparkSession)
    got = dealt.mapInArrow(task, "state binary, loss double, steps long", barrier=True).collect()
    shared.destroy()
    return np.stack([np.frombuffer(r.state) for r in got]), np.array([r.loss for r in got]), int(got[0].steps)


def _gradient_pass(df, net, states, active, features, target):
    size = net.n_params
    bc = df.sparkSession.sparkContext.broadcast(states[:, :size].copy())

    def task(stream):
        total = np.zeros((len(active), size + 1))
        rows = 0
        for x, y in batches_of(stream, features, target):
            rows += len(x)
            for j in range(len(active)):
                loss, g = net.loss_and_gradient(bc.value[j], x, y)
                total[j, :size] += g
                total[j, size] += loss
        return np.append(total.ravel(), rows) if rows else None

    total = sum_over_rows(df, [features, target], task, len(active) * (size + 1) + 1, bc)
    body = total[:-1].reshape(len(active), size + 1) / total[-1]
    return body[:, :size], body[:, size]


def _validation_scores(df, net, members, features, target) -> np.ndarray:
    """Mean squared error of each member, in one pass."""
    bc = df.sparkSession.sparkContext.broadcast(members)

    def task(stream):
        total = np.zeros(len(bc.value) + 1)
        for x, y in batches_of(stream, features, target):
            total[-1] += len(x)
            total[:-1] += [((net.predict(p, x)[0] - y) ** 2).sum() for p in bc.value]
        return total

    total = sum_over_rows(df, [features, target], task, len(members) + 1, bc)
    return total[:-1] / total[-1]


def fit(
    train: DataFrame, net: Net, n_members: int = 1, lr: float = 1e-3, epochs: int = 50, batch_size: int = 512,
    patience: int | None = 10, delta: float = 0.0, decay: float = 0.01, seed: int = 73, sync: str = "average",
    validation: DataFrame | None = None, features: str = "features", target: str = "y",
    start: np.ndarray | None = None, key: Sequence[str] | None = None, shards: int | None = None,
) -> Fitted:
    """Train ``n_members`` independently seeded networks on the same passes.

    Each member stops by itself: on its validation error if there is a
    validation table, else on its training loss; its best parameters are kept.
    ``train`` should be a written or cached table, as each epoch reads it.
    ``batch_size`` counts the rows all tasks together take in one step.
    Synchronous steps need the rows' ``key``; an exchange takes Spark about a
    second, so only batches of ``SHARED_BATCH`` rows or more are shared by tasks. They take ``shards`` tasks at once,
    by default as many as there are cores; with fewer free slots Spark ends the job with an error.
    """
    began = time.time()
    if sync not in ("average", "gradient", "steps") or sync == "steps" and not key:
        raise ValueError("sync is average, gradient, or steps with a key")
    shards = shards or train.sparkSession.sparkContext.defaultParallelism
    local_batch = max(SMALLEST_BATCH, -(-batch_size // max(1, train.rdd.getNumPartitions())))
    size = net.n_params
    weights = np.stack([net.init(seed + i) for i in range(n_members)]) if start is None else start.copy()
    states = np.concatenate([weights, np.zeros((n_members, 2 * size))], axis=1)
    stoppers = [Stopper(patience or epochs + 1, delta) for _ in range(n_members)]
    losses: list[list[float]] = [[] for _ in range(n_members)]
    active, steps = list(range(n_members)), 0
    for epoch in range(epochs):
        if not active:
            break
        if sync == "average":
            new, loss, done = _average_pass(train, net, states[active], active, lr, decay, local_batch, epoch, steps, seed, features, target)
            states[active] = new
            steps += done
        elif sync == "steps":
            new, loss, done = _steps_pass(
                train, net, states[active], active, lr, decay, batch_size, epoch, steps, seed, features, target, key, shards)
            states[active] = new
            steps += done
        else:
            grad, loss = _gradient_pass(train, net, states[active], active, features, target)
            steps += 1
            for j, member in enumerate(active):
                s = states[member]
                adamw(s[:size], grad[j], s[size:2 * size], s[2 * size:], steps, lr, decay)
        if validation is not None:
            loss = _validation_scores(validation, net, states[active, :size], features, target)
        still = []
        for member, value in zip(active, loss):
            losses[member].append(float(value))
            if np.isnan(value):  # ends the member; its best parameters stay
                continue
            if not stoppers[member].update(float(value), states[member, :size]):
                still.append(member)
        active = still
    best = np.stack([s.params if s.params is not None else states[i, :size] for i, s in enumerate(stoppers)])
    return Fitted(net, best, losses, time.time() - began)


@dataclass
class Learner:
    """One network of a search: its state (weights and two moments), and the fold it leaves out."""

    net: Net
    state: np.ndarray
    lr: float
    batch_size: int
    fold: int
    seed: int
    steps: int = 0

    @classmethod
    def fresh(cls, net: Net, lr: float, batch_size: int, fold: int, seed: int) -> Learner:
        return cls(net, np.concatenate([net.init(seed), np.zeros(2 * net.n_params)]), lr, batch_size, fold, seed)

    @property
    def weights(self) -> np.ndarray:
        return self.state[:self.net.n_params]


def epoch_of(df: DataFrame, learners: Sequence[Learner], epoch: int | Sequence[int], decay: float = 0.01, features: str = "features",
             target: str = "t", fold: str = "fold") -> list[float]:
    """Train learners of any shapes for one epoch in one pass; gives the mean batch loss of each.

    A learner sees the rows of all folds but its own; tasks step through their
    rows and the results are averaged by rows, as in ``fit``.
    """
    tasks = max(1, df.rdd.getNumPartitions())
    epochs = [epoch] * len(learners) if isinstance(epoch, int) else list(epoch)
    ends = np.cumsum([len(one.state) + 5 for one in learners])
    shared = df.sparkSession.sparkContext.broadcast(list(zip(learners, epochs)))

    def task(stream):
        out, seen = np.zeros(ends[-1]), False
        part = TaskContext.get().partitionId()
        local = [(one, e, one.state.copy(), np.zeros(5)) for one, e in shared.value]  # loss, batches, rows, steps, tasks
        for i, batch in enumerate(stream):
            if not batch.num_rows:
                continue
            seen = True
            x, y = matrix(batch.column(features)), batch.column(target).to_numpy(zero_copy_only=False)
            folds = batch.column(fold).to_numpy(zero_copy_only=False)
            for one, e, state, stats in local:
                rows = np.flatnonzero(folds != one.fold)
                order = rows[np.random.default_rng((one.seed, e, part, i)).permutation(len(rows))]
                size = one.net.n_params
                w, m, v = state[:size], state[size:2 * size], state[2 * size:]
                width = max(SMALLEST_BATCH, -(-one.batch_size // tasks))
                for k in range(0, len(order), width):
                    pick = order[k:k + width]
                    loss, g = one.net.loss_and_gradient(w, x[pick], y[pick])
                    stats[3] += 1
                    adamw(w, g / len(pick), m, v, one.steps + int(stats[3]), one.lr, decay)
                    stats[:2] += loss / len(pick), 1
                stats[2] += len(rows)
        for end, (one, _, state, stats) in zip(ends, local):
            stats[4] = stats[2] > 0
            out[end - len(state) - 5:end] = np.concatenate([state * stats[2], stats])
        return out if seen else None

    total = sum_over_rows(df, [features, target, fold], task, int(ends[-1]), shared)
    losses = []
    for end, one in zip(ends, learners):
        loss, batches, rows, steps, n = total[end - 5:end]
        if rows:
            one.state = total[end - 5 - len(one.state):end - 5] / rows
            one.steps += max(1, round(steps / n))
        losses.append(float(loss / batches) if batches else float("nan"))
    return losses


def fold_errors(df: DataFrame, ensembles: Sequence[Sequence[Learner]], features: str = "features", target: str = "t", fold: str = "fold") -> list[float]:
    """For each ensemble (members that leave out the same fold) the squared error of its mean on that fold, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast([[(one.net, one.weights, one.fold) for one in e] for e in ensembles])

    def task(stream):
        out = np.zeros((len(shared.value), 2))
        for batch in stream:
            if batch.num_rows:
                x, y = matrix(batch.column(features)), batch.column(target).to_numpy(zero_copy_only=False)
                folds = batch.column(fold).to_numpy(zero_copy_only=False)
                for at, members in enumerate(shared.value):
                    rows = folds == members[0][2]
                    mean = sum(n.predict(w, x[rows])[0] for n, w, _ in members) / len(members)
                    out[at] += ((mean - y[rows]) ** 2).sum(), rows.sum()
        return out.ravel()

    total = sum_over_rows(df, [features, target, fold], task, 2 * len(ensembles), shared).reshape(-1, 2)
    return [float(s / n) if n else float("nan") for s, n in total]


def mean_variance_net(n_in: int, n_max: int, n_layers: int) -> Net:
    return Net(tuple(layer_widths(n_in, n_max, n_layers, 2)))


def pretrain_epochs(rows: int) -> int:
    for limit, epochs in PRETRAIN_EPOCHS:
        if rows < limit:
            return epochs
    return PRETRAIN_LAST


def pretrain_extractor(
    train: DataFrame, n_in: int, n_max: int, n_layers: int, n_out: int, lr: float = 1e-3, batch_size: int = 2048,
    epochs: int | None = None, seed: int = 73, features: str = "features", target: str = "y",
) -> Fitted:
    """Feature extractor trained with a ReLU and one linear output on top.

    ``transform`` gives the features; the output on top is not part of them.
    """
    net = Net((*layer_widths(n_in, n_max, n_layers, n_out), 1), head="mse")
    epochs = epochs or pretrain_epochs(train.count())
    return fit(train, net, 1, lr, epochs, batch_size, patience=None, decay=0.0, seed=seed, features=features, target=target)
