"""Linear models of many labels at once: one weight matrix, one pass over the rows an iteration for all labels.

Rows are stored once as blocks (compressed rows and their labels); a pass reads the blocks, meets the
broadcast weights of the labels that still move, and hands back sums. Partial sums of a task are added up by a
tree of tasks, in pieces of bounded size. What the driver holds grows with labels x features, never with rows.

logreg and linear_svc minimise 0.5 |w|^2 + C sum(loss), with the log loss and the squared hinge, the
bias being a feature of value one, by L-BFGS with a step of its own for every label. sgd is stochastic descent on
the log loss, a row at a time: tasks go through their rows from shared weights and the results are averaged by rows
after each epoch; rows that fit one task make it the plain sequential method.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep

#: Rows and stored values of a block at most (one row at least).
BLOCK_ROWS, BLOCK_VALUES = 4096, 1 << 20
#: Rows that are scored together.
SCORED = 512
#: Partial results that are added up by one task, the numbers in a piece of one, and those that come to the driver at a
#: time (or one result, if that is larger).
FAN, PIECE, DRIVER = 32, 1 << 17, 1 << 23
FEATURES = "struct<size:int,indices:array<int>,values:array<double>>"


@dataclass
class Block:
    """Rows of a block: dense, or by start, column (an index into ``columns``) and value."""

    x: np.ndarray | None
    start: np.ndarray
    at: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    y: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.y)

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Rows x labels, for weights labels x (features + 1), the bias last."""
        if self.x is not None:
            return self.x @ w[:, :-1].T + w[:, -1]
        row, out = self.row(), np.empty((len(self), len(w)))
        for k in range(len(w)):
            out[:, k] = np.bincount(row, weights=self.values * w[k, self.columns][self.at], minlength=len(self)) + w[k, -1]
        return out

    def row(self) -> np.ndarray:
        """The row of every stored value."""
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def add_gradient(self, into: np.ndarray, r: np.ndarray) -> None:
        """Adds r.T @ rows to labels x (features + 1)."""
        into[:, -1] += r.sum(axis=0)
        if self.x is not None:
            into[:, :-1] += r.T @ self.x
            return
        row = self.row()
        for k in range(r.shape[1]):
            into[k, self.columns] += np.bincount(self.at, weights=self.values * r[row, k], minlength=len(self.columns))


def _block(row: dict, labels: int) -> Block:
    n = row["n"]
    y = np.unpackbits(np.frombuffer(row["y"], dtype=np.uint8), count=n * labels).reshape(n, labels)
    values, weight = np.frombuffer(row["data"], dtype="<f8"), np.frombuffer(row["weight"], dtype="<f8")
    if row["columns"] is None:
        none = np.zeros(0, dtype=np.int64)
        return Block(values.reshape(n, -1), none, none, none, values, y, weight)
    start, at, columns = (np.frombuffer(row[c], dtype="<i4").astype(np.int64) for c in ("start", "at", "columns"))
    return Block(None, start, at, columns, values, y, weight)


def each(batches) -> Iterator[dict]:
    """Rows of Arrow batches as dicts, one at a time: blocks are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


BLOCKS = "n int, start binary, at binary, columns binary, data binary, y binary, weight binary"


def _schema(kind: str):
    import pyarrow as pa

    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    return pa.schema([(n, types[t]) for n, t in (x.split(" ") for x in kind.split(", "))])


def _rows_to_block(rows: list[tuple], width: int, labels: int) -> dict:
    y = np.zeros((len(rows), labels), dtype=np.uint8)
    for i, r in enumerate(rows):
        y[i, r[2]] = 1
    out = {"n": len(rows), "y": np.packbits(y).tobytes(), "weight": np.array([r[3] for r in rows], dtype="<f8").tobytes()}
    if all(r[0] is None for r in rows):
        x = np.zeros((len(rows), width))
        for i, r in enumerate(rows):
            x[i, : len(r[1])] = r[1]
        return out | {"start": None, "at": None, "columns": None, "data": x.astype("<f8").tobytes()}
    indices = [np.arange(len(r[1]), dtype=np.int64) if r[0] is None else np.asarray(r[0], dtype=np.int64) for r in rows]
    start = np.r_[0, np.cumsum([len(i) for i in indices])]
    columns, at = np.unique(np.concatenate(indices), return_inverse=True)
    data = np.concatenate([np.asarray(r[1], dtype=np.float64) for r in rows])
    return out | {"start": start.astype("<i4").tobytes(), "at": at.astype("<i4").tobytes(), "columns": columns.astype("<i4").tobytes(), "data": data.astype("<f8").tobytes()}


@dataclass
class Data:
    """Stored blocks of training rows, the labels' names, the features' number, rows and positives by label."""

    blocks: DataFrame
    labels: list[str]
    width: int
    n: int
    positives: np.ndarray

    def close(self) -> None:
        self.blocks.unpersist()


def training_data(features: DataFrame, truth: DataFrame, key: str = "handle", weight: str | None = None) -> Data:
    """Blocks of (key, features) with the labels of (key, label, y); items without a row in either are left out.

    features is FEATURES; null indices are a dense row. ``weight`` names a column of ``features`` that weighs rows."""
    spark = features.sparkSession
    names = [r.label for r in truth.select("label").distinct().orderBy("label").collect()]  # labels are few
    place = F.array_position(F.lit(names).cast("array<string>"), F.col("label")) - 1
    y = truth.groupBy(key).agg(F.collect_list(F.when(F.col("y") == 1, place).cast("int")).alias("on"))  # a row's labels
    rows = features.select(key, "features", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight")).join(y, key)
    rows = rows.select(F.col("features.size").alias("size"), F.col("features.indices").alias("indices"), F.col("features.values").alias("values"), "on", "weight")
    width = features.agg(F.max("features.size")).first()[0] or 0
    n_labels = len(names)

    def run(batches):
        import pyarrow as pa

        schema, held, size = _schema(BLOCKS), [], 0
        yield pa.RecordBatch.from_pylist([], schema=schema)
        for batch in batches:
            for indices, values, on, w in zip(*(batch.column(c).to_pylist() for c in ("indices", "values", "on", "weight"))):
                held.append((indices, values, on, w))
                size += len(values)
                if len(held) == BLOCK_ROWS or size >= BLOCK_VALUES:
                    yield pa.RecordBatch.from_pylist([_rows_to_block(held, width, n_labels)], schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist([_rows_to_block(held, width, n_labels)], schema=schema)

    # Stored, and held by the executors as far as they have room: every pass reads them.
    blocks = keep(rows.drop("size").mapInArrow(run, BLOCKS), "training-blocks").persist()
    counts = {r.label: r.pos for r in truth.where("y = 1").join(features.select(key), key).groupBy("label").agg(F.count("*").alias("pos")).collect()}
    n = blocks.agg(F.sum("n")).first()[0] or 0
    return Data(blocks, names, width, n, np.array([counts.get(x, 0) for x in names], dtype=np.float64))


SUMS = "piece int, task int, data binary"


def _pieces(v: np.ndarray, task: int) -> Iterator[dict]:
    for p in range(0, max(1, len(v)), PIECE):
        yield {"piece": p // PIECE, "task": task, "data": v[p : p + PIECE].astype("<f8").tobytes()}


def _added(batches) -> Iterator[dict]:
    """Adds up pieces that come in order of (piece, task), one at a time."""
    at, total = None, None
    for r in each(batches):
        v = np.frombuffer(r["data"], dtype="<f8")
        if at == (r["piece"], r["task"]):
            total = total + v
            continue
        if at is not None:
            yield {"piece": at[0], "task": at[1], "data": total.tobytes()}
        at, total = (r["piece"], r["task"]), v
    if at is not None:
        yield {"piece": at[0], "task": at[1], "data": total.tobytes()}


def _to_arrow(f, kind: str):
    def run(batches):
        import pyarrow as pa

        schema = _schema(kind)
        yield pa.RecordBatch.from_pylist([], schema=schema)
        for r in f(batches):
            yield pa.RecordBatch.from_pylist([r], schema=schema)

    return run


def tree_sum(data: DataFrame, f: Callable[[Iterator[dict]], np.ndarray], size: int, fan: int = FAN) -> np.ndarray:
    """The sum over tasks of ``f`` (a task's rows, as dicts, to a vector of ``size`` numbers).

    While more tasks hold a partial result than the driver may take in, groups of ``fan`` are added up by tasks; each
    of these holds one piece. An empty task adds nothing."""
    from pyspark import TaskContext

    def first(batches):
        v = f(each(batches))
        if v is not None:
            yield from _pieces(v, TaskContext.get().partitionId())

    parts, tasks = data.mapInArrow(_to_arrow(first, SUMS), SUMS), data.rdd.getNumPartitions()
    taken = max(1, min(fan, DRIVER // max(1, size)))
    while tasks > taken:
        tasks = -(-tasks // fan)
        dealt = parts.withColumn("task", (F.col("task") / fan).cast("int")).repartition("piece", "task").sortWithinPartitions("piece", "task")
        parts = dealt.mapInArrow(_to_arrow(_added, SUMS), SUMS)
    out = np.zeros(size)
    held = parts.select("piece", "data").toArrow()  # DRIVER numbers, or one result
    for piece, v in zip(held.column("piece").to_pylist(), held.column("data")):
        v = np.frombuffer(v.as_buffer(), dtype="<f8")
        out[piece * PIECE : piece * PIECE + len(v)] += v
    return out


def log_loss(z: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss and derivative by score, for signs -1 and 1."""
    m = z * sign
    return np.logaddexp(0, -m), -sign * np.exp(-np.logaddexp(0, m))


def squared_hinge(z: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = np.maximum(0, 1 - z * sign)
    return gap * gap, -2 * sign * gap


LOSSES = {"logreg": log_loss, "linear_svc": squared_hinge}


def losses_and_gradients(data: Data, w: np.ndarray, which: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all rows for the labels ``which``: losses, and gradients labels x (features + 1). One pass."""
    shared = data.blocks.sparkSession.sparkContext.broadcast((w, which))  # labels x features
    labels, size = len(data.labels), len(which) * (data.width + 2)

    def run(rows):
        w, which = shared.value
        total, seen = np.zeros((len(which), data_width + 2)), False
        for row in rows:
            b, seen = _block(row, labels), True
            value, slope = LOSSES[loss](b.scores(w), 2.0 * b.y[:, which] - 1)
            total[:, -1] += (value * b.weight[:, None]).sum(axis=0)
            b.add_gradient(total[:, :-1], slope * b.weight[:, None])
        return total.ravel() if seen else None

    data_width = data.width
    out = tree_sum(data.blocks, run, size).reshape(len(which), data.width + 2)
    shared.destroy()
    return out[:, -1], out[:, :-1]


def column_squares(data: Data) -> np.ndarray:
    """Sums of the features' squares over all rows, the bias last. One pass."""
    width = data.width

    def run(rows):
        total, seen = np.zeros(width + 1), False
        for row in rows:
            b, seen = _block(row, len(labels)), True
            if b.x is not None:
                total[:-1] += (np.square(b.x) * b.weight[:, None]).sum(axis=0)
            else:
                total[b.columns] += np.bincount(b.at, weights=np.square(b.values) * b.weight[b.row()], minlength=len(b.columns))
            total[-1] += b.weight.sum()
        return total if seen else None

    labels = data.labels
    return tree_sum(data.blocks, run, width + 1)


@dataclass
class Fit:
    """Weights labels x (features + 1), the bias last; iterations and whether each label met its tolerance; passes over the rows."""

    weights: np.ndarray
    iterations: np.ndarray
    converged: np.ndarray
    passes: int


def minimise(data: Data, loss: str, c: float = 1.0, tol: float = 1e-4, max_iter: int = 1000, history: int = 6) -> Fit:
    """0.5 |w|^2 + C sum(loss) for every label by L-BFGS.

    A label stops when its gradient's norm has fallen to tol x max(1, rarer class) / rows of the first one; it leaves the
    passes then. The driver holds some 2 x ``history`` matrices of labels x features."""
    n_labels, d = len(data.labels), data.width + 1
    w = np.zeros((n_labels, d))
    everyone = np.arange(n_labels)

    def value(w, which):
        f, g = losses_and_gradients(data, w, which, loss)
        return c * f + 0.5 * np.square(w).sum(axis=1), c * g + w

    # Features differ much in scale: the first guess of the curvature is its diagonal where all scores are zero.
    first = 1 / (1 + c * (0.25 if loss == "logreg" else 2.0) * column_squares(data))
    f, g = value(w, everyone)
    passes = 2
    rare = np.maximum(1, np.minimum(data.positives, data.n - data.positives)) / max(1, data.n)
    enough = tol * rare * np.linalg.norm(g, axis=1)
    steps, iterations = [], np.zeros(n_labels, dtype=np.int64)  # pairs of steps and changes of gradients, oldest first
    active = np.linalg.norm(g, axis=1) > enough
    stuck = np.zeros(n_labels, dtype=bool)
    while active.any() and iterations.max() < max_iter:
        direction, alphas = g.copy(), []
        for s, y, rho in reversed(steps):
            a = rho * np.einsum("ij,ij->i", s, direction)
            direction -= a[:, None] * y
            alphas.append(a)
        direction *= first
        if steps:
            s, y, rho = steps[-1]
            direction *= np.divide(1, rho * (np.square(y) * first).sum(axis=1), where=rho > 0, out=np.ones(n_labels))[:, None]
        for (s, y, rho), a in zip(steps, reversed(alphas)):
            direction += (a - rho * np.einsum("ij,ij->i", y, direction))[:, None] * s
        direction = -direction
        slope = np.einsum("ij,ij->i", g, direction)
        uphill = slope >= 0
        direction[uphill], slope[uphill] = -g[uphill], -np.square(g[uphill]).sum(axis=1)
        t, waiting = np.ones(n_labels), active.copy()
        new_w, new_f, new_g = w.copy(), f.copy(), g.copy()
        for _ in range(30):
            which = everyone[waiting]
            trial = w[which] + t[which, None] * direction[which]
            tf, tg = value(trial, which)
            passes += 1
            good = tf <= f[which] + 1e-4 * t[which] * slope[which] + 1e-12 * np.abs(f[which])
            took = which[good]
            new_w[took], new_f[took], new_g[took] = trial[good], tf[good], tg[good]
            waiting[took] = False
            t[waiting] *= 0.4
            if not waiting.any():
                break
        stuck |= waiting  # rounding leaves no descent
        s, y = new_w - w, new_g - g
        curve = np.einsum("ij,ij->i", s, y)
        rho = np.divide(1, curve, where=curve > 0, out=np.zeros(n_labels))  # zero for labels that didn't move
        steps = [*steps[-(history - 1) :], (s, y, rho)]
        iterations[active] += 1
        w, f, g = new_w, new_f, new_g
        active &= (np.linalg.norm(g, axis=1) > enough) & ~stuck
    return Fit(w, iterations, np.linalg.norm(g, axis=1) <= enough, passes)


def descend(data: Data, alpha: float = 1e-4, tol: float = 1e-3, max_iter: int = 1000, patience: int = 5) -> Fit:
    """Stochastic descent on the log loss with an L2 penalty of ``alpha`` and the rate 1 / (alpha (t0 + t)).

    An epoch is one pass for all labels. A label stops when its mean loss hasn't fallen by ``tol`` below its best for ``patience`` epochs."""
    n_labels, d = len(data.labels), data.width + 1
    w = np.zeros((n_labels, d))
    rate0 = np.sqrt(1.0 / np.sqrt(alpha))
    rate0 = rate0 / max(1.0, 1.0 / (1.0 + np.exp(-rate0)))
    t0 = 1.0 / (rate0 * alpha)
    best, waited = np.full(n_labels, np.inf), np.zeros(n_labels, dtype=np.int64)
    iterations, active, t, passes = np.zeros(n_labels, dtype=np.int64), np.ones(n_labels, dtype=bool), 0, 0
    labels, width = n_labels, data.width
    while active.any() and passes < max_iter and data.n:
        which = np.flatnonzero(active)
        shared = data.blocks.sparkSession.sparkContext.broadcast((w[which], which, t))

        def run(rows):
            w, which, t = shared.value
            w, bias, scale, n, lost = w[:, :-1].T.copy(), w[:, -1].copy(), 1.0, 0, np.zeros(len(which))
            for row in rows:
                b = _block(row, labels)
                sign = 2.0 * b.y[:, which] - 1
                for i in range(len(b)):
                    rate = 1.0 / (alpha * (t0 + t + n))
                    if b.x is not None:
                        at, v = slice(None), b.x[i]
                    else:
                        at, v = b.columns[b.at[b.start[i] : b.start[i + 1]]], b.values[b.start[i] : b.start[i + 1]]
                    z = scale * (v @ w[at]) + bias
                    loss, slope = log_loss(z, sign[i])
                    lost += loss * b.weight[i]
                    slope = slope * b.weight[i]
                    scale *= max(0.0, 1.0 - rate * alpha)
                    if scale < 1e-9:
                        w *= scale
                        scale = 1.0
                    w[at] -= (rate / scale) * np.outer(v, slope)
                    bias -= rate * slope
                    n += 1
            if not n:
                return None
            return np.r_[(np.c_[scale * w.T, bias] * n).ravel(), lost, n]

        size = len(which) * (width + 2) + 1
        out = tree_sum(data.blocks, run, size)
        shared.destroy()
        passes += 1
        w[which] = out[: len(which) * d].reshape(len(which), d) / out[-1]
        lost = out[len(which) * d : -1] / out[-1]
        t += int(out[-1])
        iterations[which] += 1
        better = lost < best[which] - tol
        waited[which] = np.where(better, 0, waited[which] + 1)
        best[which] = np.minimum(best[which], lost)
        active[which] = waited[which] < patience
    return Fit(w, iterations, ~active, passes)


def score_rows(features: DataFrame, weights: np.ndarray, labels: list[str], probabilities: bool, key: str = "handle") -> DataFrame:
    """key, label, score of every row and label, in one pass; features beyond those of the fit are an error."""
    import pyarrow as pa

    shared = features.sparkSession.sparkContext.broadcast(weights)
    kind = features.schema[key].dataType.simpleString()
    names = pa.array(labels, pa.string())

    def run(batches):
        w = shared.value
        for batch in batches if labels else ():
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("indices", "values"))))
            for s in range(0, len(rows), SCORED):
                part = rows[s : s + SCORED]
                b = _block(_rows_to_block([(i, v, [], 1.0) for i, v in part], w.shape[1] - 1, 1), 1)
                z = b.scores(w).ravel()
                z = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if probabilities else z
                at = np.repeat(np.arange(s, s + len(part)), len(labels))
                told = pa.array(np.tile(np.arange(len(labels)), len(part)))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), names.take(told), pa.array(z)], names=[key, "label", "score"])

    rows = features.select(key, F.col("features.indices").alias("indices"), F.col("features.values").alias("values"))
    return rows.mapInArrow(run, f"{key} {kind}, label string, score double")
