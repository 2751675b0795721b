"""A trainable head over chunk vectors: AdamW on weighted binary cross entropy, gradients summed by a tree of tasks.

Chunks of an epoch are dealt to batches by hash, and each batch is stored as one block under its step, so a step
reads its own files only: one pass over a step's batches gives the accumulated gradient. After every epoch the
calibration items choose thresholds and the validation items give the F1 that stops the training and picks the epoch. The
state (weights, moments, place in the epoch, history) is a table beside the run's others, bound to its split.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks
from ..sources.scratch import scratch_dir
from . import dense, linear, scores


@dataclass
class Settings:
    """What training needs; ``batch`` chunks a batch (about: they are dealt by hash), ``accumulation`` batches a step."""

    learning_rate: float = 1e-2
    weight_decay: float = 1e-2
    betas: tuple[float, float] = (0.9, 0.999)
    epsilon: float = 1e-8
    batch: int = 16
    accumulation: int = 4
    max_epochs: int = 3
    early_stopping: bool = False
    patience: int = 1
    minimum_delta: float = 0.0
    restore_best: bool = True
    checkpoint_steps: int = 500
    minimum_label_support: int = 20
    seed: int = 42

    @classmethod
    def of(cls, config: dict) -> Settings:
        """From the finetuning section of a configuration."""
        stop = config.get("early_stopping", {})
        named = {
            "batch": config.get("batch_size"), "accumulation": config.get("gradient_accumulation_steps"), "max_epochs": config.get("max_epochs", config.get("epochs")),
            "early_stopping": stop.get("enabled"), "patience": stop.get("patience"), "minimum_delta": stop.get("minimum_delta"), "restore_best": config.get("restore_best_checkpoint"),
            **{k: config.get(k) for k in ("learning_rate", "weight_decay", "checkpoint_steps", "seed")},
        }
        return cls(**{k: v for k, v in named.items() if v is not None})


@dataclass
class State:
    """Where training stands; matrices are labels x (width + 1), the bias last."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    updates: int = 0
    epoch: int = 0
    step: int = 0
    best_metric: float = float("-inf")
    best_epoch: int = 0
    waited: int = 0
    stopped: bool = False
    history: list[dict] = field(default_factory=list)

    MATRICES = ("weights", "first", "second", "best")

    def update(self, g: np.ndarray, s: Settings) -> None:
        """One AdamW step along the gradient."""
        self.updates += 1
        a, b = s.betas
        self.first = a * self.first + (1 - a) * g
        self.second = b * self.second + (1 - b) * g * g
        first, second = self.first / (1 - a**self.updates), self.second / (1 - b**self.updates)
        self.weights = self.weights * (1 - s.learning_rate * s.weight_decay) - s.learning_rate * first / (np.sqrt(second) + s.epsilon)

    def judge(self, metric: float, s: Settings) -> bool:
        """Takes in an epoch's validation metric; whether it is an improvement."""
        improved = metric > self.best_metric + s.minimum_delta
        if improved:
            self.best_metric, self.best_epoch, self.waited, self.best = metric, self.epoch, 0, self.weights
        else:
            self.waited += 1
            self.stopped = s.early_stopping and self.waited >= s.patience
        return improved


def begin(labels: int, width: int, seed: int) -> State:
    """Small normal weights, no bias."""
    w = np.random.default_rng(seed).normal(0, 0.02, size=(labels, width + 1))
    w[:, -1] = 0
    return State(w, np.zeros_like(w), np.zeros_like(w), w)


def save_state(spark: SparkSession, path: str, state: State, fingerprint: str) -> None:
    """Replaces the state's table as a whole: one row."""
    plain = {k: v for k, v in asdict(state).items() if k not in State.MATRICES}
    row = (fingerprint, json.dumps(plain), *state.weights.shape, *[bytearray(getattr(state, m).astype("<f8").tobytes()) for m in State.MATRICES])
    kind = "fingerprint string, plain string, labels int, width int, " + ", ".join(f"{m} binary" for m in State.MATRICES)
    sinks.write_parquet(spark.createDataFrame([row], kind).coalesce(1), path)


def load_state(spark: SparkSession, path: str, fingerprint: str) -> State | None:
    """The state of an interrupted training; one of another split is an error."""
    if not sinks.exists(spark, path):
        return None
    row = spark.read.parquet(path).first()
    if row.fingerprint != fingerprint:
        raise ValueError("the checkpoint belongs to another split of the items")
    matrices = {m: np.frombuffer(bytes(row[m]), dtype="<f8").reshape(row.labels, row.width) for m in State.MATRICES}
    return State(**matrices, **json.loads(row.plain))


def weighted_loss(z: np.ndarray, y: np.ndarray, positive: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean over labels, weighted mean over a batch's rows, of the cross entropy with ``positive`` weights; its derivative by score."""
    n, labels = z.shape
    w = weight[:, None] / (n * labels)
    value = (positive * y * np.logaddexp(0, -z) + (1 - y) * np.logaddexp(0, z)) * w
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    return float(value.sum()), (positive * y * (p - 1) + (1 - y) * p) * w


def dealt_batches(chunks: DataFrame, n: int, labels: list[str], width: int, s: Settings, epoch: int, key: str) -> tuple[DataFrame, int]:
    """Blocks of an epoch's batches by step, stored, and the number of steps. ``chunks`` has key, id, vector, weight and on (label numbers)."""
    batches = max(1, -(-n // s.batch))
    at = F.pmod(T.portable_hash(str(s.seed + epoch), F.col("id")), F.lit(batches)).alias("batch")
    rows = chunks.select(at, "vector", "on", "weight").repartition("batch").sortWithinPartitions("batch")
    n_labels, accumulation = len(labels), s.accumulation
    kind = f"step int, batch long, {linear.BLOCKS}"

    def run(arrow):
        import pyarrow as pa

        schema, held, at = linear._schema(kind), [], None
        yield pa.RecordBatch.from_pylist([], schema=schema)
        block = lambda: pa.RecordBatch.from_pylist([{"step": at // accumulation, "batch": at} | linear._rows_to_block(held, width, n_labels)], schema=schema)
        for batch in arrow:
            for b, vector, on, w in zip(*(batch.column(c).to_pylist() for c in ("batch", "vector", "on", "weight"))):
                if b != at and held:
                    yield block()
                    held = []
                at = b
                held.append((None, vector, on, w))
        if held:
            yield block()

    path = f"{scratch_dir(chunks.sparkSession)}/loomtext/batches-{T.new_name()}"
    rows.mapInArrow(run, kind).write.partitionBy("step").parquet(path)
    return chunks.sparkSession.read.schema(kind).parquet(path), -(-batches // s.accumulation)


def step_gradient(blocks: DataFrame, step: int, w: np.ndarray, positive: np.ndarray, accumulation: int) -> tuple[float, np.ndarray]:
    """Sum of the batches' mean losses, and the gradient that a step accumulates: each batch's mean over ``accumulation``."""
    shared = blocks.sparkSession.sparkContext.broadcast((w, positive))
    labels, width = w.shape

    def run(rows):
        w, positive = shared.value
        total, lost, seen = np.zeros((labels, width)), 0.0, 0
        for row in rows:
            b = linear._block(row, labels)
            value, slope = weighted_loss(b.scores(w), b.y.astype(float), positive, b.weight)
            b.add_gradient(total, slope / accumulation)
            lost, seen = lost + value, seen + 1
        return np.r_[total.ravel(), lost, seen] if seen else None

    out = linear.tree_sum(blocks.where(F.col("step") == step), run, w.size + 2)
    shared.destroy()
    return out[-2] / max(1.0, out[-1]), out[:-2].reshape(w.shape)


@dataclass
class Head:
    """A trained head: labels, weights, thresholds by label, the chosen epoch and every epoch's row."""

    labels: list[str]
    weights: np.ndarray
    thresholds: dict[str, float]
    epoch: int
    history: list[dict]
    metrics: dict

    def forward(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.weights[:, :-1].T + self.weights[:, -1]


def item_scores(chunks: DataFrame, weights: np.ndarray, labels: Sequence[str], key: str = "handle") -> DataFrame:
    """key, label, score: weighted mean logits of an item's chunks."""
    rows = chunks.select(F.struct(key, "weight").alias("c"), dense.dense_features(F.col("vector")).alias("features"))
    logits = linear.score_rows(rows, weights, list(labels), False, "c").select(F.col(f"c.{key}").alias(key), F.col("c.weight").alias("weight"), "label", F.col("score").alias("logit"))
    return dense.aggregate_logits(logits, key, "weight")


def tuned(chunks: DataFrame, truth: DataFrame, splits: DataFrame, weights: np.ndarray, labels: list[str], s: Settings, key: str) -> tuple[dict[str, float], dict]:
    """Thresholds from the calibration items, and the validation items' metrics under them."""
    held = item_scores(chunks.join(splits.where("split in ('calibration', 'validation')").select(key), key, "left_semi"), weights, labels, key)
    rows = held.join(truth, [key, "label"]).join(splits, key).persist()
    try:
        swept = scores.sweep(rows.where("split = 'calibration'"), scores.HEAD_CANDIDATES)
        general = float(scores.global_thresholds(swept).first()["threshold"])
        table = scores.per_label_thresholds(swept, general, s.minimum_label_support)
        found = {r.label: float(r.threshold) for r in table.collect()}  # one row a label
        judged = rows.where("split = 'validation'")
        metrics = scores.multilabel_metrics(scores.apply_thresholds(judged, table), key).first().asDict()
        ap = scores.average_precision(judged).agg(F.avg("average_precision")).first()[0]
        return found, metrics | {"average_precision_macro": ap}
    finally:
        rows.unpersist()


def train(
    chunks: DataFrame,
    truth: DataFrame,
    splits: DataFrame,
    settings: Settings | None = None,
    path: str | None = None,
    fingerprint: str = "",
    key: str = "handle",
    stop_after: int | None = None,
) -> Head | None:
    """Fits a head on the train items' chunks (key, id, vector, weight; id names a chunk) under (key, label, y) and (key, split).

    ``path`` keeps the state: a training that was interrupted goes on from its last saved step, in the same batches; one
    bound to another ``fingerprint`` is an error, and so are splits without calibration items. ``stop_after`` ends after so many
    steps, as an interruption would, and returns nothing. Test items are never read. A label's weight for positives is
    negatives / max(positives, 1). Vectors are of one width; items without chunks have no score.
    """
    s, spark = settings or Settings(), chunks.sparkSession
    if splits.where("split = 'calibration'").isEmpty():
        raise ValueError("training a head needs calibration items")
    train_items = splits.where("split = 'train'").select(key)
    of_train = truth.join(train_items, key, "left_semi")
    positive = {r.label: r.pos_weight for r in dense.positive_weights(of_train).collect()}  # one row a label
    labels = sorted(positive)
    place = F.array_position(F.lit(labels).cast("array<string>"), F.col("label")) - 1
    on = of_train.groupBy(key).agg(F.collect_list(F.when(F.col("y") == 1, place).cast("int")).alias("on"))
    rows = chunks.join(on, key).select("id", F.col("vector").cast("array<double>").alias("vector"), F.col("weight").cast("double").alias("weight"), "on")
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    state = (load_state(spark, path, fingerprint) if path else None) or begin(len(labels), width, s.seed)
    weigh = np.array([positive[x] for x in labels])
    keep_state = lambda: save_state(spark, path, state, fingerprint) if path else None
    done = 0
    while state.epoch < s.max_epochs and not state.stopped:
        blocks, steps = dealt_batches(rows, n, labels, width, s, state.epoch, key)
        lost = []
        while state.step < steps:
            loss, g = step_gradient(blocks, state.step, state.weights, weigh, s.accumulation)
            lost.append(loss)
            state.update(g, s)
            state.step, done = state.step + 1, done + 1
            if s.checkpoint_steps and state.step % s.checkpoint_steps == 0:
                keep_state()
            if stop_after is not None and done >= stop_after:
                return None
        state.epoch, state.step = state.epoch + 1, 0
        _, metrics = tuned(chunks, truth, splits, state.weights, labels, s, key)
        improved = state.judge(float(metrics["f1_macro"]), s)
        state.history.append(
            {
                "epoch": state.epoch, "train_loss": float(np.mean(lost)) if lost else None, "validation_f1_macro": metrics["f1_macro"],
                "validation_f1_micro": metrics["f1_micro"], "validation_average_precision_macro": metrics["average_precision_macro"], "learning_rate": s.learning_rate,
                "improved": improved, "best_epoch": state.best_epoch, "best_validation_f1_macro": state.best_metric,
            }
        )
        keep_state()
    chosen = state.best if s.restore_best and state.best_epoch else state.weights
    thresholds, metrics = tuned(chunks, truth, splits, chosen, labels, s, key)
    return Head(labels, chosen, thresholds, state.best_epoch, state.history, metrics)
