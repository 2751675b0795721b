"""The head's training against a plain numpy version, resumed and stopped, with its batches read back from storage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import head

S = head.Settings(batch=16, accumulation=2, max_epochs=2, learning_rate=0.05, checkpoint_steps=2, minimum_label_support=3)


def data(spark, items=90, width=6, labels=3, seed=4):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(labels, width))
    chunks, truth, splits = [], [], []
    for i in range(items):
        x = rng.normal(size=width)
        y = (w @ x > 0.3).astype(int)
        for c in range(1 + i % 3):
            chunks.append((i, i * 10 + c, [float(v) for v in x + rng.normal(size=width) * 0.2], 1.0 / (1 + c)))
        truth += [(i, f"l{k}", int(y[k])) for k in range(labels)]
        splits.append((i, ("train", "train", "train", "calibration", "validation", "test")[i % 6]))
    return (
        spark.createDataFrame(chunks, "handle long, id long, vector array<double>, weight double").repartition(3),
        spark.createDataFrame(truth, "handle long, label string, y int"),
        spark.createDataFrame(splits, "handle long, split string"),
    ), (chunks, truth, splits)


def plain(spark, chunks, truth, splits, s, epochs):
    """Weights after so many epochs, the batches drawn by the same hashes."""
    train = {i for i, split in splits if split == "train"}
    y = np.zeros((max(i for i, _ in splits) + 1, 3))
    for i, label, on in truth:
        y[i, int(label[1])] = on
    pos = y[sorted(train)].sum(axis=0)
    positive = (len(train) - pos) / np.maximum(pos, 1)
    rows = [c for c in chunks if c[0] in train]
    n_batches = -(-len(rows) // s.batch)
    state = head.begin(3, len(rows[0][2]), s.seed)
    w, m, v, t, losses = state.weights.copy(), 0.0, 0.0, 0, []
    for epoch in range(epochs):
        ids = spark.createDataFrame([(c[1],) for c in rows], "id long")
        at = {r.id: r.b for r in ids.select("id", F.pmod(T.portable_hash(str(s.seed + epoch), F.col("id")), F.lit(n_batches)).alias("b")).collect()}
        own = []
        for step in range(-(-n_batches // s.accumulation)):
            g, of_step = np.zeros_like(w), []
            for b in range(step * s.accumulation, (step + 1) * s.accumulation):
                part = [c for c in rows if at[c[1]] == b]
                if not part:
                    continue
                x = np.array([[*c[2], 1.0] for c in part])
                yy, k = np.array([y[c[0]] for c in part]), np.array([c[3] for c in part])[:, None]
                z = x @ w.T
                p = 1 / (1 + np.exp(-z))
                g += ((positive * yy * (p - 1) + (1 - yy) * p) * k).T @ x / (3 * len(part)) / s.accumulation
                of_step.append((-(positive * yy * np.log(p) + (1 - yy) * np.log(1 - p)) * k).sum() / (3 * len(part)))
            own.append(np.mean(of_step) if of_step else 0.0)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * (1 - s.learning_rate * s.weight_decay) - s.learning_rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(np.mean(own))
    return w, losses


def test_as_plain_numpy_and_resumed(spark, tmp_path):
    frames, raw = data(spark)
    whole = head.train(*frames, head.Settings(**{**vars(S), "restore_best": False}))
    want, losses = plain(spark, *raw, S, 2)
    assert np.abs(whole.weights - want).max() < 1e-9
    assert np.allclose([h["train_loss"] for h in whole.history], losses) and len(whole.history) == 2
    # Interrupted in the second epoch, past a saved step, and gone on with: the same weights.
    path = f"file://{tmp_path}/state"
    own = head.Settings(**{**vars(S), "restore_best": False})
    steps = head.dealt_batches(frames[0].join(frames[2].where("split = 'train'"), "handle").withColumn("on", F.array().cast("array<int>")), sum(1 for c in raw[0] if c[0] % 6 < 3), ["l0"], 6, S, 0, "handle")[1]
    assert head.train(*frames, own, path, "f1", stop_after=steps + 3) is None
    again = head.train(*frames, own, path, "f1")
    assert np.abs(again.weights - want).max() < 1e-9 and [h["epoch"] for h in again.history] == [1, 2]
    with pytest.raises(ValueError):
        head.train(*frames, own, path, "f2")


def test_best_epoch_early_stop_and_splits(spark):
    s = head.Settings(max_epochs=9, early_stopping=True, patience=2)
    state = head.begin(1, 2, 0)
    for epoch, (metric, improved, stopped) in enumerate([(0.5, True, False), (0.4, False, False), (0.6, True, False), (0.6, False, False), (0.55, False, True)], 1):
        state.epoch, state.weights = epoch, np.full((1, 3), float(epoch))
        assert state.judge(metric, s) == improved and state.stopped == stopped
    assert state.best_epoch == 3 and state.best[0, 0] == 3
    frames, _ = data(spark, 12)
    with pytest.raises(ValueError):
        head.train(frames[0], frames[1], frames[2].where("split <> 'calibration'"), S)


def test_learns_and_never_reads_test_items(spark):
    frames, _ = data(spark, 240)
    spoiled = frames[0].join(frames[2], "handle").withColumn("vector", F.when(F.col("split") == "test", F.array_repeat(F.lit(float("nan")), 6)).otherwise(F.col("vector"))).drop("split")
    found = head.train(spoiled, *frames[1:], head.Settings(**{**vars(S), "max_epochs": 3, "learning_rate": 0.1}))
    assert found.metrics["f1_macro"] > 0.75 and found.epoch == max(found.history, key=lambda h: (h["validation_f1_macro"], -h["epoch"]))["epoch"]
    assert set(found.thresholds) == {"l0", "l1", "l2"}
