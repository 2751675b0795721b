"""Run aggregates: seeds, epochs, exposure, timing, and the checks of resumable stages."""

from __future__ import annotations

import csv
import json
import threading
import time
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.config import leaves
from .percentiles import exact_percentiles


def seed_aggregate(runs: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, least and largest of each metric over the runs of a group."""
    stats = (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))
    return runs.groupBy(*by).agg(F.count("*").alias("n_runs"), *[f(m).alias(f"{m}_{name}") for m in metrics for name, f in stats])


def paired_differences(runs: DataFrame, metric: str, a: str, b: str, model: str = "model", seed: str = "seed") -> DataFrame:
    """a minus b for every seed that has both."""
    value = lambda m: F.max(F.when(F.col(model) == m, F.col(metric)))
    pairs = runs.groupBy(seed).agg(value(a).alias("a"), value(b).alias("b"))
    return pairs.where("a is not null and b is not null").select(seed, "a", "b", (F.col("a") - F.col("b")).alias("difference"))


def per_label_over_seeds(rows: DataFrame) -> DataFrame:
    """Per model and label: F1 of each seed's predictions (model, seed, label, y, pred), averaged over seeds."""
    y, p = F.col("y") == 1, F.col("pred") == 1
    n = lambda c: F.sum(c.cast("long"))
    per = rows.groupBy("model", "seed", "label").agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return seed_aggregate(per.withColumn("f1", f1), ("model", "label"), ("f1",))


def epoch_summary(epochs: DataFrame, selected: DataFrame | None = None, run: str = "run", metric: str = "metric") -> DataFrame:
    """Epochs, the numerical peak (the first of equals), the last epoch, and the selected epoch's gap to the peak."""
    peak = epochs.groupBy(run).agg(
        F.count("*").alias("epochs_evaluated"),
        F.max_by("epoch", F.struct(metric, -F.col("epoch"))).alias("peak_epoch"),
        F.max(metric).alias("peak_metric"),
        F.max("epoch").alias("stopped_after_epoch"),
    )
    if selected is None:
        return peak
    chosen = selected.select(run, F.col("epoch").alias("selected_epoch"))
    own = epochs.join(chosen, run).where(F.col("epoch") == F.col("selected_epoch")).select(run, "selected_epoch", F.col(metric).alias("selected_metric"))
    return peak.join(own, run, "left").withColumn("peak_minus_selected", F.col("peak_metric") - F.col("selected_metric"))


def threshold_rows(thresholds: DataFrame, labels: Sequence[str]) -> DataFrame:
    """label and threshold rows from arrays of thresholds in label order."""
    names = F.array(*map(F.lit, labels))
    rest = [c for c in thresholds.columns if c != "thresholds"]
    rows = thresholds.select(*rest, F.posexplode("thresholds").alias("i", "threshold"))
    return rows.select(*rest, F.get(names, F.col("i")).alias("label"), "threshold")


def exposure(documents: DataFrame) -> DataFrame:
    """Totals, coverage and chunk statistics per split and over all (split is null), in one rollup.

    Columns: split, original, source, observed (characters), total_tokens, selected_tokens, chunks, units.
    """
    share = lambda a, b: F.try_divide(F.lit(100.0) * F.sum(a), F.sum(b))
    fraction = F.coalesce(F.try_divide(F.col("observed").cast("double"), F.col("source").cast("double")), F.lit(0.0))
    n = lambda c: F.sum(c.cast("long"))
    kind = documents.schema["split"].dataType.simpleString()
    of_split = exact_percentiles(documents.withColumn("fraction", fraction), "fraction", [0.5], "split")
    of_all = exact_percentiles(documents.withColumn("fraction", fraction), "fraction", [0.5])
    medians = [(g, 0, q[0]) for g, q in of_split.items()] + [(None, 1, q[0]) for q in of_all.values()]
    medians = documents.sparkSession.createDataFrame(medians, f"s {kind}, whole int, document_fraction_median double")
    found = documents.rollup("split").agg(
        F.grouping("split").cast("int").alias("total"),
        F.count("*").alias("n_documents"),
        F.sum("original").alias("original_characters"),
        F.sum("source").alias("capped_characters"),
        F.sum("observed").alias("selected_characters"),
        share("source", "original").alias("cap_retained_percentage"),
        share("observed", "source").alias("coverage_percentage"),
        share("selected_tokens", "total_tokens").alias("token_coverage_percentage"),
        F.sum("chunks").alias("selected_chunks"),
        F.avg("chunks").alias("chunks_mean"),
        F.percentile("chunks", F.lit(0.5)).alias("chunks_median"),
        F.percentile("chunks", F.lit(0.95)).alias("chunks_p95"),
        F.max("chunks").alias("chunks_max"),
        F.avg(fraction).alias("document_fraction_mean"),
        n(F.col("units") > 1).alias("documents_with_multiple_units"),
        n(F.col("observed") == F.col("source")).alias("fully_exposed_documents"),
        n(F.col("original") > F.col("source")).alias("truncated_documents"),
        n(F.col("total_tokens") == 0).alias("tokenless_documents"),
    )
    same = found["split"].eqNullSafe(medians["s"]) & (found["total"] == medians["whole"])
    return found.join(F.broadcast(medians), same, "left").drop("s", "whole", "total")  # a row a split


def scaling_estimate(runs: DataFrame, documents: str = "documents", seconds: str = "seconds") -> DataFrame:
    """Documents per hour, and whole documents in 24 and 20 hours; null without time."""
    hourly = F.try_divide(F.col(documents) * F.lit(3600.0), F.col(seconds).cast("double"))
    return runs.withColumns({"documents_per_hour": hourly, "documents_24h": F.floor(hourly * 24), "documents_20h": F.floor(hourly * 20)})


def session_time(sessions: DataFrame) -> DataFrame:
    """Seconds of all sessions of a run, interrupted ones included."""
    return sessions.groupBy("run").agg(F.sum("seconds").alias("seconds_total"), F.count("*").alias("sessions"), F.sum((F.col("state") == "interrupted").cast("long")).alias("interrupted"))


def mark_interrupted(sessions: DataFrame, current: str) -> DataFrame:
    """Sessions that are still open but not the current one were interrupted."""
    open_one = (F.col("state") == "running") & (F.col("session") != current)
    return sessions.withColumn("state", F.when(open_one, "interrupted").otherwise(F.col("state")))


def bound_to(results: DataFrame, fingerprint: str) -> DataFrame:
    """Results of this split; results of another one are an error."""
    if not results.where(~F.col("split_fingerprint").eqNullSafe(F.lit(fingerprint))).isEmpty():
        raise ValueError("results belong to another split")
    return results


def require_complete(expected: DataFrame, completed: DataFrame, keys: Sequence[str]) -> None:
    missing = expected.join(completed, list(keys), "left_anti").limit(5).collect()  # the first few, for the message
    if missing:
        raise ValueError(f"experiments without a result: {[tuple(r) for r in missing]}")


def selection_roles(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per configuration with its roles joined by a semicolon."""
    roles = F.array_join(F.array_sort(F.collect_set("role")), ";")
    return rows.groupBy(*keys).agg(roles.alias("selection_roles"))


@dataclass(frozen=True)
class RunNeeds:
    """What a finished run has to hold, and what it may not: paths below its folder."""

    files: Sequence[str]
    absent: Sequence[str] = ()


def require_run(folder: str | Path, needs: RunNeeds, seed: int) -> dict[str, Any]:
    """A run's context (context.json), if its files are there, none is that may not be, and all its seeds are ``seed``.

    Seeds are told by the context and by the column seed of the metrics tables among the files.
    """
    base = Path(folder)
    lacking = sorted(f for f in needs.files if not (base / f).exists())
    if lacking:
        raise FileNotFoundError(f"the run of seed {seed} lacks {lacking}")
    found = sorted(f for f in needs.absent if (base / f).exists())
    if found:
        raise ValueError(f"the run of seed {seed} goes too far: {found}")
    context = json.loads((base / "context.json").read_text(encoding="utf-8"))
    told = {int(context["seed"])}
    for f in needs.files:
        if f.endswith(".csv"):
            with (base / f).open(encoding="utf-8", newline="") as rows:
                told |= {int(r["seed"]) for r in csv.DictReader(rows) if r.get("seed")}
    if told != {seed}:
        raise ValueError(f"the run of seed {seed} tells the seeds {sorted(told)}")
    return context


#: Keys that the runs of one comparison share, and parts of their settings that may differ.
SHARED_KEYS = ("split_fingerprint", "dataset_fingerprint", "split_sizes", "labels", "commit", "source_digest")
OWN_SETTINGS = ("experiment.seed", "experiment.output_dir", "data.prepared_parquet", "data.split_manifest", "data.labels_json")


def context_differences(contexts: Sequence[dict[str, Any]], settings: Sequence[dict[str, Any]] = (), own: Sequence[str] = OWN_SETTINGS) -> list[str]:
    """What differs between runs that have to be comparable: shared keys, and settings outside ``own``."""
    out = [k for k in SHARED_KEYS if len({json.dumps(c.get(k), sort_keys=True) for c in contexts}) > 1]
    flat = [{".".join(p): json.dumps(v, sort_keys=True) for p, v in leaves(s)} for s in settings]
    for path in sorted({p for f in flat for p in f}):
        if path not in own and len({f.get(path) for f in flat}) > 1:
            out.append(f"settings.{path}")
    return out


def validate_shared_context(contexts: Sequence[dict[str, Any]], settings: Sequence[dict[str, Any]] = ()) -> None:
    found = context_differences(contexts, settings)
    if found:
        raise ValueError(f"runs disagree on {found}")


class Heartbeat:
    """Writes a session's seconds to a file at once, at intervals while it lasts, and at its end.

    The file keeps one row a session, so time up to the last beat counts even if the driver is lost; sessions
    that were running when another began were interrupted.
    """

    def __init__(self, path: str | Path, stage: str, seconds: float = 60.0):
        self.path, self.seconds, self.began = Path(path), seconds, time.time()
        self.session = f"{stage}-{self.began:.6f}"
        self.stopped, self.lock = threading.Event(), threading.Lock()
        held = self.read()
        for row in held:
            if row["state"] == "running":
                row["state"] = "interrupted"
        self.rows = held
        self.beat("running")
        self.thread = threading.Thread(target=self._run, name="heartbeat", daemon=True)
        self.thread.start()

    def read(self) -> list[dict[str, Any]]:
        return json.loads(self.path.read_text(encoding="utf-8")) if self.path.exists() else []

    def beat(self, state: str) -> float:
        """The seconds of all sessions."""
        with self.lock:
            own = {"session": self.session, "state": state, "seconds": time.time() - self.began}
            rows = [*(r for r in self.rows if r["session"] != self.session), own]
            fresh = self.path.with_suffix(".new")
            fresh.write_text(json.dumps(rows), encoding="utf-8")
            fresh.replace(self.path)
            return sum(r["seconds"] for r in rows)

    def _run(self) -> None:
        while not self.stopped.wait(self.seconds):
            self.beat("running")

    def stop(self, state: str = "done") -> float:
        self.stopped.set()
        self.thread.join()
        return self.beat(state)
