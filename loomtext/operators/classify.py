"""One binary classifier per label, all fitted in the same passes; convergence rows, grids and leaderboards."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linear
from .dense import FEATURE_SETS

MODES = ("raw", "normalized", "language_stopwords")
SPARSE = ("bow", "tfidf", "bm25")
CLASSIFIERS = ("logreg", "linear_svc", "sgd")


@dataclass
class Classifier:
    """A kind of linear model and its settings: C weighs the losses of logreg and linear_svc, alpha the penalty of sgd."""

    name: str
    c: float
    alpha: float
    tol: float
    max_iter: int

    @property
    def kind(self) -> str:
        return "linear_svc" if self.name.startswith("linear_svc") else self.name

    def fit(self, data: linear.Data) -> linear.Fit:
        if self.kind == "sgd":
            return linear.descend(data, self.alpha, self.tol, self.max_iter)
        return linear.minimise(data, self.kind, self.c, self.tol, self.max_iter)


def create_classifier(name: str, c: float = 1.0, tol: float | None = None, max_iter: int = 3000, alpha: float = 1e-4) -> Classifier:
    """logreg, linear_svc (and linear_svc_* names, with settings of their own) or sgd; the tolerance is 1e-3 for sgd, else 1e-4."""
    if name not in CLASSIFIERS and not name.startswith("linear_svc_"):
        raise ValueError(f"unknown classifier: {name}")
    return Classifier(name, c, alpha, tol if tol is not None else 1e-3 if name == "sgd" else 1e-4, max_iter)


@dataclass
class OneVsRest:
    """Weights labels x (features + 1) with the labels' names; a label of one class only has a constant score."""

    name: str
    labels: list[str]
    fit: linear.Fit
    max_iter: int

    @property
    def score_kind(self) -> str:
        return "decision_scores" if self.name.startswith("linear_svc") else "probabilities"

    def scores(self, features: DataFrame, key: str = "handle") -> DataFrame:
        """key, label, score for every label, in one pass."""
        return linear.score_rows(features, self.fit.weights, self.labels, self.score_kind == "probabilities", key)

    def convergence(self, spark) -> DataFrame:
        rows = [(label, int(i), self.max_iter, bool(c)) for label, i, c in zip(self.labels, self.fit.iterations, self.fit.converged, strict=True)]
        return spark.createDataFrame(rows, "label string, iterations int, max_iterations int, converged boolean")


def fit_one_vs_rest(features: DataFrame, indicator: DataFrame, name: str = "logreg", key: str = "handle", weight: str | None = None, **settings) -> OneVsRest:
    """One model a label from (key, features) and (key, label, y); see linear.FEATURES and create_classifier.

    The rows are stored as blocks once and read once an iteration, whatever the number of labels."""
    classifier = create_classifier(name, **settings)
    data = linear.training_data(features, indicator, key, weight)
    try:
        found = classifier.fit(data)
    finally:
        data.close()
    one_class = (data.positives == 0) | (data.positives == data.n)
    constant = np.where(data.positives > 0, 1.0, -1.0) * (1.0 if classifier.kind == "linear_svc" else 1000.0)  # a probability of 0 or 1
    found.weights[one_class, :-1], found.weights[one_class, -1] = 0.0, constant[one_class]
    found.iterations[one_class], found.converged[one_class] = 0, True
    return OneVsRest(name, data.labels, found, classifier.max_iter)


def grid(dense: tuple[str, ...] = ("sbert", "labse")) -> list[tuple[str, str, str, str]]:
    """All experiments: (preprocessing, feature set, representation, classifier)."""
    sparse = list(product(MODES, FEATURE_SETS, SPARSE, CLASSIFIERS))
    return sparse + [("transformer", f, d, c) for d, f, c in product(dense, FEATURE_SETS, CLASSIFIERS)]


KEY = ("preprocessing", "feature_set", "representation", "classifier")


def leaderboard(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Adds place: experiments by the metric downwards, ties by key. One row an experiment."""
    return results.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc(metric), *KEY)))


def family() -> Column:
    """The representation family of an experiment: fine-tuned models are their own, encoders are frozen."""
    r = F.col("representation")
    base = F.substring_index(r, ":", 1)
    return (
        F.when(F.col("preprocessing") == "transformer_finetuned", r)
        .when(base.isin("sbert", "labse"), F.concat(base, F.lit("_frozen")))
        .otherwise(r)
    )


def family_winners(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    order = F.struct(-F.col(metric), *KEY)
    own = results.withColumn("family", family())
    return own.groupBy("family").agg(F.min_by(F.struct(*results.columns), order).alias("r")).select("r.*", "family")


def selected_models(results: DataFrame, metric: str = "f1_macro") -> DataFrame:
    """Each family's best experiment; the best of all is the confirmatory one. Columns of the results, family,
    confirmatory and selection_roles (joined by ;)."""
    best = leaderboard(results, metric).where("place = 1").select(*KEY, F.lit(True).alias("confirmatory"))
    rows = family_winners(results, metric).join(best, list(KEY), "left").withColumn("confirmatory", F.coalesce("confirmatory", F.lit(False)))
    roles = F.when(F.col("confirmatory"), "family_secondary;global_confirmatory").otherwise("family_secondary")
    return rows.select(*results.columns, "family", "confirmatory", roles.alias("selection_roles"))


def pending(expected: DataFrame, completed: DataFrame) -> DataFrame:
    """Experiments without a result."""
    return expected.join(completed, list(KEY), "left_anti")
