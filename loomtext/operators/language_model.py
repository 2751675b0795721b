"""A trained language detector: naive Bayes over hashed byte n-grams of words.

Spark counts the n-grams of every labelled text once; each task adds up one array of languages x buckets, and a tree of
tasks adds these. What the driver holds and what a detector carries is that array alone, whatever the number of
texts. A text's log-likelihoods are sums over its n-grams, and its score is the normalised probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linear
from .language import LibraryDetector

#: Buckets of n-grams, the longest n-gram in bytes, and what every bucket holds beforehand.
BUCKETS, LONGEST, SMOOTHING = 1 << 16, 4, 0.5
#: Bytes of a text that are hashed together.
STEP = 1 << 20
_OTHER = re.compile(r"[\W\d_]+")
_TIMES = np.random.default_rng(3).integers(1, 2**63, size=LONGEST, dtype=np.uint64) | np.uint64(1)


def ngram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the 1- to LONGEST-grams of the text's lower-cased letters, words apart by one space; nothing without letters."""
    plain = _OTHER.sub(" ", text.lower()).strip()
    if not plain:
        return
    data = np.frombuffer(f" {plain} ".encode(), dtype=np.uint8).astype(np.uint64)
    for s in range(0, len(data), STEP):
        part = data[s : s + STEP + LONGEST - 1]
        own = min(STEP, len(data) - s)  # n-grams that begin in this step
        h = np.zeros(len(part), dtype=np.uint64)
        for n in range(LONGEST):
            if len(part) <= n:
                break
            h = h[: len(part) - n] * np.uint64(31) + (part[n:] + np.uint64(1)) * _TIMES[n]
            yield ((h ^ (h >> np.uint64(29))) * _TIMES[0] >> np.uint64(40))[:own].astype(np.int64) % buckets


@dataclass
class LanguageModel:
    """Languages, and their log-probabilities by bucket (languages x buckets) and prior."""

    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray

    def likelihoods(self, text: str) -> np.ndarray | None:
        total, seen = self.prior.copy(), False
        for at in ngram_buckets(text, self.logs.shape[1]):
            total += self.logs @ np.bincount(at, minlength=self.logs.shape[1]) if len(at) > 4096 else self.logs[:, at].sum(axis=1)
            seen = True
        return total if seen else None

    def classify(self, text: str) -> tuple[str, float | None]:
        """The likeliest language and its probability; ``und`` for a text without letters. Ties go to the first language."""
        found = self.likelihoods(text) if self.languages else None
        if found is None:
            return "und", None
        p = np.exp(found - found.max())
        best = int(np.argmax(found))
        return self.languages[best], float(p[best] / p.sum())

    def detector(self) -> LibraryDetector:
        """A back-end like those of the libraries, for every report that takes one."""
        return LibraryDetector(self.classify)


def fit_language_model(rows: DataFrame, text: str = "text", language: str = "language", buckets: int = BUCKETS) -> LanguageModel:
    """From all labelled texts; rows without language are left out, empty texts count for the prior alone."""
    told = rows.where(F.col(language).isNotNull()).select(F.col(language).cast("string").alias("language"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    names = [r.language for r in told.select("language").distinct().orderBy("language").collect()]  # languages are few
    place = {name: i for i, name in enumerate(names)}

    def run(each):
        counts, seen = np.zeros((len(place), buckets + 1)), False
        for row in each:
            i, seen = place[row["language"]], True
            counts[i, -1] += 1
            for at in ngram_buckets(row["text"], buckets):
                counts[i, :-1] += np.bincount(at, minlength=buckets)
        return counts.ravel() if seen else None

    counts = linear.tree_sum(told, run, len(names) * (buckets + 1)).reshape(len(names), buckets + 1)
    grams = counts[:, :-1] + SMOOTHING
    prior = np.log(counts[:, -1]) - np.log(max(1.0, counts[:, -1].sum()))
    return LanguageModel(names, np.log(grams) - np.log(grams.sum(axis=1, keepdims=True)), prior)
