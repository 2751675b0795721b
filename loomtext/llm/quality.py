"""Operator 9, quality classifier: random-indexing word vectors, pooled, and a two-layer numpy network.

Every word has two tokens, its letters in lower case and its shape (letter case, digits, punctuation),
each hashed to a row of a table. A row's random index vector is sparse and ternary; its context vector
is the sum of the index vectors around it in the fitting sample. A word's vector is its index vector
plus its context vector at unit length. A document is the mean of its words' vectors and a few ratios of
its text. A network of two layers scores it; a temperature, chosen on a part of the sample that the
network was not fitted on, calibrates the probabilities.

The fit is bounded by ``max_fit_rows`` labelled documents (their texts are used whole); what reaches the
driver is a table of vectors of fixed size a task and one pooled vector a fitting document. Scoring
covers every document and its whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash, text_or_empty
from .tokenizer_files import text_batches

#: Rows of the tables of letters and of shapes, and the width of their vectors.
LEXICAL, SHAPES, WIDTH = 16_384, 1_024, 64
#: Words on either side that count as context.
REACH = 2
#: Labelled documents that a fit uses at most, and tasks that gather context vectors.
MAX_FIT_ROWS, FIT_TASKS = 12_000, 8
HELD_WORDS = 200_000
NOT_LETTERS = re.compile(r"[\W\d_]+")
LOWER, UPPER, DIGITS = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile("[A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")
EXTRAS = 6


def shape(word: str) -> str:
    """Aa9-like outline: runs of lower-case letters, capitals and digits fold, punctuation stays."""
    return DIGITS.sub("9", UPPER.sub("A", LOWER.sub("a", word)))


class Tokens:
    """Table rows of words; a bounded dictionary keeps those of words already seen."""

    def __init__(self):
        self.held: dict[str, int] = {}

    def row(self, word: str) -> int:
        letters = NOT_LETTERS.sub("", word).lower()
        found = zlib.crc32(letters.encode("utf-8", "replace")) % LEXICAL * SHAPES
        self.held[word] = found = found + zlib.crc32(shape(word).encode("utf-8", "replace")) % SHAPES
        return found

    def rows(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the letters and of the shape of each word, and the text's ratios."""
        words = text.split()
        if len(self.held) > HELD_WORDS:
            self.held = {}
        held = self.held
        both = np.fromiter(
            (held[w] if w in held else self.row(w) for w in words), dtype=np.int64, count=len(words)
        )
        n = max(1, len(words))
        again = int((both[1:] == both[:-1]).sum())
        lines = text.split("\n")
        extras = [
            np.log1p(len(words)),
            len(set(words)) / n,
            again / n,
            len(text) / n if words else 0.0,
            len(set(lines)) / len(lines),
            float(not words),
        ]
        return both // SHAPES, both % SHAPES, np.array(extras)


TOKENS = Tokens()


def index_vectors(seed: int = 7) -> np.ndarray:
    """Sparse ternary random index vectors of all rows: two +1 and two -1 each."""
    rng = np.random.default_rng(seed)
    out = np.zeros((LEXICAL + SHAPES, WIDTH), dtype=np.float32)
    at = np.argsort(rng.random(out.shape), axis=1)[:, :4]
    np.put_along_axis(out, at[:, :2], 1, axis=1)
    np.put_along_axis(out, at[:, 2:], -1, axis=1)
    return out


def add_context(total: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """Adds the index vectors of the words around each word of one text to the words' context sums."""
    for k in range(1, REACH + 1):
        for a, b in ((rows[k:], rows[:-k]), (rows[:-k], rows[k:])):
            for s in range(0, len(a), 100_000):
                own, near = a[s : s + 100_000], b[s : s + 100_000]
                order = np.argsort(own, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
                total[own[order[first]]] += np.add.reduceat(index[near[order]], first, axis=0)


def word_vectors(index: np.ndarray, context: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + np.divide(context, norm, out=np.zeros_like(context), where=norm > 0)


def pooled(vectors: np.ndarray, lexical: np.ndarray, shapes: np.ndarray, extras: np.ndarray) -> np.ndarray:
    out = np.zeros(2 * WIDTH + EXTRAS)
    if len(lexical):
        for at, rows in ((0, lexical), (WIDTH, shapes + LEXICAL)):
            total = np.zeros(WIDTH)
            for s in range(0, len(rows), 200_000):
                total += vectors[rows[s : s + 200_000]].sum(axis=0, dtype=np.float64)
            out[at : at + WIDTH] = total / len(rows)
    out[2 * WIDTH :] = extras
    return out


@dataclass
class Network:
    """Two layers with a temperature; ``predict`` gives the probability of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 11) -> Network:
    """Adam on the log loss; the last fifth of a fixed shuffle picks the best epoch and the temperature."""
    rng = np.random.default_rng(seed)
    if not len(x):
        x, y = np.zeros((1, 2 * WIDTH + EXTRAS)), np.ones(1)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 4 // 5)
    fit, check = order[:cut], order[cut:] if len(x) > cut else order
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net = Network(
        mean, scale, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden),
        float(np.log((y[fit].sum() + 1) / (len(fit) - y[fit].sum() + 1))),
    )
    z = (x - mean) / scale
    held = [net.w1, net.b1, net.w2, np.array(net.b2)]
    first, second, step = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
    best, kept = np.inf, [p.copy() for p in held]
    loss = lambda g, t: float(np.mean(np.logaddexp(0, g) - t * g))
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            w1, b1, w2, b2 = held
            a = np.tanh(z[rows] @ w1 + b1)
            g = (1 / (1 + np.exp(-np.clip(a @ w2 + b2, -40, 40))) - y[rows]) / len(rows)
            back = np.outer(g, w2) * (1 - a * a)
            grads = [z[rows].T @ back + 1e-4 * w1, back.sum(axis=0), a.T @ g + 1e-4 * w2, g.sum()]
            step += 1
            for p, q, m, v in zip(held, grads, first, second, strict=True):
                m += 0.1 * (q - m)
                v += 0.001 * (q * q - v)
                p -= 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        now = loss(np.tanh(z[check] @ held[0] + held[1]) @ held[2] + held[3], y[check])
        if now < best:
            best, kept = now, [p.copy() for p in held]
    net.w1, net.b1, net.w2, net.b2 = kept[0], kept[1], kept[2], float(kept[3])
    logits = net.logits(x[check])
    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=lambda t: loss(logits / t, y[check])))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([pooled(self.vectors, *TOKENS.rows(t)) for t in texts]).reshape(len(texts), 2 * WIDTH + EXTRAS)
        return self.network.predict(x)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_fit_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most ``max_fit_rows`` documents with their label, those of the smallest hash of the identifier.

    Rows whose identifier's CRC-32 leaves 1 when divided by 3 are held out. An identifier with several
    labels counts with the smallest. Repeated documents of a chosen identifier count once.
    """
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where("doc_id is not null and y in (0, 1)")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_fit_rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    # The broadcast side has at most max_fit_rows narrow rows.
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "y")


def held_out(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    max_fit_rows: int = MAX_FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> QualityModel:
    """Fits word vectors and network on a bounded sample of labelled texts. Without any labelled text the
    model scores every text alike."""
    spark = docs.sparkSession
    text_batches(spark)
    sample = labelled_sample(docs, labels, max_fit_rows, id_col, text_col, label_col)

    def tokens(batches):
        for batch in batches:
            rows = [TOKENS.rows(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), *(pa.array([r[i] for r in rows], type=t) for i, t in enumerate([pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]))],
                names=["y", "lexical", "shapes", "extras"],
            )

    rows = stash(sample.mapInArrow(tokens, "y int, lexical array<int>, shapes array<int>, extras array<double>"), "fit-tokens")

    def contexts(batches):
        index = index_vectors()
        total = np.zeros_like(index)
        for batch in batches:
            for name, base in (("lexical", 0), ("shapes", LEXICAL)):
                for x in batch.column(name):
                    add_context(total, index, x.values.to_numpy().astype(np.int64) + base)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    index = index_vectors()
    context = np.zeros_like(index)
    for r in rows.coalesce(FIT_TASKS).mapInArrow(contexts, "total binary").toLocalIterator():  # FIT_TASKS rows at most
        context += np.frombuffer(r.total, dtype=np.float32).reshape(index.shape)
    vectors = word_vectors(index, context)
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches):
        for batch in batches:
            x = [
                pooled(shared.value, a.values.to_numpy().astype(np.int64), b.values.to_numpy().astype(np.int64), c.values.to_numpy())
                for a, b, c in zip(batch.column("lexical"), batch.column("shapes"), batch.column("extras"), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "x"])

    found = sorted((bytes(r.x), r.y) for r in rows.coalesce(FIT_TASKS).mapInArrow(pool, "y int, x binary").collect())
    x = np.array([np.frombuffer(a) for a, _ in found]).reshape(len(found), 2 * WIDTH + EXTRAS)
    return QualityModel(vectors, fit_network(x, np.array([float(y) for _, y in found])))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Only the text is scored. A null text counts as empty; empty texts are scored too, all alike.
    Identifiers, null (never held out) and repeated ones too, pass through. An empty table gives an empty
    result; other columns are not read.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their own columns and in one narrow pass.

    Only the text counts: null and empty texts score alike, rows that repeat an identifier or a text are
    judged one by one, a score of exactly ``least`` stays, and an empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts.to_pylist()), pa.float64())

    return docs.where(score(text_or_empty(text_col)) >= least)
