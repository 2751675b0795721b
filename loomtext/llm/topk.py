"""Operator 2, exact top-k search by inner product with multi-resolution segment statistics.

A vector is turned by a fixed rotation and cut into segments, at several resolutions from one segment to
half as many as components. For vectors q and c with segment means m and deviations s over segments of
length n, a segment's part of the squared distance is at least n * ((m_q - m_c)^2 + (s_q - s_c)^2).
Squared distance and inner product differ by the vectors' norms alone, so this lower bound is the upper
bound n * (m_q m_c + s_q s_c) of the segment's part of the product. Going from coarse to fine, pairs whose
bound can't reach the query's k-th best score so far are left out, and rows that no query wants leave the
finer levels; survivors get the exact integer product.

The rotation keeps products and distances. It lays the directions of most variance, fitted on a bounded
sample, on the segments' means, which coarse levels see; on vectors without such directions only fine levels prune. Every
query starts with a floor, its k-th best score among another bounded sample, so that bounds bite from the
first row on. Both samples steer the search alone: every row is bounded or scored.

Queries go in blocks of bounded size, one after the other: a block is broadcast, meets all rows in one
scan without a shuffle, its tasks keep k rows a query, and its result is stored before the next block's
queries leave the stored table. Neither queries nor rows have to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, stash
from .tokenizer_files import text_batches

#: Queries that are broadcast together at most.
BLOCK = 8192
#: Pairs that are bounded together.
PAIRS = 1_000_000
#: Rows of the samples that fit the rotation and the first floors.
SAMPLE = 4096
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def integer_rows(vectors: np.ndarray, sizes: np.ndarray, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of ragged rows, zero-padded to ``width``; exact in float64 up to 2^53."""
    out = np.zeros((len(sizes), width))
    inside = np.arange(width) < sizes[:, None]
    out[inside] = np.floor(scale * vectors)
    return out


def resolutions(width: int) -> list[int]:
    """Parts of the vector at each level, coarse to fine: one, four times as many each, at last half the components."""
    parts, level = [], 1
    while level < -(-width // 2):
        parts.append(level)
        level *= 4
    return [*parts, max(1, -(-width // 2))]


def fitted_rotation(x: np.ndarray) -> np.ndarray:
    """An orthogonal matrix that lays the sample's principal directions on means of segments, most variance coarsest."""
    width = x.shape[1]
    if not width:
        return np.zeros((0, 0))
    top = np.nanmax(np.abs(x), initial=1.0) or 1.0
    _, directions = np.linalg.eigh((x / top).T @ (x / top))
    # Haar-like targets: what the means of the coarsest segments tell comes first.
    shapes = []
    for parts in resolutions(width):
        for p in range(parts):
            n = -(-width // parts)
            v = np.zeros(width)
            v[p * n : (p + 1) * n] = 1.0
            if v.any():
                shapes.append(v)
    kept, found = [], np.zeros((0, width))
    for v in [*shapes, *np.eye(width)]:
        rest = v - found.T @ (found @ v)
        rest -= found.T @ (found @ rest)
        size = np.linalg.norm(rest)
        if size > 1e-6 and len(kept) < width:
            kept.append(rest / size)
            found = np.array(kept)
    return directions[:, ::-1] @ found


def segment_statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that a plain product of two rows is the bound."""
    width = -(-max(1, x.shape[1]) // parts)
    cut = np.zeros((len(x), parts * width))
    cut[:, : x.shape[1]] = x
    cut = cut.reshape(len(x), parts, width)
    mean = cut.mean(axis=2)
    deviation = np.sqrt(np.maximum(0, np.square(cut - mean[:, :, None]).mean(axis=2)))
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(width)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of paired integer rows, held within 64 bits."""
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if largest < 2**53:
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    exact = ((int(x) * int(y) for x, y in zip(a, b, strict=True)) for a, b in zip(q.tolist(), c.tolist(), strict=True))
    return np.array([min(HIGH, max(LOW, sum(x))) for x in exact], dtype=np.int64)


class Best:
    """The k best (score, smaller identifier) of every query of a block, as rows come by."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray, rotation: np.ndarray):
        self.ids, self.k, self.start, self.rotation = ids, k, floor, rotation
        self.score = np.full((len(ids), k), LOW, dtype=np.int64)
        self.who = np.full((len(ids), k), HIGH, dtype=np.int64)
        self.filled = np.zeros(len(ids), dtype=np.int64)
        self.parts = resolutions(q.shape[1])
        self.pairs = np.zeros(len(self.parts) + 1, dtype=np.int64)  # all pairs, then those left by each level
        self.widen(q)

    def widen(self, q: np.ndarray) -> None:
        self.q = q
        self.norms = np.sqrt(np.square(q).sum(axis=1))
        self.statistics = [segment_statistics(self.turned(q), p) for p in self.parts]

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Rotated rows; components beyond the rotation's width stay as they are."""
        n = len(self.rotation)
        return np.concatenate([x[:, :n] @ self.rotation, x[:, n:]], axis=1)

    def offer(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        own = self.filled[query] < self.k
        worth = own | (scores > self.score[query, -1]) | ((scores == self.score[query, -1]) & (ids < self.who[query, -1]))
        query, ids, scores = query[worth], ids[worth], scores[worth]
        if not len(query):
            return
        touched, back = np.unique(query, return_inverse=True)
        full = np.arange(self.k) < self.filled[touched][:, None]
        row = np.r_[np.repeat(np.arange(len(touched)), full.sum(axis=1)), back]
        score = np.r_[self.score[touched][full], scores]
        who = np.r_[self.who[touched][full], ids]
        order = np.lexsort((who, ~score, row))  # ~score orders downwards without overflow
        row, score, who = row[order], score[order], who[order]
        start = np.searchsorted(row, np.arange(len(touched)))
        rank = np.arange(len(row)) - start[row]
        keep = rank < self.k
        at = touched[row[keep]], rank[keep]
        self.score[at], self.who[at] = score[keep], who[keep]
        self.filled[touched] = np.minimum(self.k, np.bincount(row, minlength=len(touched)))

    def take(self, ids: np.ndarray, c: np.ndarray) -> None:
        """All rows of c against all queries of the block, in steps of bounded size."""
        step = max(self.k, PAIRS // max(1, len(self.ids)))
        for s in range(0, len(ids), step):
            self.step(ids[s : s + step], c[s : s + step])

    def step(self, ids: np.ndarray, c: np.ndarray) -> None:
        own = np.where(self.filled < self.k, -np.inf, self.score[:, -1].astype(np.float64))
        floor = np.maximum(own, self.start)
        sizes = np.sqrt(np.square(c).sum(axis=1))
        turned = self.turned(c)
        rows = np.arange(len(ids))
        near = ids[None, :] != self.ids[:, None]
        self.pairs[0] += int(near.sum())
        for level, (parts, of_queries) in enumerate(zip(self.parts, self.statistics, strict=True), start=1):
            mine = segment_statistics(turned[rows], parts)
            slack = 1 + 1e-9 * np.outer(self.norms, sizes[rows])  # rounding of the bounds
            near &= of_queries @ mine.T + slack >= floor[:, None]
            self.pairs[level] += int(near.sum())
            wanted = near.any(axis=0)
            if not wanted.any():
                return
            rows, near = rows[wanted], near[:, wanted]
        query, at = np.nonzero(near)
        row = rows[at]
        for s in range(0, len(query), 100_000):
            part = slice(s, s + 100_000)
            self.offer(query[part], ids[row[part]], products(self.q[query[part]], c[row[part]]))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: no null vector, no null or non-finite component, an identifier."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return narrow.where("vec_id is not null and x is not null").where(~F.exists("x", bad))


def _ragged(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = batch.column("x")
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    return batch.column("vec_id").to_numpy(), column.flatten().to_numpy(zero_copy_only=False), sizes


def query_blocks(queries: DataFrame, block: int) -> Iterator[tuple[np.ndarray, list]]:
    """Blocks of at most ``block`` queries, streamed from the stored table partition by partition."""
    ids, held = [], []
    for r in queries.toLocalIterator():
        ids.append(r.vec_id)
        held.append(r.x)
        if len(ids) == block:
            yield np.array(ids, dtype=np.int64), held
            ids, held = [], []
    if ids:
        yield np.array(ids, dtype=np.int64), held


def _matrix(lists: list, width: int, scale: float) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return integer_rows(np.array([x for v in lists for x in v], dtype=np.float64), sizes, max(width, int(sizes.max(initial=0))), scale)


def sampled_rows(rows: DataFrame, n: int = SAMPLE) -> tuple[np.ndarray, list]:
    """The rows of the smallest hashes of identifier and vector, ``n`` at most: identifiers and vectors."""
    found = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(n).collect()
    return np.array([r.vec_id for r in found], dtype=np.int64), [r.x for r in found]


def first_floors(ids: np.ndarray, q: np.ndarray, seen: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """A score that k rows of the sample reach, for each query; none where the sample holds fewer others."""
    out = np.full(len(ids), -np.inf)
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    for s in range(0, len(ids), 1024):
        scores = q[s : s + 1024] @ c.T
        scores[ids[s : s + 1024, None] == seen[None, :]] = -np.inf
        if scores.shape[1] >= k:
            out[s : s + 1024] = np.partition(scores, -k, axis=1)[:, -k]
    out -= 1 + 1e-9 * np.abs(np.where(np.isfinite(out), out, 0))  # rounding of products beyond 2^53
    return out


def top_k(
    vectors: DataFrame,
    k: int = 10,
    every: int = 100,
    scale: float = 1024.0,
    block: int = BLOCK,
    sample: int = SAMPLE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    survival: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products.

    Queries are the rows whose identifier ``every`` divides; candidates are all rows but those of the
    query's own identifier. Components become floor(scale * x). Ties go to the smaller identifier.
    Vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without an
    identifier. Shorter vectors count as padded with zeros; scores beyond 64 bits stop at its ends. Rows
    that repeat an identifier count one by one. Without queries or candidates the result is empty.
    Other columns are not read. ``survival`` gives level and pairs instead: all pairs (level 0) and
    those that the bounds of each level left.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    text_batches(spark, 10_000)
    rows = usable(vectors, id_col, vector_col)
    queries = stash(rows.where(F.col("vec_id") % every == 0), "queries")
    seen, lists = sampled_rows(rows, sample)
    near = _matrix(lists, 0, scale)
    rotation = fitted_rotation(near)
    path = new_path(spark, "topk")
    kind = "level int, pairs long" if survival else "query_id long, vec_id long, score long, query_row long"
    names = [x.split(" ")[0] for x in kind.split(", ")]
    number = 0
    for ids, lists in query_blocks(queries, block):
        q = _matrix(lists, near.shape[1], scale)
        shared = spark.sparkContext.broadcast((ids, q, first_floors(ids, q, seen, near, k), rotation))  # ``block`` rows at most

        def run(batches, shared=shared):
            ids, q, floor, rotation = shared.value
            best = Best(ids, q, k, floor, rotation)
            for batch in batches:
                if not batch.num_rows:
                    continue
                who, flat, sizes = _ragged(batch)
                c = integer_rows(flat, sizes, max(int(sizes.max(initial=0)), best.q.shape[1]), scale)
                if c.shape[1] > best.q.shape[1]:
                    best.widen(np.pad(best.q, ((0, 0), (0, c.shape[1] - best.q.shape[1]))))
                best.take(who, c)
            if survival:
                columns = np.arange(len(best.pairs)), best.pairs
                types = [pa.int32(), pa.int64()]
            else:
                row, at = np.nonzero(np.arange(k) < best.filled[:, None])
                columns = ids[row], best.who[row, at], best.score[row, at], row
                types = [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, types, strict=True)], names=names)

        part = rows.mapInArrow(run, kind)
        if not survival:
            order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
            part = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part.write.parquet(f"{path}/block={number}")  # the next block begins when this one is stored
        shared.destroy()
        number += 1
    if survival:
        empty = spark.createDataFrame([], kind)
        found = spark.read.schema(kind + ", block int").parquet(path) if number else empty
        return found.groupBy("level").agg(F.sum("pairs").alias("pairs"))
    if not number:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(kind + ", rank int, block int").parquet(path)
    return found.select("query_id", "rank", "vec_id", "score")
