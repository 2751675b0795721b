"""Operator 11, hard-negative mining by dual-tree search: a tree over anchors and one over candidates.

The trees' upper levels are one: a binary split of space fitted on a bounded sample, of which labels are the
first. Rows are sorted by (label, cell) over ranges, so neighbours lie together, and cut into groups of bounded
size: a group of candidates and a block of anchors are nodes, each with its centre, radius, labels and, for anchors,
the scores still needed. Inside a task each of them gets the lower levels, split at medians down to leaves.

For a pair of nodes every inner product lies within centre product +- (|ca| rc + |cc| ra + ra rc). A pair whose
interval can't reach what any of its anchors needs, that lies above what they may take, or whose labels can't
match is left out with all its anchors at once: first between blocks and groups, by a join of their few numbers, so
that only blocks of use travel; then between the nodes of both trees in the task. Leaf pairs are scored exactly.

Two searches run: the first finds each anchor's positives, the second, for each positive, the best negatives
within its score window. Every anchor begins with what a bounded sample gives it, so that intervals bite from
the first pair on; samples steer the search alone, and no row is left unscored that could be in the result.
A task holds one group and one block at a time; many blocks of one group are shared out over slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_side, stash
from .tokenizer_files import text_batches
from .topk import products

#: Rows and components of a group of candidates, rows of a block of anchors, at most.
GROUP, COMPONENTS, BLOCK = 8192, 1 << 20, 256
#: Rows of a leaf: candidates, anchors.
LEAF, ANCHOR_LEAF = 256, 32
#: Blocks that meet a group in one slice, about.
SLICE = 32
#: Rows and components of the sample that fits the upper splits and gives the first floors, at most; splits deep.
SAMPLE, SAMPLE_COMPONENTS, DEPTH = 4096, 1 << 19, 6
NONE = -(1 << 62)


def _wide(x: np.ndarray) -> np.ndarray:
    """Integers as float32 where that is exact: half the bytes."""
    return x.astype("<f4") if np.abs(x).max(initial=0) < 2**24 else x.astype("<f8")


def _thin(data: bytes, rows: int, width: int) -> np.ndarray:
    kind = "<f4" if len(data) == 4 * rows * width else "<f8"
    return np.frombuffer(data, dtype=kind).reshape(rows, width).astype(np.float64)


def integer_matrix(column, width: int, scale: float) -> np.ndarray:
    """floor(scale * x) of an Arrow column of lists, zero-padded to ``width``."""
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    return out


def _direction(x: np.ndarray) -> np.ndarray:
    """From one far point to another: the line that a node is split along."""
    a = x[np.argmax(np.square(x - x.mean(axis=0)).sum(axis=1))]
    b = x[np.argmax(np.square(x - a).sum(axis=1))]
    size = np.linalg.norm(b - a)
    return (b - a) / size if size else b - a


def fitted_splits(x: np.ndarray, depth: int = DEPTH) -> list[tuple[np.ndarray, float]]:
    """Directions and medians of a binary tree's inner nodes in heap order, fitted on the sample."""
    splits, nodes = [], [np.arange(len(x))]
    for _ in range(depth):
        below = []
        for rows in nodes:
            line = _direction(x[rows]) if len(rows) > 1 else np.zeros(x.shape[1])
            along = x[rows] @ line
            cut = float(np.median(along)) if len(rows) else 0.0
            splits.append((line, cut))
            below += [rows[along <= cut], rows[along > cut]]
        nodes = below
    return splits


def cells(x: np.ndarray, splits: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """Each row's leaf of the upper splits, from left to right."""
    at = np.zeros(len(x), dtype=np.int64)
    lines, cuts = np.array([s[0] for s in splits]).reshape(len(splits), -1), np.array([s[1] for s in splits])
    depth = (len(splits) + 1).bit_length() - 1
    for _ in range(depth):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, lines[at]) > cuts[at])
    return at - len(splits)


@dataclass
class Tree:
    """Nodes over a permutation of rows: children, spans, balls and labels."""

    order: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    left: np.ndarray  # the first child, the second follows; 0 for leaves
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray


def ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A centre and a radius that holds every row, rounding included."""
    centre = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
    far = float(np.sqrt(np.square(x - centre).sum(axis=1).max(initial=0.0)))
    return centre, far * (1 + 1e-9) + 1e-9 * (1 + float(np.abs(x).max(initial=0)))


def built(x: np.ndarray, labels: np.ndarray, leaf: int) -> Tree:
    order = np.lexsort((np.arange(len(x)), labels))
    nodes, left, at = [(0, len(x))], [0], 0
    while at < len(nodes):
        a, b = nodes[at]
        if b - a > leaf:
            rows = order[a:b]
            if labels[rows[0]] != labels[rows[-1]]:
                cut = int(np.searchsorted(labels[rows], labels[rows[(b - a) // 2]]))  # between labels first
                cut = cut or int(np.searchsorted(labels[rows], labels[rows[0]], side="right"))
            else:
                along = x[rows] @ _direction(x[rows])
                rows = rows[np.argsort(along, kind="stable")]
                order[a:b], cut = rows, (b - a) // 2
            left[at] = len(nodes)
            nodes += [(a, a + cut), (a + cut, b)]
            left += [0, 0]
        at += 1
    balls = [ball(x[order[a:b]]) for a, b in nodes]
    spans = np.array(nodes, dtype=np.int64)
    return Tree(
        order, spans[:, 0], spans[:, 1], np.array(left), np.array([c for c, _ in balls]), np.array([r for _, r in balls]),
        np.array([labels[order[a:b]].min(initial=1 << 62) for a, b in nodes]), np.array([labels[order[a:b]].max(initial=NONE) for a, b in nodes]),
    )


def intervals(ca: np.ndarray, ra: np.ndarray, cc: np.ndarray, rc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of paired balls, with room for rounding."""
    na, nc = np.linalg.norm(ca, axis=1), np.linalg.norm(cc, axis=1)
    middle, room = np.einsum("ij,ij->i", ca, cc), na * rc + nc * ra + ra * rc
    room += 1 + 1e-9 * (na + ra) * (nc + rc)
    return middle - room, middle + room


class Kept:
    """The k best (score, smaller identifier) of many places."""

    def __init__(self, places: int, k: int):
        self.k = k
        self.score = np.full((places, k), NONE, dtype=np.int64)
        self.who = np.full((places, k), 1 << 62, dtype=np.int64)
        self.filled = np.zeros(places, dtype=np.int64)

    def offer(self, place: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(place):
            return
        touched, back = np.unique(place, return_inverse=True)
        full = np.arange(self.k) < self.filled[touched][:, None]
        row = np.r_[np.repeat(np.arange(len(touched)), full.sum(axis=1)), back]
        score, who = np.r_[self.score[touched][full], scores], np.r_[self.who[touched][full], ids]
        sort = np.lexsort((who, -score, row))
        row, score, who = row[sort], score[sort], who[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(touched)))[row]
        keep = rank < self.k
        at = touched[row[keep]], rank[keep]
        self.score[at], self.who[at] = score[keep], who[keep]
        self.filled[touched] = np.minimum(self.k, np.bincount(row, minlength=len(touched)))

    def worst(self) -> np.ndarray:
        return np.where(self.filled == self.k, self.score[:, -1], NONE)


class Search:
    """One block of anchors against groups of candidates. ``windows``: lowest and highest score each place may take.

    A place is (anchor, window); without windows (the search of positives) an anchor is one place of no bounds."""

    def __init__(self, ids, labels, x, floors, windows, k: int):
        self.ids, self.labels, self.x, self.k = ids, labels, x, k
        self.same = windows is None
        self.floors = floors  # (anchors, windows)
        n, w = floors.shape
        self.low, self.high = (np.full((n, w), NONE), np.full((n, w), -NONE)) if windows is None else windows
        self.tree = built(x, labels, ANCHOR_LEAF)

    def needs(self, kept: Kept) -> np.ndarray:
        return np.maximum(np.maximum(self.floors, self.low), kept.worst().reshape(self.floors.shape))

    def fits(self, low_a, high_a, low_c, high_c):
        """Whether nodes of these labels may hold a pair of use."""
        if self.same:
            return (low_a <= high_c) & (low_c <= high_a)
        return ~((low_a == high_a) & (low_c == high_c) & (low_a == low_c))

    def against(self, ids, labels, x, tree: Tree, counts: np.ndarray | None = None) -> Kept:
        kept, mine = Kept(self.floors.size, self.k), self.tree
        need, most = self.needs(kept).min(axis=1), self.high.max(axis=1)
        span = lambda v, how, t=mine: np.array([how(v[t.order[a:b]]) if b > a else 0 for a, b in zip(t.start, t.stop)])
        floor, ceiling = span(need, np.min), span(most, np.max)
        pairs, done = np.zeros((1, 2), dtype=np.int64), []
        while len(pairs):
            a, c = pairs.T
            lower, upper = intervals(mine.centre[a], mine.radius[a], tree.centre[c], tree.radius[c])
            good = (upper >= floor[a]) & (lower <= ceiling[a]) & self.fits(mine.low[a], mine.high[a], tree.low[c], tree.high[c])
            a, c, upper = a[good], c[good], upper[good]
            leaf = (mine.left[a] == 0) & (tree.left[c] == 0)
            done.append(np.c_[a[leaf], c[leaf], upper[leaf]])
            a, c = a[~leaf], c[~leaf]
            # The wider of both is split, a leaf never.
            split_c = (tree.left[c] > 0) & ((mine.left[a] == 0) | (tree.radius[c] >= mine.radius[a]))
            pairs = np.concatenate(
                [np.c_[a[split_c], tree.left[c[split_c]] + i] for i in (0, 1)] + [np.c_[mine.left[a[~split_c]] + i, c[~split_c]] for i in (0, 1)]
            )
        leaves = np.concatenate(done)
        if counts is not None:  # pairs of rows: all, and those in leaf pairs that are left
            a, c = leaves[:, :2].astype(np.int64).T
            counts += [len(self.ids) * len(ids), int(((mine.stop - mine.start)[a] * (tree.stop - tree.start)[c]).sum())]
        by = {}
        for a, c, upper in leaves:
            by.setdefault(int(c), []).append((int(a), upper))
        for c in sorted(by, key=lambda c: -max(u for _, u in by[c])):
            need = self.needs(kept)
            rows = [mine.order[mine.start[a] : mine.stop[a]] for a, u in by[c]]
            rows = np.concatenate([r for r, (_, u) in zip(rows, by[c]) if u >= need[r].min(initial=1 << 62)] or [np.zeros(0, dtype=np.int64)])
            if len(rows):
                self.score(kept, rows, tree.order[tree.start[c] : tree.stop[c]], ids, labels, x, need)
        return kept

    def score(self, kept: Kept, rows, at, ids, labels, x, need) -> None:
        q, c = self.x[rows], x[at]
        if np.linalg.norm(q, axis=1).max() * np.linalg.norm(c, axis=1).max(initial=0) < 2**52:
            scores = (q @ c.T).astype(np.int64)
        else:
            i, j = np.divmod(np.arange(len(rows) * len(at)), len(at))
            scores = products(q[i], c[j]).reshape(len(rows), len(at))
        equal = self.labels[rows][:, None] == labels[at][None, :]
        usable = equal & (self.ids[rows][:, None] != ids[at][None, :]) if self.same else ~equal
        for w in range(need.shape[1]):
            here = usable & (scores >= need[rows, w][:, None]) & (scores <= self.high[rows, w][:, None])
            i, j = np.nonzero(here)
            kept.offer(rows[i] * need.shape[1] + w, ids[at[j]], scores[i, j])


PACK = "node long, n int, keys binary, ids binary, labels binary, data binary, centre array<double>, radius double, low_label long, high_label long"


def _packs(batches, most: int, width: int, scale: float) -> Iterator[dict]:
    """Rows in order as nodes of at most ``most`` rows; one that is an eighth full ends where the label does."""
    from pyspark import TaskContext

    base, number, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

    def flush() -> Iterator[dict]:
        nonlocal number, held, size
        if size:
            ids, labels, x = (np.concatenate([h[i] for h in held]) for i in range(3))
            centre, radius = ball(x)
            # Keys tell rows apart that repeat an identifier.
            keys = ((base + number) << 14) + np.arange(size)
            yield {
                "node": base + number, "n": size, "keys": keys.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(),
                "labels": labels.astype("<i8").tobytes(), "data": _wide(x).tobytes(), "centre": centre, "radius": radius,
                "low_label": int(labels.min()), "high_label": int(labels.max()),
            }
            number += 1
        held, size = [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        x = integer_matrix(batch.column("x"), width, scale)
        edges = np.r_[0, np.flatnonzero(np.diff(labels)) + 1, len(ids)]
        for a, b in zip(edges[:-1], edges[1:]):
            if size >= max(1, most // 8) and held[-1][1][-1] != labels[a]:
                yield from flush()
            while a < b:
                step = min(b - a, most - size)
                held.append((ids[a : a + step], labels[a : a + step], x[a : a + step]))
                size, a = size + step, a + step
                if size == most:
                    yield from flush()
    yield from flush()


def _batches(rows: Iterator[dict], schema, most: int = 16):
    import pyarrow as pa

    held, some = [], False
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, some = [], True
    if held or not some:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _schema(kind: str):
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, types[t]) for n, t in (x.split(" ") for x in kind.split(", "))])


def _packed(rows: DataFrame, splits, most: int, width: int, scale: float, label: str) -> DataFrame:
    """Rows (vec_id, label, x) as stored nodes, sorted over ranges by label, cell and hash."""
    import pyarrow as pa

    shared = rows.sparkSession.sparkContext.broadcast(splits)  # of the bounded sample

    def route(batches):
        for batch in batches:
            at = cells(integer_matrix(batch.column("x"), width, scale), shared.value) if width else np.zeros(batch.num_rows, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=[*batch.schema.names, "cell"])

    kind = rows.schema["x"].dataType.simpleString()
    routed = rows.mapInArrow(route, f"vec_id long, label long, x {kind}, cell long")
    order = ["label", "cell", "hash", "uid"]
    routed = routed.withColumns({"hash": F.xxhash64("vec_id"), "uid": F.monotonically_increasing_id()})
    dealt = routed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "x")

    def pack(batches):
        yield from _batches(_packs(batches, most, width, scale), _schema(PACK))

    return stash(dealt.mapInArrow(pack, PACK), label)


def _unpack(row: dict, width: int):
    n = row["n"]
    ids, labels = (np.frombuffer(row[c], dtype="<i8") for c in ("ids", "labels"))
    return ids, labels, _thin(row["data"], n, width)


def _each(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


BLOCKS = PACK + ", floors binary, lows binary, highs binary, least long, most long"


def _with_floors(search_of, row: dict, sample, width: int, k: int) -> dict:
    """The block with what the sample gives its anchors to begin with."""
    ids, labels, x = _unpack(row, width)
    search = search_of(ids, labels, x)
    seen, of, c = sample
    kept = search.against(seen, of, c, built(c, of, LEAF)) if len(seen) else Kept(search.floors.size, k)
    floors = np.maximum(search.floors, kept.worst().reshape(search.floors.shape))
    return row | {
        "floors": floors.astype("<i8").tobytes(), "lows": search.low.astype("<i8").tobytes(), "highs": search.high.astype("<i8").tobytes(),
        "least": int(np.maximum(floors, search.low).min()), "most": int(search.high.max()),
    }


WORK = "part long, slice long, kind int, n int, keys binary, ids binary, labels binary, data binary, floors binary, lows binary, highs binary"
FOUND = "anchor long, anchor_id long, window int, score long, vec_id long"


def _searched(groups: DataFrame, blocks: DataFrame, same: bool, width: int, k: int, windows: int) -> DataFrame:
    """FOUND: what every group holds for the anchors of every block whose interval with it is of use, k a place at most."""
    g = groups.select("node", "centre", "radius", "low_label", "high_label")
    b = blocks.select(*[F.col(c).alias(f"b_{c}") for c in ("node", "centre", "radius", "low_label", "high_label", "least", "most")])
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    g = g.withColumn("norm", F.sqrt(dot("centre", "centre")))
    b = b.withColumn("b_norm", F.sqrt(dot("b_centre", "b_centre")))
    room = F.col("norm") * F.col("b_radius") + F.col("b_norm") * F.col("radius") + F.col("radius") * F.col("b_radius")
    room = room + 1 + (F.col("norm") + F.col("radius")) * (F.col("b_norm") + F.col("b_radius")) * 1e-9
    middle = dot("centre", "b_centre")
    if same:
        fits = (F.col("low_label") <= F.col("b_high_label")) & (F.col("b_low_label") <= F.col("high_label"))
    else:
        one = (F.col("low_label") == F.col("high_label")) & (F.col("b_low_label") == F.col("b_high_label"))
        fits = ~(one & (F.col("low_label") == F.col("b_low_label")))
    use = fits & (middle + room >= F.col("b_least")) & (middle - room <= F.col("b_most"))
    # One row a node and a few numbers in it: blocks of the stated anchors against groups of all rows.
    pairs = stash(g.join(small_side(b, "block-balls"), use).select(F.col("node").alias("part"), F.col("b_node").alias("node")), "node-pairs")
    slices = pairs.groupBy("part").agg(F.ceil(F.count("*") / SLICE).cast("long").alias("slices"))
    pairs = pairs.join(slices, "part").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")))
    names = [x.split(" ")[0] for x in WORK.split(", ")]
    none = F.lit(None).cast("binary")
    payload = groups.select(F.col("node").alias("part"), "n", none.alias("keys"), "ids", "labels", "data", *[none.alias(c) for c in ("floors", "lows", "highs")])
    mine = pairs.select("part", "slice").distinct().join(payload, "part").withColumn("kind", F.lit(0)).select(*names)
    theirs = pairs.join(blocks, "node").withColumn("kind", F.lit(1)).select(*names)
    work = mine.unionByName(theirs).repartition("part", "slice").sortWithinPartitions("part", "slice", "kind")

    def run(batches):
        import pyarrow as pa

        schema, at = _schema(FOUND), None
        yield pa.RecordBatch.from_pylist([], schema=schema)
        for row in _each(batches):
            if row["kind"] == 0:
                ids, labels, x = _unpack(row, width)
                tree, at = built(x, labels, LEAF), (row["part"], row["slice"])
                continue
            if (row["part"], row["slice"]) != at:
                raise ValueError("a block came without its group")
            a_ids, a_labels, a = _unpack(row, width)
            shape = lambda c: np.frombuffer(row[c], dtype="<i8").reshape(-1, windows)
            search = Search(a_ids, a_labels, a, shape("floors"), None if same else (shape("lows"), shape("highs")), k)
            kept = search.against(ids, labels, x, tree)
            place, rank = np.nonzero(np.arange(k) < kept.filled[:, None])
            who = place // windows
            keys = np.frombuffer(row["keys"], dtype="<i8")
            columns = keys[who], a_ids[who], (place % windows).astype(np.int32), kept.score[place, rank], kept.who[place, rank]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return work.mapInArrow(run, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def shifted_labels(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """``vectors`` with the label (label + 1) % ``labels`` where ``every`` divides vec_id."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.withColumn("label", label)


def mine_hard_negatives(
    vectors: DataFrame,
    positives: int = 5,
    negatives: int = 3,
    every: int = 50,
    scale: float = 256.0,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    group_rows: int = GROUP,
    block_rows: int = BLOCK,
    sample: int = SAMPLE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * x); a score is the integer inner product. Anchors are rows whose
    identifier ``every`` divides. An anchor's positives are its best ``positives`` rows of the same label and another
    identifier; each gets the best ``negatives`` rows of another label with low * positive_score <= 100 *
    negative_score <= high * positive_score. Higher scores come first, ties by smaller identifier. Vectors that are null
    or hold a null, NaN or infinite component take no part, nor do rows without identifier or label. Shorter
    vectors count as padded with zeros; scores beyond 62 bits are not held apart. Rows that repeat an identifier count one by one,
    as anchors too. A positive without negatives, or an anchor without positives, gives no row; nor does an empty
    table. Other columns are not read.
    """
    spark = vectors.sparkSession
    text_batches(spark, 4096)
    labelled = vectors.where(F.col(label_col).isNotNull())
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = labelled.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("x"))
    rows = rows.where("vec_id is not null and x is not null").where(~F.exists("x", lambda x: bad(x.cast("double"))))
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    most = max(16, min(sample, SAMPLE_COMPONENTS // max(1, width)))
    seen = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(most).collect()  # bounded: steers the search alone
    lists = [np.floor(scale * np.array(r.x, dtype=np.float64)) for r in seen]
    x = np.array([np.pad(v, (0, width - len(v))) for v in lists]).reshape(len(seen), width)
    ids, labels = (np.array([r[c] for r in seen], dtype=np.int64) for c in ("vec_id", "label"))
    splits = fitted_splits(x)
    shared = spark.sparkContext.broadcast((ids, labels, x))
    group_rows = max(16, min(group_rows, COMPONENTS // max(1, width)))
    groups = _packed(rows, splits, group_rows, width, scale, "candidates")
    anchors = _packed(rows.where(F.col("vec_id") % every == 0), splits, min(block_rows, group_rows), width, scale, "anchors")

    def first(batches):
        def search_of(i, y, v):
            return Search(i, y, v, np.full((len(i), 1), NONE), None, positives)

        yield from _batches((_with_floors(search_of, r, shared.value, width, positives) for r in _each(batches)), _schema(BLOCKS))

    blocks = stash(anchors.mapInArrow(first, BLOCKS), "anchor-blocks")
    found = _best(_searched(groups, blocks, True, width, positives, 1), positives)
    found = stash(found.select("anchor", "anchor_id", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    of_block = found.groupBy(F.shiftright("anchor", 14).alias("node")).agg(F.collect_list(F.struct("anchor", "window", "positive_score")).alias("p"))  # a block's
    told = of_block.select("node", *[F.col(f"p.{c}").alias(c) for c in ("anchor", "window", "positive_score")])
    told = anchors.join(told, "node")

    def second(batches):
        def windows_of(row):
            n = row["n"]
            lows, highs = np.full((n, positives), -NONE), np.full((n, positives), NONE)  # no window takes nothing
            for a, w, s in zip(row.pop("anchor"), row.pop("window"), row.pop("positive_score")):
                lows[a & 0x3FFF, w], highs[a & 0x3FFF, w] = -((-low * s) // 100), (high * s) // 100
            def search_of(i, y, v):
                return Search(i, y, v, np.full((n, positives), NONE), (lows, highs), negatives)

            return _with_floors(search_of, row, shared.value, width, negatives)

        yield from _batches((windows_of(r) for r in _each(batches)), _schema(BLOCKS))

    blocks = stash(told.select(*anchors.columns, "anchor", "window", "positive_score").mapInArrow(second, BLOCKS), "anchor-windows")
    hard = _best(_searched(groups, blocks, False, width, negatives, positives), negatives)
    hard = hard.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(hard, ["anchor", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
