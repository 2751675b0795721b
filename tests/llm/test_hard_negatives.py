"""Hard negatives against brute force in plain numpy, with odd rows, ties, windows and nodes of every size."""

import numpy as np
import pytest

from loomtext.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cell string, node string, hash string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "c", "n", "h") for i, v, y in rows], SCHEMA)


def plain(rows, every=50, scale=256):
    ok = [(i, [int(np.floor(scale * float(np.float32(c)))) for c in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, v, y in ok:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, z) for j, w, z in ok if j != i)
        mine = [(j, -s) for s, j, z in scored if z == y][:5]
        for p, ps in mine:
            hard = [(j, -s) for s, j, z in scored if z != y and 50 * ps <= 100 * -s <= 95 * ps][:3]
            out += [(i, p, r, n, ps, s) for r, (n, s) in enumerate(hard, 1)]
    return sorted(out)


def clustered(seed, n, labels=4, width=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, width))
    return [(k, [float(c) for c in middles[rng.integers(6)] + rng.normal(size=width) * 0.4], int(rng.integers(labels))) for k in range(n)]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"group_rows": 40, "block_rows": 3, "sample": 30}])
def test_as_brute_force(spark, settings):
    rows = clustered(1, 700)
    # Ties and hot rows: one vector many times, a zero one, repeated identifiers, odd ones that take no part.
    rows += [(1000 + k, rows[50][1], k % 2) for k in range(60)]
    rows += [(2000 + 25 * k, [0.0] * 12, 1) for k in range(4)] + [rows[100], rows[7], (rows[7][0], rows[8][1], 2)]
    rows += [(3000, None, 1), (3050, [1.0, None], 1), (3100, [float("nan")] * 12, 0), (3150, [float("inf")] * 12, 0), (3200, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(3250, [2.0, 1.0], 1), (3300, [], 2)]
    got = found(H.mine_hard_negatives(table(spark, rows), every=25, **settings))
    want = plain(rows, every=25)
    assert got == want and len(want) > 200


def test_negative_scores_and_large_ones(spark):
    rows = [(k, [-1.0 if k % 2 else 1.0, float(k % 5)], k % 2) for k in range(40)] + [(100 + k, [2e6 - 4e4 * k, 3e6 + 1e4 * k], k % 2) for k in range(20)]
    rows += [(200 + k, [-1.0], 5 + k) for k in range(2)]
    assert found(H.mine_hard_negatives(table(spark, rows), every=10)) == plain(rows, every=10)


def test_empty_and_single(spark):
    none = H.mine_hard_negatives(table(spark, []).limit(0))
    assert none.count() == 0 and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert H.mine_hard_negatives(table(spark, [(50, [1.0], 1)])).count() == 0
    shifted = {r.vec_id: r.label for r in H.shifted_labels(table(spark, [(7, [1.0], 9), (8, [1.0], 9), (14, [1.0], None)])).collect()}
    assert shifted == {7: 0, 8: 9, 14: None}


def test_intervals_hold_and_prune():
    """Every product lies within its nodes' interval; on clustered vectors most node pairs go unscored."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(8, 16)) * 500
    x = np.floor(np.concatenate([m + rng.normal(size=(500, 16)) * 20 for m in middles]))
    labels = np.repeat(np.arange(8), 500)
    tree, small = H.built(x, labels, 256), H.built(x[::40], labels[::40], 32)
    for a in range(len(small.start)):
        rows = x[::40][small.order[small.start[a] : small.stop[a]]]
        for c in range(len(tree.start)):
            s = rows @ x[tree.order[tree.start[c] : tree.stop[c]]].T
            lower, upper = H.intervals(small.centre[[a]], small.radius[[a]], tree.centre[[c]], tree.radius[[c]])
            assert lower[0] <= s.min() and s.max() <= upper[0]
    ids = np.arange(len(x))
    mixed = ids % 5  # labels that say nothing of place: only intervals prune
    search = H.Search(ids[::40], mixed[::40], x[::40], np.full((100, 1), H.NONE), None, 5)
    kept = search.against(ids, mixed, x, H.built(x, mixed, 64))
    again = H.Search(ids[::40], mixed[::40], x[::40], kept.worst()[:, None], None, 5)
    counts = np.zeros(2, dtype=np.int64)
    same = again.against(ids, mixed, x, H.built(x, mixed, 64), counts)
    assert (same.score == kept.score).all() and (same.who == kept.who).all() and counts[1] < 0.5 * counts[0]
