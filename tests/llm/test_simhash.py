import numpy as np
import pytest
import xxhash

from loomtext.llm import simhash


def plain_fingerprint(text, words=3):
    found = text.encode().lower().split()
    spans = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, most=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                parent[root(i)] = root(j)
    best = {}
    for i, x in enumerate(ids):
        best[root(i)] = min(best.get(root(i), x), x)
    return [best[root(i)] for i in range(len(ids))]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{i}É" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            base = out[rng.integers(0, len(out))].split(" ")
            for _ in range(rng.integers(0, 3)):
                base[rng.integers(0, len(base))] = str(rng.choice(words))
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choice(words, size=rng.integers(1, 160))))
    return out + ["", " \t", "One two", "one TWO", "x" * 3_000_000 + " a b c"]


@pytest.mark.parametrize("group_rows", [8, 8192])
def test_components_equal_brute_force(spark, group_rows):
    rows = list(enumerate(texts(150, 3), start=10))
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, fp string")
    found = {r.doc_id: r for r in simhash.near_duplicates(df, group_rows=group_rows).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    assert [int(found[i].fingerprint, 16) for i, _ in rows] == fps
    assert [found[i].component_id for i, _ in rows] == plain_components([i for i, _ in rows], fps)


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (2, "a"), (None, "b c")], "doc_id long, text string")
    found = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert len(found) == 5
    assert [x for x in found if x[1] == "0" * 16] == [("1", "0" * 16, 1), ("None", "0" * 16, 1)]
    assert sum(x[0] == "2" and x[2] == 2 for x in found) == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_tree_on_dense_and_sparse_groups():
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 2**64, size=3, dtype=np.uint64)[rng.integers(0, 3, 900)]
    for _ in range(5):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64))
    fp = np.unique(np.r_[fp, rng.integers(0, 2**64, size=60, dtype=np.uint64)])
    a, b = simhash.group_links(np.zeros(len(fp), dtype=np.int64), fp, 3)
    joined = dict(zip(a.tolist(), b.tolist(), strict=True))
    ids = fp.tolist()
    want = plain_components(ids, ids)
    have = [joined.get(x, x) for x in ids]
    assert len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have))


def test_components_with_a_hub_equal_union_find(spark):
    """A node with a third of all links, chains and a cycle: the smallest node of each component is found."""
    rng = np.random.default_rng(9)
    links = [(5000, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(200, 260)] + [(1, 2), (2, 3), (3, 1), (7, 7)]
    links += [(int(a), int(b)) for a, b in rng.integers(2000, 2600, (500, 2))]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in simhash.components(df, salts=8).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert simhash.components(df.limit(0)).count() == 0


def test_crowds_of_close_fingerprints_lose_no_link(spark):
    """Two crowds that dealing by bits can't part, and strays near one of them."""
    rng = np.random.default_rng(10)
    one, two = (int(x) for x in rng.integers(0, 2**64, 2, dtype=np.uint64))
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = {flip(one, int(rng.integers(0, 3))) for _ in range(120)} | {flip(two, int(rng.integers(0, 6))) for _ in range(150)}
    ids = sorted(fps)
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in ids], "fp long").selectExpr("fp as node", "fp")
    for most in (3, 6):
        links = simhash.similar_links(df, most, group_rows=16).collect()
        near = lambda x: x % 2**64
        assert all((near(r.a) ^ near(r.b)).bit_count() <= 64 for r in links)
        name = {x: x for x in ids}

        def top(x, name=name):
            while name[x] != x:
                x = name[x]
            return x

        for r in links:
            a, b = top(near(r.a)), top(near(r.b))
            name[max(a, b)] = min(a, b)
        assert [top(x) for x in ids] == plain_components(ids, ids, most)
