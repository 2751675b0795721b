"""Iterative stratification: quotas against the greedy rule, whole splits against a plain version and the hash method."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import labels

SHARES = {"train": 0.6, "validation": 0.2, "test": 0.2}


def greedy(n, wanted):
    left, given = [round(w * 10**9) for w in wanted], [0] * len(wanted)
    for _ in range(n):
        f = max(range(len(left)), key=lambda f: (left[f], -f))
        left[f] -= 10**9
        given[f] += 1
    return given


def test_quotas_are_the_greedy_rule():
    rng = random.Random(4)
    for _ in range(300):
        wanted = [rng.uniform(-5, 30) if rng.random() < 0.7 else rng.randint(0, 9) for _ in range(rng.randint(1, 4))]
        n = rng.randint(0, 60)
        assert labels.quotas(n, wanted) == greedy(n, wanted)


def made(seed=3, n=400):
    rng = random.Random(seed)
    names = [f"l{k}" for k in range(12)]
    return [(i, sorted({names[min(11, int(rng.expovariate(0.3)))] for _ in range(rng.randint(0 if i % 40 == 0 else 1, 4))})) for i in range(n)]


def plain(rows, hashes):
    left, folds = dict(rows), list(SHARES)
    wanted = {x: [sum(x in v for v in left.values()) * SHARES[f] for f in folds] for v in left.values() for x in v}
    out = {}
    while any(left.values()):
        held = {}
        for v in left.values():
            for x in v:
                held[x] = held.get(x, 0) + 1
        label = min(held, key=lambda x: (held[x], x))
        mine = sorted((i for i, v in left.items() if label in v), key=lambda i: (hashes[i], i))
        given, at = greedy(len(mine), wanted[label]), 0
        for f, k in enumerate(given):
            for i in mine[at : at + k]:
                out[i] = folds[f]
                for x in left.pop(i):
                    wanted[x][f] -= 1
            at += k
    rest = sorted(left, key=lambda i: (hashes[i], i))
    given, at = greedy(len(rest), [len(rest) * SHARES[f] for f in folds]), 0
    for f, k in enumerate(given):
        out |= dict.fromkeys(rest[at : at + k], folds[f])
        at += k
    return out


def off(rows, split):
    """The labels' summed distance from their wanted counts."""
    total = 0.0
    for x in {x for _, v in rows for x in v}:
        mine = [split[i] for i, v in rows if x in v]
        total += sum(abs(mine.count(f) - len(mine) * s) for f, s in SHARES.items())
    return total


def test_as_a_plain_version_and_nearer_than_by_hash(spark):
    rows = made()
    items = spark.createDataFrame(rows, "handle long, labels array<string>").repartition(5)
    hashes = {r.handle: r.h for r in items.select("handle", T.portable_hash("42", F.col("handle")).alias("h")).collect()}
    got = {r.handle: r.split for r in labels.split_items(items, SHARES, max_tries=1, method="iterative")[0].collect()}
    assert got == plain(rows, hashes)
    by_hash = {r.handle: r.split for r in labels.split_items(items, SHARES, max_tries=1)[0].collect()}
    assert off(rows, got) < 0.5 * off(rows, by_hash)
    with pytest.raises(ValueError):
        labels.split_items(items, SHARES, method="other")


def test_groups_stay_whole(spark):
    rows = [(i, v, i // 3) for i, v in made(n=90)]
    items = spark.createDataFrame(rows, "handle long, labels array<string>, g long")
    got = labels.split_items(items, SHARES, max_tries=1, group_column="g", method="iterative")[0].collect()
    assert len({(r.g, r.split) for r in got}) == len({r.g for r in got}) > 20
