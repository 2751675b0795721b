"""Near copies by wide fingerprints, held against all pairs at the exact similarity."""

import numpy as np

from loomtext.llm.shared import table
from loomtext.llm.simhash import drop_near_duplicates, majority, similar_documents, spread_bits

from .test_simhash import texts


def plain_set(text, words=5):
    found = text.encode().lower().split()
    return {b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)} or {b" ".join(found)}


def pairs_of(rows, least):
    """All pairs of rows (numbers) at a similarity of ``least`` or more."""
    sets, out = [plain_set(t) for _, t in rows], []
    for i in range(len(rows)):
        for j in range(i):
            if min(len(sets[i]), len(sets[j])) >= least * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if both >= least * (len(sets[i]) + len(sets[j]) - both):
                    out.append((i, j))
    return out


def joined(n, pairs):
    name = list(range(n))
    for i, j in pairs:
        a, b = name[i], name[j]
        name = [min(a, b) if x in (a, b) else x for x in name]
    return name


def edited(rng, copies, words=300, edits=0.01):
    base = [f"v{i}" for i in rng.integers(0, 2000, words)]
    return [" ".join(x if rng.random() > edits else f"n{rng.integers(10**6)}" for x in base) for _ in range(copies)]


def test_sums_of_bits():
    h = np.random.default_rng(3).integers(0, 2**64, 5000, dtype=np.uint64)
    for n in (0, 1, 2, 3, 7, 300, 5000):
        bits = np.unpackbits(spread_bits(h[:n], 2, 32).astype(">u8").view(np.uint8).reshape(n, 256), axis=1).sum(axis=0, dtype=np.int64)
        assert (np.packbits(bits * 2 > n) == majority(h[:n], 2, 32).astype(">u8").view(np.uint8)).all()


def test_pairs_link_and_others_do_not(spark):
    rng = np.random.default_rng(8)
    rows = texts(100, 4) + [t for _ in range(20) for t in edited(rng, 4)] + edited(rng, 60, 400, 0.008)
    rows = list(enumerate(rows, start=10))
    df = spark.createDataFrame([(i, t, 1, 2, "w") for i, t in rows], "doc_id long, text string, fp int, node int, wide string")
    for group_rows in (4096, 24):
        found = {r.doc_id: r.component_id for r in similar_documents(df, group_rows=group_rows).collect()}
        assert len(found) == len(rows)
        sure = pairs_of(rows, 0.84)
        assert len(sure) > 300
        assert np.mean([found[rows[i][0]] == found[rows[j][0]] for i, j in sure]) > 0.99
        least = joined(len(rows), pairs_of(rows, 0.72))
        for k, (i, _) in enumerate(rows):  # nobody joins without a chain of links that are nearly as similar
            assert least[k] == least[found[i] - 10]
    kept = sorted(r.doc_id for r in drop_near_duplicates(df).collect())
    assert kept == sorted(set(found.values()))


def test_lightly_edited_copies_of_the_tables_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").dropDuplicates(["text"])
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    pairs = pairs_of(rows, 0.8)
    got = drop_near_duplicates(docs)
    left = {r.doc_id for r in got.collect()}
    assert got.columns == docs.columns and len(pairs) >= 5
    gone = {rows[i][0] for i, _ in pairs}  # rows are in order of their identifiers, so the second of a pair is the smaller
    assert len(gone - left) >= 0.95 * len(gone)
    assert {i for i, _ in rows} - left <= {rows[i][0] for i, _ in pairs_of(rows, 0.74)}


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (3, "A"), (None, "b c"), (2, "a")], "doc_id long, text string")
    found = sorted((str(r.doc_id), str(r.component_id)) for r in similar_documents(df).collect())
    assert found == sorted([("1", "1"), ("None", "1"), ("2", "2"), ("2", "2"), ("3", "2"), ("None", "None")])
    # Rows that repeat a staying identifier stay, once for each text.
    assert sorted(str(r.doc_id) for r in drop_near_duplicates(df).collect()) == ["1", "2", "None", "None"]
    assert similar_documents(df.limit(0)).count() == 0 and drop_near_duplicates(df.limit(0)).count() == 0
