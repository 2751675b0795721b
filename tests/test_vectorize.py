"""Counts, totals and weights of texts that stay in their rows."""

import re
from collections import Counter

import pytest

from loomtext.operators import vectorize

TEXTS = [(1, "the cat saw the cat and the dog"), (2, ""), (3, None), (4, "a dog; the dog"), (5, "dog dog dog bird")]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_counts_and_weights_need_no_exchange(spark):
    texts = spark.createDataFrame(TEXTS, "handle long, text string")
    counts = vectorize.term_counts(texts)
    assert "Exchange" not in _plan(counts)
    model = vectorize.fit_totals("bm25", vectorize.term_totals(texts), 5)
    weights = model.transform_texts(texts)
    assert "Exchange" not in _plan(weights) and "Window" not in _plan(weights)


@pytest.mark.parametrize("held", [3, 1 << 19])
@pytest.mark.parametrize("rows", [TEXTS, [*TEXTS, (1, "the cat"), (None, "dog"), (None, "bird dog")]])
def test_totals_are_the_sums_of_all_counts(spark, monkeypatch, held, rows):
    monkeypatch.setattr(vectorize, "HELD_TERMS", held)
    want: dict = {}
    for k, t in rows:
        w = re.findall(r"\w{2,}", (t or "").lower())
        want.setdefault(k, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    texts = spark.createDataFrame(rows, "handle long, text string").coalesce(1)
    counts = {(r.handle, r.term): r.tf for r in vectorize.term_counts(texts).collect()}
    assert counts == {(k, t): n for k, c in want.items() for t, n in c.items()}
    df, tf = Counter(t for c in want.values() for t in c), sum(want.values(), Counter())
    assert {r.term: (r.df, r.corpus_tf) for r in vectorize.term_totals(texts).collect()} == {t: (df[t], tf[t]) for t in df}


@pytest.mark.parametrize("kind", ["bow", "tfidf", "bm25"])
@pytest.mark.parametrize("rows", [TEXTS, [*TEXTS, (1, "the cat")]])
def test_weights_of_texts_are_those_of_their_counts(spark, kind, rows):
    texts = spark.createDataFrame(rows, "handle long, text string")
    model = vectorize.fit(kind, vectorize.term_counts(texts), 5, 6)
    of = lambda df: {(r.handle, r.term): pytest.approx(r.weight, abs=1e-12) for r in df.collect()}
    assert of(model.transform_texts(texts)) == {k: v.expected for k, v in of(model.transform(vectorize.term_counts(texts))).items()}
    best = of(model.transform_texts(texts, top=2))
    for handle in {h for h, _ in best}:
        every = sorted((v.expected for (h, _), v in of(model.transform_texts(texts)).items() if h == handle), reverse=True)
        assert sorted((v.expected for (h, _), v in best.items() if h == handle), reverse=True)[:2] == every[:2]


def test_classifier_reads_stored_vectors(spark, monkeypatch):
    """Every step of a fit reads the vectors; texts are not cut into terms again."""
    from loomtext.operators import classify
    from loomtext.plans import q_dense

    class Stop(Exception):
        pass

    def seen(features, *_, **__):
        assert "MapInArrow" not in _plan(features)
        raise Stop

    monkeypatch.setattr(classify, "fit_one_vs_rest", seen)
    with pytest.raises(Stop):
        q_dense.sparse_classifier(spark, "/root/testdata/sf0.001")


def test_classifier_is_calibrated_on_items_of_its_own(spark, monkeypatch):
    """Thresholds by label come from items that are neither fitted nor measured; these scores never reach 0.5."""
    from pyspark.sql import functions as F

    from loomtext.functions.text import unit_hash
    from loomtext.operators import classify, scores
    from loomtext.plans import q_dense

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen, calibrate, apply = {}, scores.calibrate, scores.apply_thresholds
    of = lambda rows: {r.handle for r in rows.select("handle").distinct().collect()}

    class Model:
        score_kind = "probabilities"

        def scores(self, features):
            rows = features.select("handle").crossJoin(d.select(F.col("lang").alias("label")).distinct())
            own = rows.join(d.select(F.col("doc_id").alias("handle"), "lang"), "handle")
            return own.select("handle", "label", ((F.col("lang") == F.col("label")).cast("int") * 0.2 + unit_hash("s", F.col("handle"), F.col("label")) * 0.15).alias("score"))

    def calibrated(rows, *args):
        seen["calibration"], seen["told"] = of(rows), calibrate(rows, *args)
        return seen["told"]

    def applied(rows, thresholds):
        seen["test"], seen["given"] = of(rows), thresholds
        return apply(rows, thresholds)

    monkeypatch.setattr(classify, "fit_one_vs_rest", lambda features, truth, name: seen.update(train=of(features) & of(truth)) or Model())
    monkeypatch.setattr(scores, "calibrate", calibrated)
    monkeypatch.setattr(scores, "apply_thresholds", applied)
    found = q_dense.sparse_classifier(spark, "/root/testdata/sf0.001").first()
    parts = [seen[s] for s in ("train", "calibration", "test")]
    assert all(parts) and sum(map(len, parts)) == d.count() == len(set.union(*parts))
    assert seen["given"] is seen["told"] and found.n_items == len(seen["test"]) and found.f1_micro > 0.9
    assert calibrate(d.select("lang").limit(0).selectExpr("lang label", "0.5D score", "1 y"), "probabilities", "per_label_threshold") == 0.5


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2), (2, 2), (2, 3), (1, 4)])
def test_rows_are_counted_as_arrays(ngrams):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = [[], ["aa"], ["aa"] * 9, [], *[[f"w{i}" for i in rng.integers(0, 6, n)] for n in rng.integers(0, 30, 40)], []]
    batches = [pa.RecordBatch.from_pydict({"k": list(range(a, b)), "w": pa.array(rows[a:b], pa.list_(pa.string()))}) for a, b in ((0, 3), (3, 4), (4, 45))]
    found = {}
    pieces = list(vectorize._pieces([b.slice(0) for b in batches], 25))
    assert all(p.num_rows == 1 or sum(map(len, p.column("w").to_pylist())) <= 25 for p in pieces) and any(p.num_rows > 1 for p in pieces)
    for piece in pieces:
        names, row, gram, n = vectorize._counted(piece.column("w"), *ngrams)
        assert len(set(names.to_pylist())) == len(names)
        for r, g, c in zip(row.tolist(), gram.tolist(), n.tolist(), strict=True):
            key = piece.column("k")[r].as_py(), names[g].as_py()
            assert key not in found
            found[key] = c
    want = Counter((k, " ".join(w[i : i + n])) for k, w in enumerate(rows) for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(w) - n + 1))
    assert found == want
