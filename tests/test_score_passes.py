"""Metrics read their rows from stored tables, a bounded number of times."""

import numpy as np
import pytest

from loomtext.operators import percentiles, scores


def test_later_passes_read_only_open_parts(spark, monkeypatch):
    stored = []
    keep = percentiles.keep
    monkeypatch.setattr(percentiles, "keep", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    values = np.random.default_rng(1).random(20_000)
    rows = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = percentiles.exact_percentiles(rows, "v", [0.1, 0.5])[None]
    assert np.allclose(found, np.quantile(values, [0.1, 0.5]), rtol=1e-14)
    assert stored[0].count() == 20_000 and all(df.count() < 100 for df in stored[1:])


@pytest.mark.parametrize("kind", ["random", "ties", "one", "null"])
def test_average_precision_of_odd_scores(spark, kind):
    rng = np.random.default_rng(3)
    s = {"random": rng.random(800), "ties": rng.integers(0, 4, 800) / 3, "one": np.ones(800), "null": np.r_[rng.random(700), [np.nan] * 100]}[kind]
    y = (rng.random(800) < 0.3).astype(int)
    rows = [("a", None if kind == "null" and np.isnan(v) else float(v), int(t)) for v, t in zip(s, y)]
    df = spark.createDataFrame(rows, "label string, score double, y int")
    place = np.where(np.isnan(s), -1.0, s)
    want = sum((y[place >= p].sum() / (place >= p).sum()) * y[place == p].sum() for p in set(place)) / y.sum()
    assert scores.average_precision(df).first()["average_precision"] == pytest.approx(want, abs=1e-12)


def test_f1_needs_no_items(spark):
    rows = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 0, 0), (2, "a", 0, 1), (2, "b", 0, 0)], "handle long, label string, y int, pred int")
    found = scores.f1_metrics(rows)
    assert "handle" not in found._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
    assert tuple(found.first()) == tuple(scores.multilabel_metrics(rows).select("f1_macro", "f1_micro").first())
    assert {(r.label, r.support, r.f1) for r in scores.label_f1(rows).collect()} == {(r.label, r.support, r.f1) for r in scores.per_label(rows.withColumn("score", rows.pred / 2)).collect()}
    told = {r.metric: r.estimate for r in scores.bootstrap_intervals(rows, 8).collect()}
    assert told == pytest.approx({"f1_macro": found.first()[0], "f1_micro": found.first()[1]})


@pytest.mark.parametrize("range_rows", [1, 7, 100, 1 << 19])
def test_ranges_of_any_size_give_the_same_precision(spark, monkeypatch, range_rows):
    """Labels of very different size, frequent scores, odd numbers and no label at all; no range is long."""
    rng = np.random.default_rng(8)
    rows = [(label, float(s), int(t)) for label, n in (("a", 900), ("b", 60), ("c", 1), (None, 300)) for s, t in zip(rng.integers(0, 400, n) / 401, rng.random(n) < 0.4)]
    rows += [("a", 0.25, int(i % 3 == 0)) for i in range(300)] + [("b", v, t) for v, t in ((float("nan"), 1), (float("nan"), 0), (float("inf"), 1), (float("-inf"), 1), (-0.0, 1), (None, 1), (None, 0))] + [("d", 0.5, 0)]
    monkeypatch.setattr(scores, "SORTED_ROWS", 50)
    df = spark.createDataFrame(rows, "label string, score double, y int").repartition(3)
    found = {r.label: r.average_precision for r in scores.average_precision(df, range_rows=range_rows).collect()}
    want = {}
    for label in {r[0] for r in rows}:
        own = [((-1, 0.0) if s is None else (1, 0.0) if s != s else (0, s), t) for x, s, t in rows if x == label]
        if any(t for _, t in own):
            want[label] = sum(sum(u for q, u in own if q >= p) / sum(q >= p for q, _ in own) for p, t in own if t) / sum(t for _, t in own)
    assert found == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    lists = scores._ranged(df, ("label",), scores._edges(df, ("label",), range_rows))
    assert "explode" not in _plan(lists) and all(sorted(set(r.scores)) == r.scores for r in lists.where("range >= 0 and label <> 'b'").collect())


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_an_items_draw_is_made_once_for_both_sides(spark, monkeypatch):
    """Draws of both models and streams are those of one model and stream alone, and one pass makes them."""
    rng = np.random.default_rng(4)
    rows = [(i, label, int(rng.random() < 0.5), int(rng.random() < 0.5)) for i in range(60) for label in "abc"]
    one = spark.createDataFrame(rows, "handle long, label string, y int, pred int").repartition(3)
    two = one.withColumn("pred", 1 - one.pred)
    asked, plain = [], scores._drawn_counts
    monkeypatch.setattr(scores, "_drawn_counts", lambda hits, n, seed, key, streams: asked.append((hits, streams)) or plain(hits, n, seed, key, streams))
    scores.paired_bootstrap(one, two, 40)
    ((hits, streams),) = asked
    assert streams == ("f1_macro", "f1_micro")
    parts = hits.rdd.glom().map(lambda p: [r.handle for r in p]).collect()
    assert all(p == sorted(p) for p in parts) and sum(len(set(p)) for p in parts) == len(set(sum(parts, [])))
    found = plain(hits, 40, 42, "handle", streams).collect()
    for model, df in enumerate((one, two)):
        for stream in streams:
            want = {tuple(r) for r in scores._replicate_counts(df, 40, 42, "handle", stream).select("replicate", "label", "tp", "fp", "fn").collect()}
            assert {(r.replicate, r.label, r.tp, r.fp, r.fn) for r in found if (r.model, r.stream) == (model, stream)} == want


def test_languages_are_measured_in_the_items_rows(spark):
    """Sums by language and label are all that is exchanged: no row of an item and a label is moved or ranked by a window."""
    import re

    from loomtext.plans import q_scores

    plan = _plan(q_scores.language_performance(spark, "/root/testdata/sf0.001"))
    keys = {tuple(re.findall(r"(\w+)#", k)) for k in re.findall(r"exchange hashpartitioning\((.*?), \d+\)", plan)}
    assert "window" not in plan and keys == {("language", "label"), ("language",)}
    # Neither the hashes nor the sorted rows are made twice.
    assert plan.count("sha2(") == 1 and plan.count("array_sort(") == 1 and plan.count("aggregate(filter(") == 2


@pytest.mark.parametrize("labels", [2, 4, 9])
def test_languages_of_odd_rows(spark, labels):
    """Frequent and odd scores, an item of two languages, one without a language, repeated rows and a rare language."""
    rng = np.random.default_rng(labels)
    odd = [float("nan"), None, float("inf"), float("-inf"), -0.0, 0.0]
    rows = []
    for i in range(120):
        own = ["en", "fr", "fr", None][i % 4] if i else "it"
        for j in range(labels):
            s = odd[int(rng.integers(6))] if rng.random() < 0.2 else float(rng.integers(0, 5)) / 4
            rows.append((i, own, f"l{j}", s, int(rng.random() < 0.4), int(rng.random() < 0.4)))
        if i % 10 == 5:
            rows += [r for r in rows if r[0] == i]  # in the same language
        if i % 10 == 6:
            rows += [(i, "de", f"x{j}", *r[3:]) for j, r in enumerate([r for r in rows if r[0] == i])]
    df = spark.createDataFrame(rows, "handle int, language string, label string, score double, y int, pred int").repartition(3)
    found = {r.language: r for r in scores.by_language(df, 2).collect()}
    place = lambda r: ((2, 0.0) if r[3] is None else (0, 0.0) if r[3] != r[3] else (1, -r[3]), r[2], r[1] or "")
    ranked = [(r, at) for i in range(120) for at, r in enumerate(sorted((r for r in rows if r[0] == i), key=place))]
    assert set(found) == {"en", "fr", "de"}
    for language, r in found.items():
        own = [(x, at) for x, at in ranked if x[1] == language]
        items = {i: [(x, at) for x, at in own if x[0] == i] for i in {x[0] for x, _ in own}}
        assert r.n == len(items)
        for k in (3, 5):
            hits = {i: sum(x[4] for x, at in of if at < k) for i, of in items.items()}
            assert r[f"precision_at_{k}"] == pytest.approx(np.mean([hits[i] / min(k, len(of)) for i, of in items.items()]))
            assert r[f"recall_at_{k}"] == pytest.approx(np.mean([hits[i] / max(1, sum(x[4] for x, _ in of)) for i, of in items.items()]))
        f1, names = [], {x[2] for x, _ in own}
        for name in names:
            y, p = np.array([(x[4], x[5]) for x, _ in own if x[2] == name]).T
            f1.append(2 * (y * p).sum() / max(1, (y + p).sum()))
        y, p = np.array([(x[4], x[5]) for x, _ in own]).T
        assert (r.f1_macro, r.f1_micro) == (pytest.approx(np.mean(f1)), pytest.approx(2 * (y * p).sum() / (y + p).sum()))
        held = len({x[2] for x, _ in own if x[4]})
        assert (r.evaluable_labels, r.non_evaluable_labels) == (held, len(names) - held)


def test_language_performance_of_odd_tables_is_that_of_the_sql(spark, tmp_path):
    """Orders that repeat or have no priority, parts without a brand or unknown, lines without an order."""
    import duckdb

    from loomtext.plans import base, q_scores

    held = "/root/testdata/sf0.001"
    tables = {
        "orders": f"SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority) FROM '{held}/orders.parquet', range(3) r(i) WHERE i = 0 OR o_orderkey % (i + 2) = 0",
        "part": f"SELECT * REPLACE (CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand) FROM '{held}/part.parquet' WHERE p_partkey % 17 <> 0",
        "lineitem": f"SELECT * REPLACE (CASE WHEN l_orderkey % 19 = 0 THEN NULL ELSE l_orderkey END AS l_orderkey) FROM '{held}/lineitem.parquet'",
    }
    con = duckdb.connect()
    for name, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(base.oracle_sql()["language_performance"]).fetchall()}
    found = {r[0]: tuple(r[1:]) for r in q_scores.language_performance(spark, str(tmp_path)).collect()}
    assert len(want) == 5 and found == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
