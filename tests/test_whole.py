"""Registered queries cover their whole tables and use the operators' own limits."""

from loomtext.plans import base, catalog, q_dense  # noqa: F401

TABLES = "/root/testdata/sf0.01"  # the smallest has no run of 60 or more


def test_every_run_is_evaluated(spark):
    events = spark.read.parquet(f"{TABLES}/events.parquet").select("user_id", "event_id", "value").collect()
    runs: dict = {}
    for r in events:
        runs.setdefault(r.user_id, {}).setdefault(r.event_id % 12, []).append(r.value)
    found = q_dense.epoch_summary(spark, TABLES).collect()
    assert {r.run: (r.epochs_evaluated, r.stopped_after_epoch) for r in found} == {u: (len(e), max(e)) for u, e in runs.items()}
    assert len(runs) > 60
    stops = q_dense.early_stopping(spark, TABLES).select("run", "epoch").collect()
    assert {(r.run, r.epoch) for r in stops} == {(u, e) for u, es in runs.items() for e in es} and len(stops) == sum(map(len, runs.values()))


def test_vocabulary_has_production_size(spark):
    from loomtext.plans import q_labels

    texts = spark.read.parquet(f"{TABLES}/documents.parquet")
    assert q_labels.bow_vocab(spark, TABLES).count() == 100_000
    assert q_labels.bm25_stats(spark, TABLES).first().terms == 100_000 and texts.count() > 0


def test_replicates_and_iterations_are_the_operators_own(spark, monkeypatch):
    import inspect

    from loomtext.operators import classify
    from loomtext.plans import pipeline, q_scores

    class Seen(Exception):
        pass

    def catch(f):
        def run(*args, **named):
            bound = inspect.signature(f).bind(*args, **named)
            bound.apply_defaults()
            raise Seen(bound.arguments)

        return run

    asked = []
    for holder, name, call in (
        (q_scores.S, "bootstrap_intervals", q_scores.bootstrap_ci),
        (q_scores.S, "paired_bootstrap", q_scores.paired_bootstrap),
        (classify, "fit_one_vs_rest", q_dense.ovr_logreg),
        (classify, "fit_one_vs_rest", q_dense.ovr_linear_svc),
    ):
        with monkeypatch.context() as m:
            m.setattr(holder, name, catch(getattr(holder, name)))
            try:
                call(spark, TABLES)
            except Seen as e:
                given = e.args[0]
                own = inspect.signature(classify.create_classifier).parameters["max_iter"].default
                asked.append(given.get("replicates") or given.get("settings", {}).get("max_iter", own))
    assert asked == [1000, 1000, 3000, 3000]
    assert '"bootstrap_resamples", 1000' in inspect.getsource(pipeline)
