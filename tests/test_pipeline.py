"""The batch run on the synthetic corpus: end to end and resumed, dense stages, families and paired reports."""

import json
import time

import pytest
from pyspark.sql import functions as F

from loomtext.operators import classify, dense, runs
from loomtext.plans.pipeline import Run
from loomtext.sources import readers, sinks


def settings(tmp_path):
    return {
        "experiment": {"name": "dummy", "seed": 42, "output_dir": str(tmp_path / "runs")},
        "data": {"metadata_csv": f"file://{tmp_path}/meta", "target_columns": ["sedici.subject.materias[es]"]},
        "labels": {"min_support": 2},
        "split": {"validation_size": 0.2, "test_size": 0.2, "max_tries": 3},
        "preprocessing": {"modes": ["normalized"]},
        "features": {"sets": ["abstract+fulltext"]},
        "representations": {"enabled": ["bm25", "sbert"], "max_features": 200, "ngram_range": [1, 1]},
        "classifiers": {"enabled": ["sgd"]},
        "metrics": {"bootstrap_resamples": 10, "comparative_bootstrap_resamples": 10, "language_min_support": 1},
        "language": {"abstract_ground_truth_csv": f"file://{tmp_path}/truth"},
    }


def test_run_and_resume(spark, tmp_path):
    corpus = readers.synthetic_corpus(spark, 120)  # with texts of their own, else whole groups of copies move together
    sinks.write_csv(corpus.withColumn("fulltext", F.concat("fulltext", "handle")), f"file://{tmp_path}/meta")
    spoken = F.concat("`dc.description.abstract[es]`", "`dc.description.abstract[en]`")
    code = F.when(F.col("`dc.description.abstract[es]`") != "", "es").otherwise("en")
    truth = corpus.limit(60).select("handle", spoken.alias("text"), code.alias("final"), code.alias("catalogued"), code.alias("other"))
    sinks.write_csv(truth, f"file://{tmp_path}/truth")
    config = settings(tmp_path)
    encoders = {"sbert": dense.hashing_encoder(16)}
    run = Run(spark, config, encoders=encoders)
    prepared = run.run("prepare")
    assert prepared.count() == 120 and set(prepared.toPandas().split) == {"train", "validation", "test"}
    assert sum(len(r.labels) for r in prepared.select("labels").collect()) == 144
    with pytest.raises(ValueError):
        run.run("unknown")
    with pytest.raises(ValueError):
        run.run("finalize")  # the grid has no results yet
    dense_stage = Run(spark, config, resume=True, encoders=encoders).run("sbert")
    assert [r.representation for r in dense_stage.collect()] == ["sbert"] and not (run.folder / "_TEST_SUCCESS").exists()
    again = Run(spark, config, resume=True, encoders=encoders)
    assert again.folder == run.folder
    metrics = again.run("all").first()
    assert metrics.f1_macro > 0.6
    for marker, there in (("_SUCCESS", True), ("_VALIDATION_SUCCESS", True), ("_TEST_SUCCESS", True), ("RUN_INCOMPLETE", False)):
        assert (run.folder / marker).exists() == there
    report = lambda name: spark.read.option("header", True).csv(f"file://{run.folder}/reports/{name}")
    names = (
        "per_label_test multilabel_confusion_matrices language_performance results_test_comparative per_label_test_comparative paired_bootstrap_vs_global "
        "language_agreement_summary fulltext_coverage text_unit_statistics abstract_language_ground_truth_per_language selected_test_models_frozen "
        "embedding_coverage_sbert_full_document_abstract_fulltext timing classifier_convergence scaling_estimate"
    ).split()
    assert all(report(n).count() > 0 for n in names)
    assert len(list((run.folder / "reports" / "charts").iterdir())) == 7 and report("charts/test_metrics_overview").count() == 12
    families = report("results_test_comparative").collect()
    assert {r.family for r in families} == {"bm25", "sbert_frozen"} and sum("global" in r.selection_roles for r in families) == 1
    assert [float(r.f1_macro) for r in families] == sorted((float(r.f1_macro) for r in families), reverse=True)
    assert "accuracy" in {r.language for r in report("abstract_language_ground_truth_per_language").collect()}
    assert "Families" in (run.folder / "evaluation.md").read_text()
    sessions = json.loads((run.folder / "timing_sessions.json").read_text())
    assert [s["state"] for s in sessions] == ["done", "failed", "done", "done"]
    assert json.loads((run.folder / "thresholds.json").read_text())
    assert "abstract" not in spark.read.parquet(f"file://{run.folder}/items_without_text").columns
    listed = spark.read.option("header", True).csv(f"file://{run.folder}/reports_manifest")
    assert listed.count() > 30 and listed.where("length(sha256) <> 64").count() == 0
    # Another run takes the prepared items over.
    config["data"]["prepared_parquet"] = f"file://{run.folder}/items_with_languages"
    other = Run(spark, config)
    assert other.folder != run.folder and other.with_languages().count() == 120


def test_another_driver_goes_on(spark, tmp_path):
    """State lies beside the tables: a driver with an empty folder keeps to the split and trains on from the head's state."""
    corpus = readers.synthetic_corpus(spark, 80)
    sinks.write_csv(corpus.withColumn("fulltext", F.concat("fulltext", "handle")), f"file://{tmp_path}/meta")
    config = settings(tmp_path)
    del config["language"]["abstract_ground_truth_csv"]
    config["split"] |= {"calibration_size": 0.2, "max_tries": 1}
    config["experiment"] |= {"table_dir": f"file://{tmp_path}/tables", "run_id": "r1"}
    config["finetuning"] = {"models": {"sbert_finetuned": "hash"}, "max_epochs": 1, "batch_size": 64, "learning_rate": 0.05}
    encoders = {"sbert_finetuned": dense.hashing_encoder(8)}
    first = Run(spark, config, encoders=encoders)
    prepared = first.splits()
    told = first.finetune(prepared).first()
    assert told.model == "sbert_finetuned" and told.selected_epoch == 1
    config["experiment"]["output_dir"] = str(tmp_path / "other")
    second = Run(spark, config, encoders=encoders)
    assert second.base == first.base and second.folder != first.folder
    assert sinks.read_state(spark, second.path("state/thresholds/sbert_finetuned")) and second.finetune(second.splits()).first().f1_macro == told.f1_macro
    sinks.write_state(spark, second.path("state/context"), {"seed": 42, "split_fingerprint": "x", "split_sizes": {}})
    with pytest.raises(ValueError):
        second.splits()


def test_heartbeat_counts_interrupted_sessions(tmp_path):
    place = tmp_path / "t.json"
    first = runs.Heartbeat(place, "a", 0.01)
    time.sleep(0.05)
    first.stopped.set()  # as if the driver were lost
    second = runs.Heartbeat(place, "b", 60)
    assert second.stop() >= 0.03
    assert [r["state"] for r in json.loads(place.read_text())] == ["interrupted", "done"]


def test_run_checks(tmp_path):
    needs = runs.RunNeeds(("context.json", "metrics.csv"), ("_TEST",))
    with pytest.raises(FileNotFoundError):
        runs.require_run(tmp_path, needs, 13)
    (tmp_path / "context.json").write_text(json.dumps({"seed": 13, "split_fingerprint": "x"}))
    (tmp_path / "metrics.csv").write_text("seed,f1\n13,0.5\n")
    assert runs.require_run(tmp_path, needs, 13)["split_fingerprint"] == "x"
    with pytest.raises(ValueError):
        runs.require_run(tmp_path, needs, 42)
    (tmp_path / "_TEST").write_text("")
    with pytest.raises(ValueError):
        runs.require_run(tmp_path, needs, 13)
    contexts = [{"seed": 1, "labels": ["a"]}, {"seed": 2, "labels": ["a"]}]
    runs.validate_shared_context(contexts, [{"experiment": {"seed": 1}, "x": 1}, {"experiment": {"seed": 2}, "x": 1}])
    assert runs.context_differences([contexts[0], contexts[1] | {"labels": ["b"]}], [{"x": 1}, {"x": 2}]) == ["labels", "settings.x"]
    with pytest.raises(ValueError):
        runs.validate_shared_context([{"commit": "a"}, {"commit": "b"}])


def test_dense_items_by_chunk_and_cache(spark, tmp_path):
    items = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "handle string, split string")
    units = spark.createDataFrame([("a", 0, "one two three", 0.25), ("a", 1, "four", 0.75), ("b", 0, " ", 1.0)], "handle string, unit_idx int, text string, weight double")
    asked = spark.sparkContext.accumulator(0)

    def encoder(texts):
        import numpy as np

        asked.add(len(texts))
        return np.array([[float(len(t.split())), float(len(t))] for t in texts])

    def vectors(mode, **more):
        return {r.handle: r.vector for r in dense.encode_items(units, items, encoder, 2, mode, 2, 0, str(tmp_path / "c"), **more).collect()}

    got = vectors(dense.CHUNKED, model="m")
    assert got == {"a": [0.25 * 1.5 + 0.75, 0.25 * 6.0 + 0.75 * 4.0], "b": [0.0, 0.0], "c": [0.0, 0.0]}
    assert asked.value == 3 and vectors(dense.CHUNKED, model="m") == got and asked.value == 3
    assert vectors(dense.TRUNCATED, model="m")["a"] == [0.25 * 3 + 0.75, 0.25 * 13 + 0.75 * 4]
    vectors(dense.CHUNKED, model="other")  # another model shares no rows
    assert asked.value == 8
    told = {r.partition: r for r in dense.embedding_coverage(units, items, dense.CHUNKED, 2).collect()}
    assert (told["train"].text_units, told["train"].chunks, told["test"].documents_without_units) == (2, 3, 2)


def test_finetuned_inference(spark):
    import numpy as np

    units = spark.createDataFrame([("a", 0, [1, 2, 3], 1.0), ("b", 0, [4], 1.0)], "handle string, unit_idx int, ids array<int>, weight double")
    truth = spark.createDataFrame([("a", "x", 1), ("a", "y", 0), ("b", "x", 0), ("b", "y", 1)], "handle string, label string, y int")
    forward = lambda tokens: np.array([[float(sum(t)), -float(sum(t))] for t in tokens])
    rows = {(r.handle, r.label): (r.score, r.pred) for r in dense.evaluate_finetuned(units, truth, forward, ["x", "y"], 0.0, 2, 4).collect()}
    assert rows == {("a", "x"): (3.0, 1), ("a", "y"): (-3.0, 0), ("b", "x"): (4.0, 1), ("b", "y"): (-4.0, 0)}


def test_selected_models_are_family_winners(spark):
    rows = [("n", "f", "bm25", "sgd", 0.5, 0.1), ("n", "f", "bm25", "logreg", 0.7, 0.1), ("transformer", "f", "sbert", "sgd", 0.6, 0.2), ("raw", "f", "bow", "sgd", 0.7, 0.3)]
    df = spark.createDataFrame(rows, "preprocessing string, feature_set string, representation string, classifier string, f1_macro double, f1_micro double")
    got = {r.family: (r.classifier, r.confirmatory) for r in classify.selected_models(df).collect()}
    assert got == {"bm25": ("logreg", True), "sbert_frozen": ("sgd", False), "bow": ("sgd", False)}
