"""The batch run: metadata to items, languages, splits, grid, selection and test reports, with resumable stages."""

from __future__ import annotations

import time
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, dense, head, items, labels, language, language_model, runs, scores, vectorize
from ..sources import readers, sinks
from ..sources.scratch import scratch_dir

RESULT = "preprocessing string, feature_set string, representation string, classifier string, f1_macro double, f1_micro double, score_kind string, split_fingerprint string"
HISTORY = (
    "epoch int, train_loss double, validation_f1_macro double, validation_f1_micro double, validation_average_precision_macro double, learning_rate double, "
    "improved boolean, best_epoch int, best_validation_f1_macro double"
)
#: Stages that end before the test items are looked at.
DENSE_STAGES = ("sbert", "labse")


def file_name(key: tuple[str, ...]) -> str:
    """An experiment's key as a file name."""
    return "-".join(part.replace("+", "_") for part in key)


class Run:
    """One run folder and its stages. Tables go to Parquet, reports to CSV; a restart goes on where tables end.

    The folder holds markers, settings and small JSON files of the driver. Tables and reports lie in it, too,
    on a local session; on a cluster they go to ``experiment.table_dir``, or else to the folder that
    spark.checkpoint.dir names, so that all executors reach them.
    """

    def __init__(self, spark: SparkSession, config: dict[str, Any], resume: bool = False, encoders: dict[str, dense.Encoder] | None = None):
        self.spark, self.config, self.encoders = spark, config, encoders or {}
        own = config["experiment"]
        self.seed = int(own.get("seed", 42))
        self.folder = sinks.run_folder(own.get("output_dir", "outputs"), own["name"], resume)
        shared = own.get("table_dir")
        if not shared and not spark.sparkContext.master.startswith("local"):
            shared = f"{scratch_dir(spark)}/runs"
        # Tables and state of a named run are found again by a driver whose own folder is empty.
        self.base = f"{shared.rstrip('/')}/{own.get('run_id') or self.folder.name}" if shared else f"file://{self.folder.resolve()}"
        self.timings: list[tuple[str, float]] = []
        sinks.write_json({k: v for k, v in config.items() if not k.startswith("_")}, self.folder / "config.json")
        sinks.write_json(sinks.environment(), self.folder / "environment.json")
        self.log = sinks.run_log(self.folder / "run.log")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, name: str) -> DataFrame | None:
        return sinks.read_parquet(self.spark, self.path(name))

    def keep(self, name: str, build) -> DataFrame:
        """The table of that name, built and written if it isn't there yet."""
        found = self.table(name)
        if found is None:
            began = time.time()
            sinks.write_parquet(build(), self.path(name))
            self.timings.append((name, time.time() - began))
            found = self.table(name)
        return found

    def report(self, name: str, df: DataFrame) -> None:
        sinks.write_csv(df, self.path(f"reports/{name}"))

    # --- stages ---------------------------------------------------------------------------------------------

    def items(self) -> DataFrame:
        data = self.config["data"]
        metadata = readers.read_metadata(self.spark, data["metadata_csv"])
        targets = data["target_columns"]
        limit = int(data.get("max_fulltext_chars", 100_000))

        def build() -> DataFrame:
            rows = items.metadata_rows(
                metadata, targets, data.get("abstract_columns"), data.get("keyword_columns"), data.get("handle_column", "handle"), limit
            )
            whole, found = readers.prepare_fulltext(self.spark, data, items.roll_up_items(rows, limit))
            chosen = self.config.get("labels", {})
            kept, _ = labels.select_labels(whole, chosen.get("top_k"), int(chosen.get("min_support", 1)))
            cohort = self.config.get("sampling", {}).get("cohort_manifest")
            if cohort:  # a frozen cohort takes the sample's place
                frozen = readers.read_metadata(self.spark, cohort).withColumn("pos", F.col("pos").cast("long"))
                sampled = labels.restore_cohort(kept, frozen)
            else:
                sampled = labels.stratified_sample(kept, self.config.get("sampling", {}).get("target_n"), self.seed)
            self.keep("sampled_handles", lambda: sampled.select("handle"))
            return items.content_groups(readers.attach_fulltext(self.spark, data, sampled, found))

        self.report("target_schema_report", items.target_schema_report(metadata, targets))
        out = self.keep("items", build)
        self.report("fulltext_missing_handles", self.table("sampled_handles").join(out.select("handle"), "handle", "left_anti").orderBy("handle"))
        return out

    def detector(self) -> language.Detector:
        """The configured back-end; ``ngram`` is trained on the table (language, text) that ``language.ngram_training`` names."""
        settings = self.config.get("language", {})
        if settings.get("backend") == "ngram":
            return language_model.fit_language_model(self.spark.read.parquet(settings["ngram_training"])).detector()
        return language.create_detector(settings.get("backend", "heuristic"))

    def with_languages(self) -> DataFrame:
        source = self.items()
        settings = self.config.get("language", {})
        width = int(settings.get("fulltext_preprocessing_segment_chars", 12_000))
        share = float(settings.get("multilingual_min_character_share", 0.2))

        def build() -> DataFrame:
            held = self.config["data"].get("prepared_parquet")
            if held:  # a table of an earlier run serves if it has all items
                asked = source.select("handle").withColumn("pos", F.monotonically_increasing_id())
                found = readers.prepared_dataset(self.spark, held, asked)
                if found is not None:
                    return found
            detect, out = self.detector(), source
            for field, column in (("abstract", "abstract_segments"), ("fulltext", "fulltext_documents")):
                units = source.select("handle", F.posexplode(column).alias("pos", "text")).where(F.trim("text") != "")
                if field == "fulltext":
                    seen = language.detect_distributed(
                        units, detect, width=int(settings.get("segment_chars", 4000)), count=int(settings.get("fulltext_segments", 5))
                    )
                else:
                    seen = units.withColumn("d", detect(F.col("text"))).select("handle", "pos", F.length("text").alias("chars"), "d.language", "d.score")
                found = language.aggregate_languages(seen, "handle", share)
                if field == "fulltext":
                    found = language.override_by_windows(found, units, detect, "handle", width, share)
                found = found.select("handle", *[F.col(c).alias(f"{field}_{c}") for c in ("detected_language", "language_score", "language_set")])
                out = out.join(found, "handle", "left").withColumn(f"{field}_detected_language", F.coalesce(f"{field}_detected_language", F.lit("und")))
            pieces = F.flatten(F.transform("fulltext_documents", lambda d: language.slices(d, width)))
            key = language.detect_keywords(F.col("keywords"), detect, int(settings.get("keyword_min_chars", 20)))
            out = out.withColumn("fulltext_preprocessing_segments", pieces).withColumns(
                {
                    "_abstract": detect.each(F.col("abstract_segments")),
                    "_fulltext": detect.each(F.col("fulltext_preprocessing_segments")),
                    "keywords_detected_language": key["language"],
                }
            )
            named = lambda c, field: F.transform(c, lambda d: d[field])
            return out.withColumns(
                {
                    "abstract_segment_languages": named("_abstract", "language"),
                    "abstract_segment_language_scores": named("_abstract", "score"),
                    "fulltext_preprocessing_segment_languages": named("_fulltext", "language"),
                }
            ).drop("_abstract", "_fulltext")

        return self.keep("items_with_languages", build)

    def shares(self) -> dict[str, float]:
        s = self.config["split"]
        return labels.split_shares(float(s.get("validation_size", 0.15)), float(s.get("test_size", 0.15)), float(s.get("calibration_size", 0.0)))

    def splits(self) -> DataFrame:
        source = self.with_languages()
        s, shares = self.config["split"], self.shares()
        manifest = self.keep(
            "split_manifest",
            lambda: labels.split_items(source, shares, self.seed, int(s.get("max_tries", 20)), group_column="content_group", method=s.get("method", "hash"))[0].select("handle", "split"),
        )
        frozen = labels.restore_split(source, manifest)
        context = {"seed": self.seed, "split_fingerprint": labels.split_fingerprint(frozen), "split_sizes": {r.split: r.n for r in labels.split_sizes(frozen).collect()}}
        before = sinks.read_state(self.spark, self.path("state/context"))
        if before is not None:  # a resumed run has to go on with the split that it began with
            runs.validate_shared_context([before, context])
        else:
            sinks.write_state(self.spark, self.path("state/context"), context)
        sinks.write_json(before or context, self.folder / "context.json")
        return frozen

    def reports(self, prepared: DataFrame) -> None:
        for name, df in (
            ("dataset_statistics", labels.dataset_statistics(prepared)),
            ("label_statistics", labels.label_support(prepared).orderBy(F.desc("support"), "label")),
            ("label_pair_statistics", labels.label_pairs(prepared)),
            ("text_statistics", labels.text_statistics(prepared, ["abstract", "keywords", "fulltext"])),
            ("label_coverage_by_split", labels.coverage(prepared, tuple(self.shares()))),
            ("exact_content_duplicate_groups", items.duplicate_groups(prepared)),
            ("language_by_subject", labels.labels_by_language(prepared, "abstract_detected_language")),
            ("fulltext_coverage", items.fulltext_coverage(prepared)),
            ("text_unit_statistics", items.text_unit_statistics(prepared)),
            *((f"{f}_language_distribution", language.distribution(prepared, f"{f}_detected_language")) for f in ("abstract", "fulltext", "keywords")),
        ):
            self.report(name, df)
        told = [
            prepared.select(F.lit(f).alias("field"), F.col(f"{f}_declared_language").alias("declared"), F.col(f"{f}_detected_language").alias("detected"))
            for f in ("abstract", "fulltext")
            if f"{f}_declared_language" in prepared.columns
        ]
        both = reduce(DataFrame.unionByName, told)
        self.report("language_agreement", language.agreement(both))
        self.report("language_agreement_summary", language.agreement_summary(both))
        self.ground_truth(prepared)
        self.keep("items_without_text", lambda: sinks.without_text(prepared))

    def ground_truth(self, prepared: DataFrame) -> None:
        """Reports against audited abstract segments, if the settings name their table."""
        settings = self.config.get("language", {})
        place = settings.get("abstract_ground_truth_csv")
        if not place:
            return
        columns = settings.get("abstract_ground_truth_columns", ["handle", "text", "final", "catalogued", "other"])
        build = lambda raw: language.ground_truth(raw, *columns)
        cache = settings.get("abstract_ground_truth_cache")
        truth = readers.signed_cache(self.spark, place, cache, build) if cache else build(readers.read_metadata(self.spark, place))
        audit = self.keep("abstract_language_audit", lambda: language.segment_audit(prepared, truth))
        self.report("abstract_language_ground_truth_conflicts", language.ground_truth_conflicts(truth))
        known = audit.where("ground_truth_language is not null")
        names = ("ground_truth_language", "detected_language")
        self.report("abstract_language_ground_truth_summary", language.accuracy_summary(known, *names))
        self.report("abstract_language_ground_truth_per_language", language.averages(language.per_language(known, *names)))
        self.report("abstract_language_ground_truth_confusion", language.confusion(known, *names))

    def candidates(self, kinds: tuple[str, ...] | None = None) -> list[tuple[str, str, str, str]]:
        """The grid of the configuration, sparse and dense, or that of some representations only."""
        c = self.config
        modes = c.get("preprocessing", {}).get("modes") or [c.get("preprocessing", {}).get("mode", "raw")]
        enabled = [r for r in c["representations"].get("enabled", []) if kinds is None or r in kinds]
        out = []
        for r in enabled:
            own = modes if r in classify.SPARSE else ["transformer"]
            out += [(m, f, r, k) for m in own for f in c["features"].get("sets", list(dense.FEATURE_SETS)) for k in c["classifiers"].get("enabled", ["logreg"])]
        return out

    def counts(self, prepared: DataFrame, mode: str, feature_set: str) -> DataFrame:
        """Term counts of a text form, made once for all representations and classifiers."""
        c = self.config["representations"]
        texts = dense.feature_text(prepared, feature_set, mode)
        build = lambda: vectorize.term_counts(texts, ngrams=tuple(c.get("ngram_range", (1, 2))), lowercase=bool(c.get("lowercase", True)))
        return self.keep(f"counts/{mode}-{feature_set.replace('+', '_')}", build)

    def sparse_vectors(self, prepared: DataFrame, mode: str, feature_set: str, representation: str) -> DataFrame:
        c = self.config["representations"]
        train = prepared.where("split = 'train'").select("handle")
        counts = self.counts(prepared, mode, feature_set)
        b = c.get("bm25", {})
        model = vectorize.fit(
            representation, counts.join(train, "handle", "left_semi"), train.count(), c.get("max_features", 100_000), c.get("min_df", 1), c.get("max_df", 1.0),
            float(b.get("k1", 1.5)), float(b.get("b", 0.75)),
        )
        return vectorize.indexed_vectors(model.transform(counts), model)

    def dense_vectors(self, prepared: DataFrame, feature_set: str, name: str) -> DataFrame:
        """Items' vectors by an encoder given to the run; its coverage of the splits is reported."""
        if name not in self.encoders:
            raise ValueError(f"the run was given no encoder for {name}")
        c = self.config["representations"].get(name, {})
        settings = {"mode": c.get("embedding_mode", dense.CHUNKED), "length": int(c.get("max_length", 128)), "overlap": int(c.get("overlap", 0))}
        units = dense.weighted_units(prepared, feature_set, self.config["features"].get("field_weights"))
        told = dense.embedding_coverage(units, prepared, **settings).withColumns({"feature_set": F.lit(feature_set), "representation": F.lit(name)})
        self.report(f"embedding_coverage_{name}_{settings['mode']}_{feature_set.replace('+', '_')}", told)
        width = len(self.encoders[name]([""])[0])
        cache = self.path(f"vectors/{name}")
        found = dense.encode_items(units, prepared, self.encoders[name], width, cache_path=cache, model=name, **settings)
        return found.select("handle", dense.dense_features(F.col("vector")).alias("features"))

    def settings_of(self, name: str) -> dict[str, Any]:
        """A classifier's own settings (C, tol, max_iter, alpha) from the configuration."""
        own = self.config["classifiers"].get("params", {}).get(name, {})
        return {k.lower(): own[k] for k in ("C", "tol", "max_iter", "alpha") if k in own}

    def fit(self, prepared: DataFrame, key: tuple[str, str, str, str], held: str) -> tuple[DataFrame, str]:
        """Scores of the calibration items and those of ``held`` (handle, label, score, y, split), and their kind."""
        mode, feature_set, representation, name = key
        sparse = representation in classify.SPARSE
        vectors = self.sparse_vectors(prepared, mode, feature_set, representation) if sparse else self.dense_vectors(prepared, feature_set, representation)
        train = prepared.where("split = 'train'").select("handle")
        truth = labels.indicator(prepared)
        fitted = classify.fit_one_vs_rest(vectors.join(train, "handle", "left_semi"), truth.join(train, "handle", "left_semi"), name, **self.settings_of(name))
        told = fitted.convergence(self.spark).withColumns({c: F.lit(v) for c, v in zip(classify.KEY, key, strict=True)})
        self.keep("convergence/" + file_name(key), lambda: told)
        rest = prepared.where(F.col("split").isin("calibration", held)).select("handle", "split")
        return fitted.scores(vectors.join(rest.select("handle"), "handle", "left_semi")).join(truth, ["handle", "label"]).join(rest, "handle"), fitted.score_kind

    def threshold(self, rows: DataFrame, kind: str, held: str):
        part = rows.where("split = 'calibration'")
        part = rows.where(F.col("split") == held) if part.isEmpty() else part
        t = self.config.get("thresholds", {})
        return scores.calibrate(part, kind, t.get("mode", "default"), int(t.get("minimum_label_support", 20)))

    def grid(self, prepared: DataFrame, kinds: tuple[str, ...] | None) -> DataFrame:
        """Validation results of the candidates; each is appended when done, and done ones are skipped."""
        fingerprint = labels.split_fingerprint(prepared)
        path, names = self.path("validation_results"), list(classify.KEY)
        empty = self.spark.createDataFrame([], RESULT)
        done = lambda: self.spark.read.schema(RESULT).parquet(path) if sinks.exists(self.spark, path) else empty
        for key in self.candidates(kinds):
            if not runs.bound_to(done(), fingerprint).where(F.struct(*names) == F.struct(*map(F.lit, key))).isEmpty():
                continue
            began = time.time()
            rows, kind = self.fit(prepared, key, "validation")
            measured = scores.multilabel_metrics(scores.apply_thresholds(rows.where("split = 'validation'"), self.threshold(rows, kind, "validation")))
            m = measured.first()
            row = (*key, float(m.f1_macro), float(m.f1_micro), kind, fingerprint)
            self.spark.createDataFrame([row], RESULT).coalesce(1).write.mode("append").parquet(path)
            self.timings.append(("|".join(key), time.time() - began))
        told = [t for key in self.candidates(kinds) if (t := self.table("convergence/" + file_name(key))) is not None]
        if told:
            self.report("classifier_convergence", reduce(DataFrame.unionByName, told).orderBy(*names, "label"))
        return done()

    def finetune(self, prepared: DataFrame) -> DataFrame:
        """A trained head for each model of the finetuning section, over its encoder's unit vectors: results on the
        validation items and every epoch's rows. A head that was interrupted goes on; test items are not looked at."""
        own = self.config.get("finetuning", {})
        fingerprint, truth, rows = labels.split_fingerprint(prepared), labels.indicator(prepared), []
        units = dense.weighted_units(prepared, own.get("feature_set", "abstract+keywords+fulltext"), self.config["features"].get("field_weights"))
        units = units.withColumn("text_hash", F.sha2("text", 256))
        settings = head.Settings.of({"seed": self.seed, **own})
        settings.minimum_label_support = int(self.config.get("thresholds", {}).get("minimum_label_support", 20))
        for name in own.get("models", {}):
            if name not in self.encoders:
                raise ValueError(f"the run was given no encoder for {name}")
            began = time.time()
            vectors = self.keep(f"vectors/{name}", lambda: dense.encode_texts(units, self.encoders[name]))  # noqa: B023
            chunks = units.join(vectors, "text_hash").select("handle", F.concat_ws("|", "handle", "unit_idx").alias("id"), "vector", "weight")
            chunks = self.keep(f"chunks/{name}", lambda: chunks)  # noqa: B023
            found = head.train(chunks, truth, prepared.select("handle", "split"), settings, self.path(f"state/heads/{name}"), fingerprint)
            self.report(f"epoch_history_{name}", self.spark.createDataFrame(found.history, HISTORY))
            sinks.write_state(self.spark, self.path(f"state/thresholds/{name}"), found.thresholds)
            m = found.metrics
            rows.append((name, found.epoch, settings.max_epochs, settings.early_stopping, float(m["f1_macro"]), float(m["f1_micro"]), m["average_precision_macro"]))
            self.timings.append((f"finetune|{name}", time.time() - began))
        kind = "model string, selected_epoch int, max_epochs int, early_stopping_enabled boolean, f1_macro double, f1_micro double, average_precision_macro double"
        out = self.spark.createDataFrame(rows, kind).orderBy(F.desc("f1_macro"), "model")
        self.report("results_validation_finetuned", out)
        return out

    def test_rows(self, prepared: DataFrame, key: tuple[str, str, str, str]) -> tuple[DataFrame, Any]:
        """Test predictions of a configuration, fitted on training items alone and kept, and its thresholds."""
        name = "test_predictions/" + file_name(key)
        place = self.path(f"state/thresholds/{file_name(key)}")  # beside the tables: another driver goes on with them
        found, told = self.table(name), sinks.read_state(self.spark, place)
        if found is None or told is None:
            rows, kind = self.fit(prepared, key, "test")
            tuned = self.threshold(rows, kind, "test")
            told = {r.label: r.threshold for r in tuned.collect()} if isinstance(tuned, DataFrame) else {"": float(tuned)}  # one row a label
            sinks.write_state(self.spark, place, told)
            found = self.keep(name, lambda: scores.apply_thresholds(rows.where("split = 'test'"), tuned))
        sinks.write_json(told, self.folder / f"thresholds_{file_name(key)}.json")
        return found, told

    def finalize(self, prepared: DataFrame, results: DataFrame) -> DataFrame:
        """The validation winner on test items, then each family's best one beside it, with their reports."""
        expected = self.spark.createDataFrame(self.candidates(), ", ".join(f"{c} string" for c in classify.KEY))
        runs.require_complete(expected, results, classify.KEY)
        board = classify.leaderboard(results)
        self.report("results_validation", board.orderBy("place"))
        chosen = classify.selected_models(results)
        self.report("selected_test_models_frozen", chosen)
        sinks.mark(self.folder, sinks.VALIDATED)
        models = chosen.orderBy(F.desc("confirmatory"), "family").collect()  # one row a family
        key = tuple(models[0][c] for c in classify.KEY)
        test, tuned = self.test_rows(prepared, key)
        sinks.write_json(tuned, self.folder / "thresholds.json")
        metrics = scores.multilabel_metrics(test)
        table = scores.performance_ranking(scores.per_label(test))
        own = self.config.get("metrics", {})
        fields = ("abstract", "fulltext")
        told = [
            scores.by_language(
                test.join(prepared.select("handle", F.col(f"{f}_detected_language").alias("language")), "handle"), int(own.get("language_min_support", 30))
            ).withColumn("field", F.lit(f))
            for f in fields
        ]
        for name, df in (
            ("results_test", metrics),
            ("per_label_test", table.orderBy("rank")),
            ("multilabel_confusion_matrices", scores.confusion_matrices(test)),
            ("label_substitution_errors", scores.substitution_errors(test)),
            ("support_correlations", scores.correlations(table)),
            ("language_performance", told[0].unionByName(told[1])),
            ("bootstrap_ci", scores.bootstrap_intervals(test, int(own.get("bootstrap_resamples", 1000)), seed=self.seed)),
        ):
            self.report(name, df)
        for name, df in scores.chart_tables(test, prepared).items():
            self.report(f"charts/{name}", df)
        sinks.write_json(scores.correlation_p_values(scores.correlations(table)), self.folder / "correlation_p_values.json")
        sinks.write_parquet(scores.predictions(test), self.path("predictions_test"))
        sinks.mark(self.folder, sinks.TESTED)
        families = self.compare(prepared, models, test)
        Path(self.folder, "evaluation.md").write_text(sinks.evaluation_report(metrics, table, families), encoding="utf-8")
        return metrics

    def compare(self, prepared: DataFrame, models: list, winner: DataFrame) -> DataFrame:
        """Each selected model on the test items: metrics, labels, predictions, and the paired difference to the winner."""
        own = self.config.get("metrics", {})
        parts: dict[str, list[DataFrame]] = {"rows": [], "labels": [], "predictions": [], "paired": []}
        for m in models:
            named = lambda df, m=m: df.withColumns({"family": F.lit(m.family), "selection_roles": F.lit(m.selection_roles)})
            key = tuple(m[c] for c in classify.KEY)
            test = winner if m.confirmatory else self.test_rows(prepared, key)[0]
            about = {c: F.lit(m[c]) for c in classify.KEY} | {f"validation_{c}": F.lit(m[c]) for c in ("f1_macro", "f1_micro")}
            parts["rows"].append(named(scores.multilabel_metrics(test)).withColumns(about))
            parts["labels"].append(named(scores.per_label(test)))
            parts["predictions"].append(named(scores.predictions(test)))
            if not m.confirmatory:
                parts["paired"].append(named(scores.paired_bootstrap(winner, test, int(own.get("comparative_bootstrap_resamples", 1000)), seed=self.seed)))
        whole = {name: reduce(DataFrame.unionByName, dfs) for name, dfs in parts.items() if dfs}
        comparative = self.keep("results_test_comparative", lambda: whole["rows"])
        comparative = comparative.orderBy(F.desc("f1_macro"), *classify.KEY)
        self.report("results_test_comparative", comparative)
        self.report("per_label_test_comparative", whole["labels"])
        if "paired" in whole:
            self.report("paired_bootstrap_vs_global", whole["paired"])
        sinks.write_parquet(whole["predictions"], self.path("predictions_test_comparative"))
        return comparative.select("selection_roles", "family", "representation", "classifier", "validation_f1_macro", "f1_macro", "f1_micro")

    def run(self, stage: str = "all") -> DataFrame:
        """prepare stops after the reports; sparse, sbert and labse after their part of the grid; finetune trains the heads;
        finalize needs the whole grid and goes to the test results; all does everything but the heads."""
        if stage not in ("prepare", "sparse", *DENSE_STAGES, "finetune", "finalize", "all"):
            raise ValueError(f"unknown stage: {stage}")
        beat = runs.Heartbeat(self.folder / "timing_sessions.json", stage, float(self.config["experiment"].get("heartbeat_seconds", 60)))
        try:
            out = self.stages(stage)
        except BaseException:
            beat.stop("failed")
            raise
        self.timings.append(("total", beat.stop()))
        self.report("timing", self.spark.createDataFrame(self.timings, "stage string, seconds double"))
        if stage in ("finalize", "all"):
            observed = self.spark.createDataFrame([(self.table("items").count(), self.timings[-1][1])], "documents long, seconds double")
            self.report("scaling_estimate", runs.scaling_estimate(observed))
            files = sinks.manifest(self.spark, self.path("reports")).where(F.col("path").endswith(".csv"))
            sinks.write_csv(files, self.path("reports_manifest"))
            sinks.mark(self.folder, sinks.DONE)
        return out

    def stages(self, stage: str) -> DataFrame:
        prepared = self.splits()
        if stage in ("prepare", "all"):
            self.reports(prepared)
        if stage == "prepare":
            return prepared
        if stage == "finetune":
            return self.finetune(prepared)
        if stage == "finalize":
            return self.finalize(prepared, self.grid(prepared, ()))
        results = self.grid(prepared, {"sparse": classify.SPARSE, "all": None}.get(stage, (stage,)))
        return self.finalize(prepared, results) if stage == "all" else results


def main(argv: list[str] | None = None) -> None:
    from ..sources import config as settings

    args = settings.arguments(argv)
    spark = SparkSession.builder.appName("loomtext").getOrCreate()
    Run(spark, settings.from_arguments(args), resume=True).run(args.stage).show(truncate=False)


if __name__ == "__main__":
    main()
