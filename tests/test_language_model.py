"""The trained detector against plain counts, and its accuracy on documents that it hasn't seen."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from loomtext.functions.text import unit_hash
from loomtext.operators import language, language_model

TABLES = "/root/testdata/sf0.01"


def test_counts_and_probabilities_as_a_plain_version(spark):
    rows = [("a", "Uno dos, tres 4 dos"), ("a", "dos"), ("b", "one two three"), ("b", ""), ("b", None), (None, "x"), ("c", "été à où")]
    model = language_model.fit_language_model(spark.createDataFrame(rows, "language string, text string").repartition(3), buckets=500)
    assert model.languages == ["a", "b", "c"]
    counts = collections.defaultdict(collections.Counter)
    for name, text in rows:
        for at in language_model.ngram_buckets(text or "", 500):
            counts[name].update(at.tolist())
    for i, name in enumerate("abc"):
        total = sum(counts[name].values()) + 0.5 * 500
        want = [math.log((counts[name][k] + 0.5) / total) for k in range(500)]
        assert np.allclose(model.logs[i], want)
    assert np.allclose(np.exp(model.prior), [2 / 6, 3 / 6, 1 / 6])
    assert model.classify("dos tres")[0] == "a" and model.classify("12 !")[0] == "und"
    found = model.likelihoods("two")
    assert math.isclose(model.classify("two")[1], np.exp(found.max()) / np.exp(found).sum(), rel_tol=1e-9)
    whole = np.concatenate(list(language_model.ngram_buckets("ab " * 10)))
    assert len(whole) == sum(31 - n for n in range(4))  # a space at either end, one between words


def test_accuracy_on_held_out_documents_and_reports(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").withColumn("held", unit_hash("language", F.col("doc_id")) < 0.34)
    model = language_model.fit_language_model(docs.where("not held"), language="lang")
    detect = model.detector()
    seen = docs.where("held").select("doc_id", "lang", detect(F.col("text")).alias("d")).select("doc_id", F.col("lang").alias("truth"), F.col("d.language").alias("guess"), "d.score")
    rows = seen.where("length(guess) > 0").collect()
    assert len(rows) > 250 and np.mean([r.truth == r.guess for r in rows if r.guess != "und"]) > 0.98
    assert all(r.score is None or 0 < r.score <= 1 for r in rows)
    table = language.per_language(seen)
    assert table.count() >= 4
    each = docs.limit(5).select(detect.each(F.array("text", F.lit(None).cast("string"))).alias("x")).collect()
    assert all(r.x[1].language == "und" for r in each)


def test_a_run_trains_its_back_end(spark, tmp_path):
    from loomtext.plans.pipeline import Run

    place = f"file://{tmp_path}/labelled"
    spark.createDataFrame([("es", "la casa de los libros"), ("en", "the house of the books")], "language string, text string").write.parquet(place)
    run = Run(spark, {"experiment": {"name": "d", "output_dir": str(tmp_path / "runs")}, "language": {"backend": "ngram", "ngram_training": place}})
    row = spark.createDataFrame([("the books",)], "text string").select(run.detector()(F.col("text")).alias("d")).first()
    assert row.d.language == "en" and row.d.score > 0.5
