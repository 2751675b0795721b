"""Queries on dense features, classifiers, leaderboards and run aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import classify, dense, head, labels, runs, scores, vectorize
from ..sources.scratch import keep
from .base import query, table


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as arrays of character lengths of their words, a stand-in for token ids."""
    words = F.split(F.trim(F.regexp_replace("text", "[ \t\n]+", " ")), " ")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.transform(words, lambda w: F.length(w)).alias("ids"))


_TOK = "t AS (SELECT conv_id, turn, role, list_transform(string_split(trim(regexp_replace(text, '[ \\t\\n]+', ' ', 'g')), ' '), lambda w: length(w)) AS ids FROM conversations)"


@query(
    f"""WITH {_TOK}, c AS (SELECT conv_id, turn, role, ids, unnest(range(0, greatest(len(ids), 1), 24)) AS s FROM t)
    SELECT conv_id, turn, role, s::INT AS start_at, list_sum(ids[s + 1 : s + 32])::BIGINT AS total, len(ids[s + 1 : s + 32])::INT AS n FROM c"""
)
def chunk_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tokens(spark, sf).select("conv_id", "turn", "role", F.posexplode(dense.chunk_tokens(F.col("ids"), 32, 8)).alias("i", "c"))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", "role", (F.col("i") * 24).alias("start_at"), total.alias("total"), F.size("c").alias("n"))


@query(
    f"""WITH {_TOK}, n AS (SELECT *, greatest((len(ids) + 9) // 10, 1) AS k FROM t),
    c AS (SELECT conv_id, turn, role, ids, k, unnest(CASE WHEN k > 4 THEN list_transform(range(4), lambda i: i * (k - 1) // 3) ELSE range(k) END) AS j FROM n)
    SELECT conv_id, turn, role, coalesce(list_sum(ids[j * 10 + 1 : j * 10 + 10]), 0)::BIGINT AS total FROM c"""
)
def uniform_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _tokens(spark, sf).select("conv_id", "turn", "role", F.explode(dense.uniform_chunks(F.col("ids"), 10, 4)).alias("c"))
    return rows.select("conv_id", "turn", "role", F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query(
    """WITH e AS (SELECT label, vec_id % 5 AS w, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, (i - 1)::INT AS i, round(sum(x * w) / sum(w), 6) AS value FROM e GROUP BY label, i"""
)
def pool_weighted(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"), (F.col("vec_id") % 5).alias("w"))
    pooled = dense.pool(v, ["label"], "weighted_mean", weight="w")
    return pooled.select("label", F.posexplode("vector").alias("i", "x")).select("label", "i", F.round("x", 6).alias("value"))


@query(
    """WITH e AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)
    SELECT label, (i - 1)::INT AS i, round(avg(x), 6) AS mean, round(max(x), 6) AS largest FROM e GROUP BY label, i"""
)
def pool_mean_max(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    parts = [
        dense.pool(v, ["label"], mode).select("label", F.posexplode("vector").alias("i", name)).withColumn(name, F.round(name, 6))
        for mode, name in (("mean", "mean"), ("max", "largest"))
    ]
    return parts[0].join(parts[1], ["label", "i"])


def _items(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    user, other = F.col("role") == "user", F.col("role") != "user"
    return c.groupBy(F.col("conv_id").alias("handle")).agg(
        F.array_sort(F.collect_list(F.when(user, F.col("text")))).alias("abstract_segments"),
        F.array_sort(F.collect_list(F.when(other, F.col("text")))).alias("fulltext_documents"),
        F.when(F.col("conv_id") % 3 == 0, "a b").otherwise("").alias("keywords"),
    )


@query(
    """WITH c AS (SELECT conv_id, sum((role = 'user')::INT) AS a, sum((role <> 'user')::INT) AS f, (conv_id % 3 = 0)::INT AS k FROM conversations GROUP BY conv_id),
    t AS (SELECT *, (a > 0)::INT * 0.25::DOUBLE + k * 0.15::DOUBLE + (f > 0)::INT * 0.6::DOUBLE AS total FROM c)
    SELECT conv_id AS handle, (a + f + k)::BIGINT AS units, round(CASE WHEN f > 0 THEN 0.6::DOUBLE / total ELSE 0 END, 6) AS fulltext_weight, round(1.0::DOUBLE, 6) AS total_weight FROM t"""
)
def segment_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = dense.weighted_units(_items(spark, sf), "abstract+keywords+fulltext")
    full = F.sum(F.when(F.col("text").startswith("FULLTEXT: "), F.col("weight")).otherwise(0.0))
    return rows.groupBy("handle").agg(F.count("*").alias("units"), F.round(full, 6).alias("fulltext_weight"), F.round(F.sum("weight"), 6).alias("total_weight"))


@query(
    f"""WITH {_TOK}, n AS (SELECT conv_id, greatest((len(ids) + 9) // 10, 1) AS k FROM t)
    SELECT conv_id AS handle, sum(least(k, 4))::BIGINT AS chunks, round(count(*)::DOUBLE, 6) AS weight FROM n GROUP BY conv_id"""
)
def chunk_weights(spark: SparkSession, sf: str) -> DataFrame:
    units = _tokens(spark, sf).select(F.col("conv_id").alias("handle"), F.col("turn").alias("unit_idx"), "ids", F.lit(1.0).alias("weight"))
    rows = dense.chunk_weights(units, 10, 4)
    return rows.groupBy("handle").agg(F.count("*").alias("chunks"), F.round(F.sum("weight"), 6).alias("weight"))


@query(
    """WITH e AS (SELECT user_id AS handle, event_type AS label, value AS logit, (event_id % 4)::DOUBLE AS w FROM events)
    SELECT handle, label, round(avg(logit), 6) AS mean, round(sum(w * logit) / greatest(sum(w), 1e-12::DOUBLE), 6) AS weighted FROM e GROUP BY ALL"""
)
def logits_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("handle"), F.col("event_type").alias("label"), F.col("value").alias("logit"), (F.col("event_id") % 4).cast("double").alias("w"))
    plain = dense.aggregate_logits(e).withColumnRenamed("score", "mean")
    both = plain.join(dense.aggregate_logits(e, weight="w").withColumnRenamed("score", "weighted"), ["handle", "label"])
    return both.select("handle", "label", F.round("mean", 6).alias("mean"), F.round("weighted", 6).alias("weighted"))


@query(
    """WITH o AS (SELECT o_orderkey AS handle, list_transform(range(o_orderkey % 7), lambda i: (i * i)::INT) AS ids FROM orders),
    c AS (SELECT handle, i AS chunk_idx, ids[(i * 3 + 1)::INT:(i * 3 + 3)::INT] AS part FROM o, unnest(range(greatest(1, (len(ids) + 2) // 3))) t(i))
    SELECT handle, chunk_idx::INT AS chunk_idx, '101,' || array_to_string(list_concat(part, [102]), ',') AS tokens FROM c"""
)
def special_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the model's first and last token."""
    n = (F.col("o_orderkey") % 7).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * i)).otherwise(F.array().cast("array<int>"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("handle"), F.posexplode(dense.chunk_tokens(ids, 3)).alias("chunk_idx", "part"))
    whole = dense.add_special_tokens(F.col("part"), 101, 102)
    return o.select("handle", "chunk_idx", F.array_join(whole.cast("array<string>"), ",").alias("tokens"))


@query(
    """WITH t AS (SELECT user_id AS seed, event_type AS model, round(max(value), 3) AS hi, round(min(value), 3) AS lo FROM events GROUP BY ALL)
    SELECT seed, model, unnest(['a', 'b']) AS label, unnest([lo, hi]) AS threshold FROM t"""
)
def threshold_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of thresholds as rows by label."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("seed"), F.col("event_type").alias("model"))
    return runs.threshold_rows(e.agg(F.array(F.round(F.min("value"), 3), F.round(F.max("value"), 3)).alias("thresholds")), ["a", "b"])


@query()
def encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Units encoded by the hashing encoder and pooled to items by weight."""
    items = _items(spark, sf)
    units = dense.weighted_units(items, "abstract+fulltext")
    vectors = dense.encode_texts(units, dense.hashing_encoder(32))
    pooled = dense.encode_segmented(units, vectors, items, 32)
    return pooled.select("handle", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


# --- classifiers -------------------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    features = e.select(F.col("vec_id").alias("handle"), dense.dense_features(F.col("embedding")).alias("features"))
    items = e.select(F.col("vec_id").alias("handle"), F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("labels"))
    return features, labels.indicator(items)


def _ovr(spark: SparkSession, sf: str, name: str) -> DataFrame:
    features, truth = _vectors(spark, sf)
    model = classify.fit_one_vs_rest(features, truth, name)
    rows = model.scores(features).join(truth, ["handle", "label"])
    pred = scores.apply_thresholds(rows, scores.default_threshold(model.score_kind))
    return scores.multilabel_metrics(pred).select("f1_micro", "f1_macro", "n_items")


@query()
def ovr_logreg(spark: SparkSession, sf: str) -> DataFrame:
    return _ovr(spark, sf, "logreg")


@query()
def ovr_linear_svc(spark: SparkSession, sf: str) -> DataFrame:
    return _ovr(spark, sf, "linear_svc")


@query()
def ovr_sgd(spark: SparkSession, sf: str) -> DataFrame:
    return _ovr(spark, sf, "sgd")


@query()
def ovr_convergence(spark: SparkSession, sf: str) -> DataFrame:
    return classify.fit_one_vs_rest(*_vectors(spark, sf), "logreg").convergence(spark)


@query()
def sparse_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 vectors of documents, one classifier a language, its threshold calibrated on items of a split of their own and
    measured on held-out ones."""
    d = table(spark, sf, "documents")
    shares = {"train": 0.6, "calibration": 0.1, "test": 0.3}
    items, _ = labels.split_items(d.select(F.col("doc_id").alias("handle"), F.array("lang").alias("labels")), shares)
    texts = d.select(F.col("doc_id").alias("handle"), "text")
    train = items.where("split = 'train'").select("handle")
    totals = vectorize.term_totals(texts.join(train, "handle", "left_semi"), ngrams=(1, 1))
    model = vectorize.fit_totals("bm25", totals, train.count())
    vectors = keep(vectorize.indexed_vectors(model.transform_texts(texts, ngrams=(1, 1)), model), "vectors")  # read by every step of the fit
    truth = labels.indicator(items, others=("split",))
    fitted = classify.fit_one_vs_rest(vectors.join(train, "handle", "left_semi"), truth.where("split = 'train'").drop("split"), "logreg")
    rows = fitted.scores(vectors.join(train, "handle", "left_anti")).join(truth, ["handle", "label"])
    rows = keep(rows, "scores")  # read by the calibration and the metrics
    tuned = scores.calibrate(rows.where("split = 'calibration'"), fitted.score_kind, "per_label_threshold")
    return scores.multilabel_metrics(scores.apply_thresholds(rows.where("split = 'test'"), tuned)).select("f1_micro", "f1_macro", "n_items")


def _grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(classify.grid())], "i int, preprocessing string, feature_set string, representation string, classifier string")


_GRID_LIST = ", ".join(str((i, *row)) for i, row in enumerate(classify.grid()))
#: Every order is an observation of one experiment of the grid; the metric comes from the sum of their prices.
_RESULT = f"""g AS (SELECT * FROM (VALUES {_GRID_LIST}) t(i, preprocessing, feature_set, representation, classifier)),
    x AS (SELECT (o_orderkey % {len(classify.grid())})::INT AS i, (sum(round(o_totalprice * 100)::BIGINT) % 100003)::BIGINT AS f1_macro, count(*) AS n FROM orders GROUP BY 1),
    r AS (SELECT preprocessing, feature_set, representation, classifier, f1_macro, n FROM x JOIN g USING (i))"""


def _results(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    seen = table(spark, sf, "orders").groupBy((F.col("o_orderkey") % len(classify.grid())).cast("int").alias("i")).agg((F.sum(cents) % 100003).alias("f1_macro"), F.count("*").alias("n"))
    return seen.join(_grid(spark), "i").drop("i")


@query(f"WITH {_RESULT} SELECT * EXCLUDE n, row_number() OVER (ORDER BY f1_macro DESC, preprocessing, feature_set, representation, classifier)::INT AS place FROM r")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """Experiments by what the orders make of their metric."""
    return classify.leaderboard(_results(spark, sf).drop("n"))


@query(
    f"""WITH {_RESULT}, f AS (SELECT * EXCLUDE n, CASE WHEN representation IN ('sbert', 'labse') THEN representation || '_frozen' ELSE representation END AS family FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY f1_macro DESC, preprocessing, feature_set, representation, classifier) AS n FROM f) SELECT * EXCLUDE n FROM k WHERE n = 1"""
)
def family_winners(spark: SparkSession, sf: str) -> DataFrame:
    return classify.family_winners(_results(spark, sf).drop("n"))


@query(f"WITH {_RESULT} SELECT preprocessing, feature_set, representation, classifier FROM r WHERE f1_macro % 2 = 1")
def pending_experiments(spark: SparkSession, sf: str) -> DataFrame:
    """Experiments of the orders whose metric is odd: those of an even one count as done."""
    found = _results(spark, sf)
    return classify.pending(found.select(*classify.KEY), found.where("f1_macro % 2 = 0"))


@query()
def trained_head(spark: SparkSession, sf: str) -> DataFrame:
    """A head over the embeddings as chunk vectors, a label each of their classes, splits by hash: every epoch's row."""
    from ..functions.text import unit_hash

    e = table(spark, sf, "embeddings").where("embedding is not null and label is not null")
    chunks = e.select(F.col("vec_id").alias("handle"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(1.0).alias("weight"))
    items = e.select(F.col("vec_id").alias("handle"), F.array(F.concat(F.lit("c"), F.col("label").cast("string"))).alias("labels"))
    at = unit_hash("head", F.col("vec_id"))
    splits = e.select(F.col("vec_id").alias("handle"), F.when(at < 0.6, "train").when(at < 0.75, "calibration").when(at < 0.9, "validation").otherwise("test").alias("split"))
    found = head.train(chunks, labels.indicator(items), splits, head.Settings(batch=256, accumulation=4, max_epochs=3, checkpoint_steps=0))
    kind = "epoch int, train_loss double, validation_f1_macro double, validation_f1_micro double, improved boolean, best_epoch int"
    return spark.createDataFrame([tuple(h[c.split(" ")[0]] for c in kind.split(", ")) for h in found.history], kind)


@query(
    """WITH e AS (SELECT doc_id AS handle, quality FROM labels), n AS (SELECT count(*) AS n, sum(quality) AS p FROM e)
    SELECT 'quality' AS label, (n - p)::DOUBLE / greatest(p, 1) AS pos_weight FROM n"""
)
def positive_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("handle"), F.lit("quality").alias("label"), F.col("quality").alias("y"))
    return dense.positive_weights(rows)


# --- run aggregates ----------------------------------------------------------------------------------------------


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.col("user_id").alias("run"), (F.col("event_id") % 12).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("metric"))


_EPOCHS = "ep AS (SELECT user_id AS run, event_id % 12 AS epoch, round(avg(value), 6) AS metric FROM events GROUP BY ALL)"


@query(
    f"""WITH RECURSIVE {_EPOCHS}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM ep),
    f AS (SELECT run, epoch, metric, i, metric AS best, TRUE AS improved, 0 AS waited FROM o WHERE i = 1
      UNION ALL SELECT o.run, o.epoch, o.metric, o.i, CASE WHEN o.metric > f.best + 0.5::DOUBLE THEN o.metric ELSE f.best END, o.metric > f.best + 0.5::DOUBLE,
      CASE WHEN o.metric > f.best + 0.5::DOUBLE THEN 0 ELSE f.waited + 1 END FROM f JOIN o ON o.run = f.run AND o.i = f.i + 1)
    SELECT run, epoch, metric, best, improved, waited::INT AS waited, waited >= 3 AS stop FROM f"""
)
def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    return dense.early_stopping(_epochs(spark, sf), 0.5, 3)


@query(f"WITH {_EPOCHS} SELECT run, count(*) AS epochs_evaluated, arg_max(epoch, (metric, -epoch)) AS peak_epoch, max(metric) AS peak_metric, max(epoch) AS stopped_after_epoch FROM ep GROUP BY run")
def epoch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runs.epoch_summary(_epochs(spark, sf))


@query(
    """SELECT event_type AS model, count(*) AS n_runs, round(avg(value), 6) AS value_mean, round(stddev_samp(value), 6) AS value_sd, min(value) AS value_min, max(value) AS value_max
    FROM events GROUP BY 1"""
)
def seed_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("model"), "value")
    found = runs.seed_aggregate(e, ("model",), ("value",))
    return found.withColumns({"value_mean": F.round("value_mean", 6), "value_sd": F.round("value_sd", 6)})


@query(
    """WITH r AS (SELECT user_id AS seed, event_id % 2 AS m, max(round(value, 4)) AS v FROM events GROUP BY ALL)
    SELECT x.seed, x.v AS a, y.v AS b, round(x.v - y.v, 6) AS difference FROM r x JOIN r y ON x.seed = y.seed AND x.m = 0 AND y.m = 1"""
)
def paired_differences(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("seed"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("model"))
    return runs.paired_differences(e.agg(F.max(F.round("value", 4)).alias("v")), "v", "x", "y").withColumn("difference", F.round("difference", 6))


@query(
    """WITH d AS (SELECT source AS split, length(text) AS o, least(length(text), 4000) AS s, least(length(text), 2500) AS v, length(text) // 5 AS tt, least(length(text), 2500) // 5 AS st,
      1 + least(length(text), 2500) // 500 AS c, 1 + doc_id % 3 AS u FROM documents)
    SELECT split, count(*) AS n_documents, sum(o)::BIGINT AS original_characters, sum(s)::BIGINT AS capped_characters, sum(v)::BIGINT AS selected_characters,
      round(100.0::DOUBLE * sum(s) / sum(o), 6) AS cap_retained_percentage, round(100.0::DOUBLE * sum(v) / sum(s), 6) AS coverage_percentage,
      round(100.0::DOUBLE * sum(st) / sum(tt), 6) AS token_coverage_percentage, sum(c)::BIGINT AS selected_chunks, round(avg(c), 6) AS chunks_mean,
      quantile_cont(c, 0.5) AS chunks_median, round(quantile_cont(c::DOUBLE, 0.95), 6) AS chunks_p95, max(c)::BIGINT AS chunks_max,
      round(avg(coalesce(v::DOUBLE / nullif(s, 0), 0)), 6) AS document_fraction_mean, round(quantile_cont(coalesce(v::DOUBLE / nullif(s, 0), 0), 0.5), 6) AS document_fraction_median,
      sum((u > 1)::INT)::BIGINT AS documents_with_multiple_units, sum((v = s)::INT)::BIGINT AS fully_exposed_documents, sum((o > s)::INT)::BIGINT AS truncated_documents,
      sum((tt = 0)::INT)::BIGINT AS tokenless_documents FROM d GROUP BY ROLLUP (split)"""
)
def exposure_rollup(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text").cast("long")
    seen = F.least(n, F.lit(2500).cast("long"))
    fifth = lambda c: F.floor(c / 5)
    d = table(spark, sf, "documents").select(
        F.col("source").alias("split"), n.alias("original"), F.least(n, F.lit(4000).cast("long")).alias("source"), seen.alias("observed"),
        fifth(n).alias("total_tokens"), fifth(seen).alias("selected_tokens"), (F.floor(seen / 500) + 1).alias("chunks"), (F.col("doc_id") % 3 + 1).alias("units"),
    )
    found = runs.exposure(d)
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(
    """SELECT source, count(*) AS documents, sum(n_chars)::DOUBLE / 1e6::DOUBLE AS seconds, round(count(*) * 3600.0::DOUBLE / (sum(n_chars) / 1e6::DOUBLE), 4) AS documents_per_hour,
    floor(count(*) * 3600.0::DOUBLE / (sum(n_chars)::DOUBLE / 1e6::DOUBLE) * 24)::BIGINT AS documents_24h, floor(count(*) * 3600.0::DOUBLE / (sum(n_chars)::DOUBLE / 1e6::DOUBLE) * 20)::BIGINT AS documents_20h
    FROM documents GROUP BY source"""
)
def scaling_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("documents"), (F.sum("n_chars") / F.lit(1e6)).alias("seconds"))
    return runs.scaling_estimate(d).withColumn("documents_per_hour", F.round("documents_per_hour", 4))


@query(
    """WITH s AS (SELECT user_id AS run, event_id AS session, round(value, 3) AS seconds, CASE WHEN event_type = 'click' AND event_id <> 5 THEN 'interrupted' ELSE event_type END AS state FROM events)
    SELECT run, round(sum(seconds), 3) AS seconds_total, count(*) AS sessions, sum((state = 'interrupted')::INT)::BIGINT AS interrupted FROM s GROUP BY run"""
)
def sessions_resume(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("session"), F.round("value", 3).alias("seconds"),
        F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("state"),
    )
    done = runs.session_time(runs.mark_interrupted(e, "5"))
    return done.withColumn("seconds_total", F.round("seconds_total", 3))


@query(
    """WITH r AS (SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS role FROM orders)
    SELECT status, string_agg(role, ';' ORDER BY role) AS selection_roles FROM r GROUP BY status"""
)
def selection_roles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("role"))
    return runs.selection_roles(rows, ("status",))
