"""Queries on scores, thresholds, metrics and bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scores as S
from ..sources.scratch import keep
from .base import ORDER_ITEMS, hash_scores, language_scores, query, scores_sql, table

BASE = f"{ORDER_ITEMS}, {scores_sql()}, p AS (SELECT *, (score >= 0.55)::INT AS pred FROM scores)"
_CELLS = "sum(y * pred) AS tp, sum((1 - y) * pred) AS fp, sum(y * (1 - pred)) AS fn, sum((1 - y) * (1 - pred)) AS tn"
_F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return S.apply_thresholds(hash_scores(spark, sf), 0.55)


@query(f"WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score DESC, label) AS rank FROM scores) SELECT handle, label, rank::INT AS rank FROM r WHERE rank <= 3")
def scores_topk(spark: SparkSession, sf: str) -> DataFrame:
    return S.rank_labels(hash_scores(spark, sf), k=3).select("handle", "label", "rank")


@query(
    f"""WITH {BASE}, r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score DESC, label) AS rank FROM scores),
    d AS (SELECT handle, sum(y) AS pos, sum(CASE WHEN rank <= 1 THEN y ELSE 0 END) AS h1, sum(CASE WHEN rank <= 3 THEN y ELSE 0 END) AS h3, sum(CASE WHEN rank <= 5 THEN y ELSE 0 END) AS h5 FROM r GROUP BY handle)
    SELECT round(avg(h1 / 1.0), 6) AS precision_at_1, round(avg(coalesce(h1::DOUBLE / nullif(pos, 0), 0)), 6) AS recall_at_1,
      round(avg(h3 / 3.0::DOUBLE), 6) AS precision_at_3, round(avg(coalesce(h3::DOUBLE / nullif(pos, 0), 0)), 6) AS recall_at_3,
      round(avg(h5 / 5.0::DOUBLE), 6) AS precision_at_5, round(avg(coalesce(h5::DOUBLE / nullif(pos, 0), 0)), 6) AS recall_at_5 FROM d"""
)
def precision_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    found = S.at_k(hash_scores(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


_LABEL = f"l AS (SELECT label, {_CELLS} FROM p GROUP BY label), i AS (SELECT handle, {_CELLS} FROM p GROUP BY handle)"
_METRICS = f"""(SELECT avg((fp + fn = 0)::INT) FROM i) AS subset_accuracy, (SELECT sum(fp + fn)::DOUBLE / sum(tp + fp + fn + tn) FROM l) AS hamming_loss,
  (SELECT avg(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)) FROM l) AS precision_macro, (SELECT avg(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)) FROM l) AS recall_macro,
  (SELECT avg({_F1}) FROM l) AS f1_macro, (SELECT avg(coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0)) FROM l) AS jaccard_macro,
  (SELECT sum(tp)::DOUBLE / sum(tp + fp) FROM l) AS precision_micro, (SELECT sum(tp)::DOUBLE / sum(tp + fn) FROM l) AS recall_micro,
  (SELECT 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) FROM l) AS f1_micro, (SELECT sum(tp)::DOUBLE / sum(tp + fp + fn) FROM l) AS jaccard_micro,
  (SELECT avg({_F1}) FROM i) AS f1_samples, (SELECT avg(coalesce(tp::DOUBLE / nullif(tp + fp + fn, 0), 0)) FROM i) AS jaccard_samples, (SELECT count(*) FROM i) AS n_items"""


@query(f"WITH {BASE}, {_LABEL}, m AS (SELECT {_METRICS}) SELECT round(COLUMNS(* EXCLUDE n_items), 6), n_items FROM m")
def multilabel_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = S.multilabel_metrics(_pred(spark, sf))
    names = (
        "subset_accuracy hamming_loss precision_macro recall_macro f1_macro jaccard_macro precision_micro recall_micro f1_micro jaccard_micro "
        "f1_samples jaccard_samples"
    ).split()
    return found.select(*[F.round(c, 6).alias(c) for c in names], "n_items")


_AP = """s AS (SELECT label, score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scores GROUP BY ALL),
  t AS (SELECT label, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  ap AS (SELECT label, sum(pos * tp / seen) / sum(pos) AS average_precision FROM t GROUP BY label HAVING sum(pos) > 0)"""


@query(f"WITH {BASE}, {_AP} SELECT label, round(average_precision, 6) AS average_precision FROM ap")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return S.average_precision(hash_scores(spark, sf)).withColumn("average_precision", F.round("average_precision", 6))


@query(
    f"""WITH {BASE}, {_AP}, f AS (SELECT score, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scores GROUP BY score),
    g AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM f WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT round((SELECT avg(average_precision) FROM ap), 6) AS average_precision_macro, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision_micro FROM g"""
)
def average_precision_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = S.average_precision_summary(hash_scores(spark, sf))
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@query(
    f"""WITH {BASE}, {_AP}, l AS (SELECT label, {_CELLS} FROM p GROUP BY label)
    SELECT label, (tp + fn)::BIGINT AS support, (tp + fp)::BIGINT AS predicted_support, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision,
      round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({_F1}, 6) AS f1, round(average_precision, 6) AS average_precision,
      round(coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0), 6) AS specificity, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
      row_number() OVER (ORDER BY {_F1} DESC, tp + fn DESC, label)::INT AS rank
    FROM l LEFT JOIN ap USING (label)"""
)
def per_label(spark: SparkSession, sf: str) -> DataFrame:
    ranked = S.performance_ranking(S.per_label(_pred(spark, sf)))
    return ranked.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in ranked.dtypes])


@query(f"WITH {BASE} SELECT label, {_CELLS.replace('sum(', 'sum(').replace(' AS', '::BIGINT AS')}, sum(pred)::BIGINT AS predicted_support FROM p GROUP BY label")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return S.confusion_matrices(_pred(spark, sf))


@query(f"WITH {BASE} SELECT a.label AS missed, b.label AS predicted_instead, count(*) AS n FROM p a JOIN p b ON a.handle = b.handle WHERE a.y = 1 AND a.pred = 0 AND b.y = 0 AND b.pred = 1 GROUP BY ALL")
def substitution_errors(spark: SparkSession, sf: str) -> DataFrame:
    return S.substitution_errors(_pred(spark, sf))


_LANG = "lp AS (SELECT p.*, o_orderpriority AS language FROM p JOIN orders ON o_orderkey = handle)"


@query(
    f"""WITH {BASE}, {_LANG}, l AS (SELECT language, label, {_CELLS} FROM lp GROUP BY ALL),
    m AS (SELECT language, avg({_F1}) AS f1_macro, 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS f1_micro,
      sum((tp + fn > 0)::INT) AS evaluable_labels, sum((tp + fn = 0)::INT) AS non_evaluable_labels FROM l GROUP BY language),
    r AS (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY score DESC, label) AS rank FROM lp),
    d AS (SELECT language, handle, sum(y) AS pos, sum(CASE WHEN rank <= 3 THEN y ELSE 0 END) AS h3, sum(CASE WHEN rank <= 5 THEN y ELSE 0 END) AS h5 FROM r GROUP BY ALL),
    k AS (SELECT language, count(*) AS n, avg(h3 / 3.0::DOUBLE) AS precision_at_3, avg(coalesce(h3::DOUBLE / nullif(pos, 0), 0)) AS recall_at_3,
      avg(h5 / 5.0::DOUBLE) AS precision_at_5, avg(coalesce(h5::DOUBLE / nullif(pos, 0), 0)) AS recall_at_5 FROM d GROUP BY language)
    SELECT language, n, evaluable_labels::BIGINT AS evaluable_labels, non_evaluable_labels::BIGINT AS non_evaluable_labels, round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro,
      round(precision_at_3, 6) AS precision_at_3, round(recall_at_3, 6) AS recall_at_3, round(precision_at_5, 6) AS precision_at_5, round(recall_at_5, 6) AS recall_at_5
    FROM m JOIN k USING (language) WHERE n >= 30"""
)
def language_performance(spark: SparkSession, sf: str) -> DataFrame:
    found = S.items_by_language(language_scores(spark, sf, 0.55))
    return found.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


_SWEEP = f"""{ORDER_ITEMS}, {scores_sql()}, c AS (SELECT unnest(range(1, 20)) * 0.05 AS t0), cc AS (SELECT round(t0, 2)::DOUBLE AS threshold FROM c),
  sw AS (SELECT label, threshold, sum(y * (score >= threshold)::INT) AS tp, sum((1 - y) * (score >= threshold)::INT) AS fp, sum(y * (score < threshold)::INT) AS fn
    FROM scores, cc GROUP BY ALL)"""


@query(f"WITH {_SWEEP} SELECT threshold, round(avg({_F1}), 6) AS f1_macro FROM sw GROUP BY threshold")
def threshold_global(spark: SparkSession, sf: str) -> DataFrame:
    swept = S.sweep(hash_scores(spark, sf), S.PROBABILITY_CANDIDATES)
    return S.global_thresholds(swept).withColumn("f1_macro", F.round("f1_macro", 6))


@query(
    f"""WITH {_SWEEP}, g AS (SELECT arg_max(threshold, (f, -abs(threshold - 0.5), -threshold)) AS t FROM (SELECT threshold, avg({_F1}) AS f FROM sw GROUP BY threshold)),
    b AS (SELECT label, arg_max(threshold, ({_F1}, -threshold)) AS best, max(tp + fn) AS support FROM sw GROUP BY label)
    SELECT label, CASE WHEN support >= 600 THEN best ELSE (SELECT t FROM g) END AS threshold FROM b"""
)
def threshold_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return S.calibrate(hash_scores(spark, sf), "probabilities", "per_label_threshold", 600)


@query(
    f"""WITH {ORDER_ITEMS}, {scores_sql()}, q AS (SELECT unnest(quantile_cont(score * 4 - 2, {[round(0.02 + 0.02 * i, 2) for i in range(49)]})) AS t FROM scores)
    SELECT DISTINCT round(t, 6) AS threshold FROM (SELECT t FROM q UNION ALL SELECT 0.0)"""
)
def threshold_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = hash_scores(spark, sf).withColumn("score", F.col("score") * 4 - 2)
    found = S.candidate_thresholds(rows, "decision_scores")
    return spark.createDataFrame([(float(t),) for t in found], "threshold double").select(F.round("threshold", 6).alias("threshold")).distinct()


_STEPS = str([float(x) for x in S.POISSON_STEPS])


def _weights_sql(stream: str = "") -> str:
    h = f"sha256('42|{stream}|' || handle || '|' || i)"
    return f"""bh{stream} AS (SELECT handle, i, {h} AS h FROM items, (SELECT unnest(range(63)) AS i)),
    bu{stream} AS (SELECT handle, i * 16 + j AS r, ('0x' || substr(h, (1 + 4 * j)::INT, 4))::INT / 65536.0::DOUBLE AS u FROM bh{stream}, (SELECT unnest(range(16)) AS j)),
    bw{stream} AS (SELECT handle, r AS replicate, len(list_filter({_STEPS}, lambda s: u >= s)) AS w FROM bu{stream} WHERE r < 1000 AND u >= {float(S.POISSON_STEPS[0])}),
    bc{stream} AS (SELECT replicate, label, sum(w * y * pred) AS tp, sum(w * (1 - y) * pred) AS fp, sum(w * y * (1 - pred)) AS fn FROM p JOIN bw{stream} USING (handle) WHERE y = 1 OR pred = 1 GROUP BY ALL),
    bf{stream} AS (SELECT replicate, sum({_F1}) / (SELECT count(DISTINCT label) FROM il) AS f1_macro, 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) AS f1_micro FROM bc{stream} GROUP BY replicate)"""


@query(
    f"""WITH {BASE}, {_LABEL}, {_weights_sql()}
    SELECT 'f1_macro' AS metric, round((SELECT avg({_F1}) FROM l), 6) AS estimate, round(quantile_cont(f1_macro, 0.025), 6) AS ci_lower, round(quantile_cont(f1_macro, 0.975), 6) AS ci_upper FROM bf
    UNION ALL SELECT 'f1_micro', round((SELECT 2.0::DOUBLE * sum(tp) / sum(2 * tp + fp + fn) FROM l), 6), round(quantile_cont(f1_micro, 0.025), 6), round(quantile_cont(f1_micro, 0.975), 6) FROM bf"""
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    found = S.bootstrap_intervals(_pred(spark, sf))
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("estimate", "ci_lower", "ci_upper")])


def _draws_sql(stream: str) -> str:
    """Replicate differences of both metrics under the multiplicities of a stream."""
    h = f"sha256('42|{stream}|' || handle || '|' || i)"
    cells = lambda p: f"sum(w * y * {p}) AS tp_{p}, sum(w * (1 - y) * {p}) AS fp_{p}, sum(w * y * (1 - {p})) AS fn_{p}"
    f1 = lambda p: f"coalesce(2.0::DOUBLE * tp_{p} / nullif(2 * tp_{p} + fp_{p} + fn_{p}, 0), 0)"
    micro = lambda p: f"coalesce(2.0::DOUBLE * sum(tp_{p}) / nullif(sum(2 * tp_{p} + fp_{p} + fn_{p}), 0), 0)"
    labels = "(SELECT count(DISTINCT label) FROM il)"
    return f"""h_{stream} AS (SELECT handle, i, {h} AS h FROM items, (SELECT unnest(range(63)) AS i)),
    u_{stream} AS (SELECT handle, i * 16 + j AS r, ('0x' || substr(h, (1 + 4 * j)::INT, 4))::INT / 65536.0::DOUBLE AS u FROM h_{stream}, (SELECT unnest(range(16)) AS j)),
    w_{stream} AS (SELECT handle, r, len(list_filter({_STEPS}, lambda s: u >= s)) AS w FROM u_{stream} WHERE r < 1000 AND u >= {float(S.POISSON_STEPS[0])}),
    c_{stream} AS (SELECT r, label, {cells("a")}, {cells("b")} FROM q JOIN w_{stream} USING (handle) WHERE y = 1 OR a = 1 OR b = 1 GROUP BY ALL),
    d_{stream} AS (SELECT r, (sum({f1("b")}) - sum({f1("a")})) / {labels} AS f1_macro, {micro("b")} - {micro("a")} AS f1_micro FROM c_{stream} GROUP BY r)"""


def _paired_sql(metric: str) -> str:
    q = lambda x: f"round((SELECT quantile_cont({metric}, {x}) FROM d_{metric}), 6)"
    share = f"(SELECT avg(({metric} > 0)::INT) FROM d_{metric})"
    return f"""SELECT '{metric}' AS metric, round({metric}, 6) AS difference_candidate_minus_global, {q(0.025)} AS ci_lower, {q(0.975)} AS ci_upper,
      round({share}, 6) AS probability_candidate_better FROM e"""


@query(
    f"""WITH {ORDER_ITEMS}, {scores_sql()}, q AS (SELECT handle, label, y, (score >= 0.7::DOUBLE)::INT AS a, (score >= 0.55::DOUBLE)::INT AS b FROM scores),
    {_draws_sql("f1_macro")}, {_draws_sql("f1_micro")},
    l AS (SELECT label, sum(y * a) AS tp_a, sum((1 - y) * a) AS fp_a, sum(y * (1 - a)) AS fn_a, sum(y * b) AS tp_b, sum((1 - y) * b) AS fp_b, sum(y * (1 - b)) AS fn_b FROM q GROUP BY label),
    e AS (SELECT avg(coalesce(2.0::DOUBLE * tp_b / nullif(2 * tp_b + fp_b + fn_b, 0), 0)) - avg(coalesce(2.0::DOUBLE * tp_a / nullif(2 * tp_a + fp_a + fn_a, 0), 0)) AS f1_macro,
      2.0::DOUBLE * sum(tp_b) / sum(2 * tp_b + fp_b + fn_b) - 2.0::DOUBLE * sum(tp_a) / sum(2 * tp_a + fp_a + fn_a) AS f1_micro FROM l)
    {_paired_sql("f1_macro")} UNION ALL {_paired_sql("f1_micro")}"""
)
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    rows = keep(hash_scores(spark, sf), "scores")  # read for either side
    found = S.paired_bootstrap(S.apply_thresholds(rows, 0.7), S.apply_thresholds(rows, 0.55))
    names = ("difference_candidate_minus_global", "ci_lower", "ci_upper", "probability_candidate_better")
    return found.select("metric", *[F.round(c, 6).alias(c) for c in names])


@query(
    f"""WITH {BASE}, l AS (SELECT label, {_CELLS} FROM p GROUP BY label), t AS (SELECT (tp + fn)::DOUBLE AS s, {_F1} AS v FROM l),
    r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rv FROM t)
    SELECT count(*) AS n, round(corr(ln(1 + s), v), 6) AS pearson_log1p_support_f1, round(corr(rs::DOUBLE, rv::DOUBLE), 6) AS spearman_support_f1 FROM r"""
)
def support_correlations(spark: SparkSession, sf: str) -> DataFrame:
    found = S.correlations(S.label_f1(_pred(spark, sf)))
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"])


@query(
    f"""WITH {BASE} SELECT handle, to_json(coalesce(list_sort(list(label) FILTER (y = 1)), []))::VARCHAR AS true_labels,
    to_json(coalesce(list_sort(list(label) FILTER (pred = 1)), []))::VARCHAR AS predicted_labels FROM p GROUP BY handle"""
)
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return S.predictions(_pred(spark, sf)).select("handle", "true_labels", "predicted_labels")


@query(
    f"""WITH {ORDER_ITEMS}, {scores_sql()}, p AS (SELECT label, seed, y, (score >= 0.4::DOUBLE + 0.1::DOUBLE * seed)::INT AS pred FROM scores, (SELECT unnest([1, 2, 3]) AS seed)),
    l AS (SELECT label, seed, {_CELLS} FROM p GROUP BY ALL), f AS (SELECT label, {_F1} AS f1 FROM l)
    SELECT 'm' AS model, label, count(*) AS n_runs, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_sd, round(min(f1), 6) AS f1_min, round(max(f1), 6) AS f1_max FROM f GROUP BY label"""
)
def per_label_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import runs

    rows = hash_scores(spark, sf).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    rows = rows.withColumns({"model": F.lit("m"), "pred": (F.col("score") >= 0.4 + F.lit(0.1) * F.col("seed")).cast("int")})
    found = runs.per_label_over_seeds(rows)
    return found.select("model", "label", "n_runs", *[F.round(c, 6).alias(c) for c in ("f1_mean", "f1_sd", "f1_min", "f1_max")])
