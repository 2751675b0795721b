"""Queries on labels, samples, splits and sparse vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, vectorize
from ..sources.scratch import keep
from .base import HASH, ORDER_ITEMS, document_items, order_items, query, table


@query(
    f"""WITH {ORDER_ITEMS}, s AS (SELECT len(labels) AS n FROM items), l AS (SELECT count(DISTINCT label) AS labels FROM il)
    SELECT count(*) AS items, sum(n)::BIGINT AS assignments, avg(n) AS cardinality, quantile_cont(n, 0.5) AS median_labels, stddev_pop(n) AS std_labels,
      min(n)::INT AS min_labels, max(n)::INT AS max_labels, any_value(l.labels) AS labels, avg(n) / any_value(l.labels) AS density FROM s, l"""
)
def dataset_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return labels.dataset_statistics(order_items(spark, sf))


@query(f"WITH {ORDER_ITEMS} SELECT label, count(*) AS support FROM il GROUP BY label")
def label_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_support(order_items(spark, sf))


@query(
    f"""WITH {ORDER_ITEMS}, s AS (SELECT label, count(*) AS n FROM il GROUP BY label),
    c AS (SELECT a.label AS label_a, b.label AS label_b, count(*) AS k FROM il a JOIN il b ON a.handle = b.handle AND a.label < b.label GROUP BY ALL)
    SELECT x.label AS label_a, y.label AS label_b, coalesce(k, 0) AS cooccurrence, coalesce(k, 0)::DOUBLE / (x.n + y.n - coalesce(k, 0)) AS jaccard
    FROM s x JOIN s y ON x.label < y.label LEFT JOIN c ON c.label_a = x.label AND c.label_b = y.label"""
)
def label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_pairs(order_items(spark, sf))


@query(f"WITH {ORDER_ITEMS} SELECT a.label AS label_a, b.label AS label_b, count(*) AS n FROM il a JOIN il b ON a.handle = b.handle GROUP BY ALL")
def label_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_matrix(order_items(spark, sf))


@query(f"WITH {ORDER_ITEMS}, l AS (SELECT DISTINCT label FROM il) SELECT label, sum(list_contains(labels, label)::INT)::BIGINT AS positives, count(*) AS n FROM items, l GROUP BY label")
def label_indicator(spark: SparkSession, sf: str) -> DataFrame:
    rows = labels.indicator(order_items(spark, sf))
    return rows.groupBy("label").agg(F.sum("y").alias("positives"), F.count("*").alias("n"))


@query(
    f"""WITH {ORDER_ITEMS}, s AS (SELECT label, count(*) AS n FROM il GROUP BY label HAVING count(*) >= 5 ORDER BY n DESC, label LIMIT 10)
    SELECT handle, array_to_string(list_sort(list(label)), ',') AS labels FROM il WHERE label IN (SELECT label FROM s) GROUP BY handle"""
)
def label_select_topk(spark: SparkSession, sf: str) -> DataFrame:
    kept, _ = labels.select_labels(order_items(spark, sf), 10, 5)
    return kept.select("handle", F.array_join("labels", ",").alias("labels"))


_ORDERED = f"""{ORDER_ITEMS}, sup AS (SELECT label, count(*) AS n FROM il GROUP BY label),
  st AS (SELECT handle, arg_min(label, (n, label)) AS stratum FROM il JOIN sup USING (label) GROUP BY handle),
  pl AS (SELECT handle, stratum, (row_number() OVER (PARTITION BY stratum ORDER BY {HASH.format("'42|' || handle")}, handle) - 0.5) / count(*) OVER (PARTITION BY stratum) AS place FROM st)"""
_SPLIT = "CASE WHEN place < 0.65 THEN 'train' WHEN place < 0.65 + 0.1 THEN 'calibration' WHEN place < 0.65 + 0.1 + 0.1 THEN 'validation' ELSE 'test' END AS split"
SHARES = {"train": 0.65, "calibration": 0.1, "validation": 0.1, "test": 0.15}


@query(f"WITH {_ORDERED} SELECT handle, {_SPLIT} FROM pl")
def split_assign(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_items(order_items(spark, sf), SHARES)[0].select("handle", "split")


@query(
    f"""WITH {_ORDERED}, a AS (SELECT handle, {_SPLIT} FROM pl), c AS (SELECT label, split FROM il JOIN a USING (handle))
    SELECT label, count(*) AS support_total, count(*) FILTER (split = 'train') AS support_train, count(*) FILTER (split = 'calibration') AS support_calibration,
      count(*) FILTER (split = 'validation') AS support_validation, count(*) FILTER (split = 'test') AS support_test,
      count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'calibration') > 0 AND count(*) FILTER (split = 'validation') > 0
      AND count(*) FILTER (split = 'test') > 0 AS present_in_all_splits FROM c GROUP BY label"""
)
def split_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return labels.coverage(labels.split_items(order_items(spark, sf), SHARES)[0], tuple(SHARES))


@query(f"WITH {_ORDERED}, a AS (SELECT handle, {_SPLIT} FROM pl) SELECT split, count(*) AS n FROM a GROUP BY split")
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.split_sizes(labels.split_items(order_items(spark, sf), SHARES)[0])


_FOLD = "sha256(replace(lower(trim(regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+', ' ', 'g'))), 'ß', 'ss'))"


@query(
    f"""WITH items AS (SELECT {_FOLD} AS g, doc_id, ['lang:' || lang, 'source:' || source] AS labels FROM documents),
    il AS (SELECT DISTINCT g, unnest(labels) AS label FROM items), sup AS (SELECT label, count(*) AS n FROM il GROUP BY label),
    st AS (SELECT g, arg_min(label, (n, label)) AS stratum FROM il JOIN sup USING (label) GROUP BY g),
    pl AS (SELECT g, (row_number() OVER (PARTITION BY stratum ORDER BY {HASH.format("'42|' || g")}, g) - 0.5) / count(*) OVER (PARTITION BY stratum) AS place FROM st)
    SELECT doc_id AS handle, {_SPLIT} FROM items JOIN pl USING (g)"""
)
def split_group_safe(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.items import content_groups

    # Narrow and stored: the split reads items and groups several times, the texts once.
    items = keep(content_groups(document_items(spark, sf)).select("handle", "labels", "content_group"), "grouped-items")
    return labels.split_items(items, SHARES, group_column="content_group", max_tries=1)[0].select("handle", "split")


@query(f"WITH {_ORDERED} SELECT handle FROM pl WHERE place < 2000::DOUBLE / (SELECT count(*) FROM items)")
def sample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return labels.stratified_sample(order_items(spark, sf), 2000).select("handle")


@query()
def split_restore(spark: SparkSession, sf: str) -> DataFrame:
    """A split frozen to a manifest, restored for reordered items: the fingerprints agree."""
    items = keep(order_items(spark, sf), "items")  # read by the split, the restored split and both fingerprints
    frozen, seed = labels.split_items(items, SHARES)
    restored = labels.restore_split(items.orderBy(F.desc("handle")), frozen.select("handle", "split"))
    one, two = labels.split_fingerprint(frozen), labels.split_fingerprint(restored)
    return spark.createDataFrame([(seed, one == two)], "seed int, same boolean")


# --- sparse vectors ----------------------------------------------------------------------------------------------


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("handle"), "text", "lang")


_COUNTS = """w AS (SELECT doc_id AS handle, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
  g AS (SELECT handle, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
  c AS (SELECT handle, term, count(*) AS tf FROM g GROUP BY ALL),
  nd AS (SELECT count(*)::DOUBLE AS n FROM documents)"""
_VOCAB = f"""{_COUNTS}, v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS corpus_tf FROM c GROUP BY term ORDER BY corpus_tf DESC, term LIMIT 100000),
  kc AS (SELECT c.*, v.df FROM c JOIN v USING (term))"""


def _fitted(spark: SparkSession, sf: str, kind: str):
    """The model of all documents, and the documents' weights by it."""
    texts = _texts(spark, sf)
    one_row = not vectorize.repeats(texts, "handle")
    model = vectorize.fit_totals(kind, vectorize.term_totals(texts, one_row=one_row), texts.count())
    return model, lambda top=None: model.transform_texts(texts, one_row=one_row, top=top)


@query(f"WITH {_VOCAB} SELECT term, df, corpus_tf FROM v")
def bow_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf, "bow")[0].terms


@query(f"WITH {_VOCAB} SELECT handle, term, tf::DOUBLE AS weight FROM kc")
def bow_counts(spark: SparkSession, sf: str) -> DataFrame:
    _, weights = _fitted(spark, sf, "bow")
    return weights()


@query(
    f"""WITH {_VOCAB}, r AS (SELECT handle, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM kc, nd)
    SELECT handle, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY handle)), 6) AS weight FROM r"""
)
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    _, weights = _fitted(spark, sf, "tfidf")
    return weights().withColumn("weight", F.round("weight", 6))


_BM25 = f"""{_VOCAB}, dl AS (SELECT handle, sum(tf)::DOUBLE AS dl FROM kc GROUP BY handle), av AS (SELECT sum(dl) / (SELECT n FROM nd) AS a FROM dl),
  b AS (SELECT handle, term, tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS weight
    FROM kc JOIN dl USING (handle), av, nd)"""


@query(f"WITH {_BM25} SELECT handle, term, round(weight, 6) AS weight FROM b")
def bm25_weights(spark: SparkSession, sf: str) -> DataFrame:
    _, weights = _fitted(spark, sf, "bm25")
    return weights().withColumn("weight", F.round("weight", 6))


@query(f"WITH {_BM25} SELECT (SELECT count(*) FROM v) AS terms, (SELECT count(*) FROM documents) AS documents, round((SELECT a FROM av), 6) AS average_length")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    model, _ = _fitted(spark, sf, "bm25")
    return model.terms.agg(F.count("*").alias("terms")).select(
        "terms", F.lit(model.n_documents).cast("long").alias("documents"), F.round(F.lit(model.average_length), 6).alias("average_length")
    )


@query(
    """WITH w AS (SELECT doc_id AS handle, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
    g AS (SELECT handle, lang, unnest(w) AS term FROM w), c AS (SELECT handle, lang, term, count(*) AS tf FROM g GROUP BY ALL),
    v AS (SELECT term, count(*) AS df FROM c WHERE lang <> 'de' GROUP BY term HAVING count(*) >= 2),
    n AS (SELECT count(*)::DOUBLE AS n FROM documents WHERE lang <> 'de'),
    a AS (SELECT sum(tf)::DOUBLE / (SELECT n FROM n) AS a FROM c JOIN v USING (term) WHERE lang <> 'de'),
    k AS (SELECT c.*, df FROM c JOIN v USING (term) WHERE lang = 'de'), dl AS (SELECT handle, sum(tf)::DOUBLE AS dl FROM k GROUP BY handle)
    SELECT handle, term, round(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / a)) * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 6) AS weight
    FROM k JOIN dl USING (handle), a, n"""
)
def bm25_train_only(spark: SparkSession, sf: str) -> DataFrame:
    """Fitted on all languages but one, applied to that one."""
    texts = _texts(spark, sf)
    train, test = texts.where("lang <> 'de'"), texts.where("lang = 'de'")
    model = vectorize.fit_totals("bm25", vectorize.term_totals(train, ngrams=(1, 1)), train.count(), None, min_df=2)
    return model.transform_texts(test, ngrams=(1, 1)).withColumn("weight", F.round("weight", 6))


@query(
    f"""WITH {_BM25}, r AS (SELECT handle, term, round(weight, 6) AS weight, row_number() OVER (PARTITION BY handle ORDER BY round(weight, 9) DESC, term) AS rank FROM b)
    SELECT handle, term, weight, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def entry_bm25_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    _, weights = _fitted(spark, sf, "bm25")
    order = Window.partitionBy("handle").orderBy(F.desc(F.round("weight", 9)), "term")
    ranked = weights(5).withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    return ranked.withColumn("weight", F.round("weight", 6))
