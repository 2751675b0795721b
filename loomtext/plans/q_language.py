"""Queries on language identification and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, language
from .base import query, table

_HITS = {
    g: " + ".join(f"contains(p, ' {w} ')::INT" for w in words) for g, words in language.MARKERS.items()
}


def detect_sql(source: str, text: str, keep: str, name: str = "det") -> str:
    """CTEs: ``name`` holds keep, language and score of every row of source."""
    hits = ", ".join(f"{h} AS n_{g}" for g, h in _HITS.items())
    best = "greatest(n_es, n_en, n_pt, n_fr)"
    return f"""{name}_p AS (SELECT {keep}, ' ' || trim(regexp_replace(lower({text}), '\\s+', ' ', 'g')) || ' ' AS p FROM {source}),
    {name}_h AS (SELECT {keep}, length(trim(p)) AS len, {hits} FROM {name}_p),
    {name} AS (SELECT {keep}, CASE WHEN len < 12 OR {best} = 0 THEN 'und' WHEN n_es = {best} THEN 'es' WHEN n_en = {best} THEN 'en'
      WHEN n_pt = {best} THEN 'pt' ELSE 'fr' END AS language,
      CASE WHEN len < 12 OR {best} = 0 THEN NULL ELSE {best}::DOUBLE / (n_es + n_en + n_pt + n_fr) END AS score FROM {name}_h)"""


DET = detect_sql("documents", "text", "doc_id, lang, source")


def detected(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumn("d", language.heuristic(F.col("text")))
    return d.select("doc_id", "lang", "source", F.col("d.language").alias("language"), F.col("d.score").alias("score"))


@query(f"WITH {DET} SELECT doc_id, language, score FROM det")
def language_heuristic(spark: SparkSession, sf: str) -> DataFrame:
    return detected(spark, sf).select("doc_id", "language", "score")


_WINDOWS = f"""w AS (SELECT doc_id, unnest(CASE WHEN length(text) > 4000 THEN range(5) ELSE [0] END) AS part, text FROM documents),
  s AS (SELECT doc_id, part, CASE WHEN length(text) > 4000 THEN substr(text, part * (length(text) - 4000) // 4 + 1, 4000) ELSE text END AS piece FROM w),
  {detect_sql("s", "piece", "doc_id, part", "win")},
  v AS (SELECT doc_id, language, count(*) AS n, min(part) AS first, avg(score) AS score FROM win GROUP BY ALL),
  vote AS (SELECT doc_id, language, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, language <> 'und' DESC, first) AS r FROM v) WHERE r = 1)"""


@query(f"WITH {_WINDOWS} SELECT doc_id, language, score FROM vote")
def language_windows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return language.detect_distributed(d, language.create_detector()).select("doc_id", "language", "score")


_AGG = f"""{detect_sql("conversations", "text", "conv_id, turn, role, text", "seg")},
  u AS (SELECT conv_id, language, sum(length(text)) AS chars, avg(score) AS score, min(turn) AS first FROM seg GROUP BY ALL),
  k AS (SELECT *, language <> 'und' AND chars::DOUBLE / greatest(coalesce(sum(chars) FILTER (language <> 'und') OVER (PARTITION BY conv_id), 0), 1) >= 0.2 AS sig FROM u),
  a AS (SELECT conv_id, list_sort(list(language) FILTER (sig)) AS langs,
    arg_max(language, (chars, (language <> 'und')::INT, -first)) AS dominant, arg_max_null(score, (chars, (language <> 'und')::INT, -first)) AS score FROM k GROUP BY conv_id)"""


@query(
    f"""WITH {_AGG} SELECT conv_id, CASE WHEN len(langs) > 1 THEN 'mul' ELSE dominant END AS detected_language,
    CASE WHEN len(langs) > 1 THEN NULL ELSE score END AS language_score, coalesce(array_to_string(langs, ','), '') AS language_set FROM a"""
)
def language_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").withColumn("d", language.heuristic(F.col("text")))
    units = c.select("conv_id", F.col("turn").alias("pos"), "text", F.col("d.language").alias("language"), F.col("d.score").alias("score"))
    return language.aggregate_languages(units, "conv_id").withColumn("language_set", F.array_join("language_set", ","))


@query(
    f"""WITH {detect_sql("documents", "text", "doc_id, text", "whole")},
    p AS (SELECT doc_id, unnest(range(0, length(text), 12000)) AS part, text FROM documents),
    s AS (SELECT doc_id, part, substr(text, part + 1, 12000) AS piece FROM p),
    {detect_sql("s", "piece", "doc_id, part, piece", "win")},
    u AS (SELECT doc_id, language, sum(length(piece)) AS chars FROM win GROUP BY ALL),
    k AS (SELECT *, language <> 'und' AND chars::DOUBLE / greatest(coalesce(sum(chars) FILTER (language <> 'und') OVER (PARTITION BY doc_id), 0), 1) >= 0.2 AS sig FROM u),
    a AS (SELECT doc_id, list_sort(list(language) FILTER (sig)) AS langs FROM k GROUP BY doc_id)
    SELECT doc_id, CASE WHEN len(langs) > 1 THEN 'mul' ELSE language END AS detected_language, coalesce(array_to_string(langs, ','), '') AS language_set
    FROM whole LEFT JOIN a USING (doc_id)"""
)
def language_override(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("pos"), "text")
    first = units.withColumn("d", language.heuristic(F.col("text"))).select(
        "doc_id", "pos", "text", F.col("d.language").alias("language"), F.col("d.score").alias("score")
    )
    whole = language.aggregate_languages(first, "doc_id")
    found = language.override_by_windows(whole, units, language.create_detector(), "doc_id")
    return found.select("doc_id", "detected_language", F.array_join("language_set", ",").alias("language_set"))


@query(
    """WITH k AS (SELECT doc_id, CASE WHEN length(trim(source || ' of the ' || lang)) < 16 THEN 'und' ELSE 'long' END AS kind, source || ' of the ' || lang AS t FROM documents)
    SELECT doc_id, CASE WHEN kind = 'und' THEN 'und' ELSE 'en' END AS language FROM k"""
)
def language_keywords(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat_ws(" ", F.col("source"), F.lit("of the"), F.col("lang"))
    found = language.detect_keywords(text, language.create_detector(), 16)
    return table(spark, sf, "documents").select("doc_id", found["language"].alias("language"))


@query(f"WITH {DET} SELECT language, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percentage FROM det GROUP BY language")
def language_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return language.distribution(detected(spark, sf), "language")


_PAGES = f"""{detect_sql("pages", "html", "page_id, html", "pd")},
  pa AS (SELECT 'page' AS field, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS declared, language AS detected FROM pd)"""


def _page_rows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select(
        F.lit("page").alias("field"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("declared"), language.heuristic(F.col("html"))["language"].alias("detected")
    )


@query(f"WITH {_PAGES} SELECT field, declared, detected, count(*) AS n, declared = detected AS agrees FROM pa GROUP BY ALL")
def language_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return language.agreement(_page_rows(spark, sf))


@query(
    f"""WITH {_PAGES}, b AS (SELECT field, declared NOT IN ('und', 'mul') AND detected <> 'und' AS ok, declared = detected AS same FROM pa)
    SELECT field, count(*) AS n, sum(ok::INT)::BIGINT AS auditable, sum((ok AND same)::INT)::BIGINT AS agreements,
    sum((ok AND same)::INT)::DOUBLE / nullif(sum(ok::INT), 0) AS agreement_rate FROM b GROUP BY field"""
)
def language_agreement_summary(spark: SparkSession, sf: str) -> DataFrame:
    return language.agreement_summary(_page_rows(spark, sf))


@query(f"WITH {DET} SELECT language, source AS label, count(*) AS n FROM det GROUP BY ALL")
def language_by_subject(spark: SparkSession, sf: str) -> DataFrame:
    return labels.labels_by_language(detected(spark, sf).withColumn("labels", F.array("source")), "language")


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    return detected(spark, sf).select("doc_id", F.col("lang").alias("truth"), F.col("language").alias("guess"))


@query(f"WITH {DET} SELECT count(*) AS n, sum((lang = language)::INT)::BIGINT AS correct, avg((lang = language)::INT) AS accuracy FROM det")
def gt_summary(spark: SparkSession, sf: str) -> DataFrame:
    return language.accuracy_summary(_truth(spark, sf))


@query(f"WITH {DET} SELECT lang AS truth, language AS guess, count(*) AS n FROM det GROUP BY ALL")
def gt_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return language.confusion(_truth(spark, sf))


@query(
    f"""WITH {DET}, g AS (SELECT lang AS language FROM det UNION SELECT language FROM det),
    c AS (SELECT g.language, sum((d.lang = g.language AND d.language = g.language)::INT)::DOUBLE AS tp, sum((d.language = g.language)::INT)::DOUBLE AS p,
      sum((d.lang = g.language)::INT) AS s FROM g, det d GROUP BY g.language)
    SELECT language, coalesce(tp / nullif(p, 0), 0) AS precision, coalesce(tp / nullif(s, 0), 0) AS recall, coalesce(2 * tp / nullif(p + s, 0), 0) AS f1, s::BIGINT AS support FROM c"""
)
def gt_per_language(spark: SparkSession, sf: str) -> DataFrame:
    return language.per_language(_truth(spark, sf))


@query(
    """WITH t AS (SELECT 1 + doc_id % 90 AS k, CASE WHEN doc_id % 11 = 0 THEN 'auditar' ELSE lang END AS language FROM documents),
    v AS (SELECT '10915/' || k AS handle, sha256('segment ' || k) AS text_hash, language FROM t WHERE language <> 'auditar')
    SELECT handle, text_hash, array_to_string(list_sort(list_distinct(list(language))), ',') AS languages FROM v GROUP BY 1, 2 HAVING count(DISTINCT language) > 1"""
)
def gt_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return language.ground_truth_conflicts(_ground_truth(spark, sf))


def _ground_truth(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("doc_id") % 90 + 1).cast("string")
    raw = table(spark, sf, "documents").select(
        F.concat(F.lit("http://x/handle/10915/"), k).alias("uri"),
        F.concat(F.lit(" Segment  "), k).alias("resumen"),
        F.when(F.col("doc_id") % 11 == 0, "auditar").otherwise(F.col("lang")).alias("final"),
        F.col("lang").alias("catalogued"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("langid"),
    )
    return language.ground_truth(raw, "uri", "resumen", "final", "catalogued", "langid")


@query(
    """SELECT CASE WHEN doc_id % 2 = 0 THEN 'human_langid_agreement' ELSE 'manual_audit' END AS truth_source, count(*) AS n
    FROM documents WHERE doc_id % 11 <> 0 GROUP BY 1"""
)
def gt_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _ground_truth(spark, sf).groupBy("truth_source").agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT 1 + doc_id % 90 AS k, lang AS language FROM documents WHERE doc_id % 11 <> 0),
    m AS (SELECT k, min(language) AS truth FROM t GROUP BY k)
    SELECT doc_id, truth FROM documents LEFT JOIN m ON k = 1 + doc_id % 120"""
)
def gt_attach(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("doc_id") % 120 + 1).cast("string")
    segments = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("10915/"), k).alias("handle"), F.concat(F.lit("segment "), k).alias("text"))
    return language.attach_ground_truth(segments, _ground_truth(spark, sf)).select("doc_id", "truth")


@query(
    """WITH p AS (SELECT lang AS t, CASE WHEN doc_id % 5 = 0 THEN 'en' ELSE lang END AS g FROM documents),
    l AS (SELECT unnest(list_distinct([t, g])) AS language, t, g FROM p),
    c AS (SELECT language, sum((t = language AND g = language)::INT) AS tp, sum((g = language)::INT) AS k, sum((t = language)::INT)::BIGINT AS support FROM l GROUP BY language),
    r AS (SELECT language, coalesce(tp::DOUBLE / nullif(k, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(support, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(k + support, 0), 0) AS f1, support FROM c),
    w AS (SELECT sum(precision * support) / sum(support) AS p, sum(recall * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f, sum(support)::BIGINT AS s FROM r),
    a AS (SELECT * FROM r UNION ALL SELECT 'accuracy', r, r, r, s FROM w UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM r
      UNION ALL SELECT 'weighted avg', p, r, f, s FROM w)
    SELECT language, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM a"""
)
def language_report(spark: SparkSession, sf: str) -> DataFrame:
    guess = F.when(F.col("doc_id") % 5 == 0, "en").otherwise(F.col("lang"))
    d = table(spark, sf, "documents").select(F.col("lang").alias("truth"), guess.alias("guess"))
    found = language.averages(language.per_language(d))
    return found.select("language", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")
