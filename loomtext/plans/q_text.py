"""Queries on text functions, items, budgets, mappings and text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dense, items, labels, vectorize
from .base import document_items, query, table

#: The oracle's white space; DuckDB's \\s is ASCII.
WS = "'[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+'"
NORM = f"trim(regexp_replace(coalesce(text, ''), {WS}, ' ', 'g'))"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(f"SELECT doc_id, sha256({NORM}) AS normal_sha256, length({NORM}) AS n FROM documents")
def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    value = T.normalize_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(value, 256).alias("normal_sha256"), F.length(value).alias("n"))


@query(name="normalize_text_nfkc")
def normalize_text_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    value = T.normalize_text(F.col("text"), nfkc=True)
    return table(spark, sf, "documents").select("doc_id", F.sha2(value, 256).alias("normal_sha256"))


@query(
    f"""SELECT doc_id, CASE WHEN {NORM} = '' THEN 0 ELSE len(string_split({NORM}, ' ')) END AS tokens,
    len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS terms FROM documents"""
)
def tokenize_counts(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.regexp_extract_all(F.lower("text"), F.lit(vectorize.TERM), F.lit(0))
    return table(spark, sf, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"), F.size(terms).alias("terms"))


def _stopword_sql() -> str:
    gone = " ".join(f"WHEN lang = '{g}' THEN {_list(T.stopwords(g))}" for g in ("en", "es", "fr", "de"))
    return f"""WITH d AS (SELECT doc_id, {NORM} AS t, CASE {gone} END AS gone FROM documents)
    SELECT doc_id, sha256(array_to_string(list_filter(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}_]+'),
      lambda w: NOT list_contains(gone, replace(lower(w), 'ß', 'ss'))), ' ')) AS kept_sha256 FROM d"""


@query(_stopword_sql)
def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    value = T.preprocess(F.col("text"), F.col("lang"), "language_stopwords")
    return table(spark, sf, "documents").select("doc_id", F.sha2(value, 256).alias("kept_sha256"))


@query(f"SELECT doc_id, sha256('KEYWORDS: ' || source || chr(10) || 'FULLTEXT: ' || {NORM}) AS text_sha256 FROM documents")
def field_prefix_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("handle"), F.col("source").alias("keywords"), F.col("text").alias("fulltext"))
    rows = dense.feature_text(d, "keywords+fulltext", "normalized")
    return rows.select(F.col("handle").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"))


@query(
    """WITH p AS (SELECT page_id, string_split(regexp_replace(url, '[/?#&]', '||', 'g'), '||') AS parts FROM pages)
    SELECT page_id, array_to_string(list_distinct_keep, '|') AS parts FROM (
      SELECT page_id, list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(v, v[i]) = i), lambda i: v[i]) AS list_distinct_keep
      FROM (SELECT page_id, list_filter(list_transform(parts, lambda x: trim(x)), lambda x: x <> '') AS v FROM p))"""
)
def multivalue_parse(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.regexp_replace("url", "[/?#&]", "||")
    return table(spark, sf, "pages").select("page_id", F.array_join(T.parse_multivalue(cell), "|").alias("parts"))


@query(
    """SELECT doc_id, nullif(regexp_extract('http://hdl.handle.net/' || (10000 + doc_id % 7) || '/' || doc_id || ' 2020/05',
      '(?:/handle/|hdl\\.handle\\.net/)?([0-9]{1,6}/[0-9]+)', 1), '') AS handle,
      nullif(regexp_extract(source, '([0-9]{1,6}/[0-9]+)', 1), '') AS none FROM documents"""
)
def handle_parse(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.concat(F.lit("http://hdl.handle.net/"), (F.col("doc_id") % 7 + 10000).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(" 2020/05"))
    return table(spark, sf, "documents").select("doc_id", T.parse_handle(cell).alias("handle"), T.parse_handle(F.col("source")).alias("none"))


@query("SELECT doc_id, trim(split_part(source || ' ::http://x::' || lang, '::', 1)) AS label FROM documents")
def uri_strip(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.concat("source", F.lit(" ::http://x::"), "lang")
    return table(spark, sf, "documents").select("doc_id", T.strip_uri(cell).alias("label"))


@query(f"SELECT doc_id, sha256('KEYWORDS: ' || source || chr(10) || 'FULLTEXT: ' || {NORM}) AS text_sha256 FROM documents")
def transformer_text(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("handle"), F.col("source").alias("keywords"), F.col("text").alias("fulltext"))
    rows = dense.transformer_text(d, "keywords+fulltext")
    return rows.select(F.col("handle").alias("doc_id"), F.sha2("text", 256).alias("text_sha256"))


_MARKED = "CASE WHEN doc_id % 5 = 0 THEN ' No  Posee. ' WHEN doc_id % 5 = 1 THEN 'NOT AVAILABLE;' ELSE lang END"


@query(f"SELECT doc_id, trim(lower(trim(regexp_replace({_MARKED}, '\\s+', ' ', 'g'))), ' .:;-_') IN {tuple(T.MISSING_MARKERS)} AS missing FROM documents")
def missing_markers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.is_missing_marker(F.expr(_MARKED)).alias("missing"))


_META = """SELECT 'http://hdl.handle.net/10915/' || (doc_id // 2) AS uri,
  CASE WHEN doc_id % 3 = 0 THEN 'No posee' ELSE lang || '||' || source END AS es,
  lang || '||' || 'extra' AS en, source || '::http://x||' || lang AS subject FROM documents"""


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.concat(F.lit("http://hdl.handle.net/10915/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("dc.identifier.uri"),
        F.when(F.col("doc_id") % 3 == 0, "No posee").otherwise(F.concat_ws("||", "lang", "source")).alias("dc.description.abstract[es]"),
        F.concat_ws("||", F.col("lang"), F.lit("extra")).alias("dc.description.abstract[en]"),
        F.concat(F.col("source"), F.lit("::http://x||"), F.col("lang")).alias("dc.subject[es]"),
    )


@query(
    f"""WITH m AS ({_META})
    SELECT regexp_extract(uri, '([0-9]{{1,6}}/[0-9]+)', 1) AS handle, count(*) AS n_rows,
      sum((es = 'No posee')::INT)::BIGINT AS markers,
      array_to_string(list_sort(list_distinct(flatten(list([split_part(subject, '::', 1), split_part(subject, '||', 2)])))), ',') AS labels
    FROM m GROUP BY 1"""
)
def metadata_items(spark: SparkSession, sf: str) -> DataFrame:
    rows = items.metadata_rows(_metadata(spark, sf), ["dc.subject[es]", "absent"])
    counts = rows.groupBy("handle").agg(F.count("*").alias("n_rows"))
    rolled = items.roll_up_items(rows).join(counts, "handle")
    return rolled.select("handle", "n_rows", F.col("abstract_missing_markers").alias("markers"), F.array_join("labels", ",").alias("labels"))


@query(
    f"""WITH m AS ({_META}), e AS (SELECT unnest([split_part(subject, '::', 1), split_part(subject, '||', 2)]) AS label FROM m)
    SELECT label, 'dc.subject[es]' AS source_field, count(*) AS support FROM e GROUP BY label"""
)
def target_schema_report(spark: SparkSession, sf: str) -> DataFrame:
    return items.target_schema_report(_metadata(spark, sf), ["dc.subject[es]", "absent"])


@query(
    """WITH f AS (SELECT conv_id, role, array_to_string(list(text ORDER BY turn), chr(10) || chr(10)) AS full_text, count(*) AS units,
      sum(length(text))::BIGINT AS chars FROM conversations WHERE trim(text) <> '' GROUP BY conv_id, role)
    SELECT conv_id, role, units, chars, sha256(full_text) AS text_sha256 FROM f"""
)
def item_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").where(F.trim("text") != "")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = c.groupBy("conv_id", "role").agg(ordered.alias("r"), F.count("*").alias("units"), F.sum(F.length("text")).alias("chars"))
    full = F.array_join(F.transform("r", lambda x: x["text"]), "\n\n")
    return rows.select("conv_id", "role", "units", "chars", F.sha2(full, 256).alias("text_sha256"))


@query(
    """WITH u AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations WHERE trim(text) <> ''),
    w AS (SELECT *, sum(n) OVER i AS total, count(*) OVER i AS k, sum(n) OVER s - n AS filled, row_number() OVER s - 1 AS before
      FROM u WINDOW i AS (PARTITION BY conv_id), s AS (PARTITION BY conv_id ORDER BY n, turn, role, text ROWS UNBOUNDED PRECEDING)),
    x AS (SELECT *, floor((400 - filled) / (k - before)) AS share FROM w),
    y AS (SELECT *, max(CASE WHEN n > share THEN share END) OVER (PARTITION BY conv_id) AS level FROM x),
    z AS (SELECT *, CASE WHEN total <= 400 THEN n ELSE least(n, greatest(level, 0)) END AS base FROM y),
    v AS (SELECT *, 400 - sum(base) OVER (PARTITION BY conv_id) AS rest,
      sum((n > greatest(level, 0))::INT) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS place FROM z)
    SELECT conv_id, turn, n AS source_chars,
      (base + CASE WHEN total > 400 AND n > greatest(level, 0) AND place <= rest THEN 1 ELSE 0 END)::BIGINT AS retained_chars FROM v"""
)
def text_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = items.budget_units(table(spark, sf, "conversations"), 400, "conv_id", ["turn", "role", "text"])
    return rows.select("conv_id", "turn", "source_chars", "retained_chars")


def _files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(" ")).alias("file_id"))
    m = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("internal_id"), F.concat(F.lit("10915/"), "doc_id").alias("handle"), F.col("doc_id").alias("at"))
    return items.map_files(d, m, order="at")


_MAPPED = """m AS (SELECT d.doc_id::VARCHAR AS file_id, CASE WHEN l.doc_id IS NOT NULL THEN '10915/' || l.doc_id END AS handle
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query(f"WITH {_MAPPED} SELECT file_id, handle FROM m")
def mapping_join(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf)


@query(
    f"""WITH {_MAPPED} SELECT count(*) AS txt_files_total, count(handle) AS mapped_txt_files,
    count(DISTINCT handle) AS handles_with_txt, 100.0 * count(handle) / count(*) AS coverage_percentage FROM m"""
)
def mapping_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return items.mapping_coverage(_files(spark, sf))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_handles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


_FP = f"sha256(replace(lower({NORM}), 'ß', 'ss'))"


@query(
    f"""WITH g AS (SELECT doc_id, {_FP} AS content_group FROM documents),
    n AS (SELECT content_group, count(*) AS n, min(doc_id) AS first_key FROM g GROUP BY 1 HAVING count(*) > 1)
    SELECT content_group, n, first_key FROM n"""
)
def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return items.duplicate_groups(items.content_groups(document_items(spark, sf)))


@query(
    f"""WITH g AS (SELECT doc_id AS handle, {_FP} AS content_group FROM documents)
    SELECT content_group, handle, n FROM g JOIN (SELECT content_group, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1) USING (content_group)"""
)
def content_duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    return items.duplicate_members(items.content_groups(document_items(spark, sf)))


@query(
    """SELECT count(*) AS documents, sum(length(text))::BIGINT AS source_characters, sum(least(length(text), 4000))::BIGINT AS represented_characters,
    100.0 * sum(least(length(text), 4000)) / sum(length(text)) AS represented_percentage, sum((length(text) > 4000)::INT)::BIGINT AS truncated
    FROM documents"""
)
def fulltext_coverage(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    d = table(spark, sf, "documents").select(F.length(text).cast("long").alias("fulltext_source_characters"), F.left(text, F.lit(4000)).alias("fulltext"))
    return items.fulltext_coverage(d)


@query(
    f"""WITH f AS (SELECT 'fulltext' AS field, length(text) AS chars, CASE WHEN {NORM} = '' THEN 0 ELSE len(string_split({NORM}, ' ')) END AS tokens FROM documents
      UNION ALL SELECT 'source', length(source), CASE WHEN trim(source) = '' THEN 0 ELSE len(string_split(trim(source), ' ')) END FROM documents),
    g AS (SELECT field, CASE WHEN tokens > 0 THEN chars END AS c, CASE WHEN tokens > 0 THEN tokens END AS t, (tokens = 0)::INT AS gone FROM f)
    SELECT field, sum(gone)::BIGINT AS missing, 100.0 * sum(gone) / count(*) AS missing_percentage, avg(c) AS mean_chars,
      quantile_cont(c, 0.5) AS median_chars, quantile_cont(c, 0.25) AS p25_chars, quantile_cont(c, 0.75) AS p75_chars, quantile_cont(c, 0.95) AS p95_chars,
      avg(t) AS mean_tokens, quantile_cont(t, 0.5) AS median_tokens, quantile_cont(t, 0.95) AS p95_tokens FROM g GROUP BY field"""
)
def text_statistics(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("text").alias("fulltext"), "source")
    return labels.text_statistics(d, ["fulltext", "source"])


@query(
    """WITH c AS (SELECT conv_id, sum((role = 'user')::INT) AS a, sum((role <> 'user')::INT) AS f FROM conversations GROUP BY conv_id)
    SELECT count(*) AS n_items, sum(a)::BIGINT AS n_abstract_segments, sum(f)::BIGINT AS n_fulltext_files, sum((a = 0)::INT)::BIGINT AS items_without_abstract,
      sum((a > 1)::INT)::BIGINT AS items_with_multiple_abstracts, sum((f > 1)::INT)::BIGINT AS items_with_multiple_fulltexts FROM c"""
)
def text_unit_statistics(spark: SparkSession, sf: str) -> DataFrame:
    own = lambda c: F.collect_list(F.when(c, F.lit(1)))
    user = F.col("role") == "user"
    per = table(spark, sf, "conversations").groupBy("conv_id").agg(own(user).alias("abstract_segments"), own(~user).alias("fulltext_documents"))
    return items.text_unit_statistics(per)


_PRIVATE = " ".join(f"WHEN '{name}' THEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')" for name, p in T.PRIVATE_PATTERNS.items())


@query(f"SELECT doc_id, array_to_string(list_filter({list(T.PRIVATE_PATTERNS)}, lambda k: CASE k {_PRIVATE} END), ',') AS findings FROM documents")
def private_content(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.private_findings(F.col("text")), ",").alias("findings"))
