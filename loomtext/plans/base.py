"""Registering queries beside their oracle SQL, and the tables that several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str | Callable[[], str]] = {}


def query(sql: str | Callable[[], str] | None = None, name: str | None = None):
    """Registers a function as a query, with the SQL that DuckDB answers it by, or a function that builds it."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


def oracle_sql() -> dict[str, str]:
    """The SQL of all queries that have one."""
    return {name: sql if isinstance(sql, str) else sql() for name, sql in ORACLE_SQL.items()}


#: Bytes of a table that is worth dealing out at least, and those of one split of files, beyond which it has splits enough.
DEALT_FROM, ONE_SPLIT = 1 << 20, 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, dealt out if it is small."""
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def dealt(df: DataFrame) -> DataFrame:
    """A stored table that fits a single split of files, dealt out to all cores (a file with one row group is one task's work
    otherwise); a larger one is left as its files are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if DEALT_FROM <= size <= ONE_SPLIT else df


def order_items(spark: SparkSession, sf_dir: str, languages: bool = False) -> DataFrame:
    """Orders as items, the brands of their parts as labels; ``languages`` adds the array of an order's priorities, one for each
    time that it is in the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    orders, how, more = table(spark, sf_dir, "orders"), "left_semi", []
    if languages:
        orders = orders.select("o_orderkey", F.struct(F.col("o_orderpriority").alias("language")).alias("l")).repartition("o_orderkey")  # moved as narrow rows
        orders, how, more = orders.groupBy("o_orderkey").agg(F.collect_list("l").alias("languages")), "inner", [F.first("languages").alias("languages")]
    rows = rows.join(orders.select("o_orderkey", *(["languages"] if languages else [])), F.col("l_orderkey") == F.col("o_orderkey"), how)
    return rows.groupBy(F.col("l_orderkey").alias("handle")).agg(F.array_sort(F.collect_set("p_brand")).alias("labels"), *more)


ORDER_ITEMS = """items AS (
  SELECT l_orderkey AS handle, list_sort(list_distinct(list(p_brand))) AS labels
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey),
il AS (SELECT handle, unnest(labels) AS label FROM items)"""


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items, with their language and source as labels."""
    d = table(spark, sf_dir, "documents")
    labels = F.array_sort(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source")))
    return d.select(F.col("doc_id").alias("handle"), F.col("text").alias("fulltext"), labels.alias("labels"), "lang")


def hash_scores(spark: SparkSession, sf_dir: str, seed: str = "score") -> DataFrame:
    """handle, label, y, score: pseudo-scores of every order and brand by hash, higher where y is 1. The items are stored,
    since every count of the rows reads them."""
    from ..operators.labels import indicator
    from ..sources.scratch import keep

    rows = indicator(keep(order_items(spark, sf_dir), "items"))
    return rows.withColumn("score", _hash_score(seed, F.col("handle"), F.col("label"), F.col("y")))


def _hash_score(seed: str, handle: Column, label: Column, y: Column) -> Column:
    return T.unit_hash(seed, handle, label) * 0.75 + y * 0.25


def language_scores(spark: SparkSession, sf_dir: str, threshold: float, seed: str = "score") -> DataFrame:
    """handle, rows: hash_scores of an order in one array of (language, label, score, y, pred), its priority being the language.
    An order that repeats has its rows once for each time."""
    from ..operators.labels import label_support
    from ..sources.scratch import keep

    items = keep(order_items(spark, sf_dir, languages=True), "items")
    names = label_support(items).agg(F.array_sort(F.collect_set("label")).alias("names"))
    rows = dealt(items).join(F.broadcast(names), F.lit(True))  # a single row
    held = F.transform("names", lambda n: F.struct(n.alias("label"), F.array_contains("labels", n).cast("int").alias("y")))
    scored = F.transform(held, lambda x: F.struct(x["label"].alias("label"), _hash_score(seed, F.col("handle"), x["label"], x["y"]).alias("score"), x["y"].alias("y")))

    def told(at: Column) -> Column:
        names = ("label", "score", "y")
        return F.transform(scored, lambda x: F.struct(at["language"].alias("language"), *[x[c].alias(c) for c in names], (x["score"] >= threshold).cast("int").alias("pred")))

    return rows.select("handle", F.flatten(F.transform("languages", told)).alias("rows"))


def scores_sql(seed: str = "score", name: str = "scores") -> str:
    return f"""{name} AS (
  SELECT handle, label, list_contains(labels, label)::INT AS y,
    ('0x' || substr(sha256('{seed}|' || handle || '|' || label), 1, 12))::BIGINT / 281474976710656.0::DOUBLE * 0.75::DOUBLE
     + list_contains(labels, label)::INT * 0.25::DOUBLE AS score
  FROM items, (SELECT DISTINCT label FROM il))"""


HASH = "('0x' || substr(sha256({}), 1, 12))::BIGINT"
