"""Operator 7, mixing sources to target weights: iterative proportional fitting and calibrated sampling.

Documents fall into cells of (source, language, topic) with their tokens. Raking multiplies the cells'
weights, one dimension after the other, so that the weights' sums meet the target share of every source,
language and topic; a fixed number of rounds. A cell's rate is its raked weight per token. Documents are
taken with probability min(1, scale * rate), where the scale makes the expected tokens meet the budget,
by a hash of the identifier: the same documents on every run.

Topics are learned from the corpus, unless a column gives them: its keywords are the words that most
documents hold, of those that at most a share of them does, and a document's topic is the keyword that it
holds most often.

Cells are made by partial aggregation and are the only thing that rounds touch. Each round's cells are
written to the shared folder, which cuts the lineage. Rates go back to documents by cell and salt, so a
source with a third of all rows is dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import forget, fresh, own_columns, stash, text_or_empty

DIMENSIONS = ("source", "lang", "topic")
SALTS = 16
#: Number of topics, and the largest share of documents that may hold a topic's keyword.
N_TOPICS, MOST_SHARE = 12, 0.3
#: Words that may become keywords: four letters or more, and nothing else.
KEYWORD = "^[a-z]{4,}$"
OTHER = "other"
#: The column that holds a text's words for a moment.
WORDS = "_words"
#: Default powers of the shares that are the targets.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
SPACE_RUN = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-cased words between the characters of SPACES; an empty one at an end where the text has a space there."""
    return F.split(F.lower(text), SPACE_RUN)


def word_count(words: Column) -> Column:
    """How many words words_of found: only its first and its last may be empty."""
    first, last = F.get(words, F.lit(0)) == "", (F.size(words) > 1) & (F.element_at(words, -1) == "")
    return (F.size(words) - first.cast("int") - last.cast("int")).cast("long")


def topic_keywords(docs: DataFrame, text_col: str = "text", n: int = N_TOPICS, most_share: float = MOST_SHARE) -> list[str]:
    """The words that most documents hold, of those that a share of ``most_share`` of them holds at most; the rarest
    first. Words are counted over all documents, once each, by partial sums; ties go by word."""
    total = docs.count()
    words = docs.select(F.explode(F.array_distinct(words_of(text_or_empty(text_col)))).alias("word"))
    held = words.where(F.col("word").rlike(KEYWORD)).groupBy("word").count()
    found = held.where(F.col("count") <= most_share * total).orderBy(F.desc("count"), "word").limit(n).collect()
    return [r.word for r in sorted(found, key=lambda r: (r["count"], r.word))]


def topic_of(words: Column, keywords: list[str]) -> Column:
    """The keyword that a text's words (words_of's) have most often (ties: the first of the list); OTHER without any."""
    if not keywords:
        return F.lit(OTHER)
    own = F.array(F.filter(words, lambda w: w.isin(*keywords)))  # an array of one names the step's result

    def ballot(found: Column, place: int, keyword: str) -> Column:
        n = F.size(F.filter(found, lambda w: w == F.lit(keyword)))
        return F.struct(n.alias("n"), F.lit(-place).alias("before"), F.lit(keyword).alias("word"))

    def ballots(found: Column) -> Column:
        return F.array_max(F.array(*[ballot(found, i, k) for i, k in enumerate(keywords)]))

    best = F.get(F.transform(own, ballots), F.lit(0))
    return F.when(best["n"] > 0, best["word"]).otherwise(OTHER)


def dimension_columns(docs: DataFrame, topic: Column) -> dict[str, Column]:
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    return {"source": named("source"), "lang": named("lang"), "topic": topic}


def narrow_rows(docs: DataFrame, id_col: str, text_col: str, topic: Column) -> DataFrame:
    """doc_id, DIMENSIONS, n_tokens and salt, stored: texts are read once for cells and documents. The topic may
    use the column WORDS."""
    rows = docs.withColumn(WORDS, words_of(text_or_empty(text_col))).select(
        F.col(id_col).alias("doc_id"),
        *(c.alias(k) for k, c in dimension_columns(docs, topic).items()),
        word_count(F.col(WORDS)).alias("n_tokens"),
        salt_of(id_col).alias("salt"),
    )
    return stash(rows, "mixing-rows")


def hash_share(seed: int, column: Column) -> Column:
    """A number in [0, 1) from 48 bits of SHA-256, the same in any engine."""
    value = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.coalesce(column.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(value, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def target_shares(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """The default target: every value's share of the tokens to the given power, made to sum to one."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    total = sums.agg(F.sum(F.pow("t", F.lit(power))).alias("s")).first()[0] or 1.0
    return sums.select(dimension, (F.pow("t", F.lit(power)) / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], total: float, rounds: int) -> DataFrame:
    """Cells with ``weight``: raked tokens whose sums have the targets' shares of ``total``. Targets have a
    column of the dimension's name and ``target``; values without a target get weight 0."""
    held = cells.withColumn("weight", F.col("tokens").cast("double"))
    for dimension, target in targets.items():  # every cell's goals, joined once for all rounds
        held = held.join(target.withColumnRenamed("target", f"goal_{dimension}"), dimension, "left")
    before = None
    for _ in range(rounds):
        for dimension in targets:
            now = held.groupBy(dimension).agg(F.sum("weight").alias("now"))
            goal = F.coalesce(f"goal_{dimension}", F.lit(0.0)) * F.lit(total)
            weight = F.coalesce(F.col("weight") * F.try_divide(goal, F.col("now")), F.lit(0.0))
            # Merged, not broadcast: there may be as many values as sources, and AQE splits hot ones.
            held = held.join(now.hint("merge"), dimension).withColumn("weight", weight).drop("now")
        after = stash(held, "raked")
        if before is not None:
            forget(before)
        before = held = after
    return held.drop(*(f"goal_{d}" for d in targets))


def calibrated_scale(cells: DataFrame, budget: float) -> float:
    """The scale at which the expected tokens, min(1, scale * rate) of each cell's, meet the budget."""
    scale, full = 0.0, -1
    while True:
        # One small aggregation a step; each step takes in the cells that the last scale fills.
        over = F.col("rate") * F.lit(scale) >= 1 - 1e-12
        row = cells.agg(
            F.sum(F.when(over, F.col("tokens")).otherwise(0)).alias("whole"),
            F.sum(F.when(over, 0.0).otherwise(F.col("rate") * F.col("tokens"))).alias("open"),
            F.sum(over.cast("long")).alias("n"),
        ).first()
        if not row.open or (row.n or 0) == full:
            return scale
        full, scale = row.n, max(scale, (budget - float(row.whole or 0)) / row.open)


def mixing_rates(
    rows: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    powers: dict[str, float] | None = None,
    rounds: int = 6,
    keep: float = 0.5,
) -> DataFrame:
    """One row per cell of ``rows`` (narrow_rows'): source, lang, topic, tokens, weight, rate (weight a token), probability.

    The targets' default is each value's share of tokens to a power (POWERS). ``keep`` is the share of all
    tokens that the sample holds in expectation.
    """
    powers = POWERS | (powers or {})
    cells = stash(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    goals = {d: (targets or {}).get(d) for d in DIMENSIONS}
    goals = {d: target_shares(cells, d, powers[d]) if g is None else g for d, g in goals.items()}
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    raked = rake(cells, goals, total, rounds).withColumn(
        "rate", F.coalesce(F.try_divide(F.col("weight"), F.col("tokens").cast("double")), F.lit(0.0))
    )
    scale = calibrated_scale(raked, keep * total)
    return raked.withColumn("probability", F.least(F.lit(1.0), F.col("rate") * F.lit(scale)))


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows (with DIMENSIONS and ``salt``) and their cell's columns, joined by cell and salt."""
    dealt = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(dealt, [*DIMENSIONS, "salt"], "left")


def salt_of(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.monotonically_increasing_id(), id_col), F.lit(SALTS)).cast("int")


def mix_sources(
    docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, **settings
) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, sampled.

    ``weight`` is the cell's rate and ``probability`` its calibrated chance, both rounded to 6 places.
    Null sources and languages, and missing columns, are a value of their own, the empty string. A null
    text counts as empty; a document without words weighs nothing but shares its cell's chance. Rows that
    repeat an identifier share its draw; a null identifier draws like an empty one. A cell without words
    is never sampled. An empty table gives an empty result. Settings are those of mixing_rates.
    """
    topic = topic_of(F.col(WORDS), topic_keywords(docs, text_col)) if topic is None else topic
    narrow = narrow_rows(docs, id_col, text_col, topic)
    rates = mixing_rates(narrow, **settings)
    return with_rates(narrow, rates).select(
        "doc_id",
        *DIMENSIONS,
        "n_tokens",
        F.round("rate", 6).alias("weight"),
        F.round("probability", 6).alias("probability"),
        (hash_share(seed, F.col("doc_id")) < F.round("probability", 6)).alias("sampled"),
    )


def sample_mixed(
    docs: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None, **settings
) -> DataFrame:
    """The rows of ``docs`` that mix_sources samples, with their own columns.

    Nulls, repeated identifiers, documents without words and empty tables count as there; a draw that
    equals the chance is not sampled. Rows that repeat an identifier in different cells share the draw,
    but each is held against its own cell's chance.
    """
    topic = topic_of(F.col(WORDS), topic_keywords(docs, text_col)) if topic is None else topic
    rates = mixing_rates(narrow_rows(docs, id_col, text_col, topic), **settings)
    rates = rates.select(*DIMENSIONS, F.round("probability", 6).alias("chance"))
    dealt = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row = fresh(docs, "row")  # no column of the caller's can clash with one of ours
    whole = docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)).withColumn(WORDS, words_of(text_or_empty(text_col)))
    marked = whole.select(F.col(row).alias("row"), *(c.alias(k) for k, c in dimension_columns(docs, topic).items()), salt_of(id_col).alias("salt"))
    kept = marked.join(dealt, [*DIMENSIONS, "salt"]).where(hash_share(seed, F.col("row")[id_col]) < F.col("chance"))
    return own_columns(kept, docs)
