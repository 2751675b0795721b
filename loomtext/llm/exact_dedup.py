"""Operator 1, exact deduplication: a tree-merge of sorted digest runs.

Every input partition is a rank and makes one run: its digests in order, each with its best document and
a count. Then ranks exchange runs in binomial rounds: in round r the ranks whose bit r is set send their
run to the rank 2^r below, which merges the two sorted runs (a sort-merge join on the digest, one row a
digest on either side) and keeps the better identifier of every digest that both hold. After as many
rounds as the number of ranks has bits, rank 0 holds every digest. A run is spread over the tasks by
digest, so no task holds it all, and it may spill; a digest that a third of all rows share is one entry a
run, at every level. With ``ways`` above two a round merges that many runs, the sent ones one after the other.
Winners then go back down to the ranks by (rank, digest) and to the rows, without gathering a digest's rows.

Verified: an entry merges with another only if SHA-256, an independent 64-bit hash and the normalised
length all agree; the three together are the sort key of the runs. Every round is a stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, forget, one_column, own_columns, small_side, spread_lookup, stash, text_or_empty

KEY = ["digest", "check", "n_norm"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document, with its rank, its digest key and its length in code points."""
    text = text_or_empty(text_col)
    norm = F.translate(text, SPACES, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n_points"),
        norm.alias("norm"),
        F.spark_partition_id().alias("rank"),
        F.monotonically_increasing_id().alias("row_uid"),
    ).select(
        "doc_id",
        "n_points",
        "rank",
        "row_uid",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("n_norm"),
    )


def first_runs(rows: DataFrame) -> DataFrame:
    """Every rank's own run: one entry a digest, its best document and how many rows have it."""
    best = F.struct(
        (-F.col("n_points")).alias("less_points"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_uid"
    )
    return rows.select("rank", *KEY, best.alias("best")).groupBy("rank", *KEY).agg(F.min("best").alias("best"), F.count("*").alias("n"))


def merge_round(runs: DataFrame, stride: int, ways: int = 2) -> DataFrame:
    """Ranks at the multiples of ``stride * ways`` take the runs of the ``ways - 1`` ranks above, ``stride`` apart."""
    place = F.expr(f"(rank div {stride}) % {ways}")
    merged = runs.where(place == 0)
    for i in range(1, ways):
        sent = runs.where(place == i).select(
            (F.col("rank") - i * stride).alias("rank"), *KEY, F.col("best").alias("sent_best"), F.col("n").alias("sent_n")
        )
        both = merged.hint("merge").join(sent.hint("merge"), ["rank", *KEY], "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("sent_n", F.lit(0))
        merged = both.select("rank", *KEY, F.least("best", "sent_best").alias("best"), n.alias("n"))  # least() skips nulls
    return merged


def merge_runs(rows: DataFrame, ways: int = 2) -> DataFrame:
    """All digests with their best document and count, merged round by round into rank 0."""
    if ways < 2:
        raise ValueError("a round merges two runs at least")
    width = (rows.agg(F.max("rank")).first()[0] or 0) + 1
    runs, stride = stash(first_runs(rows), "runs"), 1
    while stride < width:
        merged = stash(merge_round(runs, stride, ways), "runs")
        forget(runs)
        runs, stride = merged, stride * ways
    return runs.drop("rank")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ways: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_points, row_uid.

    Texts are equal when identical without the characters of SPACES. Of equal texts the one with the
    most code points stays, then the smallest identifier. A null text counts as empty; empty texts are
    equal to each other. A null identifier is larger than any other. Of rows that repeat both text and
    identifier, exactly one is kept. An empty table gives an empty result. Columns other than the
    identifier and the text are not looked at.
    """
    rows = stash(digest_rows(docs, id_col, text_col), "digests")
    groups = merge_runs(rows, ways).where("n > 1").select(*KEY, "best", F.col("n").alias("group_size"))
    known = F.col("group_size").isNotNull()
    return spread_lookup(rows, groups, KEY, "rank").select(
        "doc_id",
        F.when(known, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(known, F.col("best.row_uid") == F.col("row_uid")).otherwise(True).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_points",
        "row_uid",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ways: int = 2) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with their own columns.

    Only identifiers of dropped documents meet the texts: they are broadcast up to a measured size, and
    else merged by identifier. Identifiers of which some rows stay and others go (repeated ones) are
    told apart by digest and length; of rows that these don't tell apart either, one stays.
    """
    ruled = stash(exact_dedup(docs, id_col, text_col, ways), "ruled")
    stay = ruled.where("kept").select(F.col("doc_id").alias("stays")).distinct()
    gone = ruled.where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    same = F.col("gone").eqNullSafe(F.col("stays"))
    mixed = stash(gone.join(stay, same, "left_semi"), "mixed")
    rows = one_column(docs)  # no column of the caller's can clash with one of ours
    own_id, text = F.col("row")[id_col], F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    match = own_id.eqNullSafe(F.col("gone"))
    kept = rows.join(small_side(gone.join(stay, same, "left_anti"), "gone"), match, "left_anti")
    if mixed.isEmpty():
        return own_columns(kept, docs)
    marks = kept.join(mixed, match, "left_semi").select(
        "row", own_id.alias("own_id"), F.length(text).cast("long").alias("points"), F.sha2(F.translate(text, SPACES, ""), 256).alias("sha")
    )
    of_mixed = ruled.where("kept").join(mixed, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi")
    right = of_mixed.select(F.col("doc_id").alias("stays"), F.col("n_points").alias("right_points"), F.col("text_sha256").alias("right_sha")).distinct()
    on = F.col("own_id").eqNullSafe(F.col("stays")) & (F.col("points") == F.col("right_points")) & (F.col("sha") == F.col("right_sha"))
    one = marks.join(right, on, "left_semi").dropDuplicates(["own_id", "points", "sha"])
    return own_columns(kept.join(mixed, match, "left_anti").unionByName(one.select("row")), docs)
