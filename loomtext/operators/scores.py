"""Scores, thresholds, rankings and metrics over long tables (handle, label, score, y).

Confusion counts are partial sums per label or per item, so only labels, candidates or replicates
multiply rows. Ties rank by label.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep
from .percentiles import exact_percentiles

#: Thresholds that are tried for probabilities, and for the heads' scores of fine-tuned models.
PROBABILITY_CANDIDATES = [round(0.05 * i, 2) for i in range(1, 20)]
HEAD_CANDIDATES = [-6 + 0.25 * i for i in range(49)]


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def rank_labels(scores: DataFrame, key: str = "handle", k: int | None = None) -> DataFrame:
    """Adds rank: labels of an item by score downwards; only the first k if asked for."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "label"))
    ranked = scores.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= k) if k else ranked


def default_threshold(score_kind: str) -> float:
    return 0.5 if score_kind == "probabilities" else 0.0


def apply_thresholds(scores: DataFrame, thresholds: float | DataFrame) -> DataFrame:
    """Adds pred = score >= threshold; a table gives thresholds by label."""
    if isinstance(thresholds, DataFrame):
        # One row a label: Spark's own size check decides on a broadcast.
        return scores.join(thresholds.select("label", "threshold"), "label").withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))
    return scores.withColumn("pred", (F.col("score") >= F.lit(float(thresholds))).cast("int"))


def candidate_thresholds(scores: DataFrame, score_kind: str) -> list[float]:
    """Fixed ones for probabilities; else 0 and 49 quantiles of all scores, distinct and sorted."""
    if score_kind == "probabilities":
        return PROBABILITY_CANDIDATES
    at = [0.02 + 0.02 * i for i in range(49)]
    found = exact_percentiles(scores, "score", at).get(None, [])
    return sorted({0.0, *found})


def sweep(scores: DataFrame, candidates: list[float]) -> DataFrame:
    """label, threshold, tp, fp, fn for every candidate, in one pass: a row adds to each candidate's sums.

    A score's place among the sorted candidates is counted once; sums over places give every threshold.
    """
    ordered = sorted(candidates)
    place = sum((F.col("score") >= F.lit(float(c))).cast("int") for c in ordered)
    cells = scores.groupBy("label", place.alias("place")).agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    table = F.array(*[F.struct(F.lit(float(c)).alias("threshold"), F.lit(i + 1).alias("least")) for i, c in enumerate(ordered)])
    rows = cells.select("label", "place", "pos", "n", F.explode(table).alias("c"))
    hit = F.col("place") >= F.col("c.least")
    return rows.groupBy("label", F.col("c.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
    )


def global_thresholds(swept: DataFrame) -> DataFrame:
    """threshold, f1_macro, in order of choice: best Macro-F1, nearest to 0.5, smallest."""
    found = swept.groupBy("threshold").agg(F.avg(f1_of(F.col("tp"), F.col("fp"), F.col("fn"))).alias("f1_macro"))
    return found.orderBy(F.desc("f1_macro"), F.abs(F.col("threshold") - 0.5), "threshold")


def per_label_thresholds(swept: DataFrame, fallback: float, minimum_support: int = 20) -> DataFrame:
    """label, threshold: each label's best F1 (first candidate on ties), or the fallback for rare labels."""
    f1 = f1_of(F.col("tp"), F.col("fp"), F.col("fn"))
    best = swept.groupBy("label").agg(
        F.min_by("threshold", F.struct(-f1, F.col("threshold"))).alias("best"), F.max(F.col("tp") + F.col("fn")).alias("support")
    )
    return best.select("label", F.when(F.col("support") >= minimum_support, F.col("best")).otherwise(F.lit(float(fallback))).alias("threshold"))


def calibrate(scores: DataFrame, score_kind: str, mode: str = "default", minimum_support: int = 20) -> float | DataFrame:
    """A threshold, or a table of them, by mode: default, global_threshold, per_label_threshold. Without rows, the default."""
    if mode == "default":
        return default_threshold(score_kind)
    if mode not in ("global_threshold", "per_label_threshold"):
        raise ValueError(f"unknown threshold mode: {mode}")
    swept = sweep(scores, candidate_thresholds(scores, score_kind))
    best = global_thresholds(swept).first()
    if best is None:
        return default_threshold(score_kind)
    chosen = float(best["threshold"])
    return chosen if mode == "global_threshold" else per_label_thresholds(swept, chosen, minimum_support)


def counts(by: tuple[str, ...], rows: DataFrame, weight: Column | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    w = F.lit(1) if weight is None else weight
    y, p = F.col("y") == 1, F.col("pred") == 1
    n = lambda c: F.sum(F.when(c, w).otherwise(0))
    return rows.groupBy(*by).agg(n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn"), *more)


def confusion_matrices(rows: DataFrame) -> DataFrame:
    return counts(("label",), rows).withColumn("predicted_support", F.col("tp") + F.col("fp"))


def _grouped(by: tuple[str, ...]) -> Column:
    return F.struct(*by) if by else F.lit(0)


def _label_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """_g and the metrics that need counts of labels only: a row a label is all that is exchanged."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts(("_g", "label"), rows.withColumn("_g", _grouped(by))).groupBy("_g").agg(
        F.avg(ratio(tp, tp + fp)).alias("precision_macro"),
        F.avg(ratio(tp, tp + fn)).alias("recall_macro"),
        F.avg(f1_of(tp, fp, fn)).alias("f1_macro"),
        F.avg(ratio(tp, tp + fp + fn)).alias("jaccard_macro"),
        ratio(F.sum(tp), F.sum(tp + fp)).alias("precision_micro"),
        ratio(F.sum(tp), F.sum(tp + fn)).alias("recall_micro"),
        ratio(2 * F.sum(tp), F.sum(2 * tp + fp + fn)).alias("f1_micro"),
        ratio(F.sum(tp), F.sum(tp + fp + fn)).alias("jaccard_micro"),
        ratio(F.sum(fp + fn), F.sum(tp + fp + fn + tn)).alias("hamming_loss"),
    )


def f1_metrics(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """f1_macro and f1_micro of (label, y, pred), one row, or one for each value of ``by``; items are not grouped."""
    return _label_metrics(rows, by).select(*[F.col(f"_g.{b}").alias(b) for b in by], "f1_macro", "f1_micro")


def multilabel_metrics(rows: DataFrame, key: str = "handle", by: tuple[str, ...] = ()) -> DataFrame:
    """Twelve metrics of (key, label, y, pred), one row, or one for each value of ``by``."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    label = _label_metrics(rows, by)
    item = counts(("_g", key), rows.withColumn("_g", _grouped(by))).groupBy("_g").agg(
        F.avg(((fp + fn) == 0).cast("double")).alias("subset_accuracy"),
        F.avg(f1_of(tp, fp, fn)).alias("f1_samples"),
        F.avg(ratio(tp, tp + fp + fn)).alias("jaccard_samples"),
        F.count("*").alias("n_items"),
    )
    both = label.join(item, "_g")
    names = [c for c in both.columns if c != "_g"]
    return both.select(*[F.col(f"_g.{b}").alias(b) for b in by], *names)


#: Rows of a group that average precision sweeps in one piece, about; a larger group is cut at quantiles of its scores.
RANGE_ROWS = 1 << 19
#: Rows that a task sorts at a time.
SORTED_ROWS = 1 << 19


def average_precision(scores: DataFrame, by: tuple[str, ...] = ("label",), range_rows: int = RANGE_ROWS) -> DataFrame:
    """Sum of recall steps times precision over distinct scores downwards; groups without positives are left out.

    A group of more than ``range_rows`` rows is cut into ranges at quantiles of a part of its scores, chosen by hash. A task
    sorts its rows, sums those of equal scores (so a frequent score is a single entry) and stores each range as arrays; their
    totals give each range what lies above it. Ranges without positives are left out, the arrays of others merged and swept.
    Any edges give the same result.
    """
    return _average_precision(keep(scores.select(*by, "score", "y"), "scores"), by, range_rows)


def _edges(rows: DataFrame, by: tuple[str, ...], range_rows: int) -> dict[tuple, np.ndarray]:
    """The edges of each group's ranges, if it has more than one: about one for each ``range_rows`` rows of the table."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > range_rows)
    most = sizes.agg(F.max("n")).first()[0]
    if not most:
        return {}
    ranges = min(10_000, -(-most // range_rows))
    large = _met(rows, sizes, by, "left_semi")
    part = large.where(F.pmod(F.xxhash64("score"), F.lit(64)) == 0)
    found = part.groupBy(*by).agg(F.percentile_approx(F.col("score").cast("double"), [i / ranges for i in range(1, ranges)], 10_000).alias("e"))
    # A smaller group takes as many of them as it has ranges.
    own = F.greatest(F.lit(2), F.least(F.lit(ranges), F.ceil(F.col("n") / range_rows)).cast("int"))
    every = F.transform(F.sequence(F.lit(1), own - 1), lambda i: F.get("e", F.floor(i * ranges / own).cast("int") - 1))
    told = _met(found, sizes, by).select(*by, every.alias("e")).collect()
    return {tuple(r[c] for c in by): np.array(sorted({e for e in r.e if e is not None and math.isfinite(e)})) for r in told}


def _met(rows: DataFrame, other: DataFrame, names: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join by columns of which null is a value."""
    other = other.withColumnsRenamed({c: f"_{c}" for c in names})
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names], how).drop(*[f"_{c}" for c in names])


def _ranged(rows: DataFrame, by: tuple[str, ...], edges: dict[tuple, np.ndarray]) -> DataFrame:
    """by, range (more is higher, -1 for null) and a task's part of it: all_n, all_pos and arrays of the distinct scores with
    their n and pos."""
    import pyarrow as pa
    import pyarrow.compute as pc

    most = SORTED_ROWS

    def summed(table):
        table = table.combine_chunks()
        coded = [table.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in by]
        code, keys = coded[0].indices.to_numpy().astype(np.int64), [coded[0].dictionary]
        for own in coded[1:]:
            both, code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)
            keys = [*(k.take(pa.array(both // len(own.dictionary))) for k in keys), own.dictionary.take(pa.array(both % len(own.dictionary)))]
        groups = len(keys[0])
        short = code.astype(np.uint16) if groups < 1 << 16 else code  # short numbers sort faster
        gone = pc.is_null(table.column("score")).to_numpy()
        score = np.where(gone, -np.inf, table.column("score").to_numpy())
        y = pc.fill_null(table.column("y"), 0).to_numpy()
        order = np.argsort(score)
        order = order[np.argsort(short[order], kind="stable")]
        code, score, gone, y = code[order], score[order], gone[order], y[order]
        place, ends = np.zeros(len(code), dtype=np.int32), np.searchsorted(code, np.arange(groups + 1))
        for i, group in enumerate(zip(*(k.to_pylist() for k in keys), strict=True)):
            if group in edges:
                place[ends[i] : ends[i + 1]] = np.searchsorted(edges[group], score[ends[i] : ends[i + 1]])
        place[gone] = -1
        new = np.r_[True, (code[1:] != code[:-1]) | (place[1:] != place[:-1])]
        starts = np.flatnonzero(new | np.r_[True, score[1:] != score[:-1]])
        n, pos = np.diff(np.r_[starts, len(code)]).astype(np.int32), np.add.reduceat(y, starts).astype(np.int32)
        heads = np.flatnonzero(new[starts])
        cut = pa.array(np.r_[heads, len(starts)].astype(np.int32))
        values = [pa.array(np.add.reduceat(v, heads, dtype=np.int64)) for v in (n, pos)] + [pa.ListArray.from_arrays(cut, pa.array(v)) for v in (score[starts], n, pos)]
        return keys, code[starts][heads], place[starts][heads], values

    names = [*by, "range", "all_n", "all_pos", "scores", "n", "pos"]

    def run(batches):
        held = []
        for batch in _and_end(batches):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= most):
                table = pa.Table.from_batches(held)
                held = []
                if not table.num_rows:
                    continue
                keys, code, place, values = summed(table)
                whole = pa.RecordBatch.from_arrays([*(k.take(pa.array(code)) for k in keys), pa.array(place.astype(np.int32)), *values], names=names)
                # Lists of a whole group are long: a few rows at a time.
                yield from (whole.slice(i, 64) for i in range(0, whole.num_rows, 64))

    kind = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by]
    kind += ["range int", "all_n long", "all_pos long", "scores array<double>", "n array<int>", "pos array<int>"]
    narrow = rows.select(*by, F.col("score").cast("double").alias("score"), F.col("y").cast("long").alias("y"))
    return narrow.mapInArrow(run, ", ".join(kind))


def _and_end(batches):
    yield from batches
    yield None


def _swept(by: tuple[str, ...]):
    """A range's lists merged: its share of the sum."""

    def run(table):
        import pyarrow as pa

        flat = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("scores", "n", "pos")]
        distinct, at = np.unique(flat[0], return_inverse=True)
        n, pos = (np.bincount(at, v, len(distinct))[::-1] for v in flat[1:])
        pos0, n0 = table.column("pos0")[0].as_py(), table.column("n0")[0].as_py()
        s = float((pos * (pos0 + np.cumsum(pos)) / (n0 + np.cumsum(n))).sum())
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "pos": pa.array([0.0]), "s": pa.array([s])})

    return run


def _average_precision(rows: DataFrame, by: tuple[str, ...], range_rows: int = RANGE_ROWS) -> DataFrame:
    """average_precision of rows that are stored."""
    edges = _edges(rows, by, range_rows)
    lists = keep(_ranged(rows, by, edges), "score-lists")  # rows go through Python once
    sums = lists.groupBy(*by, "range").agg(F.sum("all_pos").cast("double").alias("pos"), F.sum("all_n").cast("double").alias("n"))
    above = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)  # a group's ranges
    sums = keep(sums.select(*by, "range", "pos", *[F.coalesce(F.sum(c).over(above), F.lit(0.0)).alias(c + "0") for c in ("pos", "n")]), "score-ranges")
    told = sums.where("pos > 0").select(*by, "range", "pos0", "n0")
    # Spark's own size check decides on a broadcast of the ranges; else both meet by what they are grouped by.
    lists = _met(lists.drop("all_n", "all_pos"), told, (*by, "range"))
    kind = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by] + ["pos double", "s double"])
    steps = lists.groupBy(*by, "range").applyInArrow(_swept(by), kind)
    found = sums.select(*by, "pos", F.lit(0.0).alias("s")).unionByName(steps).groupBy(*by).agg(F.sum("pos").alias("total"), F.sum("s").alias("s"))
    return found.where("total > 0").select(*by, (F.col("s") / F.col("total")).alias("average_precision"))


def average_precision_summary(scores: DataFrame) -> DataFrame:
    """Micro (all pairs of labels that have positives) and macro average precision; null without positives."""
    rows = keep(scores.select("label", "score", "y"), "scores")
    per = keep(_average_precision(rows, ("label",)), "average-precision")
    macro = per.agg(F.avg("average_precision").alias("average_precision_macro"))
    flat = rows.join(F.broadcast(per.select("label")), "label", "left_semi").withColumn("all", F.lit(1))  # a row a label
    micro = _average_precision(flat, ("all",)).agg(F.max("average_precision").alias("average_precision_micro"))
    return macro.join(F.broadcast(micro), F.lit(True))  # one row each


def at_k(scores: DataFrame, ks: tuple[int, ...] = (1, 3, 5), key: str = "handle", by: tuple[str, ...] = ()) -> DataFrame:
    """precision_at_k and recall_at_k; k is at most the number of labels; items without positives recall 0."""
    ranked = rank_labels(scores, key)
    labels = F.count("*")
    per = ranked.groupBy(*by, key).agg(
        F.sum("y").alias("positives"), labels.alias("labels"), *[F.sum(F.when(F.col("rank") <= k, F.col("y")).otherwise(0)).alias(f"hit_{k}") for k in ks]
    )
    values = []
    for k in ks:
        values.append(F.avg(F.col(f"hit_{k}") / F.least(F.lit(k), F.col("labels"))).alias(f"precision_at_{k}"))
        values.append(F.avg(ratio(F.col(f"hit_{k}"), F.col("positives"))).alias(f"recall_at_{k}"))
    return per.groupBy(*by).agg(*values) if by else per.agg(*values)


def per_label(rows: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1, specificity and average precision (null without positives) of each label."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rows = keep(rows.select("label", "score", "y", "pred"), "scores")
    found = confusion_matrices(rows).join(_average_precision(rows, ("label",)), "label", "left")
    return found.select(
        "label",
        (tp + fn).alias("support"),
        "predicted_support",
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        "average_precision",
        ratio(tn, tn + fp).alias("specificity"),
        "tp", "fp", "fn", "tn",
    )


def label_f1(rows: DataFrame) -> DataFrame:
    """label, support, f1: what correlations need of per_label, from counts alone."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return confusion_matrices(rows).select("label", (tp + fn).alias("support"), f1_of(tp, fp, fn).alias("f1"))


def performance_ranking(table: DataFrame) -> DataFrame:
    """Labels by F1, then support, downwards; the window is over one row a label."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("f1"), F.desc("support"), "label")))


def by_language(rows: DataFrame, minimum_support: int = 30, key: str = "handle") -> DataFrame:
    """Metrics of each language with at least ``minimum_support`` items, of (key, language, label, score, y, pred)."""
    packed = rows.groupBy(key).agg(F.collect_list(F.struct("language", "label", "score", "y", "pred")).alias("rows"))
    return items_by_language(packed, minimum_support, key)


def items_by_language(items: DataFrame, minimum_support: int = 30, key: str = "handle") -> DataFrame:
    """by_language of one row an item: key and rows, the array of its (language, label, score, y, pred).

    An item is ranked in its row, its rows are read once, and sums by language and label are all that is exchanged. Ties of
    score and label rank by language.
    """
    ks = (3, 5)

    def placed(x: Column) -> Column:
        score = x["score"].cast("double")
        kind = F.when(score.isNull(), 2).when(F.isnan(score), 0).otherwise(1)  # as a descending sort has them
        return F.struct(kind.alias("kind"), F.when(kind == 1, -score).alias("down"), *[x[c].alias(c) for c in ("label", "language", "y", "pred")])

    ranked = items.select(key, F.array_sort(F.transform("rows", placed)).alias("rows"))
    each = ranked.select(key, "rows", F.explode_outer(F.array_distinct(F.transform("rows", lambda x: x["language"]))).alias("language")).where("language is not null")
    placed_rows = F.transform("rows", lambda x, i: F.struct(x["language"].alias("language"), x["label"].alias("label"), x["y"].alias("y"), x["pred"].alias("pred"), i.alias("place")))
    own = each.select(key, "language", F.filter(placed_rows, lambda x: x["language"] == F.col("language")).alias("own"))
    of = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["y"], F.lit(0)).cast("long"))
    hits = {k: of(F.filter("own", lambda x: x["place"] < k)).alias(f"hit_{k}") for k in ks}  # noqa: B023
    whole = own.select(F.col(key).isNotNull().cast("long").alias("known"), "language", "own", of("own").alias("positives"), F.size("own").alias("labels"), *hits.values())
    told = whole.select("known", "language", "positives", "labels", *[f"hit_{k}" for k in ks], F.posexplode_outer("own").alias("at", "x"))  # no array is read once a row
    first = F.col("at") == 0  # carries what the item adds as a whole
    values = {}
    for k in ks:
        values[f"precision_at_{k}"] = F.col(f"hit_{k}") / F.least(F.lit(k), F.col("labels"))
        values[f"recall_at_{k}"] = ratio(F.col(f"hit_{k}"), F.col("positives"))
    rows = told.select("language", "x.label", "x.y", "x.pred", first.cast("long").alias("items"), F.when(first, F.col("known")).otherwise(0).alias("known"), *[F.when(first, v).alias(c) for c, v in values.items()])
    cells = counts(("language", "label"), rows, more=(F.max("y").alias("any"), *[F.sum(c).alias(c) for c in ("items", "known", *values)]))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    found = cells.groupBy("language").agg(
        F.sum("known").alias("n"),
        F.sum("any").alias("evaluable_labels"),
        F.sum(1 - F.col("any")).alias("non_evaluable_labels"),
        ratio(2 * F.sum(tp), F.sum(2 * tp + fp + fn)).alias("f1_micro"),
        F.avg(f1_of(tp, fp, fn)).alias("f1_macro"),
        *[(F.sum(c) / F.sum("items")).alias(c) for c in values],
    )
    return found.where(F.col("n") >= minimum_support)


def substitution_errors(rows: DataFrame, key: str = "handle") -> DataFrame:
    """How often a missed label met an extra one in the same item; pairs are within one item's label array."""
    missed = F.collect_list(F.when((F.col("y") == 1) & (F.col("pred") == 0), F.col("label")))
    extra = F.collect_list(F.when((F.col("y") == 0) & (F.col("pred") == 1), F.col("label")))
    per = rows.where("y <> pred").groupBy(key).agg(missed.alias("missed"), extra.alias("extra"))
    pairs = per.select(F.explode("missed").alias("missed"), "extra").select("missed", F.explode("extra").alias("predicted_instead"))
    return pairs.groupBy("missed", "predicted_instead").agg(F.count("*").alias("n"))


def correlations(table: DataFrame, support: str = "support", value: str = "f1") -> DataFrame:
    """Pearson of log1p(support) and Spearman (average ranks); windows are over one row a label."""
    usable = table.where(F.col(support).isNotNull() & F.col(value).isNotNull()).select(F.col(support).cast("double").alias("s"), F.col(value).cast("double").alias("v"))

    def average_rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy().orderBy(c))
        return first + (F.count("*").over(Window.partitionBy(c)) - 1) / 2

    ranked = usable.select("s", "v", average_rank("s").alias("rs"), average_rank("v").alias("rv"))
    return ranked.agg(F.count("*").alias("n"), F.corr(F.log1p("s"), F.col("v")).alias("pearson_log1p_support_f1"), F.corr("rs", "rv").alias("spearman_support_f1"))


def correlation_p_values(found: DataFrame) -> dict[str, float]:
    """Two-sided p-values of correlations' one row, by Student's t (numerical integral on the driver)."""
    row = found.first().asDict()
    out = {}
    for name in ("pearson_log1p_support_f1", "spearman_support_f1"):
        r, n = row[name], row["n"]
        if r is None or n < 3:
            out[name] = float("nan")
            continue
        df = n - 2
        t = abs(r) * np.sqrt(df / max(1e-300, 1 - r * r))
        angle = np.linspace(0, np.arctan(t / np.sqrt(df)), 20_001)
        whole = np.linspace(0, np.pi / 2, 20_001)
        density = lambda a: np.cos(a) ** (df - 1)
        out[name] = float(max(0.0, 1 - np.trapezoid(density(angle), angle) / np.trapezoid(density(whole), whole)))
    return out


#: Poisson(1)'s distribution function, up to where 16 bits no longer tell more.
POISSON_STEPS = np.cumsum([np.exp(-1.0) / math.factorial(i) for i in range(7)])
#: Sums of (label, cell) that a task holds at a time.
HELD_CELLS = 2000


def multiplicities(keys: list[str], replicates: int, seed: int, stream: str = "") -> np.ndarray:
    """keys x replicates Poisson(1) draws: every 16 bits of SHA-256(seed|stream|key|block) are one replicate's."""
    steps = (np.arange(65_536)[:, None] / 65_536 >= POISSON_STEPS).sum(axis=1).astype(np.uint8)
    blocks, lead = -(-replicates // 16), f"{seed}|{stream}|"
    tails, data = [str(i).encode() for i in range(blocks)], bytearray()
    for key in keys:
        begun = hashlib.sha256(f"{lead}{key}|".encode())  # what an item's blocks share is read once
        for tail in tails:
            block = begun.copy()
            block.update(tail)
            data += block.digest()
    return steps[np.frombuffer(data, dtype=">u2").reshape(len(keys), blocks * 16)[:, :replicates]]


#: Rows of draws that are summed at a time in 16 bits.
SUMMED_ROWS = 65_535 // len(POISSON_STEPS)


def _replicate_counts(rows: DataFrame, replicates: int, seed: int, key: str, stream: str) -> DataFrame:
    """replicate, label, tp, fp, fn under the items' multiplicities. A task keeps one row of sums a label and
    cell and hands these on; items are never gathered, nor multiplied by the replicates in an exchange."""
    counted = rows.where("y = 1 or pred = 1").select(key, "label", "y", "pred", F.lit(0).alias("model"))
    return _drawn_counts(counted, replicates, seed, key, (stream,)).drop("stream", "model")


def _drawn_counts(hits: DataFrame, replicates: int, seed: int, key: str, streams: tuple[str, ...]) -> DataFrame:
    """stream, model, replicate, label, tp, fp, fn of hits (key, label, y, pred, model from 0). An item's draw is made once
    for all models' rows of it that come together."""
    import pyarrow as pa

    names = ["stream", "model", "label", "cell", "sums"]

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            kinds = pa.string(), pa.int32(), pa.string(), pa.int32()
            of = [pa.array([n[i] for n in held], kind) for i, kind in enumerate(kinds)]
            out = pa.RecordBatch.from_arrays([*of, pa.array(list(held.values()), pa.list_(pa.int64()))], names=names)
            held.clear()
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                items = part.column("item").dictionary_encode()
                labels = part.column("label").dictionary_encode()
                model = part.column("model").to_numpy().astype(np.int64)
                code = (model * len(labels.dictionary) + labels.indices.to_numpy()) * 3 + part.column("cell").to_numpy()
                order = np.argsort(code, kind="stable")
                code, at = code[order], items.indices.to_numpy()[order]
                first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
                known = labels.dictionary.to_pylist()
                for stream in streams:
                    own = multiplicities(items.dictionary.to_pylist(), replicates, seed, stream).astype(np.uint16)
                    for i, j in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
                        of, cell = divmod(int(code[i]), 3)
                        of, label = divmod(of, len(known))
                        sums = sum(own[at[k : min(j, k + SUMMED_ROWS)]].sum(axis=0, dtype=np.uint16).astype(np.int64) for k in range(i, j, SUMMED_ROWS))
                        name = stream, of, known[label], cell
                        held[name] = held[name] + sums if name in held else sums
                if len(held) > HELD_CELLS:
                    yield flush()
        if held:
            yield flush()

    cell = F.when((F.col("y") == 1) & (F.col("pred") == 1), 0).when(F.col("pred") == 1, 1).otherwise(2)
    narrow = hits.select(F.col(key).cast("string").alias("item"), F.col("label").cast("string").alias("label"), cell.alias("cell"), F.col("model").cast("int").alias("model"))
    sums = narrow.mapInArrow(run, "stream string, model int, label string, cell int, sums array<long>").select("stream", "model", "label", "cell", F.posexplode("sums").alias("replicate", "n"))
    of = lambda c: F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0))
    return sums.groupBy("stream", "model", "replicate", "label").agg(of(0).alias("tp"), of(1).alias("fp"), of(2).alias("fn"))


def _drawn_f1(counted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.groupBy(*by).agg(F.sum(f1_of(tp, fp, fn)).alias("f1_sum"), ratio(2 * F.sum(tp), F.sum(2 * tp + fp + fn)).alias("f1_micro"))


def _replicate_f1(rows: DataFrame, replicates: int, seed: int, key: str, stream: str = "") -> DataFrame:
    return _drawn_f1(_replicate_counts(rows, replicates, seed, key, stream), ("replicate",))


def _hits(rows: DataFrame, key: str) -> tuple[DataFrame, int, DataFrame]:
    """The rows that F1 counts (stored: every draw reads them), the number of labels, and f1_macro and f1_micro in one row
    (none without labels)."""
    labels = rows.select("label").distinct().count()
    hits = keep(rows.where("y = 1 or pred = 1").select(key, "label", "y", "pred"), "hits")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    found = counts(("label",), hits).agg(
        (F.coalesce(F.sum(f1_of(tp, fp, fn)), F.lit(0.0)) / F.lit(float(max(1, labels)))).alias("f1_macro"), ratio(2 * F.sum(tp), F.sum(2 * tp + fp + fn)).alias("f1_micro")
    )
    return hits, labels, found.where(F.lit(labels > 0))


def bootstrap_intervals(rows: DataFrame, replicates: int = 1000, confidence: float = 0.95, seed: int = 42, key: str = "handle") -> DataFrame:
    """Estimate and percentile interval of Macro- and Micro-F1; both metrics share each replicate's draw.

    An item's multiplicity in a replicate follows from its hash alone (the Poisson bootstrap, which needs no
    totals); the number of drawn items varies about the number of items.
    """
    hits, labels, main = _hits(rows, key)
    drawn = keep(_replicate_f1(hits, replicates, seed, key).select((F.col("f1_sum") / F.lit(float(labels))).alias("f1_macro"), "f1_micro"), "drawn")
    alpha = (1 - confidence) / 2
    out = None
    for metric in ("f1_macro", "f1_micro"):
        q = drawn.agg(F.percentile(metric, F.lit(alpha)).alias("ci_lower"), F.percentile(metric, F.lit(1 - alpha)).alias("ci_upper"))
        part = main.select(F.lit(metric).alias("metric"), F.col(metric).alias("estimate")).join(F.broadcast(q), F.lit(True))  # one row each
        out = part if out is None else out.unionByName(part)
    return out.withColumns({"confidence": F.lit(confidence), "n_resamples": F.lit(replicates)})


def paired_bootstrap(reference: DataFrame, candidate: DataFrame, replicates: int = 1000, confidence: float = 0.95, seed: int = 42, key: str = "handle") -> DataFrame:
    """Candidate minus reference: difference, interval and share of replicates above 0, on the same items.

    Macro and micro draws come from streams of their own. Both tables' rows of an item are brought together, so that its draw
    of a stream is made once.
    """
    (hits_a, labels, base), (hits_b, _, seen) = _hits(reference, key), _hits(candidate, key)
    alpha, out = (1 - confidence) / 2, None
    both = hits_a.withColumn("model", F.lit(0)).unionByName(hits_b.withColumn("model", F.lit(1)))
    both = both.repartition(key).sortWithinPartitions(key)
    streams = ("f1_macro", "f1_micro")
    drawn = keep(_drawn_f1(_drawn_counts(both, replicates, seed, key, streams), ("stream", "model", "replicate")), "drawn")
    for metric in streams:
        value = F.col("f1_sum") / F.lit(float(labels)) if metric == "f1_macro" else F.col("f1_micro")
        of = drawn.where(F.col("stream") == metric)
        a, b = (of.where(f"model = {i}").select("replicate", value.alias(name)) for i, name in enumerate("ab"))
        d = a.join(b, "replicate", "full").select((F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("d"))
        q = d.agg(
            F.percentile("d", F.lit(alpha)).alias("ci_lower"),
            F.percentile("d", F.lit(1 - alpha)).alias("ci_upper"),
            F.avg((F.col("d") > 0).cast("double")).alias("probability_candidate_better"),
        )
        part = seen.select(F.lit(metric).alias("metric"), F.col(metric).alias("c")).join(F.broadcast(base.select(F.col(metric).alias("r"))), F.lit(True))
        part = part.join(F.broadcast(q), F.lit(True))  # one row each
        part = part.select("metric", (F.col("c") - F.col("r")).alias("difference_candidate_minus_global"), "ci_lower", "ci_upper", "probability_candidate_better")
        out = part if out is None else out.unionByName(part)
    return out


def predictions(rows: DataFrame, key: str = "handle") -> DataFrame:
    """One row an item: true and predicted labels and ranked scores as JSON."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "label", "score", "y", "pred")))
    per = rows.groupBy(key).agg(ordered.alias("r"))
    names = lambda flag: F.to_json(F.array_sort(F.transform(F.filter("r", lambda x: x[flag] == 1), lambda x: x["label"])))
    return per.select(
        key,
        names("y").alias("true_labels"),
        names("pred").alias("predicted_labels"),
        F.to_json(F.transform("r", lambda x: x["label"])).alias("ranked_labels"),
        F.to_json(F.transform("r", lambda x: x["score"])).alias("ranked_scores"),
    )


def chart_tables(rows: DataFrame, items: DataFrame) -> dict[str, DataFrame]:
    """What the charts of a run show, one table a chart, ready to be drawn: (key, label, y, pred, score) rows of the
    test items and the items with their labels."""
    from .labels import label_matrix

    table = performance_ranking(per_label(rows))
    metrics = multilabel_metrics(rows)
    return {
        "label_cooccurrence_heatmap": label_matrix(items),
        "support_vs_f1": table.select("label", "support", "f1"),
        "per_label_f1": table.select("rank", "label", "f1"),
        "label_error_counts": table.select("label", "fp", "fn"),
        "true_vs_predicted_support": table.select("label", "support", "predicted_support"),
        "per_label_confusion_matrices": table.select("label", "tn", "fp", "fn", "tp"),
        "test_metrics_overview": metrics.drop("n_items").unpivot([], [c for c in metrics.columns if c != "n_items"], "metric", "value"),
    }
