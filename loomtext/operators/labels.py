"""Label selection, statistics, co-occurrence, stratified samples and splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import keep


def label_support(items: DataFrame) -> DataFrame:
    """Items that have each label (labels count once an item)."""
    return items.select(F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("support"))


def select_labels(items: DataFrame, top_k: int | None, min_support: int) -> tuple[DataFrame, DataFrame]:
    """Items with selected labels only (others go), and all supports. Ties in support go by label."""
    stats = label_support(items)
    chosen = stats.where(F.col("support") >= min_support)
    if top_k:
        chosen = chosen.orderBy(F.desc("support"), "label").limit(top_k)
    # One row: the selected labels, at most top_k or the labels of sufficient support.
    names = chosen.agg(F.coalesce(F.collect_set("label"), F.array().cast("array<string>")).alias("chosen")).first()["chosen"]
    kept = F.array_sort(F.array_intersect(F.array_distinct("labels"), F.lit(sorted(names)).cast("array<string>") if names else F.array().cast("array<string>")))
    return items.withColumn("labels", kept).where(F.size("labels") > 0), stats


def dataset_statistics(items: DataFrame) -> DataFrame:
    """Items, labels, assignments, cardinality, density, and the labels an item has (population deviation)."""
    sizes = items.select(F.size(F.array_distinct("labels")).alias("n"))
    own = sizes.agg(
        F.count("*").alias("items"),
        F.sum("n").cast("long").alias("assignments"),
        F.avg("n").alias("cardinality"),
        F.percentile("n", F.lit(0.5)).alias("median_labels"),
        F.stddev_pop("n").alias("std_labels"),
        F.min("n").alias("min_labels"),
        F.max("n").alias("max_labels"),
    )
    count = label_support(items).agg(F.count("*").alias("labels"))
    both = own.join(F.broadcast(count), F.lit(True))  # one row each
    return both.withColumn("density", F.try_divide(F.col("cardinality"), F.col("labels").cast("double")))


def label_pairs(items: DataFrame, key: str = "handle") -> DataFrame:
    """Items that hold each pair of labels a < b, zero pairs included, with their Jaccard similarity.

    Pairs are made inside each item's label array; the table of all pairs is labels x labels.
    """
    own = F.array_sort(F.array_distinct("labels"))
    pair = F.flatten(
        F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    )
    seen = items.select(F.explode(pair).alias("p")).groupBy(F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b")).agg(F.count("*").alias("n"))
    support = label_support(items)
    left = support.select(F.col("label").alias("label_a"), F.col("support").alias("support_a"))
    right = support.select(F.col("label").alias("label_b"), F.col("support").alias("support_b"))
    every = left.join(right, F.col("label_a") < F.col("label_b"))  # one row per pair of label names
    return every.join(seen, ["label_a", "label_b"], "left").select(
        "label_a",
        "label_b",
        F.coalesce("n", F.lit(0)).alias("cooccurrence"),
        F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), (F.col("support_a") + F.col("support_b") - F.coalesce("n", F.lit(0))).cast("double")), F.lit(0.0)).alias("jaccard"),
    )


def label_matrix(items: DataFrame) -> DataFrame:
    """Co-occurrence counts of every ordered pair of labels that meet; the diagonal is the support."""
    own = F.array_distinct("labels")
    pair = F.flatten(F.transform(own, lambda a: F.transform(own, lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return items.select(F.explode(pair).alias("p")).groupBy(F.col("p.a").alias("label_a"), F.col("p.b").alias("label_b")).agg(F.count("*").alias("n"))


def indicator(items: DataFrame, key: str = "handle", others: tuple[str, ...] = ()) -> DataFrame:
    """key, label, y for every item and every label that occurs, and the items' ``others``; label names are one array on each row."""
    names = label_support(items).agg(F.array_sort(F.collect_set("label")).alias("names"))
    rows = items.select(key, *others, "labels").join(F.broadcast(names), F.lit(True))  # a single row
    return rows.select(key, *others, F.explode("names").alias("label"), "labels").select(
        key, *others, "label", F.array_contains("labels", F.col("label")).cast("int").alias("y")
    )


def rarest_label(items: DataFrame, key: str = "handle") -> DataFrame:
    """key, stratum: each item's least supported label (ties by name)."""
    exploded = items.select(key, F.explode(F.array_distinct("labels")).alias("label"))
    return exploded.join(label_support(items), "label").groupBy(key).agg(F.min_by("label", F.struct("support", "label")).alias("stratum"))


#: Ranges of hashes that a stratum is cut into.
RANGES = 1024


def _ordered(items: DataFrame, seed: int, key: str) -> DataFrame:
    """place in (0, 1) of each item in its stratum, by hash.

    A stratum's hashes are cut into RANGES; counts of the ranges give each its first place, and rows are
    numbered inside their range alone, so a stratum with a third of all items is many tasks' work.
    """
    strata = rarest_label(items, key).withColumn("h", T.portable_hash(str(seed), F.col(key)))
    strata = strata.withColumn("range", F.shiftright("h", 38).cast("int"))  # the hash has 48 bits
    sizes = strata.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    w = Window.partitionBy("stratum")  # RANGES rows a stratum
    below = F.coalesce(F.sum("n").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("stratum", "range", below.alias("below"), F.sum("n").over(w).alias("total"))
    own = F.row_number().over(Window.partitionBy("stratum", "range").orderBy("h", key))
    placed = strata.withColumn("own", own).join(sizes, ["stratum", "range"])
    return placed.select(key, "stratum", ((F.col("below") + F.col("own") - 0.5) / F.col("total")).alias("place"))


def stratified_sample(items: DataFrame, n: int | None, seed: int = 42, key: str = "handle") -> DataFrame:
    """About n items, the same share of every stratum; all of them without n or with n beyond the rows."""
    if n is None:
        return items
    total = items.count()
    if n >= total:
        return items
    kept = _ordered(items, seed, key).where(F.col("place") < n / total).select(key)
    return items.join(kept, key, "left_semi")


def _assign(items: DataFrame, shares: Mapping[str, float], seed: int, key: str) -> DataFrame:
    result, edge = None, 0.0
    for name, share in list(shares.items())[:-1]:
        edge += share
        result = F.when(F.col("place") < edge, name) if result is None else result.when(F.col("place") < edge, name)
    last = list(shares)[-1]
    return _ordered(items, seed, key).select(key, (F.lit(last) if result is None else result.otherwise(last)).alias("split"))


def label_order(sets: DataFrame) -> list[str]:
    """Labels by iterative stratification: always the one that fewest unassigned items hold (ties by name), whose items are
    assigned then. ``sets`` has labels and n (items of that very set); labels are few, sets are read once a label."""
    order: list[str] = []
    while True:
        rest = sets.where(~F.arrays_overlap("labels", F.lit(order).cast("array<string>"))) if order else sets
        held = rest.select(F.explode("labels").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n"))
        found = held.orderBy("n", "label").first()
        if found is None:
            return order
        order.append(found.label)


def quotas(n: int, wanted: list[float]) -> list[int]:
    """How many of n items go to each fold if every next one goes where most are still wanted (ties to the earlier fold)."""
    one = 10**9
    left = [round(w * one) for w in wanted]  # integers: ties are ties
    taken = lambda level: [max(0, -((level - x) // one)) for x in left]  # noqa: E731  # steps of one that begin above the level
    low, high = min(left) - (n + 1) * one, max(left)
    while low < high:  # the level that folds are filled down to
        middle = (low + high) // 2
        if sum(taken(middle)) > n:
            low = middle + 1
        else:
            high = middle
    given = taken(high)
    for _ in range(n - sum(given)):  # what lies on the level itself, one a fold at most
        given[max(range(len(left)), key=lambda f: (left[f] - given[f] * one, -f))] += 1
    return given


def _assign_iteratively(items: DataFrame, shares: Mapping[str, float], seed: int, key: str) -> DataFrame:
    """key, split by iterative stratification: labels in label_order, each one's items to the folds that want it most.

    An item's stratum is the label at which it is assigned (a label whose items all go before has none), and its rank there goes by hash, so a round is a cut of
    ranks; what the folds still want of every label is the state that rounds share (labels x folds). An item without
    labels goes by the folds' shares alone."""
    rows = items.select(key, F.array_sort(F.array_distinct("labels")).alias("labels"))
    sets = keep(rows.groupBy("labels").agg(F.count("*").alias("n")), "label-sets")
    order, folds = label_order(sets), list(shares)
    place = F.lit(order).cast("array<string>")
    stratum = F.coalesce(F.array_min(F.transform("labels", lambda x: F.nullif(F.array_position(place, x), F.lit(0)))), F.lit(len(order) + 1)).cast("int")
    strata = rows.select(key, "labels", stratum.alias("stratum")).withColumn("h", T.portable_hash(str(seed), F.col(key)))
    strata = strata.withColumn("range", F.shiftright("h", 38).cast("int"))  # the hash has 48 bits
    sizes = strata.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stratum").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows a stratum
    sizes = sizes.select("stratum", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    own = F.row_number().over(Window.partitionBy("stratum", "range").orderBy("h", key))
    ranked = keep(strata.withColumn("own", own).join(sizes, ["stratum", "range"]).select(key, "labels", "stratum", (F.col("below") + F.col("own")).alias("rank")), "ranked")
    support = {r.label: r.n for r in sets.select(F.explode("labels").alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    counts = {r.stratum: r.n for r in ranked.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    wanted = {label: [n * shares[f] for f in folds] for label, n in support.items()}
    cuts: dict[int, list[int]] = {}

    def fold_of(at: list[int]) -> Column:
        edges = [sum(at[: i + 1]) for i in range(len(at))]
        return F.size(F.filter(F.lit(edges[:-1]).cast("array<long>"), lambda e: e < F.col("rank")))

    for i, label in enumerate(order, start=1):
        cuts[i] = quotas(counts.get(i, 0), wanted[label])
        seen = ranked.where(F.col("stratum") == i).select(fold_of(cuts[i]).alias("fold"), F.explode("labels").alias("label")).groupBy("fold", "label").count()
        for r in seen.collect():  # labels x folds at most
            wanted[r.label][r.fold] -= r["count"]
    rest = len(order) + 1
    cuts[rest] = quotas(counts.get(rest, 0), [counts.get(rest, 0) * shares[f] for f in folds])
    edges = items.sparkSession.createDataFrame([(i, [sum(c[: k + 1]) for k in range(len(c) - 1)]) for i, c in cuts.items()], "stratum int, edges array<long>")
    at = F.size(F.filter("edges", lambda e: e < F.col("rank"))) + 1
    return ranked.join(F.broadcast(edges), "stratum").select(key, F.element_at(F.lit(folds).cast("array<string>"), at.cast("int")).alias("split"))  # a row a label


def split_shares(validation: float = 0.15, test: float = 0.15, calibration: float = 0.0) -> dict[str, float]:
    shares = {"train": 1 - validation - test - calibration, "calibration": calibration, "validation": validation, "test": test}
    return {k: v for k, v in shares.items() if v > 0}


def split_items(
    items: DataFrame,
    shares: Mapping[str, float] | None = None,
    seed: int = 42,
    max_tries: int = 20,
    key: str = "handle",
    group_column: str | None = None,
    method: str = "hash",
) -> tuple[DataFrame, int]:
    """Items with a split, and the seed that was used.

    ``method`` is hash (places by hash within the stratum of an item's rarest label) or iterative (iterative stratification:
    every label's shares are kept as near as the items allow).

    Seeds are tried until every label is in every split; else the seed with fewest missing stays. With a
    group column that repeats, whole groups are split by the union of their labels.
    """
    if method not in ("hash", "iterative"):
        raise ValueError(f"unknown split method: {method}")
    shares = dict(shares or split_shares())
    units, unit_key = items, key
    if group_column and group_column in items.columns:
        sizes = items.groupBy(group_column).count().agg(F.max("count")).first()[0] or 0
        if sizes > 1:
            units = items.select(group_column, F.explode("labels").alias("l")).distinct().groupBy(group_column).agg(F.collect_set("l").alias("labels"))
            unit_key = group_column
    units = keep(units.select(unit_key, "labels"), "units")  # narrow, and read several times a try
    best = None
    for tried in range(seed, seed + max_tries):
        assign = _assign if method == "hash" else _assign_iteratively
        assigned = keep(assign(units, shares, tried, unit_key), "split")  # read by the count of labels and by the result
        whole = items.join(assigned, unit_key)
        # A group has the labels of its items, so the stored units tell which labels a split has.
        missing = coverage(units.join(assigned, unit_key), tuple(shares)).where("not present_in_all_splits").count()
        if best is None or missing < best[0]:
            best = (missing, whole, tried)
        if missing == 0:
            break
    return best[1], best[2]


def coverage(items: DataFrame, required: tuple[str, ...] = ("train", "validation", "test"), seed: int = 42) -> DataFrame:
    """Support of each label in each split, and whether every required split has it."""
    rows = items.select("split", F.explode(F.array_distinct("labels")).alias("label"))
    n = lambda s: F.sum((F.col("split") == s).cast("long"))
    names = ("train", "calibration", "validation", "test")
    found = rows.groupBy("label").agg(F.count("*").alias("support_total"), *[n(s).alias(f"support_{s}") for s in names])
    present = F.lit(True)
    for s in required:
        present = present & (F.col(f"support_{s}") > 0)
    return found.withColumn("present_in_all_splits", present)


def split_sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("split").agg(F.count("*").alias("n"))


def split_fingerprint(items: DataFrame, key: str = "handle") -> str:
    """A digest of all (key, labels, split), whatever the order of rows: sums of row hashes, no gathering."""
    row = F.concat_ws("|", F.col(key).cast("string"), F.array_join(F.array_sort("labels"), ","), F.col("split"))
    parts = [F.conv(F.substring(F.sha2(row, 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    found = items.agg(F.count("*").alias("n"), *[F.sum(p).alias(f"s{i}") for i, p in enumerate(parts)])
    told = found.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in found.columns]), 256).alias("d"))
    return told.first()["d"]


def restore_split(items: DataFrame, manifest: DataFrame, key: str = "handle") -> DataFrame:
    """Items with the manifest's splits; both have to hold the same keys, once each."""
    if not manifest.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("the split manifest repeats keys")
    if not items.join(manifest, key, "left_anti").isEmpty() or not manifest.join(items, key, "left_anti").isEmpty():
        raise ValueError("the split manifest and the items hold different keys")
    return items.join(manifest.select(key, "split"), key)


def restore_cohort(items: DataFrame, manifest: DataFrame, key: str = "handle", order: str = "pos") -> DataFrame:
    """The manifest's items in its order; each has to be there."""
    if not manifest.join(items, key, "left_anti").isEmpty():
        raise ValueError("the cohort manifest holds keys without items")
    return items.join(manifest.select(key, order), key).orderBy(order)


def labels_by_language(items: DataFrame, language: str) -> DataFrame:
    return items.select(F.col(language).alias("language"), F.explode("labels").alias("label")).groupBy("language", "label").agg(F.count("*").alias("n"))


def text_statistics(items: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: missing texts, and exact percentiles (linear) of characters and words of the others."""
    stacked: Column = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in fields]))
    rows = items.select(stacked.alias("x")).select("x.field", F.length("x.text").alias("chars"), T.token_count(F.col("x.text")).alias("tokens"))
    there = F.col("tokens") > 0
    chars, tokens = F.when(there, F.col("chars")), F.when(there, F.col("tokens"))
    missing = F.sum((~there).cast("long"))
    return rows.groupBy("field").agg(
        missing.alias("missing"),
        (F.lit(100.0) * missing / F.count("*")).alias("missing_percentage"),
        F.avg(chars).alias("mean_chars"),
        *[F.percentile(chars, F.lit(p)).alias(f"{n}_chars") for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75), ("p95", 0.95))],
        F.avg(tokens).alias("mean_tokens"),
        F.percentile(tokens, F.lit(0.5)).alias("median_tokens"),
        F.percentile(tokens, F.lit(0.95)).alias("p95_tokens"),
    )
