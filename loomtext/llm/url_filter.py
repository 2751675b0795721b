"""Operator 13, URL filters: rules first, gradient-boosted trees on lexical features for what no rule judges.

A URL is cut into host and path. A rule names a host and the beginning of a path; it fits that host and all
its subdomains, and of the rules that fit the longest wins. Every other URL gets the verdict of
gradient-boosted trees over lexical features: lengths, depth, digit ratio, entropy, parameter counts, and
statistics of suffixes (top-level domain, last two labels, file extension) and of the first segment: how many
URLs have a value, and which smoothed share of its labelled ones is blocked. The trees learn from labelled
URLs: those that rules judge, unless a table of labels is given.

Statistics count every URL and are grouped after partial sums; only the trees are fitted on a bounded sample.
A labelled URL's own fold is left out of the shares it is trained on, so that a label doesn't tell itself. All
is DataFrame functions and pyspark.ml; a URL's features are computed where it lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, spread_lookup, stash, text_or_empty

#: Rules as (verdict, host and path): the list of the query.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Rules that are tried inside the row; more are looked up by key.
IN_ROW = 128
#: Labelled URLs that the trees are fitted on at most, those of the smallest hashes.
SAMPLE = 20_000
#: A value that fewer URLs have counts as unseen.
SEEN = 3
#: Labelled URLs that the overall share weighs as much as.
PRIOR = 4.0
KINDS = ("tld", "site", "extension", "segment")
FEATURES = (
    "f_length f_host f_path f_labels f_depth f_digits f_host_digits f_entropy f_params f_hyphens f_secure "
    + " ".join(f"f_{k}_seen f_{k}_blocked" for k in KINDS)
).split()


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a host's beginning."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_parts(rule: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a rule, cut before its first slash; without one it fits every path."""
    host, slash, rest = rule.partition("/")
    return host.translate({c: c + 32 for c in range(65, 91)}), slash + rest


def ruled_in_row(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule of a row's host and path, as struct of its text and verdict; null if none fits."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0]))
    entries = [
        F.struct(*[F.lit(v).alias(c) for c, v in (("host", rule_parts(r)[0]), ("path", rule_parts(r)[1]), ("rule", r), ("verdict", verdict))])
        for verdict, r in ordered
    ]
    fits = lambda x: ((F.col("host") == x["host"]) | F.col("host").endswith(F.concat(F.lit("."), x["host"]))) & F.col("path").startswith(x["path"])
    first = F.try_element_at(F.filter(F.array(*entries), fits), F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict")))


def ruled_by_key(rows: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """``rows`` (row_uid, part, host, path and more) with ruled: the same answer for any number of rules.

    A row looks up its host's suffixes of as many labels as rules' hosts have, with its path's beginnings of
    the lengths that rules' paths have, by equality. No key's rows meet in one task.
    """
    spark = rows.sparkSession
    parts = [(*rule_parts(r), r, verdict) for verdict, r in sorted(rules, key=lambda r: (r[1], r[0]))]
    labels, lengths = sorted({h.count(".") + 1 for h, *_ in parts}), sorted({len(p) for _, p, *_ in parts})
    known = spark.createDataFrame(parts, "key_host string, key_path string, rule string, verdict string")
    best = F.struct((-F.length("rule")).alias("less"), "rule", "verdict")
    known = known.groupBy("key_host", "key_path").agg(F.min(best).alias("best"))
    n = F.size(F.split("host", r"\.", -1))
    hosts = F.array_compact(F.array(*[F.when(n >= k, F.substring_index("host", ".", -k)) for k in labels]))
    paths = F.array_compact(F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in lengths]))
    keys = rows.select("row_uid", "part", F.explode(hosts).alias("key_host"), paths.alias("paths"))
    keys = keys.select("row_uid", "part", "key_host", F.explode("paths").alias("key_path"))
    met = spread_lookup(keys, known, ["key_host", "key_path"], "part").where("best is not null")
    won = met.groupBy("row_uid").agg(F.min("best").alias("best"))
    ruled = F.when(F.col("best").isNotNull(), F.struct(F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    return rows.join(won, "row_uid", "left").withColumn("ruled", ruled).drop("best")


def with_rules(rows: DataFrame, rules: Sequence[tuple[str, str]], in_row: int = IN_ROW) -> DataFrame:
    """Adds ruled to rows with host and path."""
    if len(rules) <= in_row:
        return rows.withColumn("ruled", ruled_in_row(rules))
    held = stash(rows.withColumns({"part": F.spark_partition_id(), "row_uid": F.monotonically_increasing_id()}), "urls")
    return ruled_by_key(held, rules).drop("part", "row_uid")


def values() -> dict[str, Column]:
    """The value of each of KINDS that a row's host and path have; empty where there is none."""
    return {
        "tld": F.substring_index("host", ".", -1),
        "site": F.substring_index("host", ".", -2),
        "extension": lower_ascii(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})\z", 1)),
        "segment": F.regexp_extract("path", r"\A/([^/]{0,64})", 1),
    }


def lexical() -> dict[str, Column]:
    """The features that a row's url, host and path alone tell."""
    u, n = F.col("url"), F.length("url").cast("double")
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]+", ""))
    count = lambda x, c: F.length(x) - F.length(F.translate(x, c, ""))
    own = F.filter(F.array_distinct(F.split(u, "")), lambda c: c != "")
    p = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(own, F.lit(0.0), lambda s, c: s - F.coalesce(p(c) * F.log2(p(c)), F.lit(0.0)))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "f_length": F.log1p(n),
        "f_host": F.log1p(F.length("host").cast("double")),
        "f_path": F.log1p(F.length("path").cast("double")),
        "f_labels": F.least(count(F.col("host"), "."), F.lit(16)).cast("double"),
        "f_depth": F.least(F.length(F.regexp_replace("path", "[^/]+", "")), F.lit(64)).cast("double"),
        "f_digits": share(digits(u), n),
        "f_host_digits": share(digits(F.col("host")), F.length("host")),
        "f_entropy": F.coalesce(entropy, F.lit(0.0)),
        "f_params": F.when(query == "", 0.0).otherwise(F.least(count(query, "&") + 1, F.lit(64)).cast("double")),
        "f_hyphens": F.least(count(F.col("host"), "-"), F.lit(16)).cast("double"),
        "f_secure": F.lower(F.substring(u, 1, 8)).eqNullSafe("https://").cast("double"),
    }


@dataclass
class UrlModel:
    """Statistics of values by kind, the labelled URLs' share of blocked ones, and the trees (none where one class is all)."""

    counts: dict[str, DataFrame]
    small: bool
    prior: float
    trees: GBTClassificationModel | None


def _folds() -> Column:
    return F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")


def value_counts(rows: DataFrame, seen: int) -> DataFrame:
    """kind, value, n (URLs), labelled and blocked ones in total and of fold 0; one row a value that ``seen`` URLs have."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values().items()]))
    rows = rows.select(each.alias("x"), "label", _folds().alias("fold")).select("x.*", "label", "fold")
    total = lambda of, when=None: F.coalesce(F.sum(of if when is None else F.when(when, of)), F.lit(0)).cast("long")
    known, first = F.col("label").isNotNull().cast("long"), F.col("fold") == 0
    return (
        rows.groupBy("kind", "value")
        .agg(
            F.count("*").alias("n"),
            total(known).alias("labelled"),
            total(F.col("label")).alias("blocked"),
            total(known, first).alias("labelled0"),
            total(F.col("label"), first).alias("blocked0"),
        )
        .where((F.col("value") != "") & (F.col("n") >= seen))
    )


def with_features(rows: DataFrame, model: UrlModel, fitting: bool = False) -> DataFrame:
    """Adds FEATURES to rows with url, host and path; ``fitting`` leaves the row's own fold out of the shares."""
    rows = rows.withColumns(values() | lexical())
    if not model.small:
        rows = rows.withColumn("part", F.spark_partition_id())
    for kind in KINDS:
        found = model.counts[kind].withColumnRenamed("value", kind)
        if model.small:
            rows = rows.join(F.broadcast(found), kind, "left")
        else:
            rows = spread_lookup(rows, found, [kind], "part")
        known, bad = F.col("labelled"), F.col("blocked")
        if fitting:
            first = _folds() == 0
            known = F.when(first, known - F.col("labelled0")).otherwise(F.col("labelled0"))
            bad = F.when(first, bad - F.col("blocked0")).otherwise(F.col("blocked0"))
        known, bad = F.coalesce(known, F.lit(0)), F.coalesce(bad, F.lit(0))
        rows = rows.withColumns(
            {f"f_{kind}_seen": F.log1p(F.coalesce("n", F.lit(0)).cast("double")), f"f_{kind}_blocked": (bad + model.prior * PRIOR) / (known + PRIOR)}
        ).drop("n", "labelled", "blocked", "labelled0", "blocked0")
    return rows


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)


def fit_urls(rows: DataFrame, sample: int = SAMPLE, seen: int = SEEN, trees: int = 20, depth: int = 4, seed: int = 13) -> UrlModel:
    """Statistics over all rows (url, host, path, label: 1 blocked, 0 allowed, else null), trees over a bounded sample.

    The sample holds the ``sample`` labelled URLs of the smallest hashes at most. Without labelled URLs, or with
    those of one class alone, there are no trees and every URL gets the share of blocked ones, 0 without any."""
    counts = stash(value_counts(rows, seen), "url-values")
    size = counts.agg(F.sum(F.octet_length("value") + 64)).first()[0] or 0
    fitted = stash(rows.where("label is not null").orderBy(F.xxhash64("url"), "url", "label").limit(sample), "url-sample")
    labelled, blocked = fitted.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    by_kind = {k: counts.where(F.col("kind") == k).drop("kind") for k in KINDS}
    model = UrlModel(by_kind, size <= BROADCAST_BYTES, blocked / labelled if labelled else 0.0, None)
    if 0 < blocked < labelled:
        vectors = stash(_vectors(with_features(fitted, model, fitting=True)).select("features", F.col("label").cast("double").alias("label")), "url-vectors")
        model.trees = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, seed=seed).fit(vectors)
    return model


def score_urls(rows: DataFrame, model: UrlModel) -> DataFrame:
    """Adds probability, that of being blocked, to rows with url, host and path."""
    if model.trees is None:
        return rows.withColumn("probability", F.lit(model.prior))
    own = rows.columns
    scored = model.trees.transform(_vectors(with_features(rows, model)).select(*own, "features"))
    return scored.select(*own, vector_to_array("probability")[1].alias("probability"))


def _rows(pages: DataFrame, url_col: str, carry: Sequence[str]) -> DataFrame:
    url = text_or_empty(url_col)
    held = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    return pages.select(held.alias("row"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))


def judged_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    least: float = 0.5,
    url_col: str = "url",
    carry: Sequence[str] = ("page_id",),
    in_row: int = IN_ROW,
    sample: int = SAMPLE,
    seen: int = SEEN,
    trees: int = 20,
) -> DataFrame:
    """row (a struct of the ``carry`` columns), host, path, rule, verdict (allow or block), probability, for each page.

    Rules are (verdict, host and path). ``labelled`` (url, label: 1 block, 0 allow) are URLs to learn from; without
    it the URLs that rules judge. A URL without a rule is blocked from a probability of ``least`` on; probability is
    the method's for every URL. A null URL, or one without ``://``, has an empty host and path, and no rule but
    one of an empty host fits it. Identifiers, null and repeated ones too, pass through, as do repeated URLs. URLs
    are read whole. Of rules of equal length the first by text, then verdict, wins. An empty table gives an empty result.
    """
    rows = with_rules(_rows(pages, url_col, carry), rules, in_row)
    label = F.col("ruled.verdict").eqNullSafe("block").cast("int")
    learn = rows.select("url", "host", "path", F.when(F.col("ruled").isNotNull(), label).alias("label"))
    if labelled is not None:
        given = _rows(labelled.where("label in (0, 1)"), "url", ("label",))
        learn = learn.withColumn("label", F.lit(None).cast("int")).unionByName(
            given.select("url", "host", "path", F.col("row.label").cast("int").alias("label"))
        )
    model = fit_urls(learn, sample, seen, trees)
    scored = score_urls(rows, model)
    verdict = F.when(F.col("probability") >= least, "block").otherwise("allow")
    return scored.select("row", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", verdict).alias("verdict"), "probability")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", **settings) -> DataFrame:
    """page_id, host, path, rule, verdict, probability of every page; see judged_urls."""
    found = judged_urls(pages, rules, carry=(id_col,), **settings)
    return found.select(F.col("row")[id_col].alias("page_id"), "host", "path", "rule", "verdict", "probability")


def allowed_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **settings) -> DataFrame:
    """The rows of ``pages`` that judged_urls allows, with their own columns."""
    found = judged_urls(pages, rules, carry=pages.columns, **settings).where("verdict = 'allow'")
    return found.select(*[F.col("row")[c].alias(c) for c in pages.columns])
