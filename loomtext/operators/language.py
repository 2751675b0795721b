"""Language identification: a heuristic Column detector, windows, per-item aggregates and audits."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Words, with a space on either side, that speak for a language.
MARKERS = {
    "es": ("el", "la", "los", "las", "de", "para", "investigación", "educación"),
    "en": ("the", "and", "of", "for", "research", "with", "study"),
    "pt": ("os", "as", "uma", "para", "pesquisa", "educação", "com"),
    "fr": ("le", "la", "les", "des", "une", "recherche", "avec"),
}

def heuristic(text: Column, min_chars: int = 12) -> Column:
    """The language with most distinct markers (ties in MARKERS' order) and its share of all; else und."""
    padded = F.concat(F.lit(" "), T.collapse_spaces(F.lower(F.coalesce(text, F.lit("")))), F.lit(" "))

    def hits(p: Column) -> Column:
        counts = [sum((F.contains(p, F.lit(f" {w} ")).cast("int") for w in words), F.lit(0)).alias(lang) for lang, words in MARKERS.items()]
        return F.struct((F.length(p) - 2).alias("chars"), *counts)

    def choice(h: Column) -> Column:
        values = [h[lang] for lang in MARKERS]
        best, total = F.greatest(*values), sum(values, F.lit(0))
        none = (h["chars"] < min_chars) | (best == 0)
        name = F.coalesce(*[F.when(h[lang] == best, F.lit(lang)) for lang in MARKERS])
        return F.struct(
            F.when(none, "und").otherwise(name).alias("language"),
            F.when(~none, best.cast("double") / total.cast("double")).alias("score"),
        )

    # Arrays of one element name the steps' results: the text is normalised once, and the markers counted once.
    return F.get(F.transform(F.transform(F.array(padded), hits), choice), F.lit(0))


DETECTION = "struct<language:string,score:double>"


class Detector:
    """Turns a text column into struct(language, score); ``each`` does so for an array of texts, inside its row."""

    def __init__(self, one: Callable[[Column], Column]):
        self.one = one

    def __call__(self, text: Column) -> Column:
        return self.one(text)

    def each(self, texts: Column) -> Column:
        return F.transform(texts, self.one)


class LibraryDetector(Detector):
    """A library's classifier, (language, score) of a text, in Arrow batches; Spark allows no UDF inside a lambda."""

    def __init__(self, classify: Callable[[str], tuple[str, float | None]]):
        def told(text: str | None) -> dict:
            language, score = classify(text) if text and text.strip() else ("und", None)
            return {"language": language, "score": score}

        @F.pandas_udf(DETECTION)
        def detect(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([told(t) for t in texts], columns=["language", "score"])

        @F.pandas_udf(f"array<{DETECTION}>")
        def detect_each(rows: pd.Series) -> pd.Series:
            return pd.Series([None if row is None else [told(t) for t in row] for row in rows], dtype=object)

        super().__init__(detect)
        self.each = detect_each


def _langid() -> Detector:
    from langid.langid import LanguageIdentifier, model

    held: list = []

    def classify(text: str):
        if not held:
            held.append(LanguageIdentifier.from_modelstring(model, norm_probs=True))
        language, score = held[0].classify(text)
        return language or "und", float(score)

    return LibraryDetector(classify)


def _langdetect() -> Detector:
    from langdetect import detect_langs

    def classify(text: str):
        try:
            found = detect_langs(text)
        except Exception:  # the library raises for texts without features
            return "und", None
        return (found[0].lang, float(found[0].prob)) if found else ("und", None)

    return LibraryDetector(classify)


def _lingua() -> Detector:
    from lingua import LanguageDetectorBuilder

    held: list = []

    def classify(text: str):
        if not held:
            held.append(LanguageDetectorBuilder.from_all_languages().build())
        found = held[0].detect_language_of(text)
        if found is None:
            return "und", None
        return found.iso_code_639_1.name.lower(), float(held[0].compute_language_confidence(text, found))

    return LibraryDetector(classify)


def create_detector(backend: str = "heuristic", min_chars: int = 12) -> Detector:
    """heuristic, or a library's (langid, langdetect, lingua), which has to be installed."""
    if backend == "heuristic":
        return Detector(lambda text: heuristic(text, min_chars))
    makers = {"langid": _langid, "langdetect": _langdetect, "lingua": _lingua}
    if backend not in makers:
        raise ValueError(f"unknown language backend: {backend}")
    return makers[backend]()


def window_starts(length: Column, width: int, count: int) -> Column:
    """Evenly spaced starts of ``count`` windows, the first at 0 and the last ending with the text."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (length - width) / (count - 1)).cast("int"))


def slices(text: Column, width: int) -> Column:
    """Consecutive slices of fixed width; none of an empty text."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(width))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(width)))


def vote(found: Column) -> Column:
    """The language of most of an array's detections (not und before und, then the first seen) and its mean score."""
    languages = F.array_distinct(F.transform(found, lambda d: d["language"]))

    def ballot(language: Column, at: Column) -> Column:
        own = F.filter(found, lambda d: d["language"].eqNullSafe(language))
        scores = F.filter(F.transform(own, lambda d: d["score"]), lambda x: x.isNotNull())
        mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(scores).cast("double")))
        return F.struct(
            F.size(own).alias("n"), (language != "und").cast("int").alias("known"), (-at).alias("before"), language.alias("language"), mean.alias("score")
        )

    return F.array_max(F.transform(languages, ballot))


def detect_distributed(texts: DataFrame, detector: Detector, text: str = "text", width: int = 4000, count: int = 5) -> DataFrame:
    """Adds language and score. Long texts vote by windows, inside their row: no text is copied or moved."""
    long = (F.length(text) > width) & F.lit(count > 1)
    pieces = F.when(long, F.transform(window_starts(F.length(text), width, count), lambda s: F.substring(F.col(text), s + 1, F.lit(width)))).otherwise(F.array(text))
    seen = texts.withColumn("_seen", detector.each(pieces))
    # An array of one names the vote's result, so that it is counted once.
    seen = seen.withColumn("_vote", F.get(F.transform(F.array("_seen"), vote), F.lit(0)))
    return seen.select(*texts.columns, F.col("_vote.language").alias("language"), F.col("_vote.score").alias("score"))


def aggregate_languages(units: DataFrame, key: str = "handle", min_share: float = 0.20) -> DataFrame:
    """Per item from units (key, pos, chars or text, language, score): detected_language, language_score, language_set.

    Languages with at least ``min_share`` of the characters outside und are significant; several make
    mul, else the language with most characters counts (und included; ties prefer others, then the first).
    """
    chars = F.col("chars") if "chars" in units.columns else F.length("text")
    per = units.groupBy(key, "language").agg(
        F.sum(chars).alias("chars"), F.avg("score").alias("score"), F.min("pos").alias("first")
    )
    item = Window.partitionBy(key)
    known = F.sum(F.when(F.col("language") != "und", F.col("chars")).otherwise(0)).over(item)
    per = per.withColumn("significant", (F.col("language") != "und") & (F.col("chars") / F.greatest(known, F.lit(1)) >= min_share))
    order = F.struct(F.col("chars"), (F.col("language") != "und").cast("int"), -F.col("first"))
    found = per.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("significant"), F.col("language")))).alias("language_set"),
        F.max_by("language", order).alias("dominant"),
        F.max_by("score", order).alias("score"),
    )
    many = F.size("language_set") > 1
    return found.select(
        key,
        F.when(many, "mul").otherwise(F.col("dominant")).alias("detected_language"),
        F.when(~many, F.col("score")).alias("language_score"),
        "language_set",
    )


def override_by_windows(aggregate: DataFrame, units: DataFrame, detector: Detector, key: str = "handle", width: int = 12_000, min_share: float = 0.20) -> DataFrame:
    """Language sets anew from slices of ``width``; several make mul, and mul stays mul."""
    own = slices(F.col("text"), width)
    told = units.select(key, "pos", detector.each(own).alias("found"), F.transform(own, F.length).alias("sizes"))
    told = told.select(key, "pos", F.posexplode(F.arrays_zip("found", "sizes")).alias("at", "x"))  # texts stay where they are
    pieces = told.select(
        key, (F.col("pos") * 1_000_000 + F.col("at")).alias("pos"), F.col("x.sizes").alias("chars"), F.col("x.found.language").alias("language"), F.col("x.found.score").alias("score")
    )
    seen = aggregate_languages(pieces, key, min_share).select(key, F.col("language_set").alias("window_set"))
    joined = aggregate.join(seen, key, "left")
    new = F.coalesce("window_set", F.array().cast("array<string>"))
    return joined.select(
        key, F.when(F.size(new) > 1, "mul").otherwise(F.col("detected_language")).alias("detected_language"), "language_score", new.alias("language_set")
    )


def detect_keywords(text: Column, detector: Detector, min_chars: int = 20) -> Column:
    short = F.length(F.trim(F.coalesce(text, F.lit("")))) < min_chars
    none = F.struct(F.lit("und").alias("language"), F.lit(None).cast("double").alias("score"))
    return F.coalesce(F.when(short, none), detector(F.when(~short, text)))


def agreement(rows: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Counts of declared and detected language pairs, and whether they agree."""
    return rows.groupBy(*by, "declared", "detected").agg(F.count("*").alias("n")).withColumn("agrees", F.col("declared").eqNullSafe(F.col("detected")))


def agreement_summary(rows: DataFrame, by: tuple[str, ...] = ("field",)) -> DataFrame:
    """Items, auditable items (a declared and a detected language), agreements and their rate (null without any)."""
    auditable = F.coalesce(~F.col("declared").isin("und", "mul") & (F.col("detected") != "und"), F.lit(False))
    agree = auditable & (F.col("declared") == F.col("detected"))
    n, good = F.sum(auditable.cast("long")), F.sum(agree.cast("long"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), n.alias("auditable"), good.alias("agreements"), F.try_divide(good.cast("double"), n.cast("double")).alias("agreement_rate")
    )


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Items of each language and their percentage; the window is over one row a language."""
    counts = rows.groupBy(F.col(column).alias("language")).agg(F.count("*").alias("n"))
    return counts.withColumn("percentage", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def ground_truth(raw: DataFrame, handle: str, text: str, final: str, catalogued: str, other: str) -> DataFrame:
    """Valid audited segments: handle, text_hash, language and where the truth comes from."""
    code = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    agreed = (code(catalogued) == code(other)) & (code(other) == code(final))
    rows = raw.select(
        T.parse_handle(F.col(handle)).alias("handle"),
        T.fingerprint(F.col(text)).alias("text_hash"),
        code(final).alias("language"),
        F.when(agreed, "human_langid_agreement").otherwise("manual_audit").alias("truth_source"),
    )
    return rows.where(F.col("handle").isNotNull() & ~F.col("language").isin("", "auditar", "unknown", "empty", "und"))


def ground_truth_conflicts(truth: DataFrame) -> DataFrame:
    """Segments with several languages."""
    found = truth.groupBy("handle", "text_hash").agg(F.array_sort(F.collect_set("language")).alias("languages"))
    return found.where(F.size("languages") > 1).select("handle", "text_hash", F.array_join("languages", ",").alias("languages"))


def attach_ground_truth(segments: DataFrame, truth: DataFrame) -> DataFrame:
    """Segments (handle, text, ...) with the language of the truth for (handle, text), else null."""
    one = truth.groupBy("handle", "text_hash").agg(F.min("language").alias("truth"), F.min("truth_source").alias("truth_source"))
    return segments.withColumn("text_hash", T.fingerprint(F.col("text"))).join(one, ["handle", "text_hash"], "left")


def confusion(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(guess).alias("guess")).agg(F.count("*").alias("n"))


def per_language(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Precision, recall, F1 and support for every language of the truth or the guesses."""
    both = rows.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("language"), F.col(truth).alias("t"), F.col(guess).alias("g"))
    is_t, is_g = F.col("t") == F.col("language"), F.col("g") == F.col("language")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    counts = both.groupBy("language").agg(n(is_t & is_g).alias("tp"), n(is_g).alias("predicted"), n(is_t).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    precision, recall = ratio("tp", "predicted"), ratio("tp", "support")
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("predicted") + F.col("support")).cast("double")), F.lit(0.0))
    return counts.select("language", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support")


def averages(table: DataFrame) -> DataFrame:
    """The rows accuracy, macro avg and weighted avg under a table of per_language; accuracy stands in every column.

    Its recall, weighted by support, is the share of right guesses."""
    names = ("precision", "recall", "f1")
    support = F.sum("support").alias("support")
    weigh = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support").cast("double")), F.lit(0.0)).alias(c)
    macro = table.agg(*[F.avg(c).alias(c) for c in names], support).withColumn("language", F.lit("macro avg"))
    weighted = table.agg(*[weigh(c) for c in names], support).withColumn("language", F.lit("weighted avg"))
    accuracy = weighted.select(*[F.col("recall").alias(c) for c in names], "support", F.lit("accuracy").alias("language"))
    out = table.select("language", *names, "support")
    for part in (accuracy, macro, weighted):
        out = out.unionByName(part)
    return out


def segment_audit(items: DataFrame, truth: DataFrame, key: str = "handle") -> DataFrame:
    """One row a segment of ``abstract_segments``: place, hash, length, declared and detected language, score and truth."""
    names = ("abstract_segments", "abstract_segment_declared_languages", "abstract_segment_languages", "abstract_segment_language_scores")
    told = [F.col(c) if c in items.columns else F.array().cast("array<string>") for c in names]
    rows = items.select(key, F.posexplode(F.arrays_zip(*[c.alias(f"c{i}") for i, c in enumerate(told)])).alias("segment_index", "x"))
    rows = rows.where(F.col("x.c0").isNotNull()).select(
        F.col(key).alias("handle"),
        "segment_index",
        F.col("x.c0").alias("text"),
        F.length("x.c0").alias("characters"),
        F.coalesce("x.c1", F.lit("und")).alias("declared_language"),
        F.coalesce("x.c2", F.lit("und")).alias("detected_language"),
        F.col("x.c3").cast("double").alias("detection_score"),
    )
    rows = attach_ground_truth(rows, truth)
    return rows.select(
        "handle", "segment_index", "text_hash", "characters", "declared_language", "detected_language", "detection_score",
        F.col("truth").alias("ground_truth_language"), F.col("truth_source").alias("ground_truth_source"),
    )


def truth_lists(audit: DataFrame) -> DataFrame:
    """handle and the true language of each of its segments in order, null where none is known."""
    listed = F.array_sort(F.collect_list(F.struct("segment_index", "ground_truth_language")))
    per = audit.groupBy("handle").agg(listed.alias("t"))
    return per.select("handle", F.transform("t", lambda x: x["ground_truth_language"]).alias("abstract_segment_ground_truth_languages"))


def accuracy_summary(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    good = F.sum((F.col(truth) == F.col(guess)).cast("long"))
    return rows.agg(F.count("*").alias("n"), good.alias("correct"), F.try_divide(good.cast("double"), F.count("*").cast("double")).alias("accuracy"))
