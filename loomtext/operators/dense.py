"""Dense features: chunks, weighted text units, pooling, encoders with a cache, and the fine-tuning shell."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Feature sets: all non-empty subsets of the three fields, in field order.
FIELDS = ("abstract", "keywords", "fulltext")
FEATURE_SETS = {
    "+".join(f for i, f in enumerate(FIELDS) if mask >> i & 1): [f for i, f in enumerate(FIELDS) if mask >> i & 1] for mask in range(1, 8)
}
FIELD_WEIGHTS = {"abstract": 0.25, "keywords": 0.15, "fulltext": 0.60}


def chunk_tokens(ids: Column, max_length: int, overlap: int = 0) -> Column:
    """Overlapping slices; a short tail stays; an empty array gives one empty chunk."""
    if max_length <= 0 or not 0 <= overlap < max_length:
        raise ValueError("max_length has to be positive and overlap smaller")
    step = max_length - overlap
    starts = F.when(F.size(ids) > 0, F.sequence(F.lit(0), F.size(ids) - 1, F.lit(step))).otherwise(F.array(F.lit(0)))
    return F.transform(starts, lambda i: F.slice(ids, i + 1, F.lit(max_length)))


def uniform_chunks(ids: Column, length: int, maximum: int) -> Column:
    """Slices without overlap, at most ``maximum`` of them, evenly spaced with first and last."""
    chunks = chunk_tokens(ids, length)
    n = F.size(chunks)
    if maximum <= 1:
        return F.when(n > 1, F.slice(chunks, 1, 1)).otherwise(chunks)
    pick = F.transform(F.sequence(F.lit(0), F.lit(maximum - 1)), lambda i: F.get(chunks, F.floor(i * (n - 1) / (maximum - 1)).cast("int")))
    return F.when(n > maximum, pick).otherwise(chunks)


def add_special_tokens(ids: Column, first: int | None, last: int | None) -> Column:
    if first is None or last is None:
        raise ValueError("the tokenizer has no special tokens to add")
    return F.concat(F.array(F.lit(first)), ids, F.array(F.lit(last)))


def pool(vectors: DataFrame, by: Sequence[str], mode: str = "mean", vector: str = "vector", weight: str | None = None) -> DataFrame:
    """by, vector: component-wise mean, weighted_mean (a zero weight sum gives the mean) or max."""
    if mode not in ("mean", "weighted_mean", "max"):
        raise ValueError(f"unknown pooling mode: {mode}")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = vectors.select(*by, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    x = F.col("_x").cast("double")
    mean = F.avg(x)
    value = {"mean": mean, "max": F.max(x), "weighted_mean": F.coalesce(F.try_divide(F.sum(x * F.col("_w")), F.sum("_w")), mean)}[mode]
    parts = rows.groupBy(*by, "_i").agg(value.alias("_v"))
    joined = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("p"))
    return joined.select(*by, F.transform("p", lambda p: p["_v"]).alias("vector"))


def weighted_units(items: DataFrame, feature_set: str, field_weights: dict[str, float] | None = None, key: str = "handle") -> DataFrame:
    """key, unit_idx, text, weight: units of the active fields; a field's weight is split over its units and
    weights are made to sum to one over the units that are there."""
    active = FEATURE_SETS[feature_set]
    given = {f: float((field_weights or FIELD_WEIGHTS).get(f, 1.0)) for f in active}
    total = sum(given.values()) or 1.0
    source = {
        "abstract": F.col("abstract_segments") if "abstract_segments" in items.columns else None,
        "fulltext": F.col("fulltext_documents") if "fulltext_documents" in items.columns else None,
        "keywords": F.filter(F.array(F.trim(F.coalesce("keywords", F.lit("")))), lambda x: x != "") if "keywords" in items.columns else None,
    }

    def unit(f: str, values: Column):
        share = F.lit(given[f] / total) / F.size(values)
        return lambda x: F.struct(F.concat(F.lit(f"{f.upper()}: "), T.normalize_text(x)).alias("text"), share.alias("w"))

    parts = []
    for f in active:
        values = F.coalesce(source[f] if source[f] is not None else F.array().cast("array<string>"), F.array().cast("array<string>"))
        parts.append(F.transform(values, unit(f, values)))
    rows = items.select(key, F.concat(*parts).alias("u")).withColumn("s", F.aggregate("u", F.lit(0.0), lambda a, x: a + x["w"]))
    rows = rows.select(key, "s", F.posexplode("u").alias("unit_idx", "x"))
    return rows.select(key, "unit_idx", F.col("x.text").alias("text"), F.coalesce(F.try_divide(F.col("x.w"), F.col("s")), F.col("x.w")).alias("weight"))


def feature_text(items: DataFrame, feature_set: str, mode: str, key: str = "handle") -> DataFrame:
    """key, text: fields with their prefix, segments and fields on lines of their own. Keywords keep stop words."""
    parts = []
    for f in FEATURE_SETS[feature_set]:
        prefix = F.lit(f"{f.upper()}: ")
        segments, languages = {
            "abstract": ("abstract_segments", "abstract_segment_languages"),
            "fulltext": ("fulltext_preprocessing_segments", "fulltext_preprocessing_segment_languages"),
            "keywords": ("", ""),
        }[f]
        if segments in items.columns and languages in items.columns:
            value = F.array_join(
                F.transform(F.arrays_zip(F.col(segments).alias("t"), F.col(languages).alias("l")), lambda x: T.preprocess(x["t"], x["l"], mode)), "\n"
            )
        else:
            own = "normalized" if f == "keywords" and mode == "language_stopwords" else mode
            language = F.col(f"{f}_detected_language") if f"{f}_detected_language" in items.columns else F.lit("und")
            value = T.preprocess(F.coalesce(F.col(f), F.lit("")), language, own)
        parts.append(F.concat(prefix, value))
    return items.select(key, F.concat_ws("\n", *parts).alias("text"))


def transformer_text(items: DataFrame, feature_set: str, key: str = "handle") -> DataFrame:
    parts = [F.concat(F.lit(f"{f.upper()}: "), T.normalize_text(F.col(f))) for f in FEATURE_SETS[feature_set]]
    return items.select(key, F.concat_ws("\n", *parts).alias("text"))


#: An encoder turns a list of texts into a matrix with one row a text.
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(width: int = 64, seed: int = 0) -> Encoder:
    """A stand-in without pretrained weights: signed hashes of words, at unit length."""
    import zlib

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, text in enumerate(texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode(), seed)
                out[i, h % width] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def encode_texts(texts: DataFrame, encoder: Encoder, text: str = "text", batch: int = 256) -> DataFrame:
    """Adds text_hash and vector for each distinct text, batch by batch."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            rows: list = []
            values = part.tolist()
            for i in range(0, len(values), batch):
                rows += list(encoder(values[i : i + batch]))
            yield pd.Series(rows)

    distinct = texts.select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("text")).dropDuplicates(["text_hash"])
    return distinct.select("text_hash", run("text").alias("vector"))


#: How texts reach an encoder: in overlapping chunks, or whole, so that the encoder cuts them itself.
CHUNKED, TRUNCATED = "full_document", "legacy_truncated"


def encode_cached(texts: DataFrame, encoder: Encoder, cache_path: str, text: str = "text", model: str = "", setting: str = "") -> DataFrame:
    """Vectors of all texts; only those without a row in the cache are encoded, and they are appended to it.

    A cached vector belongs to a text, a model and the model's setting (its mode and chunk length, say).
    """
    spark = texts.sparkSession
    own = (F.col("model") == model) & (F.col("setting") == setting)
    try:
        cache = spark.read.parquet(cache_path).where(own)
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = None
    wanted = texts.withColumn("text_hash", F.sha2(text, 256))
    missing = wanted if cache is None else wanted.join(cache.select("text_hash"), "text_hash", "left_anti")
    made = encode_texts(missing, encoder, text).withColumns({"model": F.lit(model), "setting": F.lit(setting)})
    made.write.mode("append").option("compression", "zstd").parquet(cache_path)
    held = spark.read.parquet(cache_path).where(own).dropDuplicates(["text_hash"]).select("text_hash", "vector")
    return wanted.join(held, "text_hash")


def text_chunks(units: DataFrame, mode: str = CHUNKED, length: int = 128, overlap: int = 0) -> DataFrame:
    """Adds chunk_idx and chunk: overlapping runs of a unit's words, or the unit as it is if it is to be truncated."""
    if mode == TRUNCATED:
        return units.withColumns({"chunk_idx": F.lit(0), "chunk": F.col("text")})
    if mode != CHUNKED:
        raise ValueError(f"unknown embedding mode: {mode}")
    chunks = F.transform(chunk_tokens(F.split("text", " "), length, overlap), lambda words: F.array_join(words, " "))
    return units.select("*", F.posexplode(chunks).alias("chunk_idx", "chunk"))


def encode_items(
    units: DataFrame,
    items: DataFrame,
    encoder: Encoder,
    width: int,
    mode: str = CHUNKED,
    length: int = 128,
    overlap: int = 0,
    cache_path: str | None = None,
    model: str = "",
    key: str = "handle",
) -> DataFrame:
    """key, vector: chunks pooled to units by their mean, units to items by weight; items without units are zero.

    Blank units take no part. Weights are those of ``units`` (key, unit_idx, text, weight).
    """
    chunks = text_chunks(units.where(F.trim("text") != ""), mode, length, overlap).select(key, "unit_idx", "weight", F.col("chunk").alias("text"))
    if cache_path:
        rows = encode_cached(chunks, encoder, cache_path, model=model, setting=f"{mode}:{length}:{overlap}")
    else:
        rows = chunks.withColumn("text_hash", F.sha2("text", 256)).join(encode_texts(chunks, encoder), "text_hash")
    per_unit = pool(rows, [key, "unit_idx", "weight"])
    pooled = pool(per_unit, [key], "weighted_mean", weight="weight")
    return items.select(key).join(pooled, key, "left").select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), width)).alias("vector"))


def embedding_coverage(units: DataFrame, items: DataFrame, mode: str = CHUNKED, length: int = 128, overlap: int = 0, key: str = "handle") -> DataFrame:
    """Per split: documents, documents without units, text units, chunks, their mean and maximum a unit."""
    chunks = text_chunks(units.where(F.trim("text") != ""), mode, length, overlap).groupBy(key, "unit_idx").agg(F.count("*").alias("n"))
    per = chunks.groupBy(key).agg(F.count("*").alias("units"), F.sum("n").alias("chunks"), F.max("n").alias("most"))
    whole = items.select(key, "split").join(per, key, "left")
    return whole.groupBy(F.col("split").alias("partition")).agg(
        F.count("*").alias("documents"),
        F.sum(F.col("units").isNull().cast("long")).alias("documents_without_units"),
        F.coalesce(F.sum("units"), F.lit(0)).alias("text_units"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
        F.try_divide(F.sum("chunks").cast("double"), F.sum("units").cast("double")).alias("chunks_per_unit"),
        F.max("most").alias("most_chunks"),
    )


#: A model's forward pass: token arrays to a matrix of logits, one row a chunk and one column a label.
Forward = Callable[[list[np.ndarray]], np.ndarray]


def infer_logits(chunks: DataFrame, forward: Forward, labels: Sequence[str], key: str = "handle", batch: int = 64) -> DataFrame:
    """key, label, logit, weight of every chunk (key, tokens, weight) by a fine-tuned model, in batches inside the tasks."""
    names = list(labels)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                logits = np.asarray(forward(list(own["tokens"])), dtype=float)
                yield pd.DataFrame(
                    {
                        key: np.repeat(own[key].to_numpy(), len(names)),
                        "label": np.tile(names, len(own)),
                        "logit": logits.ravel(),
                        "weight": np.repeat(own["weight"].to_numpy(dtype=float), len(names)),
                    }
                )

    kind = chunks.schema[key].dataType.simpleString()
    return chunks.select(key, "tokens", "weight").mapInPandas(run, f"{key} {kind}, label string, logit double, weight double")


def evaluate_finetuned(units: DataFrame, truth: DataFrame, forward: Forward, labels: Sequence[str], thresholds, length: int, maximum: int, key: str = "handle") -> DataFrame:
    """key, label, score, y, pred of test items: weighted chunks, their logits, scores by item, thresholds.

    ``units`` has key, unit_idx, ids and weight; ``truth`` key, label and y.
    """
    from . import scores

    logits = infer_logits(chunk_weights(units, length, maximum, key), forward, labels, key)
    return scores.apply_thresholds(aggregate_logits(logits, key, "weight").join(truth, [key, "label"]), thresholds)


def encode_segmented(units: DataFrame, vectors: DataFrame, items: DataFrame, width: int, key: str = "handle") -> DataFrame:
    """Units' vectors (text_hash, vector) pooled by weight to items; an item without units is a zero vector."""
    joined = units.withColumn("text_hash", F.sha2("text", 256)).join(vectors.select("text_hash", "vector"), "text_hash")
    pooled = pool(joined, [key], "weighted_mean", weight="weight")
    zero = F.array_repeat(F.lit(0.0), width)
    return items.select(key).join(pooled, key, "left").select(key, F.coalesce("vector", zero).alias("vector"))


def chunk_weights(units: DataFrame, length: int, maximum: int, key: str = "handle", ids: str = "ids") -> DataFrame:
    """key, unit_idx, chunk_idx, tokens, weight: a unit's weight is split over its chunks."""
    rows = units.withColumn("c", uniform_chunks(F.col(ids), length, maximum))
    rows = rows.select(key, "unit_idx", F.size("c").alias("n"), "weight", F.posexplode("c").alias("chunk_idx", "tokens"))
    return rows.select(key, "unit_idx", "chunk_idx", "tokens", (F.col("weight") / F.col("n")).alias("weight"))


def aggregate_logits(chunks: DataFrame, key: str = "handle", weight: str | None = None) -> DataFrame:
    """key, label, score: mean logits of an item's chunks, weighted if asked for (weights sum to 1e-12 at least)."""
    if weight is None:
        return chunks.groupBy(key, "label").agg(F.avg("logit").alias("score"))
    w = F.col(weight)
    return chunks.groupBy(key, "label").agg((F.sum(w * F.col("logit")) / F.greatest(F.sum(w), F.lit(1e-12))).alias("score"))


def early_stopping(epochs: DataFrame, delta: float, patience: int, run: str = "run", epoch: str = "epoch", metric: str = "metric") -> DataFrame:
    """Adds best, improved, waited and stop: an epoch improves if its metric beats the best so far by over ``delta``.

    A fold over one run's epochs, in order.
    """
    per = epochs.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(metric).cast("double").alias("metric")))).alias("e"))
    kind = "array<struct<epoch:bigint,metric:double,best:double,improved:boolean,waited:int>>"
    fold = F.expr(
        f"aggregate(e, cast(array() as {kind}), (a, x) -> concat(a, array(named_struct("
        "'epoch', x.epoch, 'metric', x.metric, "
        f"'best', if(size(a) = 0 or x.metric > element_at(a, -1).best + {delta}, x.metric, element_at(a, -1).best), "
        f"'improved', size(a) = 0 or x.metric > element_at(a, -1).best + {delta}, "
        f"'waited', if(size(a) = 0 or x.metric > element_at(a, -1).best + {delta}, 0, element_at(a, -1).waited + 1)))))"
    )
    return per.select(run, F.explode(fold).alias("x")).select(run, "x.*").withColumn("stop", F.col("waited") >= patience)


def dense_features(vector: Column) -> Column:
    """A vector as features for classifiers: size, null indices, values."""
    values = vector.cast("array<double>")
    return F.struct(F.size(values).alias("size"), F.lit(None).cast("array<int>").alias("indices"), values.alias("values"))


def positive_weights(indicator: DataFrame) -> DataFrame:
    """label, pos_weight = negatives / max(positives, 1) of the training items."""
    pos = F.sum("y")
    return indicator.groupBy("label").agg(((F.count("*") - pos) / F.greatest(pos, F.lit(1))).cast("double").alias("pos_weight"))
