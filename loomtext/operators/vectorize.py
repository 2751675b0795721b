"""Sparse features as long tables: term counts, vocabularies, TF-IDF and BM25, fitted on training items.

A text's n-grams are counted, weighted and summed in its own row, in Arrow batches: neither texts nor counts move.
The vocabulary alone is grouped by term, after partial sums of a bounded number of terms a task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import keep

#: Words of two characters or more.
TERM = "(?U)[0-9A-Z_a-z\\w]{2,}"
#: Bytes of a vocabulary that is broadcast at most; a larger one is joined by merging.
BROADCAST_BYTES = 64 << 20


def terms(texts: DataFrame, key: str = "handle", text: str = "text", ngrams: tuple[int, int] = (1, 2), lowercase: bool = True) -> DataFrame:
    """key, term: every n-gram occurrence of every text."""
    value = F.coalesce(F.col(text), F.lit(""))
    words = texts.select(key, F.regexp_extract_all(F.lower(value) if lowercase else value, F.lit(TERM), F.lit(0)).alias("w"))
    grams, made = [], F.col("w")
    for n in range(1, ngrams[1] + 1):
        if n > 1:
            size = F.greatest(F.size("w") - (n - 1), F.lit(0))
            made = F.zip_with(F.slice(made, F.lit(1), size), F.slice("w", F.lit(n), size), lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= ngrams[0]:
            grams.append(made)
    return words.select(key, F.explode(F.concat(*grams)).alias("term"))


#: Weights that may be equal once rounded to nine digits lie no farther apart.
NEAR = 1e-8
#: Words whose n-grams a task counts at a time; a longer row is counted alone.
HELD_TERMS = 1 << 21
#: Rows that a task hands on at a time.
HANDED = 1 << 16


def _words(texts: DataFrame, key: str, text: str, lowercase: bool) -> DataFrame:
    value = F.coalesce(F.col(text), F.lit(""))
    return texts.select(key, F.regexp_extract_all(F.lower(value) if lowercase else value, F.lit(TERM), F.lit(0)).alias("w"))


def _pieces(batches, held: int):
    """The batches' rows in pieces of at most ``held`` words (or of one row), small batches put together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rows, room = [], held
    for batch in batches:
        ends, start = np.cumsum(pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False)), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = int(np.searchsorted(ends, before + room, "right"))
            if stop <= start and rows:
                yield pa.Table.from_batches(rows).combine_chunks()
                rows, room = [], held
                continue
            stop = max(stop, start + 1)
            rows.append(batch.slice(start, stop - start))
            room, start = max(0, room - (int(ends[stop - 1]) - before)), stop
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks()


def _counted(lists, low: int, high: int):
    """The distinct n-grams of a list array's rows, and arrays of row, n-gram (its place) and count in the row.

    Words are numbered once, and an n-gram is the number of its first words and that of its last one, so counting sorts
    numbers; a text is put together once for each distinct n-gram."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words, word, row = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    names, gram, at = words, word, np.arange(len(word))
    found, before = [], 0
    for n in range(1, high + 1):
        if n > 1:
            fits = at + (n - 1) < len(word)
            fits[fits] = row[at[fits] + (n - 1)] == row[at[fits]]
            at = at[fits]
            pair, gram = np.unique(gram[fits] * max(1, len(words)) + word[at + (n - 1)], return_inverse=True)
            first, last = names.take(pa.array(pair // max(1, len(words)))), words.take(pa.array(pair % max(1, len(words))))
            names = pc.binary_join_element_wise(first, last, " ")
        if n >= low and len(at):
            both = np.sort(row[at] * len(names) + gram)
            starts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
            found.append((names, both[starts] // len(names), both[starts] % len(names) + before, np.diff(np.r_[starts, len(both)])))
            before += len(names)
    if not found:
        return words.slice(0, 0), *[np.zeros(0, dtype=np.int64)] * 3
    return pa.concat_arrays([f[0] for f in found]), *[np.concatenate([f[i] for f in found]) for i in (1, 2, 3)]


def _handed(columns: dict):
    """Arrow batches of HANDED rows of whole columns."""
    import pyarrow as pa

    whole = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for start in range(0, whole.num_rows, HANDED):
        yield whole.slice(start, HANDED)


def repeats(texts: DataFrame, key: str) -> bool:
    """Whether a key (or null) has several rows; reads the keys alone."""
    return not texts.select(key).groupBy(key).count().where("count > 1").isEmpty()


def term_counts(
    texts: DataFrame, key: str = "handle", text: str = "text", ngrams: tuple[int, int] = (1, 2), lowercase: bool = True, one_row: bool | None = None
) -> DataFrame:
    """key, term, tf. A row's n-grams are counted in the row; sums by key follow only where a key has several rows
    (``one_row`` tells that none has; None: looked up)."""
    words, kind, held = _words(texts, key, text, lowercase), texts.schema[key].dataType.simpleString(), HELD_TERMS

    def run(batches):
        import pyarrow as pa

        for piece in _pieces(batches, held):
            names, row, gram, n = _counted(piece.column("w"), *ngrams)
            yield from _handed({key: piece.column(key).combine_chunks().take(pa.array(row)), "term": names.take(pa.array(gram)), "tf": pa.array(n)})

    counts = words.mapInArrow(run, f"`{key}` {kind}, term string, tf long")
    if one_row if one_row is not None else not repeats(texts, key):
        return counts
    return counts.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def _best(row: np.ndarray, weight: np.ndarray, top: int) -> np.ndarray:
    """Places of those that may be among their row's ``top`` highest weights."""
    order = np.argsort(row, kind="stable")
    starts = np.flatnonzero(np.r_[True, row[order][1:] != row[order][:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
    kept = []
    for part in np.split(order, starts[1:]):
        w = weight[part]
        kept.append(part[w >= np.partition(w, -top)[-top] - NEAR] if len(part) > top else part)
    return np.concatenate(kept)


def term_totals(
    texts: DataFrame, key: str = "handle", text: str = "text", ngrams: tuple[int, int] = (1, 2), lowercase: bool = True, one_row: bool | None = None
) -> DataFrame:
    """term, df, corpus_tf over all texts. A task hands on the sums of HELD_TERMS words at a time, which go by term without a
    further map of partial sums."""
    if not (one_row if one_row is not None else not repeats(texts, key)):
        return _totals(term_counts(texts, key, text, ngrams, lowercase, False))
    held = HELD_TERMS

    def run(batches):
        import pyarrow as pa

        for piece in _pieces(batches, held):
            names, _, gram, n = _counted(piece.column("w"), *ngrams)
            df, tf = np.bincount(gram, minlength=len(names)), np.bincount(gram, n, len(names)).astype(np.int64)
            yield from _handed({"term": names, "df": pa.array(df), "corpus_tf": pa.array(tf)})

    parts = _words(texts, key, text, lowercase).mapInArrow(run, "term string, df long, corpus_tf long")
    return parts.repartition("term").groupBy("term").agg(F.sum("df").alias("df"), F.sum("corpus_tf").alias("corpus_tf"))


def _totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("corpus_tf"))


def vocabulary(counts: DataFrame, n_documents: int, max_features: int | None = None, min_df: int | float = 1, max_df: int | float = 1.0) -> DataFrame:
    """term, df, corpus_tf of the terms within the document limits, the most frequent ones first kept.

    Integers are document counts, fractions shares of the documents. Ties in frequency go by term.
    """
    return _chosen(_totals(counts), n_documents, max_features, min_df, max_df)


def _chosen(found: DataFrame, n_documents: int, max_features: int | None, min_df: int | float, max_df: int | float) -> DataFrame:
    low = min_df if isinstance(min_df, int) else min_df * n_documents
    high = max_df if isinstance(max_df, int) else max_df * n_documents
    found = found.where((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))
    return found.orderBy(F.desc("corpus_tf"), "term").limit(max_features) if max_features else found


@dataclass
class SparseModel:
    """A fitted representation: a stored table of terms with df, its size, and the fit's scalars."""

    kind: str
    terms: DataFrame
    n_documents: int
    average_length: float
    k1: float = 1.5
    b: float = 0.75
    n_bytes: int | None = None

    def known(self, counts: DataFrame) -> DataFrame:
        """The counts' terms that the vocabulary has, with df."""
        table = self.terms.select("term", "df")
        return counts.join(F.broadcast(table) if self.n_bytes is not None and self.n_bytes <= BROADCAST_BYTES else table, "term")

    def transform(self, counts: DataFrame, key: str = "handle") -> DataFrame:
        """key, term, weight for the counts' terms that the vocabulary has."""
        known = self.known(counts)
        n, df, tf = F.lit(float(self.n_documents)), F.col("df").cast("double"), F.col("tf").cast("double")
        of_item = Window.partitionBy(key)
        if self.kind == "bow":
            return known.select(key, "term", tf.alias("weight"))
        if self.kind == "tfidf":
            raw = known.select(key, "term", (tf * (F.log((1 + n) / (1 + df)) + 1)).alias("w"))
            raw = raw.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(of_item)))
            return raw.select(key, "term", F.coalesce(F.try_divide(F.col("w"), F.col("norm")), F.lit(0.0)).alias("weight"))
        known = known.withColumn("dl", F.sum("tf").over(of_item).cast("double"))
        average = self.average_length if self.average_length > 0 else 1.0
        idf = F.log((n - df + 0.5) / (df + 0.5) + 1)
        denominator = tf + self.k1 * (1 - self.b + self.b * F.col("dl") / F.lit(average))
        return known.select(key, "term", (tf * (self.k1 + 1) / denominator * idf).alias("weight"))


    def transform_texts(
        self, texts: DataFrame, key: str = "handle", text: str = "text", ngrams: tuple[int, int] = (1, 2), lowercase: bool = True, one_row: bool | None = None, top: int | None = None
    ) -> DataFrame:
        """transform of the texts' counts, without an exchange: a row's terms are looked up, weighted and summed in the row.

        ``top`` may leave out terms that are certainly not among a row's ``top`` highest weights (those within NEAR of the
        last of them all stay). A vocabulary beyond BROADCAST_BYTES is joined by merging, and keys with several rows are
        summed first; ``top`` leaves out nothing then."""
        one_row = one_row if one_row is not None else not repeats(texts, key)
        if not one_row or self.n_bytes is None or self.n_bytes > BROADCAST_BYTES:
            return self.transform(term_counts(texts, key, text, ngrams, lowercase, one_row), key)
        words, kind_of_key = _words(texts, key, text, lowercase), texts.schema[key].dataType.simpleString()
        table = self.terms.select("term", "df").toArrow()  # BROADCAST_BYTES at most
        df = table.column("df").to_numpy().astype(np.float64)
        if self.kind == "tfidf":
            factor = np.log((1.0 + self.n_documents) / (1.0 + df)) + 1
        else:
            factor = np.log((self.n_documents - df + 0.5) / (df + 0.5) + 1)
        shared = texts.sparkSession.sparkContext.broadcast((table.column("term").combine_chunks(), factor))
        kind, k1, b, average, held = self.kind, self.k1, self.b, self.average_length if self.average_length > 0 else 1.0, HELD_TERMS

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc

            vocabulary, factors = shared.value
            for piece in _pieces(batches, held):
                names, row, gram, n = _counted(piece.column("w"), *ngrams)
                place = pc.fill_null(pc.index_in(names, vocabulary.cast(names.type)), -1).to_numpy()[gram]
                row, place, tf = row[place >= 0], place[place >= 0], n[place >= 0].astype(np.float64)
                of_row = lambda values: np.bincount(row, values, piece.num_rows)[row]
                if kind == "bow":
                    weight = tf
                elif kind == "tfidf":
                    weight = tf * factors[place]
                    norm = np.sqrt(of_row(np.square(weight)))
                    weight = np.divide(weight, norm, out=np.zeros(len(tf)), where=norm > 0)
                else:
                    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * of_row(tf) / average)) * factors[place]
                if top:
                    best = _best(row, weight, top)
                    row, place, weight = row[best], place[best], weight[best]
                yield from _handed({key: piece.column(key).combine_chunks().take(pa.array(row)), "term": vocabulary.take(pa.array(place)), "weight": pa.array(weight)})

        return words.mapInArrow(run, f"`{key}` {kind_of_key}, term string, weight double")


def fit(
    kind: str,
    counts: DataFrame,
    n_documents: int,
    max_features: int | None = 100_000,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    k1: float = 1.5,
    b: float = 0.75,
) -> SparseModel:
    """bow, tfidf or bm25 from the training items' counts. ``n_documents`` includes items without terms."""
    return fit_totals(kind, _totals(counts), n_documents, max_features, min_df, max_df, k1, b)


def fit_totals(
    kind: str,
    totals: DataFrame,
    n_documents: int,
    max_features: int | None = 100_000,
    min_df: int | float = 1,
    max_df: int | float = 1.0,
    k1: float = 1.5,
    b: float = 0.75,
) -> SparseModel:
    """fit from the training texts' term_totals."""
    if kind not in ("bow", "tfidf", "bm25"):
        raise ValueError(f"unknown sparse representation: {kind}")
    table = keep(_chosen(totals, n_documents, max_features, min_df, max_df), "vocabulary")
    sums = table.agg(F.sum("corpus_tf").alias("tf"), F.sum(F.octet_length("term") + F.lit(32)).alias("bytes")).first()
    average = float(sums.tf or 0) / n_documents if n_documents else 0.0
    return SparseModel(kind, table, n_documents, average, k1, b, int(sums.bytes or 0))


def numbered(table: DataFrame) -> DataFrame:
    """term, id: terms numbered from 0 in alphabetical order, partition by partition of a sorted table."""
    order = keep(table.select("term").orderBy("term").withColumn("part", F.spark_partition_id()), "ordered-terms")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    starts = order.groupBy("part").count().withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1
    return order.withColumn("place", place).join(starts, "part").select("term", (F.col("start") + F.col("place")).cast("int").alias("id"))


def indexed_vectors(weights: DataFrame, model: SparseModel, key: str = "handle") -> DataFrame:
    """key, features: sparse vectors for classifiers; term ids in alphabetical order."""
    ids = keep(numbered(model.terms), "term-ids")
    small = model.n_bytes is not None and model.n_bytes <= BROADCAST_BYTES
    rows = weights.join(F.broadcast(ids) if small else ids, "term")
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("id", "weight"))).alias("v"))
    v = F.struct(
        F.lit(ids.count()).cast("int").alias("size"),
        F.transform("v", lambda x: x["id"]).alias("indices"),
        F.transform("v", lambda x: x["weight"]).alias("values"),
    )
    return rows.select(key, v.alias("features"))
