"""Item table: raw metadata rows to one row per handle, text budgets, mapping joins, content groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def discover_columns(columns: Sequence[str]) -> dict[str, list[str]]:
    """Columns of abstracts, keywords and addresses, by their names."""
    low = [(c, c.lower()) for c in columns]
    return {
        "abstract": [c for c, x in low if "abstract" in x],
        "keywords": [c for c, x in low if "dc.subject" in x],
        "uri": [c for c, x in low if "identifier.uri" in x or x == "handle" or x.endswith(".uri")],
    }


def resolve_columns(df: DataFrame, configured: str | Sequence[str] | None, kind: str) -> list[str]:
    if configured is None or configured == "auto":
        return discover_columns(df.columns)[kind]
    return [c for c in configured if c in df.columns]


def cell(name: str) -> Column:
    return F.col(f"`{name}`")


def metadata_rows(
    metadata: DataFrame,
    target_columns: Sequence[str],
    abstract_columns: str | Sequence[str] | None = "auto",
    keyword_columns: str | Sequence[str] | None = "auto",
    handle_column: str = "handle",
    max_fulltext_chars: int = 100_000,
) -> DataFrame:
    """Row-wise parsing: handle, segments, markers, declared languages, keywords, full text, labels, row_no."""
    abstracts = resolve_columns(metadata, abstract_columns, "abstract")
    keywords = resolve_columns(metadata, keyword_columns, "keywords")
    targets = [c for c in target_columns if c in metadata.columns]
    languages = [c for c in metadata.columns if c.startswith("dc.language") or c == "sedici2003.idioma[es]"]
    if handle_column in metadata.columns:
        handle = T.parse_handle(cell(handle_column))
    else:
        uris = discover_columns(metadata.columns)["uri"]
        handle = T.parse_handle(F.concat_ws(" ", *[cell(c) for c in uris])) if uris else F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    full = F.substring(F.coalesce(cell("fulltext"), F.lit("")), 1, max_fulltext_chars) if "fulltext" in metadata.columns else F.lit("")
    parts = (
        T.text_segments([(c, cell(c)) for c in abstracts])
        if abstracts
        else F.struct(F.array().cast("array<struct<text:string,language:string>>").alias("segments"), F.lit(0).cast("long").alias("markers"))
    )
    return (
        metadata.withColumn("row_no", F.monotonically_increasing_id())
        .select(
            "row_no",
            handle.alias("handle"),
            parts.alias("parts"),
            (T.declared_language([cell(c) for c in languages]) if languages else F.lit("und")).alias("fulltext_declared_language"),
            (T.combine_cells([cell(c) for c in keywords], uri=True) if keywords else F.lit("")).alias("keywords"),
            full.alias("fulltext"),
            (F.length(F.coalesce(cell("fulltext"), F.lit(""))).cast("long") if "fulltext" in metadata.columns else F.lit(0).cast("long")).alias("fulltext_characters"),
            (T.parse_labels([cell(c) for c in targets]) if targets else none).alias("labels"),
        )
        .select("*", F.col("parts.segments").alias("segments"), F.col("parts.markers").alias("abstract_missing_markers"))
        .drop("parts")
    )


def roll_up_items(rows: DataFrame, max_fulltext_chars: int = 100_000) -> DataFrame:
    """One row per handle from metadata_rows: rows without handle or labels go, the others merge in row order."""
    ordered = F.array_sort(
        F.collect_list(F.struct("row_no", "segments", "keywords", "fulltext", "fulltext_declared_language", "labels", "fulltext_characters"))
    )
    grouped = (
        rows.where(F.col("handle").isNotNull() & (F.size("labels") > 0))
        .groupBy("handle")
        .agg(ordered.alias("r"), F.sum("abstract_missing_markers").alias("abstract_missing_markers"))
    )
    each = lambda name: F.transform("r", lambda x: x[name])
    records = F.array_distinct(F.flatten(each("segments")))
    texts = F.filter(each("fulltext"), lambda x: x != "")
    languages = F.array_distinct(each("fulltext_declared_language"))
    units = F.array_distinct(F.filter(each("fulltext"), lambda x: F.trim(x) != ""))
    # Characters before any cut, with the two line ends between texts.
    long = F.filter(each("fulltext_characters"), lambda n: n > 0)
    characters = F.aggregate(long, F.lit(0).cast("long"), lambda a, n: a + n) + F.greatest(F.size(long) - 1, F.lit(0)) * 2
    return (
        grouped.withColumns({"records": records})
        .select(
            "handle",
            F.array_join(F.transform("records", lambda x: x["text"]), "\n\n").alias("abstract"),
            F.transform("records", lambda x: x["text"]).alias("abstract_segments"),
            F.transform("records", lambda x: x["language"]).alias("abstract_segment_declared_languages"),
            "abstract_missing_markers",
            T.one_language(F.transform("records", lambda x: x["language"])).alias("abstract_declared_language"),
            F.when(F.size(languages) == 1, F.get(languages, F.lit(0))).otherwise("mul").alias("fulltext_declared_language"),
            F.array_join(F.array_distinct(F.filter(each("keywords"), lambda x: x != "")), " ").alias("keywords"),
            F.substring(F.array_join(texts, "\n\n"), 1, max_fulltext_chars).alias("fulltext"),
            characters.alias("fulltext_source_characters"),
            units.alias("fulltext_documents"),
            F.when(F.size(units) > 0, F.array(F.lit("inline:0"))).otherwise(F.array().cast("array<string>")).alias("fulltext_source_ids"),
            F.array_sort(F.array_distinct(F.flatten(each("labels")))).alias("labels"),
        )
    )


def construct_items(metadata: DataFrame, target_columns: Sequence[str], **settings) -> tuple[DataFrame, DataFrame]:
    """The item table and the report on the target columns."""
    limit = settings.get("max_fulltext_chars", 100_000)
    return roll_up_items(metadata_rows(metadata, target_columns, **settings), limit), target_schema_report(metadata, target_columns)


def target_schema_report(metadata: DataFrame, target_columns: Sequence[str]) -> DataFrame:
    """Rows that hold each label, by source column; columns that don't exist are skipped."""
    found = [c for c in target_columns if c in metadata.columns]
    if not found:
        return metadata.sparkSession.createDataFrame([], "label string, source_field string, support long")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("source_field"), T.parse_multivalue(cell(c), uri=True).alias("labels")) for c in found]))
    rows = metadata.select(cells.alias("x")).select("x.source_field", F.explode("x.labels").alias("label"))
    return rows.groupBy("label", "source_field").agg(F.count("*").alias("support"))


def budget_units(units: DataFrame, max_chars: int, key: str = "handle", order: str | Sequence[str] = "pos", text: str = "text") -> DataFrame:
    """A fair character budget per item: each unit's retained length, by water-filling.

    Adds source_chars, retained_chars and retained text. Blank units go. Level: the largest length that
    every unit may have within the budget; what remains goes to the first units that are longer, one
    character each. Windows are over one item's units.
    """
    order = [order] if isinstance(order, str) else list(order)
    blank = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), T.SPACE, " ")) == ""
    n, level = F.col("_n"), F.col("_level")
    item = Window.partitionBy(key)
    up = item.orderBy("_n", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = units.where(~blank).withColumn("_n", F.length(text).cast("long"))
    seen = seen.withColumns(
        {
            "_total": F.sum("_n").over(item),
            "_count": F.count("*").over(item),
            "_filled": F.sum("_n").over(up) - n,
            "_before": F.count("*").over(up) - 1,
        }
    )
    # With the shorter units whole, the rest share what is left; the level is where a unit first no longer fits.
    seen = seen.withColumn("_share", F.floor((F.lit(max_chars) - F.col("_filled")) / (F.col("_count") - F.col("_before"))))
    whole = F.col("_total") <= max_chars
    over = F.greatest(F.max(F.when(n > F.col("_share"), F.col("_share"))).over(item), F.lit(0))
    seen = seen.withColumn("_level", F.when(whole, F.lit(1 << 62)).otherwise(over)).withColumn("_base", F.least(n, level))
    so_far = item.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = seen.withColumns(
        {
            "_rest": F.when(whole, F.lit(0)).otherwise(F.lit(max_chars) - F.sum("_base").over(item)),
            "_turn": F.sum((n > level).cast("long")).over(so_far),
        }
    )
    kept = F.col("_base") + F.when((n > level) & (F.col("_turn") <= F.col("_rest")), 1).otherwise(0)
    return seen.select(
        *units.columns,
        n.alias("source_chars"),
        kept.cast("long").alias("retained_chars"),
        F.substring(F.col(text), F.lit(1), kept.cast("int")).alias("retained"),
    )


def budgeted_fulltext(units: DataFrame, max_chars: int, key: str = "handle", order: str = "pos", text: str = "text", source: str | None = None) -> DataFrame:
    """One row per item: fulltext_documents, fulltext_source_ids, fulltext, its characters and whether any were cut."""
    rows = budget_units(units, max_chars, key, order, text)
    name = F.col(source) if source else F.lit(None).cast("string")
    got = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col("retained"), name.alias("source")))).alias("r"),
        F.sum("source_chars").alias("fulltext_source_characters"),
        F.sum("retained_chars").alias("kept"),
    )
    ids = F.transform("r", lambda x, i: x["source"]) if source else F.transform("r", lambda x, i: F.concat(F.lit("parquet:"), i.cast("string")))
    return got.select(
        key,
        F.transform("r", lambda x: x["retained"]).alias("fulltext_documents"),
        ids.alias("fulltext_source_ids"),
        F.array_join(F.transform("r", lambda x: x["retained"]), "\n\n").alias("fulltext"),
        "fulltext_source_characters",
        (F.col("kept") < F.col("fulltext_source_characters")).alias("fulltext_truncated"),
    )


def map_files(files: DataFrame, mapping: DataFrame, id_column: str = "internal_id", handle_column: str = "handle", order: str | None = None) -> DataFrame:
    """Files with the handle of the first mapping row of their identifier, or null."""
    missing = {id_column, handle_column} - set(mapping.columns)
    if missing:
        raise ValueError(f"the mapping lacks {sorted(missing)}")
    clean = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    rank = F.col(order) if order else F.monotonically_increasing_id()
    first = (
        mapping.select(clean(id_column).alias("file_id"), T.parse_handle(F.col(handle_column)).alias("handle"), rank.alias("at"))
        .groupBy("file_id")
        .agg(F.min_by("handle", "at").alias("handle"))
    )
    return files.withColumn("file_id", clean("file_id")).join(first, "file_id", "left")


def mapping_coverage(mapped: DataFrame) -> DataFrame:
    total, held = F.count("*"), F.count("handle")
    return mapped.agg(
        total.alias("txt_files_total"),
        held.alias("mapped_txt_files"),
        F.count_distinct("handle").alias("handles_with_txt"),
        F.coalesce(F.try_divide(F.lit(100.0) * held, total), F.lit(0.0)).alias("coverage_percentage"),
    )


def content_groups(items: DataFrame, text: str = "fulltext", nfkc: bool = False) -> DataFrame:
    return items.withColumn("content_group", T.fingerprint(F.col(text), nfkc))


def duplicate_groups(items: DataFrame, key: str = "handle") -> DataFrame:
    """Content groups of several items: their number and their first key. No group is gathered."""
    groups = items.groupBy("content_group").agg(F.count("*").alias("n"), F.min(key).alias("first_key"))
    return groups.where("n > 1")


def duplicate_members(items: DataFrame, key: str = "handle") -> DataFrame:
    """One row per item of a content group of several: content_group, n and the item's key."""
    groups = duplicate_groups(items, key).select("content_group", "n")
    return items.select("content_group", key).join(groups, "content_group")


def fulltext_coverage(items: DataFrame) -> DataFrame:
    """Documents, their characters before and after the budget, the percentage that is represented, and how many were cut.

    Reads fulltext, and fulltext_source_characters and fulltext_truncated where they are there.
    """
    kept = F.length(F.coalesce("fulltext", F.lit(""))).cast("long")
    source = F.col("fulltext_source_characters") if "fulltext_source_characters" in items.columns else kept
    cut = F.col("fulltext_truncated") if "fulltext_truncated" in items.columns else source > kept
    return items.agg(
        F.count("*").alias("documents"),
        F.sum(source).alias("source_characters"),
        F.sum(kept).alias("represented_characters"),
        F.try_divide(F.lit(100.0) * F.sum(kept), F.sum(source)).alias("represented_percentage"),
        F.sum(cut.cast("long")).alias("truncated"),
    )


def text_unit_statistics(items: DataFrame) -> DataFrame:
    """Items, abstract segments and full-text files, and items without or with several of them (array columns)."""
    a, f = (F.coalesce(F.size(c), F.lit(0)) for c in ("abstract_segments", "fulltext_documents"))
    n = lambda c: F.sum(c.cast("long"))
    return items.agg(
        F.count("*").alias("n_items"),
        n(a).alias("n_abstract_segments"),
        n(f).alias("n_fulltext_files"),
        n(a <= 0).alias("items_without_abstract"),
        n(a > 1).alias("items_with_multiple_abstracts"),
        n(f > 1).alias("items_with_multiple_fulltexts"),
    )
