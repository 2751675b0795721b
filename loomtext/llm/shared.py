"""What the operators share: reading tables, the shared folder, stashed tables, skew-free lookups."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/loomtext/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and rows are computed once."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a stashed table that nothing will read again."""
    spark = df.sparkSession
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, label: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """A narrow table, stashed and measured: to be broadcast up to ``most`` bytes, else to be merged."""
    held = stash(df, label)
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8)) + 8 for c, t in df.dtypes)
    size = held.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(held) if size <= most else held.hint("merge")


def one_column(df: DataFrame) -> DataFrame:
    """The rows as one struct column ``row``, so that a caller's columns can't clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def own_columns(rows: DataFrame, df: DataFrame) -> DataFrame:
    """The columns of ``df`` out of ``row``."""
    return rows.select(*[F.col("row")[c].alias(c) for c in df.columns])


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def spread_lookup(rows: DataFrame, found: DataFrame, keys: list[str], part: str) -> DataFrame:
    """Left join of ``rows`` with ``found`` (one row a key), without a hot key meeting in one task.

    ``part`` is the input partition that a row came from, fixed in a stashed table. First the distinct
    (part, key) pairs learn the answer: a key has one such pair a partition at most. Then rows join on
    (part, key), which deals a hot key's rows out as the input did.
    """
    pairs = rows.groupBy(part, *keys).agg(F.lit(1).alias("_one")).drop("_one")
    return rows.join(pairs.join(found, keys), [part, *keys], "left")


def pieces(data: bytes, most: int) -> Iterator[bytes]:
    """Cuts a text's bytes after ASCII white space into pieces of about ``most`` bytes; no word is cut."""
    start, end = 0, len(data)
    while end - start > most:
        cut = start + most
        while cut < end and data[cut] not in b" \t\n\x0b\x0c\r":
            cut += 1
        yield data[start:cut]
        start = cut
    yield data[start:]
