"""Where the vocabulary files of public tokenizers are, and how text batches reach the workers."""

from __future__ import annotations

from pyspark.sql import SparkSession


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed ``public_tokenizers``."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Arrow batches hold at most ``rows`` rows in this session: texts are long, workers are small.

    Spark bounds a batch's bytes as well, by spark.sql.execution.arrow.maxBytesPerBatch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(key, "10000"))
    if held <= 0 or held > rows:
        spark.conf.set(key, str(rows))


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]
