"""Text functions as Columns: normalisation, multi-value cells, labels, stop words, fingerprints."""

from __future__ import annotations

import os
import re
import uuid
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path
from zipfile import ZipFile

import pandas as pd
import pyspark
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that mark a missing text, after folding and stripping of " .:;-_".
MISSING_MARKERS = (
    "no posee",
    "no se posee",
    "no posee resumen",
    "sin resumen",
    "sin abstract",
    "no disponible",
    "not available",
    "does not have",
)
#: Declared languages that say nothing.
NO_LANGUAGE = ("", "nan", "none", "other", "und")
#: Unicode's white space beside the plain space, and the four separators that it leaves out, as a class.
_ODD_SPACE = r"\t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Visible ASCII is told first in these classes: Java asks an odd class for every range that it has.
_ODD, _ANY = f"[[^!-~]&&[{_ODD_SPACE}]]", f"[[^!-~]&&[ {_ODD_SPACE}]]"
#: White space that isn't a single plain space already, so that common text has nothing to be replaced.
SPACE = f"{_ODD}{_ANY}*| {_ANY}+"
#: What stands between white space.
SPACED = f"[!-~[^ {_ODD_SPACE}]]+"
#: Words as runs of word characters; those of ASCII are told first, without a look at Unicode's properties.
WORD = "(?U)[0-9A-Z_a-z\\w]+"
#: Handles: digits, a slash, digits, wherever they come first.
HANDLE = "(?:/handle/|hdl\\.handle\\.net/)?([0-9]{1,6}/[0-9]+)"
#: Spark's stop-word lists by ISO 639-1 code.
STOPWORD_LISTS = {
    "da": "danish", "de": "german", "en": "english", "es": "spanish", "fi": "finnish", "fr": "french", "hu": "hungarian",
    "it": "italian", "nl": "dutch", "no": "norwegian", "pt": "portuguese", "ru": "russian", "sv": "swedish", "tr": "turkish",
}


def compatible(text: Column) -> Column:
    """NFKC. Text of ASCII characters alone is in that form and stays in the JVM's hands."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    beyond = F.when(~text.rlike("^\\p{ASCII}*$"), text)  # null, which costs the worker nothing, for all others
    return F.coalesce(nfkc(beyond), text)


def collapse_spaces(text: Column) -> Column:
    """White space becomes single spaces; none at either end; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "))


def normalize_spaces(text: Column, nfkc: bool = False) -> Column:
    """Collapsed white space, after NFKC if asked for (a pandas UDF for text beyond ASCII)."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    return collapse_spaces(compatible(value) if nfkc else value)


def normalize_text(text: Column, nfkc: bool = False) -> Column:
    """As normalize_spaces, with NUL as white space."""
    value = F.coalesce(text.cast("string"), F.lit(""))
    return collapse_spaces(F.replace(compatible(value) if nfkc else value, F.lit("\0"), F.lit(" ")))


def fold(text: Column) -> Column:
    """Lower case with ß as ss: case folding for the languages at hand."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def parse_handle(text: Column) -> Column:
    """The first digits/digits of a cell, or null."""
    return F.nullif(F.regexp_extract(collapse_spaces(text), HANDLE, 1), F.lit(""))


def strip_uri(text: Column) -> Column:
    """What stands before the first two colons."""
    return F.trim(F.substring_index(collapse_spaces(text), "::", 1))


def parse_multivalue(text: Column, separator: str = "||", uri: bool = False) -> Column:
    """Distinct values of a cell in their order, trimmed, without empty ones."""
    parts = F.split(collapse_spaces(text), F.lit("\\Q" + separator + "\\E"))

    def clean(x: Column) -> Column:
        return F.trim(F.substring_index(x, "::", 1) if uri else x)

    return F.array_distinct(F.filter(F.transform(parts, clean), lambda x: x != ""))


def is_missing_marker(text: Column) -> Column:
    return F.btrim(fold(collapse_spaces(text)), F.lit(" .:;-_")).isin(*MISSING_MARKERS)


def declared_suffix(column: str) -> str:
    """The language in brackets at a column name's end, else und."""
    if column.endswith("]") and "[" in column:
        return column.rsplit("[", 1)[1][:-1].lower() or "und"
    return "und"


def text_segments(cells: Sequence[tuple[str, Column]]) -> Column:
    """Struct(segments: array<struct<text, language>>, markers: int) from cells in column order.

    Absence markers are counted and left out; texts that fold alike stay once, with the first language.
    """
    kind = "array<struct<text:string,language:string,folded:string>>"

    def tagged(language: str):
        return lambda x: F.struct(x.alias("text"), F.lit(language).alias("language"), fold(x).alias("folded"))

    stacked = F.concat(*[F.transform(parse_multivalue(cell), tagged(declared_suffix(name))) for name, cell in cells])
    marked = F.filter(stacked, lambda x: is_missing_marker(x["text"]))
    real = F.filter(stacked, lambda x: ~is_missing_marker(x["text"]))
    once = F.aggregate(
        real,
        F.array().cast(kind),
        lambda kept, x: F.when(F.exists(kept, lambda y: y["folded"] == x["folded"]), kept).otherwise(F.concat(kept, F.array(x))),
    )
    segments = F.transform(once, lambda x: F.struct(x["text"].alias("text"), x["language"].alias("language")))
    return F.struct(segments.alias("segments"), F.size(marked).cast("long").alias("markers"))


def parse_labels(cells: Sequence[Column]) -> Column:
    """Sorted union of the cells' values without their URIs."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[parse_multivalue(c, uri=True) for c in cells]))))


def combine_cells(cells: Sequence[Column], uri: bool = False) -> Column:
    """Distinct values of all cells in their order, joined by a space."""
    return F.array_join(F.array_distinct(F.flatten(F.array(*[parse_multivalue(c, uri=uri) for c in cells]))), " ")


def one_language(languages: Column) -> Column:
    """One distinct language is itself, several are mul, none is und."""
    distinct = F.array_distinct(languages)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0))).when(F.size(distinct) > 1, "mul").otherwise("und")


def declared_language(cells: Sequence[Column]) -> Column:
    """Language of the declared codes of all cells, region parts left off."""
    code = lambda x: F.substring_index(F.lower(F.trim(x)), "-", 1)
    codes = F.flatten(F.array(*[F.transform(F.split(F.coalesce(c, F.lit("")), "\\|\\|"), code) for c in cells]))
    return one_language(F.filter(codes, lambda x: ~x.isin(*NO_LANGUAGE)))


def _mllib_jar() -> Path | None:
    """Spark's machine-learning library, under SPARK_HOME or above the place of PySpark, which may be a zip file."""
    home = os.environ.get("SPARK_HOME")
    places = [Path(home)] if home else []
    for folder in (*places, *Path(pyspark.__file__).parents):
        found = sorted(folder.glob("jars/spark-mllib_*.jar")) if folder.is_dir() else []
        if found:
            return found[0]
    return None


@lru_cache
def stopwords(language: str) -> tuple[str, ...]:
    """Folded stop words of a language, sorted; none for unknown languages and und. Needs no session: Spark's
    lists are read from its library file, and from the session only where that file is not found."""
    name = STOPWORD_LISTS.get(language or "")
    if not name:
        return ()
    library = _mllib_jar()
    if library:
        with ZipFile(library) as jar:
            words = jar.read(f"org/apache/spark/ml/feature/stopwords/{name}.txt").decode().split("\n")
    else:
        words = StopWordsRemover.loadDefaultStopWords(name)
    return tuple(sorted({w.strip().lower().replace("ß", "ss") for w in words} - {""}))


def remove_stopwords(text: Column, language: Column, languages: Sequence[str] = ("en", "es", "fr", "de", "pt")) -> Column:
    """Words that are no stop words, joined by a space; text of other languages stays as it is."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def outside(gone: tuple[str, ...]):
        return lambda w: ~fold(w).isin(*gone)

    result = None
    for lang in languages:
        kept = F.array_join(F.filter(words, outside(stopwords(lang))), " ")
        result = F.when(language == lang, kept) if result is None else result.when(language == lang, kept)
    return text if result is None else result.otherwise(text)


def preprocess(text: Column, language: Column, mode: str, nfkc: bool = False) -> Column:
    """raw, normalized or language_stopwords."""
    if mode == "raw":
        return F.coalesce(text.cast("string"), F.lit(""))
    if mode == "normalized":
        return normalize_text(text, nfkc)
    if mode == "language_stopwords":
        return remove_stopwords(normalize_text(text, nfkc), language)
    raise ValueError(f"unknown preprocessing mode: {mode}")


def fingerprint(text: Column, nfkc: bool = False) -> Column:
    """SHA-256 of the folded, normalised text."""
    return F.sha2(fold(normalize_spaces(text, nfkc)), 256)


def token_count(text: Column) -> Column:
    """Words between white space; none in a blank text."""
    words = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(SPACED), F.lit(0))
    return F.size(words).cast("long")


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was once read as Latin-1, read again; other text stays."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    odd = text.rlike("[ÃÂâ]") & text.rlike("^[\\x00-\\xff]*$")
    return F.when(odd & ~F.contains(again, F.lit("�")), again).otherwise(text)


def canonical_labels(exported: Sequence[str], canonical: Sequence[str]) -> list[str]:
    """The canonical labels, if the exported ones are these, or these with every character beyond ASCII lost.

    Exported labels may be UTF-8 that was read as Latin-1; number and order have to agree."""

    def forms(label: str) -> set[str]:
        lost = re.sub(r"[^\x00-\x7f]", "\ufffd", label)
        return {label, lost, label.encode().decode("latin-1")}

    odd = [i for i, (got, want) in enumerate(zip(exported, canonical, strict=False)) if got not in forms(want)]
    if odd or len(exported) != len(canonical):
        raise ValueError(f"{len(exported)} labels for {len(canonical)}, those at {odd} are others")
    return list(canonical)


#: Patterns of what a publishable text must not hold, whatever the case of the first two.
PRIVATE_CONTENT = (
    ("home_path", True, r"(?:[A-Za-z]:[\\/]+Users[\\/]+|/Users/|/home/)[^\s\"'<>]+"),
    ("drive_path", True, r"(?:/content/drive/(?:MyDrive|My Drive)/|[A-Za-z]:[\\/]+Mi unidad[\\/]+)[^\s\"'<>]+"),
    ("access_token", False, r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{30,}|hf_[A-Za-z0-9]{25,})\b"),
)
#: This engine's addition: addresses of persons.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"
#: Patterns by name, as Java and RE2 read them.
PRIVATE_PATTERNS = {name: f"(?i){pattern}" if any_case else pattern for name, any_case, pattern in PRIVATE_CONTENT} | {"email": EMAIL}


def private_findings(text: Column) -> Column:
    """Names of the private patterns that a text holds."""
    found = [F.when(text.rlike(p), F.lit(name)) for name, p in PRIVATE_PATTERNS.items()]
    return F.array_compact(F.array(*found))


def portable_hash(*parts: Column | str) -> Column:
    """48 bits of SHA-256 over the parts joined by |, as a long; the same in any SQL engine."""
    joined = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 12), 16, 10).cast("long")


def unit_hash(*parts: Column | str) -> Column:
    """portable_hash as a number in [0, 1)."""
    return portable_hash(*parts).cast("double") / F.lit(float(1 << 48))


def new_name() -> str:
    """A name that nothing else has."""
    return uuid.uuid4().hex
