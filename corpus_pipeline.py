"""A corpus pipeline of five stages over ``documents``: quality, exact copies, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet to the shared folder and reads them again as the next one's documents. All but the last return
the columns of documents, extra ones too. A null text counts as empty everywhere, texts are read whole,
and an empty table gives an empty result; what else may be odd is told stage by stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm.byte_bpe import round_trip
from loomtext.llm.exact_dedup import drop_exact_duplicates
from loomtext.llm.mixing import sample_mixed
from loomtext.llm.quality import fit_quality, keep_good
from loomtext.llm.shared import forget, stash, table
from loomtext.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their own labelled rows, doesn't reject.

    Rows are judged one by one by their text, repeated ones and those without identifier as well; a score of
    exactly one half stays. Empty texts share a score. Without labels all score alike.
    """
    return keep_good(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts: the longest original, then the smallest identifier (null is the
    largest). Of rows that repeat identifier and text one stays. Empty texts are equal to each other."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest identifier, of every component of texts at a Jaccard similarity of 0.8 on five-word
    shingles; fingerprints find the pairs, the texts' whole sets verify them. A row without identifier stays only if its component has none; rows
    that repeat a staying identifier stay once for each text. Texts without words are alike."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, sampled towards the target shares of sources, languages and topics. Null sources and
    languages are a value of their own; rows that repeat an identifier share its draw, and a draw that equals
    the chance is not taken; a document of a cell without words never is."""
    return sample_mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its ids and the digests of ids and of decoded bytes; identifiers, null and repeated
    ones too, pass through, and an empty text has no ids."""
    return round_trip(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("encoding", encoding)]

#: The classifier and the similar texts' components are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)
        before = docs
    return docs
