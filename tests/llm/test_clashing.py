"""Every name that the operators use inside as an extra column: rows and their values stay as they are."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import loomtext.llm
from loomtext.llm import exact_dedup, mixing, secrets_scan, simhash

HOME = Path(loomtext.llm.__file__).parent
#: Whatever stands in quotes in the operators' code and looks like a name, the former internal names too.
NAMES = sorted(
    {n for f in ("exact_dedup", "simhash", "mixing", "secrets_scan", "shared") for n in re.findall(r'"([A-Za-z_][A-Za-z0-9_]*)"', (HOME / f"{f}.py").read_text())}
    | {"_gone", "_stays", "_id", "_p", "_words", "_salt", "_source", "_topic", "_lang", "row_", "Row", "own_id"}
)
OWN = ["doc_id", "text", "source", "lang"]
EXTRA = [n for n in {n.lower(): n for n in NAMES}.values() if n.lower() not in OWN]


def docs(spark):
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, "one two three four five six", "s", "en"), (2, "one two three four five six ", "s", "en"), (3, f'token = "{key}" ok', "t", "de")]
    rows += [(4, "one two three four five six", "s", "en"), (4, "seven eight nine ten words here now", "s", "en"), (4, "seven eight nine ten words here now", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    return df.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in EXTRA])


def redacted(df):
    return secrets_scan.redact(df, secrets_scan.scan_secrets(df.select("doc_id", "text", "source"), least=0.0))


@pytest.mark.parametrize("f", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, lambda d: mixing.sample_mixed(d, keep=1.0), redacted])
def test_columns_of_any_name_stay(spark, f):
    whole = docs(spark)
    got = f(whole)
    assert got.columns == whole.columns and len(EXTRA) > 100
    rows = [r.asDict() for r in got.collect()]
    assert rows
    for r in rows:
        assert all(r[n] == f"{n}:{r['doc_id']}" for n in EXTRA)
    plain = f(whole.select(*OWN)).collect()
    assert sorted(tuple(r[c] for c in OWN) for r in rows) == sorted(tuple(r) for r in plain)
