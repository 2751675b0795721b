from pyspark.sql import functions as F

from loomtext.llm import secrets_scan as S


def test_assigned_and_quoted_values(spark):
    texts = ["x password=hunter2abc y", 'pwd: "p@ss!wo rd#1" z', "secret = QwErTyUiOpLkJhGfDsAz.", "token: required", "plain text = nothing", "sha256: " + "ab12" * 10]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.candidate, r.kept) for r in S.scan_secrets(df).collect()}
    assert found[0] == ("hunter2abc", True)
    assert found[1] == ("p@ss!wo rd#1", True)
    assert found[2] == ("QwErTyUiOpLkJhGfDsAz", True)
    assert found[3] == ("required", False)
    assert 4 not in found and not found[5][1]


def test_dictionary_reaches_the_end_of_the_alphabet(spark):
    rows = spark.createDataFrame([("user-session-storage-template-2024",), ("a" * 300 + "bcdefgh",)], "candidate string")
    rows = S.with_features(rows.select("candidate", *(F.lit("").alias(c) for c in ("before", "after", "path"))))
    a, b = rows.select("f_dictionary", "f_distinct").collect()
    assert a.f_dictionary == 1.0
    assert b.f_distinct == 8 / 256
    df = spark.createDataFrame([(1, "the user-session-storage-template-2024 file")], "doc_id long, text string")
    assert [r.kept for r in S.scan_secrets(df).collect()] == [False]
