"""Each private pattern on texts that hold it, and on ones that come near."""

from loomtext.functions.text import private_findings

CASES = [
    (r"see C:\Users\ana\notes.txt", ["home_path"]),
    ("in /home/ana/x and /USERS/b", ["home_path"]),
    ("/home/ alone", []),
    ("/content/drive/MyDrive/run1/a.csv", ["drive_path"]),
    (r"d:\mi unidad\x.csv", ["drive_path"]),
    ("/content/drive/Other/a.csv", []),
    ("ghp_" + "a1" * 12, ["access_token"]),
    ("GHP_" + "A1" * 12, []),
    ("hf_" + "b" * 24, []),
    ("hf_" + "b" * 25, ["access_token"]),
    ("github_pat_" + "c_" * 15, ["access_token"]),
    ("write to ana@example.org", ["email"]),
    ("ana@localhost", []),
    (None, []),
    ("", []),
]


def test_private_patterns(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, text string")
    got = {r.i: r.found for r in df.select("i", private_findings(df.text).alias("found")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]
