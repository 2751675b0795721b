"""Small cases of the operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomtext.llm import mixing, pii, secrets_scan
from loomtext.llm.byte_bpe import ByteCodec, decode, encode, round_trip
from loomtext.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from loomtext.llm.quality import fit_quality, keep_good, score_quality
from loomtext.llm.simhash import drop_near_duplicates
from loomtext.llm.token_counts import WordCounter, token_counts
from loomtext.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, digest string, rank int"


def frame(spark, rows):
    """Documents with columns that clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "d", 7) for i, t in rows], DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (4, "ab"), (4, "ab"), (5, "a\x0b b "), (6, "é" * 50_000), (7, "other")]


def test_exact_dedup(spark):
    got = exact_dedup(frame(spark, ODD).repartition(5)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [by[i][0].keep_id for i in (1, 2, 3)] == [3, 3, 3] and by[3][0].kept
    assert by[4][0].group_size == 4 and {r.keep_id for r in by[4]} == {5} and by[None][0].keep_id == 5
    assert by[7][0].kept and by[6][0].group_size == 1
    assert by[2][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert sum(r.kept for r in got) == 4
    assert exact_dedup(frame(spark, ODD).limit(0)).count() == 0


@pytest.mark.parametrize("parts,ways,rounds", [(1, 2, 0), (4, 2, 2), (6, 2, 3), (7, 3, 2)])
def test_binomial_rounds_equal_brute_force(spark, monkeypatch, parts, ways, rounds):
    from loomtext.llm import exact_dedup as E

    strides = []
    plain_round = E.merge_round
    monkeypatch.setattr(E, "merge_round", lambda runs, stride, w: (strides.append(stride), plain_round(runs, stride, w))[1])
    random.seed(parts)
    rows = [(i, random.choice(["hot", " hot", "h ot  ", f"text {i % 5}", f"own{i}"])) for i in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(parts)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, ways=ways).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(t.replace(" ", ""), []).append((-len(t), i))
    want = {i: (min(g)[1], len(g), i == min(g)[1]) for g in groups.values() for _, i in g}
    assert got == want and strides == [ways**r for r in range(rounds)]


def test_drop_exact_duplicates_keeps_one_of_repeated_rows(spark):
    rows = [(1, "x"), (1, "x"), (2, "x"), (3, "y"), (None, "z"), (None, "z")]
    got = drop_exact_duplicates(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "None"]


def test_drop_near_duplicates(spark):
    rng = np.random.default_rng(1)
    long = " ".join(rng.choice([f"w{i}" for i in range(500)], 4000))
    got = drop_near_duplicates(frame(spark, [(5, long), (9, long + " end"), (6, "something else here"), (None, long + " last")]))
    assert sorted(r.doc_id for r in got.collect()) == [5, 6]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 12)).astype(np.float32)
    x[7] = x[9]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1001, [float("nan")] * 12), (1002, [None] * 12), (1003, [float("inf")] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    df = df.withColumns({"rank": F.lit(1), "score": F.lit("s"), "x": F.lit(0)})  # clashing names
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df.repartition(3), every=50, block=3, sample=64).collect()]
    q = np.floor(1024 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 400, 50):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(order)]
    assert sorted(got) == sorted(want)
    assert top_k(df.limit(0)).count() == 0


def test_top_k_bounds_prune_level_by_level(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 32))
    x = centres[rng.integers(0, 8, 1500)] + 0.15 * rng.normal(size=(1500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    left = {r.level: r.pairs for r in top_k(df, every=100, sample=300, survival=True).collect()}
    assert left[0] == 15 * 1499 and sorted(left) == [0, 1, 2, 3]
    assert left[1] >= left[2] >= left[3] and left[3] < 0.2 * left[0]


def test_rotation_keeps_products_and_bounds_hold():
    from loomtext.llm import topk as K

    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 7, 64):
        x = rng.normal(size=(60, width)) * rng.uniform(0.1, 5, width)
        turn = K.fitted_rotation(x)
        assert np.allclose(turn @ turn.T, np.eye(width))
        y = x @ turn
        for parts in K.resolutions(width):
            s = K.segment_statistics(y, parts)
            assert (s @ s.T + 1e-6 >= x @ x.T).all()


def test_top_k_of_few_and_huge_vectors(spark):
    df = spark.createDataFrame([(0, [1e6, 2.0]), (1, [2e6]), (1, [2e6]), (2, [])], "vec_id long, embedding array<double>")
    got = {(r.rank, r.vec_id, r.score) for r in top_k(df, k=3).collect()}
    assert got == {(1, 1, 1024 * 10**6 * 2048 * 10**6), (2, 1, 1024 * 10**6 * 2048 * 10**6), (3, 2, 0)}


RULES = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_pii_base_rules():
    random.seed(6)
    for _ in range(4000):
        alphabet = random.choice(["a.@1-", "1.2 ", "+1()-. 5", "@a.b_%", "12345 -", "é1.2@x", "0.255.300 "])
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 40)))
        want = sorted((m.start(), k, m.end()) for k, p in RULES.items() for m in re.finditer(p, text) if pii.valid(k, m.group()))
        assert pii.base_spans(text) == want
    assert pii.base_spans("a" * 200_000 + "@" * 500) == []


def test_pii_finds_what_base_rules_swallow(spark):
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "6011111111111117", "4222222222222220"]
    phones = [f"+1 (20{i}) 555-01{i}4" for i in range(5)]
    rows = [(i, f"pay {c} now call {p} soon") for i, (c, p) in enumerate(zip(cards, phones, strict=True))]
    hidden = "é x +1 (209) 555-0199 4111111111111111 end"
    df = frame(spark, [*rows, (9, hidden), (10, None), (None, "mail a.b@c.de"), (11, "1234 5678")])
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    assert got[9].n_card == got[9].n_phone == 0
    assert got[9].spans == "phone:4:21,card:22:38" and got[9].n_added == 2
    assert got[10].spans == "" and got[10].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[None].spans == "email:5:13" and got[11].spans == ""
    assert pii.find_personal_data(df.limit(0)).count() == 0


TRICKY = ["<|endoftext|>a <|startoftext|>", "Σσ İ éé ", "\x1c\x85 \xa0a", "'sS't", "日本 aaa---", "  \n\n x", "a" * 3000, "ab" * 500]


def test_token_counts(spark):
    random.seed(8)
    texts = TRICKY + ["".join(random.choice("abc 1é-.\n'") for _ in range(random.randint(0, 80))) for _ in range(300)]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert WordCounter(path).count(texts) == want
    got = {r.doc_id: r for r in token_counts(frame(spark, [(1, None), (2, "a " * 2049), (None, "é")])).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (0, 0, False)
    assert got[2].over_limit and got[None].n_bytes == 2


def test_byte_bpe(spark):
    random.seed(9)
    texts = TRICKY + ["".join(random.choice("aab \n\t=-é日🙂1'") for _ in range(random.randint(0, 60))) for _ in range(400)]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = ByteCodec(path, public_tokenizers.PATTERN)
    for text, (n, ids, data, split) in zip(texts, codec.digests(texts), strict=True):
        want = library.encode_ordinary(text)
        assert n == len(want) and codec.encode(text) == want and codec.decode(want) == text
        assert ids == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and data == hashlib.sha256(text.encode()).hexdigest()
        ends = np.cumsum([len(codec.bytes_of[i]) for i in want]).tolist()
        assert codec.encode_all([text])[0][1] == ends and split == sum(e not in np.cumsum([len(c.encode()) for c in text]) for e in ends)
    assert "�" in codec.decode(codec.encode("日")[:-1] or [codec.encode("é🙂")[-1]]) or len(codec.encode("日")) == 1
    df = frame(spark, [(1, "日本 x"), (2, None)])
    assert {r.doc_id: bytes(r.decoded) for r in decode(encode(df)).collect()} == {1: "日本 x".encode(), 2: b""}
    assert {r.doc_id: r.n_tokens for r in round_trip(df).collect()}[2] == 0


def test_secrets(spark):
    rows = [
        (1, 'x token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" y'),
        (2, "the order 4041894974608795 shipped"),
        (3, None),
        (4, "see commit 9b0b3c6a43eb78aa99cbd7049c572391524f37a8 there"),
        (5, "use password=7602ad27cf5550de1c now"),
    ]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in secrets_scan.scan_secrets(df).collect()}
    assert got[1].kept and got[5].kept and not got[2].kept and not got[4].kept and 3 not in got
    model = secrets_scan.fit_forest(secrets_scan.example_findings(spark, 3000))
    rest = secrets_scan.example_findings(spark, 4000).exceptAll(secrets_scan.example_findings(spark, 3000))
    from pyspark.ml.feature import VectorAssembler

    held = VectorAssembler(inputCols=secrets_scan.FEATURES, outputCol="features").transform(secrets_scan.with_features(rest))
    assert model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95
    masked = secrets_scan.redact(df, secrets_scan.scan_secrets(df)).where("doc_id = 1").first().text
    assert masked == 'x token = "[secret]" y'


def test_mixing_meets_targets(spark):
    cells = spark.createDataFrame([("a", "en", "p", 900), ("a", "fr", "p", 50), ("b", "en", "q", 40), ("b", "fr", "p", 10)], "source string, lang string, topic string, tokens long")
    half = {d: spark.createDataFrame([(v, 0.5) for v in vs], f"{d} string, target double") for d, vs in (("source", "ab"), ("lang", ["en", "fr"]))}
    raked = mixing.rake(cells, half, 1000.0, 40)
    for d in ("source", "lang"):
        assert all(abs(r[1] - 500) < 1 for r in raked.groupBy(d).agg(F.sum("weight")).collect())
    rows = raked.withColumn("rate", F.col("weight") / F.col("tokens"))
    scale = mixing.calibrated_scale(rows, 400.0)
    assert rows.agg(F.sum(F.least(F.lit(1.0), F.col("rate") * scale) * F.col("tokens"))).first()[0] == pytest.approx(400)
    df = spark.createDataFrame([(1, None, None, "x y", 3), (None, "s", "en", None, 4), (2, "s", "en", "a b c", 5)], "doc_id long, source string, lang string, text string, topic int")
    got = mixing.mix_sources(df).collect()
    assert {r.n_tokens for r in got} == {2, 0, 3}
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_quality(spark):
    random.seed(3)
    good = lambda: " ".join(random.choice(["alpha", "beta", "gamma", "delta"]) + random.choice(["", ",", "."]) for _ in range(60))
    bad = lambda: " ".join(random.choice(["ALPHA", "BETA", "ZZ"]) + "!!" for _ in range(60))
    rows = [(i, good() if i % 2 else bad()) for i in range(240)]
    docs = frame(spark, [*rows, (900, None), (None, "")])
    truth = spark.createDataFrame([(i, i % 2) for i in range(240)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = fit_quality(docs, truth)
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    held = [r for i, r in got.items() if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == r.doc_id % 2 for r in held if r.doc_id < 240]) > 0.95
    assert got[900].score == got[None].score and not got[None].held_out
    assert set(keep_good(docs, model).columns) == set(docs.columns)
    assert 0 < fit_quality(docs, truth.limit(0)).scores(["x"])[0] < 1
