"""Empty tables, repeated rows, nulls, very long texts and ties, for every operator and every stage."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomtext.llm import mixing, quality, secrets_scan
from loomtext.llm.byte_bpe import round_trip
from loomtext.llm.token_counts import token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
CLASH = "rank int, score string, node int, fp string, part string, key int, kept string, candidate int, number int, hash string"
PROSE = "the river walked seven houses and a token = \"9b0b3c6a43eb78aa99cbd7049c572391524f37a8\" stayed "


def docs(spark, rows):
    """Documents with columns whose names the operators use inside."""
    df = spark.createDataFrame([(i, t, "en", None if i is None else f"s{i % 3}", 1) for i, t in rows], DOCS)
    return df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})


ROWS = [(1, PROSE), (1, PROSE), (2, None), (2, None), (None, PROSE), (None, ""), (3, " \t\n"), (4, PROSE * 40_000), (5, "x" * 3_000_000), (6, "é日 " * 1000)]


def quality_model(spark):
    rng = np.random.default_rng(2)
    word = lambda ws: " ".join(rng.choice(ws, 60))
    rows = [(i, word(["alpha", "beta", "Gamma,", "delta."]) if i % 2 else word(["ALPHA!!", "BETA", "##"])) for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    return docs(spark, rows), labels


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    model = quality.QualityModel(quality.index_vectors(), quality.fit_network(np.zeros((0, 134)), np.zeros(0)))
    for df in (token_counts(none), secrets_scan.scan_secrets(none), quality.score_quality(none, model), round_trip(none), mixing.mix_sources(none)):
        assert df.count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_empty_and_odd_tables(spark, tmp_path, name, stage):
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    none = docs(spark, []).limit(0)
    got = stage(spark, none, str(tmp_path))
    assert got.count() == 0 and (name == "encoding" or got.columns == none.columns)
    whole = docs(spark, ROWS)
    got = stage(spark, whole, str(tmp_path))
    kept = [r.doc_id for r in got.select("doc_id").collect()]
    if name == "encoding":
        assert len(kept) == len(ROWS)
        return
    assert got.columns == whole.columns and {str(i) for i in kept} <= {str(i) for i, _ in ROWS}
    if name == "exact":
        # The blank texts are equal, the prose of 1, 1 and null is; a longest original stays, then the smallest identifier.
        assert sorted(map(str, kept)) == ["1", "3", "4", "5", "6"]
    if name == "near":
        assert {"1", "4", "5", "6"} <= set(map(str, kept)) and len(kept) < len(ROWS)


def test_repeated_rows_and_long_texts_pass_through(spark):
    whole = docs(spark, ROWS)
    for df in (token_counts(whole), round_trip(whole), mixing.mix_sources(whole)):
        rows = df.collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in ROWS)
        same = [tuple(r)[1:] for r in rows if r.doc_id == 1]
        assert len(same) == 2 and same[0] == same[1]
    found = secrets_scan.scan_secrets(whole).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {1: 2, None: 1, 4: 40_000}


def test_equal_draws_go_together(spark):
    """Rows of one identifier and cell share their draw; a draw that equals the chance is not taken."""
    rows = [(i // 2, "word " * 5) for i in range(200)]
    got = {}
    for r in mixing.mix_sources(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.sampled, r.probability))
    assert all(len(x) == 1 for x in got.values()) and 20 < sum(next(iter(x))[0] for x in got.values()) < 80
    share = spark.createDataFrame([(7,)], "doc_id long").select(mixing.hash_share(42, F.col("doc_id")).alias("u")).first().u
    assert 0 <= share < 1


def test_topics_are_the_corpus_own_words(spark):
    texts = ["River river bank"] * 4 + ["market market bank"] * 5 + ["Ärger zu"] * 2 + [None, "bank " * 9, "river market"] + ["und"] * 16
    df = docs(spark, list(enumerate(texts)))
    words = mixing.topic_keywords(df, n=2)
    held = {}
    for t in texts:
        for w in {w for w in (t or "").lower().split() if re.fullmatch("[a-z]{4,}", w)}:
            held[w] = held.get(w, 0) + 1
    best = sorted((-n, w) for w, n in held.items() if n <= 0.3 * len(texts))[:2]
    assert words == [w for _, w in sorted((-n, w) for n, w in best)]
    assert words == ["river", "market"]
    got = {r.doc_id: r.topic for r in mixing.mix_sources(df, topic=mixing.topic_of(mixing.words_of(F.coalesce("text", F.lit(""))), words)).collect()}
    assert got[0] == "river" and got[4] == "market" and got[9] == "other" and got[11] == "other" and got[13] == "river"


def plain_tokens(text):
    """Rows of letters and shapes, word by word."""
    out = []
    for w in text.split():
        letters = "".join(c for c in w if not re.match(r"[\W\d_]", c)).lower()
        outline = re.sub(r"\d+", "9", re.sub("[A-ZÀ-ÖØ-Þ]+", "A", re.sub(r"[^\W\d_A-ZÀ-ÖØ-Þ]+", "a", w)))
        out.append((zlib.crc32(letters.encode()) % quality.LEXICAL, zlib.crc32(outline.encode()) % quality.SHAPES))
    return out


def test_quality_equals_a_plain_version(spark):
    whole, labels = quality_model(spark)
    model = quality.fit_quality(whole, labels)
    index, context = quality.index_vectors(), np.zeros((quality.LEXICAL + quality.SHAPES, quality.WIDTH))
    for r in whole.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 3 == 1:
            continue  # held out
        for at, base in ((0, 0), (1, quality.LEXICAL)):
            rows = [x[at] + base for x in plain_tokens(r.text)]
            for i, a in enumerate(rows):
                for j in range(max(0, i - quality.REACH), min(len(rows), i + quality.REACH + 1)):
                    if j != i:
                        context[a] += index[rows[j]]
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = index + np.where(norm > 0, context / np.where(norm > 0, norm, 1), 0)
    assert np.allclose(model.vectors, vectors, atol=1e-4)

    def plain_score(text):
        words, tokens = text.split(), plain_tokens(text)
        pooled = [np.mean([vectors[t[at] + base] for t in tokens], axis=0) if tokens else np.zeros(quality.WIDTH) for at, base in ((0, 0), (1, quality.LEXICAL))]
        n, lines = max(1, len(words)), text.split("\n")
        again = sum(a == b for a, b in zip(tokens, tokens[1:]))
        extras = [np.log1p(len(words)), len(set(words)) / n, again / n, len(text) / n if words else 0.0, len(set(lines)) / len(lines), float(not words)]
        x, net = np.concatenate([*pooled, extras]), model.network
        logit = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
        return 1 / (1 + np.exp(-np.clip(logit / net.temperature, -40, 40)))

    odd = [(i, t) for i, t in enumerate(["", None, "alpha beta", "ALPHA!! ##", "Ünï 12,5 x\ny", "word " * 100_000])]
    got = {r.doc_id: r.score for r in quality.score_quality(docs(spark, odd), model).collect()}
    for i, t in odd:
        assert got[i] == pytest.approx(plain_score(t or ""), abs=1e-3)
    test = quality.score_quality(whole, model).where("held_out").collect()
    assert len(test) > 20 and np.mean([r.predicted == r.doc_id % 2 for r in test]) > 0.95


def test_quality_of_the_tables_on_held_out_rows(spark):
    place = "/root/testdata/sf0.01"
    whole, labels = (spark.read.parquet(f"{place}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_quality(whole, quality.fit_quality(whole, labels)).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.predicted == r.quality for r in rows]) > 0.93
