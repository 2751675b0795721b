"""Pinned small cases of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import classify, dense, items, labels, language, scores, vectorize
from loomtext.sources import config, readers, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


def test_spaces_labels_and_handles(spark):
    assert one(spark, "  Café   investigación ", T.normalize_spaces) == "Café investigación"
    assert one(spark, "ﬁn x", lambda c: T.normalize_text(c, nfkc=True)) == "fin x"
    assert one(spark, None, T.normalize_text) == ""
    assert one(spark, "Violencia::uri|| Educación ||Violencia", lambda c: T.parse_labels([c])) == ["Educación", "Violencia"]
    assert one(spark, "http://x/handle/10915/10 y", T.parse_handle) == "10915/10"
    assert one(spark, "none", T.parse_handle) is None
    assert one(spark, "a||b||a|| ", T.parse_multivalue) == ["a", "b"]
    assert one(spark, " No  posee. ", T.is_missing_marker)
    assert one(spark, "niÃ±o", T.repair_mojibake) == "niño"


def test_stopwords(spark):
    keep = lambda lang: (lambda c: T.remove_stopwords(c, F.lit(lang)))
    assert one(spark, "the study of method", keep("en")) == "study method"
    assert one(spark, "the study, of", keep("und")) == "the study, of"
    with pytest.raises(ValueError):
        T.preprocess(F.lit("a"), F.lit("en"), "other")


def test_metadata_languages_and_markers(spark):
    rows = [("10915/1", "Uno||No posee||The same", "es", "A::u"), ("10915/1", "Dos", "pt", "B"), (None, "x", "es", "A"), ("10915/2", "y", "es", "")]
    df = spark.createDataFrame(rows, "handle string, `dc.description.abstract[es]` string, `dc.language[es]` string, `dc.subject.materia[es]` string")
    parsed = items.metadata_rows(df, ["dc.subject.materia[es]"], keyword_columns=[])
    got = items.roll_up_items(parsed).collect()
    assert [r.handle for r in got] == ["10915/1"]
    assert got[0].abstract_segments == ["Uno", "The same", "Dos"] and got[0].abstract_missing_markers == 1
    assert got[0].abstract_declared_language == "es" and got[0].fulltext_declared_language == "mul"
    assert got[0].labels == ["A", "B"]


def budget_by_rounds(lengths, most):
    """The same rule as rounds of equal shares."""
    if sum(lengths) <= most:
        return lengths
    given, rest = [0] * len(lengths), most
    while rest:
        hungry = [i for i, n in enumerate(lengths) if given[i] < n]
        share = max(1, rest // len(hungry))
        for i in hungry:
            take = min(share, lengths[i] - given[i], rest)
            given[i], rest = given[i] + take, rest - take
    return given


def test_budget_equals_rounds(spark):
    random.seed(4)
    cases = [[100, 100]] + [[random.randint(1, 60) for _ in range(random.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(k, i, "x" * n) for k, c in enumerate(cases) for i, n in enumerate(c)], "handle int, pos int, text string")
    got = {(r.handle, r.pos): r.retained_chars for r in items.budget_units(df, 80).collect()}
    assert [got[0, 0], got[0, 1]] == [40, 40]
    for k, c in enumerate(cases):
        assert [got[k, i] for i in range(len(c))] == budget_by_rounds(c, 80)


def test_files_to_handles(spark):
    files = spark.createDataFrame([("1", "p"), ("2", "q")], "file_id string, txt_path string")
    mapping = spark.createDataFrame([("1 ", "hdl.handle.net/10915/10", 0), ("1", "10915/99", 1)], "internal_id string, handle string, n int")
    mapped = items.map_files(files, mapping, order="n")
    assert {r.file_id: r.handle for r in mapped.collect()} == {"1": "10915/10", "2": None}
    assert items.mapping_coverage(mapped).first().mapped_txt_files == 1
    with pytest.raises(ValueError):
        items.map_files(files, mapping.drop("handle"))


def test_language(spark):
    detect = lambda x: one(spark, x, language.heuristic)["language"]
    assert detect("The research and the study of methods for education") == "en"
    assert detect("AI") == "und" and detect(None) == "und" and detect("zzzzzzzzzzzzzzz qqqq") == "und"
    units = spark.createDataFrame([("a", 0, "x" * 30, "en", 0.5), ("a", 1, "y" * 30, "es", 0.7), ("b", 0, "z" * 9, "und", None)], "handle string, pos int, text string, language string, score double")
    got = {r.handle: r for r in language.aggregate_languages(units).collect()}
    assert got["a"].detected_language == "mul" and got["a"].language_set == ["en", "es"] and got["a"].language_score is None
    assert got["b"].detected_language == "und"
    with pytest.raises(ValueError):
        language.create_detector("none")


def test_bm25_by_hand(spark):
    counts = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "b", 1), (1, "c", 3), (2, "a", 1)], "handle int, term string, tf int")
    model = vectorize.fit("bm25", counts, 3, None)
    assert model.average_length == pytest.approx(8 / 3)
    import math

    idf = math.log((3 - 2 + 0.5) / 2.5 + 1)
    want = 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (8 / 3))) * idf
    got = {(r.handle, r.term): r.weight for r in model.transform(counts).collect()}
    assert got[0, "a"] == pytest.approx(want)
    with pytest.raises(ValueError):
        vectorize.fit("other", counts, 3)


def label_rows(spark, n=80):
    rows = [(f"h{i}", ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["a", "b"], f"g{i // 2 if i < 20 else i + 100}") for i in range(n)]
    return spark.createDataFrame(rows, "handle string, labels array<string>, content_group string")


def test_splits_cover_and_respect_groups(spark):
    df = label_rows(spark)
    got, _ = labels.split_items(df, {"train": 0.6, "validation": 0.2, "test": 0.2}, group_column="content_group")
    rows = got.collect()
    assert len(rows) == 80
    groups = {}
    for r in rows:
        assert groups.setdefault(r.content_group, r.split) == r.split
    assert all(r.present_in_all_splits for r in labels.coverage(got).collect())
    again = labels.restore_split(df.orderBy(F.desc("handle")), got.select("handle", "split"))
    assert labels.split_fingerprint(again) == labels.split_fingerprint(got)
    with pytest.raises(ValueError):
        labels.restore_split(df.limit(3), got.select("handle", "split"))


def test_metrics(spark):
    rows = [(0, "x", 1, 0.9), (0, "y", 0, 0.2), (0, "z", 0, 0.1), (1, "x", 1, 0.7), (1, "y", 1, 0.6), (1, "z", 0, 0.65)]
    df = spark.createDataFrame(rows, "handle int, label string, y int, score double")
    at = scores.at_k(df, (1,)).first()
    assert (at.precision_at_1, at.recall_at_1) == (1.0, 0.75)
    ap = {r.label: r.average_precision for r in scores.average_precision(df).collect()}
    assert ap["x"] == 1.0 and "z" not in ap
    m = scores.multilabel_metrics(scores.apply_thresholds(df, 0.5)).first()
    assert m.subset_accuracy == 0.5 and m.hamming_loss == pytest.approx(1 / 6) and m.f1_micro == pytest.approx(6 / 7)
    better = scores.paired_bootstrap(scores.apply_thresholds(df, 0.95), scores.apply_thresholds(df, 0.5), replicates=20).collect()
    assert all(r.difference_candidate_minus_global > 0 for r in better)


def test_chunks_and_pooling(spark):
    df = spark.createDataFrame([(list(range(10)),), ([],)], "a array<int>")
    got = [r.c for r in df.select(dense.chunk_tokens(F.col("a"), 4, 1).alias("c")).collect()]
    assert got == [[[0, 1, 2, 3], [3, 4, 5, 6], [6, 7, 8, 9], [9]], [[]]]
    v = spark.createDataFrame([("k", [1.0, 3.0], 1), ("k", [3.0, 1.0], 3)], "k string, vector array<double>, w int")
    assert dense.pool(v, ["k"], "mean").first().vector == [2.0, 2.0]
    assert dense.pool(v, ["k"], "weighted_mean", weight="w").first().vector == [2.5, 1.5]
    assert dense.pool(v, ["k"], "max").first().vector == [3.0, 3.0]
    with pytest.raises(ValueError):
        dense.pool(v, ["k"], "sum")


def test_early_stopping(spark):
    df = spark.createDataFrame([("r", 0, 0.5), ("r", 1, 0.501), ("r", 2, 0.49)], "run string, epoch int, metric double")
    got = sorted(dense.early_stopping(df, 0.002, 2).collect(), key=lambda r: r.epoch)
    assert [r.stop for r in got] == [False, False, True]


def test_grid_and_families(spark):
    assert len(classify.grid()) == 231
    df = spark.createDataFrame([("raw", "bm25"), ("transformer", "sbert:x"), ("transformer_finetuned", "labse_finetuned")], "preprocessing string, representation string")
    assert [r.f for r in df.select(classify.family().alias("f")).collect()] == ["bm25", "sbert_frozen", "labse_finetuned"]
    with pytest.raises(ValueError):
        classify.create_classifier("tree")


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("experiment: {name: x}\ndata: {target_columns: [t]}\nsplit: {}\nfeatures: {}\nrepresentations: {a: 1, b: {c: 2}}\nclassifiers: {}\n")
    (tmp_path / "b.yaml").write_text("extends: a.yaml\nrepresentations: {b: {d: 3}}\n")
    assert config.load(tmp_path / "b.yaml")["representations"] == {"a": 1, "b": {"c": 2, "d": 3}}
    (tmp_path / "c.yaml").write_text("extends: a.yaml\nsplit: {test_size: 0.9}\n")
    with pytest.raises(ValueError):
        config.load(tmp_path / "c.yaml")


class FakeStore:
    tree = {"root": [{"id": "f", "name": "corpus", "folder": True}], "f": [{"id": "1", "name": "10.txt"}, {"id": "g", "name": "sub", "folder": True}], "g": [{"id": "2", "name": "11.TXT"}, {"id": "3", "name": "x.pdf"}]}

    def children(self, folder_id):
        return self.tree[folder_id]

    def download(self, file_id):
        return b"caf\xe9 text"


def test_store(spark):
    assert readers.resolve_folder(FakeStore(), "/content/drive/MyDrive/corpus") == "f"
    with pytest.raises(ValueError):
        readers.drive_path("/somewhere/else")
    assert [r.file_id for r in readers.store_index(spark, FakeStore(), "MyDrive/corpus").orderBy("file_id").collect()] == ["10", "11"]
    assert readers.download_text(FakeStore(), "1") == "caf� text"


def test_text_files_and_cache(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_bytes(b"one \xff")
    (tmp_path / "t" / "2.txt").write_text("two")
    index = readers.txt_index(spark, str(tmp_path / "t"))
    mapped = index.withColumn("handle", F.concat(F.lit("10915/"), "file_id"))
    got = {r.handle: r.fulltext for r in readers.read_txt(spark, mapped, mapped.select("handle"), str(tmp_path / "t")).collect()}
    assert got == {"10915/1": "one �", "10915/2": "two"}
    asked = []

    def read(missing):
        asked.append(missing.count())
        return missing.withColumn("fulltext", F.lit("t"))

    path = str(tmp_path / "cache")
    frame = lambda *h: spark.createDataFrame([(x,) for x in h], "handle string")
    readers.materialised_fulltext(spark, path, frame("a"), read)
    assert readers.materialised_fulltext(spark, path, frame("a", "b"), read).count() == 2 and asked == [1, 1]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/out"
    sinks.write_parquet(df, path)
    sinks.write_parquet(df, path)
    assert spark.read.parquet(path).count() == 2
    assert sinks.order_free_digest(df) == sinks.order_free_digest(df.orderBy(F.desc("k")).select("v", "k"))
    folder = sinks.run_folder(tmp_path / "runs", "x")
    assert sinks.run_folder(tmp_path / "runs", "x", resume=True) == folder
    sinks.mark(folder, "_SUCCESS")
    assert sinks.run_folder(tmp_path / "runs", "x", resume=True) != folder


def test_stream(spark, tmp_path):
    from loomtext.streaming.ingest import ingest

    spark.createDataFrame([("a", "x"), ("b", " ")], "handle string, text string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_library_detectors_in_rows_and_windows(spark):
    """A pandas UDF may not stand in a lambda: arrays of texts go to the worker as they are."""
    from loomtext.operators import language

    fake = language.LibraryDetector(lambda t: ("es" if "el" in t else "en", 0.5 if "el" in t else 0.25))
    df = spark.createDataFrame([(1, ["el a", " ", "of b"], "el " * 40 + "xx" * 200), (2, None, "of"), (3, [], None)], "k int, parts array<string>, text string")
    got = {r.k: r for r in df.withColumn("d", fake.each(F.col("parts"))).collect()}
    assert [(d.language, d.score) for d in got[1].d] == [("es", 0.5), ("und", None), ("en", 0.25)] and got[2].d is None and got[3].d == []
    seen = {r.k: (r.language, r.score) for r in language.detect_distributed(df, fake, width=100, count=5).collect()}
    assert seen == {1: ("en", 0.25), 2: ("en", 0.25), 3: ("und", None)}
    native = language.create_detector()
    assert {r.k: r.language for r in language.detect_distributed(df, native, width=100).collect()}[3] == "und"
    key = df.select("k", language.detect_keywords(F.col("text"), fake, 5).alias("d")).collect()
    assert [r.d.language for r in key] == ["es", "und", "und"]


def test_audit_and_averages(spark):
    from loomtext.operators import language

    items = spark.createDataFrame([("1/1", ["uno", "dos"], ["es", "en"], [0.5, 0.75])], "handle string, abstract_segments array<string>, abstract_segment_languages array<string>, abstract_segment_language_scores array<double>")
    raw = spark.createDataFrame([("1/1", "uno", "es", "es", "es"), ("1/1", "dos", "es", "", "x")], "h string, t string, f string, c string, o string")
    audit = language.segment_audit(items, language.ground_truth(raw, "h", "t", "f", "c", "o"))
    assert len(audit.columns) == 9
    assert [(r.segment_index, r.ground_truth_language, r.ground_truth_source) for r in audit.orderBy("segment_index").collect()] == [(0, "es", "human_langid_agreement"), (1, "es", "manual_audit")]
    assert language.truth_lists(audit).first()[1] == ["es", "es"]
    table = language.per_language(audit, "ground_truth_language", "detected_language")
    rows = {r.language: r for r in language.averages(table).collect()}
    assert rows["accuracy"].f1 == 0.5 and rows["macro avg"].recall == 0.25 and rows["weighted avg"].precision == 1.0 and rows["macro avg"].support == 2


def test_config_leaves_and_rules(tmp_path):
    assert config.layered({"a": {"b": 1, "c": {}}}, {"a": {"b": {"d": 2}}, "e": {}}) == {"a": {"c": {}, "b": {"d": 2}}, "e": {}}
    assert config.layered({"a": {"b": 1}}, {"a": {}}) == {"a": {"b": 1}} and config.layered({"a": {"b": 1}}, {"a": 3}) == {"a": 3}
    assert len(config.complaints({})) == 7
    (tmp_path / "a.yaml").write_text("experiment: {name: x}\ndata: {target_columns: [t]}\nsplit: {}\nfeatures: {}\nrepresentations: {}\nclassifiers: {}\n_own: 1\n")
    args = config.arguments(["--config", str(tmp_path / "a.yaml"), "--output", "o"])
    found = config.from_arguments(args)
    assert found["experiment"] == {"name": "x", "output_dir": "o"} and "_own" not in config.dump(found)


def test_open_runs_are_found_by_name(tmp_path):
    a, b = sinks.run_folder(tmp_path, "x"), sinks.run_folder(tmp_path, "x")
    c = sinks.run_folder(tmp_path, "x_y")
    assert len({a, b, c}) == 3 and sinks.run_folder(tmp_path, "x", resume=True) == max(a, b)
    sinks.mark(max(a, b), sinks.DONE)
    assert sinks.run_folder(tmp_path, "x", resume=True) == min(a, b)


def test_manifest_cohort_and_prepared(spark, tmp_path):
    from loomtext.operators import labels

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_bytes(b"x\r\ny\r\n")
    (tmp_path / "files" / "b.bin").write_bytes(b"x\r\n")
    import hashlib

    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in sinks.manifest(spark, f"file://{tmp_path}/files").collect()}
    assert got == {"a.txt": (4, hashlib.sha256(b"x\ny\n").hexdigest()), "b.bin": (3, hashlib.sha256(b"x\r\n").hexdigest())}
    items = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "handle string, v int")
    order = spark.createDataFrame([("c", 0), ("a", 1)], "handle string, pos int")
    assert [r.handle for r in labels.restore_cohort(items, order).collect()] == ["c", "a"]
    with pytest.raises(ValueError):
        labels.restore_cohort(items, spark.createDataFrame([("z", 0)], "handle string, pos int"))
    path = str(tmp_path / "prepared")
    assert readers.prepared_dataset(spark, path, order) is None
    items.write.parquet(path)
    assert [r.v for r in readers.prepared_dataset(spark, path, order).collect()] == [3, 1]
    assert readers.prepared_dataset(spark, path, spark.createDataFrame([("z", 0)], "handle string, pos int")) is None
    assert sinks.without_text(items.withColumn("fulltext", F.lit("x"))).columns == ["handle", "v"]
    meta = spark.createDataFrame([("http://x/handle/10915/7", "n")], "u string, w string")
    assert readers.handles_of(meta, ["w", "u"]).first().handle == "10915/7"


def test_store_texts_are_downloaded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Failing(FakeStore):
        def download(self, file_id):
            calls.add(1)
            if file_id == "2":
                raise OSError("gone")
            return b"one text"

    mapped = spark.createDataFrame([("1/1", "1"), ("1/2", "2"), (None, "3")], "handle string, txt_path string")
    handles = mapped.select("handle")
    from unittest import mock

    with mock.patch.object(readers.time, "sleep"):
        for want in (4, 7):  # three tries for the failing one, again on the next run; the other only once
            got = {r.handle: r.fulltext for r in readers.read_store_texts(mapped, handles, Failing(), 100, str(tmp_path / "c")).collect()}
            assert got == {"1/1": "one text"} and calls.value == want


def test_canonical_labels():
    from loomtext.functions.text import canonical_labels

    want = ["Educación", "Historia"]
    assert canonical_labels(["Educaci�n", "Historia"], want) == want == canonical_labels(["EducaciÃ³n", "Historia"], want)
    for bad in (["Educacion", "Historia"], ["Educación"], ["Historia", "Educación"]):
        with pytest.raises(ValueError):
            canonical_labels(bad, want)


def test_equal_files_make_equal_packages(tmp_path):
    import os
    import zipfile

    digests = []
    for name, order in (("a", ("x.csv", "sub/y.md")), ("b", ("sub/y.md", "x.csv"))):
        for f in order:
            place = tmp_path / name / f
            place.parent.mkdir(parents=True, exist_ok=True)
            place.write_text(f)
            os.utime(place, (len(digests), 10**9 + len(digests)))
        digests.append(sinks.write_package(tmp_path / name, tmp_path / name / "out" / "report.zip"))
    assert digests[0] == digests[1] == sinks.write_package(tmp_path / "a", tmp_path / "a" / "out" / "report.zip")
    assert zipfile.ZipFile(tmp_path / "a" / "out" / "report.zip").namelist() == ["report/sub/y.md", "report/x.csv"]


def test_hot_strata_and_labels_equal_plain_versions(spark):
    """One label holds most items: places and average precision come from ranges, and equal a plain count."""
    import hashlib

    from loomtext.operators import labels, scores

    rows = [(f"h{i}", ["hot"] if i % 3 else ["hot", f"r{i % 2}"]) for i in range(600)]
    items = spark.createDataFrame(rows, "handle string, labels array<string>")
    got = {r.handle: (r.stratum, r.place) for r in labels._ordered(items, 42, "handle").collect()}
    support = {}
    for _, ls in rows:
        for x in ls:
            support[x] = support.get(x, 0) + 1
    strata = {}
    for h, ls in rows:
        strata.setdefault(min((support[x], x) for x in ls)[1], []).append((int(hashlib.sha256(f"42|{h}".encode()).hexdigest()[:12], 16), h))
    want = {h: (s, (i + 0.5) / len(hs)) for s, hs in strata.items() for i, (_, h) in enumerate(sorted(hs))}
    assert got.keys() == want.keys() and all(got[h][0] == want[h][0] and abs(got[h][1] - want[h][1]) < 1e-12 for h in want)

    table = [("hot", (i * 7919 % 4001) / 100.0, int(i * 31 % 7 == 0)) for i in range(6000)] + [("cold", 1.0, 1), ("cold", 1.0, 0), ("none", 0.5, 0)]
    df = spark.createDataFrame(table, "label string, score double, y int")
    found = {r.label: r.average_precision for r in scores.average_precision(df).collect()}

    def plain(own):
        total, seen, tp, out = sum(y for _, y in own), 0, 0, 0.0
        for s in sorted({s for s, _ in own}, reverse=True):
            ys = [y for t, y in own if t == s]
            seen, tp = seen + len(ys), tp + sum(ys)
            out += sum(ys) * tp / seen
        return out / total

    assert found.keys() == {"hot", "cold"}
    for name in found:
        assert found[name] == pytest.approx(plain([(s, y) for x, s, y in table if x == name]))


def test_bootstrap_sums_equal_a_plain_count(spark):
    import hashlib
    import math

    import numpy as np

    from loomtext.operators import scores

    rng = np.random.default_rng(3)
    rows = [(f"i{i}", x, int(rng.random() < 0.4), int(rng.random() < 0.5)) for i in range(90) for x in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "handle string, label string, y int, pred int").repartition(3)
    got = {(r.replicate, r.label): (r.tp, r.fp, r.fn) for r in scores._replicate_counts(df, 20, 42, "handle", "s").collect()}
    steps = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(7)])
    want = {}
    for h, x, y, p in rows:
        for r in range(20):
            u = int(hashlib.sha256(f"42|s|{h}|{r // 16}".encode()).hexdigest()[4 * (r % 16) : 4 * (r % 16) + 4], 16) / 65536
            w = int((u >= steps).sum())
            c = want.setdefault((r, x), [0, 0, 0])
            c[0] += w * (y and p)
            c[1] += w * (p and not y)
            c[2] += w * (y and not p)
    assert got == {k: tuple(map(int, v)) for k, v in want.items()}
