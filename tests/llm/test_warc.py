import io

import pytest
import zstandard
from pyspark.sql import functions as F

from loomtext.llm import warc


def sample(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nX: y", None), (4, "d", ""), (5, "e", "é" * 400_000)]
    rows += [(5, "again", "é" * 400_000), (None, "none", "<p>x</p>"), (6, "f", "unique")]
    return spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, hash string")


def test_round_trip_and_revisits(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_bundles(sample(spark), path, frame_bytes=1000, bundle_bytes=3000)
    rows = warc.read_bundles(spark, path).collect()
    found = {(r.page_id, r.url): r for r in rows}
    assert len(rows) == 8
    assert found[2, ""].record_type == "response" and bytes(found[2, ""].payload) == b"<p>x</p>"
    assert found[1, "http://a"].refers_to == 2 and found[None, "none"].refers_to == 2
    assert found[1, "http://a"].payload_digest == found[2, ""].payload_digest
    assert found[3, "http://c%0D%0AX: y"].record_type == "revisit" and found[3, "http://c%0D%0AX: y"].refers_to == 4
    assert found[4, "d"].payload_bytes == 0 and found[5, "e"].payload_bytes == 800_000
    assert found[5, "again"].record_type == found[5, "e"].record_type == "response"


def test_seek_by_index_and_public_format(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_bundles(sample(spark), path, frame_bytes=50)
    index = warc.bundle_index(spark, path)
    assert index.count() == index.select("record_id").distinct().count() == 8
    entry = index.where("record_id like '<urn:page:6:%'").first()
    data = warc.bundle_file(spark, path, entry.bundle)
    headers, block = warc.read_record(data, entry.frame, entry.frame_offset)
    assert headers["WARC-Record-ID"] == entry.record_id and block.endswith(b"unique")
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC/1.1\r\n") == index.where(f"bundle = '{entry.bundle}'").count()
    place, packed, _ = warc.read_seek_table(data)[entry.frame]
    alone = bytearray(data)
    alone[:place] = b"x" * place  # other frames are not touched
    assert warc.read_record(bytes(alone), entry.frame, entry.frame_offset) == (headers, block)


def test_a_damaged_footer_or_index_is_an_error(spark, tmp_path):
    path, bad = str(tmp_path / "w"), str(tmp_path / "bad")
    warc.write_bundles(sample(spark).coalesce(1), path, frame_bytes=50)
    rows = warc.bundle_rows(spark, path)
    n = F.octet_length("data")
    flipped = F.concat(F.substring("data", F.lit(1), n - 12), F.unhex(F.lit("ff")), F.substring("data", n - 10, F.lit(12)))
    swapped = F.reverse(F.transform("records", lambda r: r["record_id"]))
    wrong = F.zip_with("records", swapped, lambda r, x: F.struct(x.alias("record_id"), r["frame"], r["frame_offset"], r["n_record"]))
    cut = F.expr("substring(data, 1, octet_length(data) - 9)")
    for column, value in (("data", flipped), ("data", cut), ("records", wrong.cast(rows.schema["records"].dataType))):
        rows.withColumn(column, value).write.mode("overwrite").parquet(bad)
        with pytest.raises(Exception, match="seek table|index does not fit|range"):
            warc.read_bundles(spark, bad).collect()


def test_small_payloads_may_stay_responses(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_bundles(sample(spark), path, min_revisit_bytes=9)
    kinds = {(r.page_id, r.record_type) for r in warc.read_bundles(spark, path).collect()}
    assert {k for _, k in kinds} == {"response"}


def test_empty(spark):
    assert warc.archive_round_trip(sample(spark).limit(0)).count() == 0
