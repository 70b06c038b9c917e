import base64
import hashlib

from bazaar.llm import warc

PAGES = [(3, "u", "x"), (1, "u", "x"), (4, None, None), (5, "v", ""), (None, "w", "x"), (1, "u", "x"), (6, "a\r\nb", "é\r\n\r\nWARC/1.1\r\n"),
         (7, "t", "y" * 200_000)]


def test_pages_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    first = {}
    for page_id, _, html in PAGES:
        if page_id is not None:
            first[html or ""] = min(first.get(html or "", page_id), page_id)
    wanted = []
    for page_id, _, html in PAGES:
        payload, of = (html or "").encode(), first[html or ""]
        wanted.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                       "response" if page_id == of else "revisit", None if page_id == of else of))
    got = warc.archived_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))


def test_payloads_are_stored_once_and_records_are_exact(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    path = warc.write_archive(pages)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    warc.export_warc(spark, path, f"{path}/warc", records_per_file=2)
    inside = sorted((r.header, bytes(r.payload) if "WARC-Type: response" in r.header else b"") for r in warc.read_archive(spark, path).collect())
    assert sorted((r.header, bytes(r.payload)) for r in warc.read_warc(spark, f"{path}/warc").collect()) == inside


def test_least_bytes_keeps_small_payloads_whole(spark):
    pages = spark.createDataFrame(PAGES[:3], "page_id long, url string, html string")
    back = warc.read_archive(spark, warc.write_archive(pages, least_bytes=2))
    assert [r.t for r in back.select(warc.field("WARC-Type").alias("t")).collect()] == ["response"] * 3


def test_a_changed_payload_is_noticed(spark):
    import pytest

    path = warc.write_archive(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"))
    spark.createDataFrame([("0" * 64, 1, bytearray(b"z"))], "sha256 string, parts int, payload binary").write.mode("append").parquet(f"{path}/payloads")
    spark.createDataFrame([("0" * 64, 0, "WARC/1.1\r\n")], "sha256 string, part int, header string").write.mode("append").parquet(f"{path}/records")
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archive(spark, path).collect()


def test_empty_table(spark):
    assert warc.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_wrong_digest_in_a_header_is_noticed(spark):
    import pytest

    path = warc.write_archive(spark.createDataFrame(PAGES[:1], "page_id long, url string, html string"))
    wrong = [(r.sha256, r.part, r.header.replace("sha1:", "sha1:A")) for r in spark.read.parquet(f"{path}/records").collect()]
    spark.createDataFrame(wrong, "sha256 string, part int, header string").write.mode("append").parquet(f"{path}/records")
    with pytest.raises(Exception, match="digest in the header"):
        warc.read_archive(spark, path).collect()


def test_urls_with_other_line_separators(spark):
    for sep in ("\x85", "\u2028", "\u2029", "\x0b", "\x0c"):
        url = f"http://x/{sep}WARC-Type: revisit{sep}WARC-Payload-Digest: sha1:none"
        (row,) = warc.archived_pages(spark.createDataFrame([(1, url, "x")], "page_id long, url string, html string")).collect()
        assert (row.url, row.record_type, row.page_id) == (url, "response", 1)


def test_a_payload_of_many_records_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART_RECORDS", 10)
    pages = spark.createDataFrame([(i, f"u{i}", "same") for i in range(95)] + [(100, "v", "other")], "page_id long, url string, html string")
    path = warc.write_archive(pages)
    assert sorted(r.parts for r in spark.read.parquet(f"{path}/payloads").collect()) == [1, 10]
    assert spark.read.parquet(f"{path}/records").select("sha256", "part").distinct().count() > 5
    back = warc.read_archive(spark, path).collect()
    assert len(back) == 96 and sorted(bytes(r.payload) for r in back) == [b"other"] + [b"same"] * 95
