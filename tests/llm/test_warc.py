import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from quillspark.llm import warc


def _expected(rows):
    last, out = {}, []
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", i), i)
    for i, _, html in rows:
        raw = (html or "").encode()
        top = last[html or ""]
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
    return sorted(out)


def test_round_trip(spark, stored):
    rows = [(i, f"http://x.example/{i % 7}", f"<p>é {i % 11}</p>\r\n\r\n" * (i % 5)) for i in range(200)]
    rows += [(500, None, None), (501, "u\r\nx: y", ""), (502, "u", "long " * 60000), (503, "u", "long " * 60000), (504, "u", "WARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit(1)).repartition(3)
    got = warc.op8_warc_revisits(spark, stored(pages=pages)).collect()
    assert sorted(tuple(r) for r in got) == _expected(rows)


def test_least_size_empty_and_repeated(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef"), (4, "u", "abcdef"), (None, "u", "zz")], "page_id long, url string, html string")
    types = {(r.record_id, r.type) for r in warc.page_records(pages, least=3).collect()}
    assert types == {("<urn:x-page:1>", "response"), ("<urn:x-page:2>", "response"), ("<urn:x-page:3>", "revisit"), ("<urn:x-page:4>", "response"), ("<urn:x-page:>", "response")}
    warc.write_pages(pages.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 5000) for i in range(50)] + [(90, "v", "y")], "page_id long, url string, html string")
    warc.write_pages(pages, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w"))
    asked = found.where((F.col("type") == "response") & F.col("target_uri").isin("v", "u3"))
    assert [r.payload for r in asked.collect()] == [bytearray(b"y")]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "response" not in plan.split("BatchScan")[0]
    heads = warc.read_archives(spark, str(tmp_path / "w"), payload="false")
    assert heads.where("payload IS NOT NULL").count() == 0 and heads.count() == 51
    assert heads.where("headers['warc-profile'] IS NOT NULL").count() == 49


def test_the_query_reads_payloads_of_responses_only(spark, stored):
    pages = spark.createDataFrame([(i, "u", "same " * 900) for i in range(40)] + [(90, "v", "own")], "page_id long, url string, html string")
    found = warc.op8_warc_revisits(spark, stored(pages=pages))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan warc") == 2 and "= response" not in plan and "= revisit" not in plan
    assert found.where("record_type = 'response'").count() == 2 and found.count() == 41


@pytest.mark.parametrize("packed", [lambda parts: b"".join(a + b for a, b in parts), lambda parts: b"".join(gzip.compress(a + b) for a, b in parts), lambda parts: b"".join(warc.member(a) + warc.member(b) for a, b in parts)])
def test_other_archives(packed):
    parts = [warc.record({"WARC-Type": "warcinfo", "Content-Type": "text/plain"}, b"made\r\n\r\nby"), warc.record({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.1 200\r\nA: b\r\n\r\nbody" * 1), warc.record({"WARC-Type": "resource"}, b"z" * 300000)]
    data = packed(parts)
    assert [p for _, p in warc.records(io.BytesIO(data))] == [b"made\r\n\r\nby", b"body", b"z" * 300000]
    assert [p for _, p in warc.records(io.BytesIO(data), [("type", frozenset(["response"]))])] == [b"body"]
    assert [f["warc-type"] for f, _ in warc.records(io.BytesIO(data), payload=False)] == ["warcinfo", "response", "resource"]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-40])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(b"HTTP/1.1 200\r\n\r\n")))
