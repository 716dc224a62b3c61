import base64
import hashlib
import tempfile

from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import lookup

PAGES = [
    (5, "http://a.example/x", "<p>same</p>"), (3, "http://b.example/y?q=1", "<p>same</p>"), (9, None, "<p>same</p>"),
    (1, "http://c.example/ü\r\nX: y", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"),
    (2, "http://d.example", None), (4, "not a url", ""), (6, "http://e.example", "x" * 100_000), (7, "", "WARC/1.1\r\n"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip_and_revisits(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("seq", F.lit("clash")).withColumn("digest", F.lit(1)).repartition(3)
    pages.write.parquet(path + "-in")
    warc.write_archives(spark.read.parquet(path + "-in"), path)
    rows = {r.metadata.page_id: r for r in warc.assemble(warc.read_records(spark, path)).collect()}
    assert set(rows) == {p[0] for p in PAGES}
    first = {}
    for i, _, html in sorted(PAGES):
        first.setdefault(html or "", i)
    for i, url, html in PAGES:
        r, html = rows[i], html or ""
        assert r.metadata.payload_bytes == len(html.encode())
        assert r.capture.declared_digest == "sha1:" + digest(html)
        assert r.capture.target_uri == (url.replace("\r", "%0D").replace("\n", "%0A") if url else url)
        assert r.request.block.startswith("GET ")
        if first[html] == i:
            assert r.capture.warc_type == "response" and bytes(r.capture.payload) == html.encode() and r.capture.payload_digest == digest(html)
            assert r.metadata.refers_to_page is None
        else:
            assert r.capture.warc_type == "revisit" and r.metadata.refers_to_page == first[html]


def test_repeated_and_null_ids(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, None, "a"), (None, None, None)], "page_id long, url string, html string").write.parquet(path + "-in")
    warc.write_archives(spark.read.parquet(path + "-in"), path)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(rows) == 4
    assert sorted(r.capture.warc_type for r in rows) == ["response", "response", "revisit", "revisit"]


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(path + "-in")
    warc.write_archives(spark.read.parquet(path + "-in"), path)
    assert warc.read_records(spark, path).count() == 0


def test_lookup_of_hot_keys_loses_no_row(spark):
    rows = spark.createDataFrame([(7 if i % 2 else i, i) for i in range(5000)] + [(None, 1)], "k long, v long")
    found = rows.where("k IS NOT NULL").groupBy("k").agg(F.max("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    assert lookup(rows, found, "k", 5001).count() == 5001
    assert lookup(rows, found, "k", 5001, how="inner").where("m IS NULL").count() == 0


def test_links_survive_a_change_of_cores(spark, monkeypatch, tmp_path):
    """Row numbers link revisits to captures; the splits of the scan change before each write."""
    pages = [(i, f"http://h/{i}", f"<p>{i % 40}</p>") for i in range(400)]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(8).write.parquet(f"{tmp_path}/in")
    keep, cores = warc.written, iter([4, 2, 1, 3] * 20)

    def other_cores(df, label):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", next(cores))
        return keep(df, label)

    monkeypatch.setattr(warc, "written", other_cores)
    try:
        warc.write_archives(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/w")
        rows = warc.assemble(warc.read_records(spark, f"{tmp_path}/w")).collect()
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    got = {r.metadata.page_id: (r.capture.warc_type, r.metadata.refers_to_page) for r in rows}
    assert got == {i: ("response", None) if i < 40 else ("revisit", i % 40) for i in range(400)}


def test_references_of_other_writers_are_followed(spark):
    """Records without any field of ours beside pageId; one reference leads nowhere."""

    def record(kind, id_, block, **fields):
        head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{id_}>\r\n{head}Content-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"

    path = tempfile.mkdtemp(prefix="spark-")
    text = record("response", "a", "HTTP/1.1 200 OK\r\n\r\nhi", Content_Type="application/http; msgtype=response") + record("metadata", "b", "pageId: 11\r\n", WARC_Concurrent_To="<a>")
    for i, to in ((1, "<a>"), (2, "<a>"), (3, "<gone>")):
        text += record("revisit", f"r{i}", "", WARC_Refers_To=to) + record("metadata", f"m{i}", f"pageId: {20 + i}\r\n", WARC_Concurrent_To=f"<r{i}>")
    text += record("revisit", "alone", "", WARC_Refers_To="<a>")
    with open(f"{path}/x.warc", "w", newline="") as f:
        f.write(text)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    got = {r.record_id: r.metadata and (r.metadata.page_id, r.metadata.refers_to_page) for r in rows}
    assert got == {"<a>": (11, None), "<r1>": (21, 11), "<r2>": (22, 11), "<r3>": (23, None), "<alone>": None}
