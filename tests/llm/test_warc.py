"""WARC round trips: what is read back from the archives against the pages themselves."""

import hashlib
import subprocess

from pyspark.sql import functions as F

from peerlens.llm import warc
from peerlens.llm.common import table

SCHEMA = "page_id long, url string, html string"


def expected(rows):
    first = {}
    for page, html in rows:
        if len(body := (html or "").encode()) >= 1000 and page is not None:
            first[body] = max(page, first.get(body, page))
    out = []
    for page, html in rows:
        body = (html or "").encode()
        keeper = first.get(body)
        again = keeper is not None and keeper != page
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_whole_table(spark, data):
    pages = table(spark, data, "pages")
    again = pages.limit(9).withColumn("page_id", F.col("page_id") + 10_000)
    both = pages.unionByName(again)
    assert got(warc.round_trip(both)) == expected([(r.page_id, r.html) for r in both.collect()])


def test_edges(spark):
    long = "".join(f"{i} é漢 " for i in range(60_000))
    rows = [
        (1, "http://a/ b\r\nX: y", long), (2, None, long), (2, "u", long), (3, "u", None), (4, "u", ""), (5, "u", "s" * 999),
        (6, "u", "s" * 999), (7, "u", "t" * 1000), (8, "u", "t" * 1000), (None, "u", "t" * 1000), (None, "u", "n" * 2000),
        (None, "u", "n" * 2000), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 9), (9, "u", "other"),
    ]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("sha", F.lit("clash"))
    assert got(warc.round_trip(pages)) == expected([(a, c) for a, _, c in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_chunks_carry_running_digests(spark):
    text = "0123456789" * 500
    pages = spark.createDataFrame([(1, "u", text), (2, "u", "x")], SCHEMA).repartition(1)
    folder, manifest = warc.write_archives(pages, chunk_bytes=700, archive_bytes=1)
    assert manifest.select("archive").distinct().count() == 2
    rows = sorted(warc.read_archives(folder, manifest, chunk_bytes=300).filter("page_id = 1").collect(), key=lambda r: r.chunk_no)
    assert [len(r.data) for r in rows] == [300] * 16 + [200]
    digest = hashlib.sha1()
    for r in rows:
        digest.update(r.data)
        assert r.digest == digest.hexdigest()
    assert [r.last for r in rows] == [False] * 16 + [True]
    assert b"".join(bytes(r.data) for r in rows).decode() == text


def test_archives_are_plain_warc(spark):
    pages = spark.createDataFrame([(1, "http://x/", "y" * 1200), (2, "http://z/", "y" * 1200)], SCHEMA).repartition(1)
    folder, manifest = warc.write_archives(pages)
    name = manifest.first().archive
    text = subprocess.run(["gzip", "-dc", f"{folder}/{name}"], capture_output=True, check=True).stdout.decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.count("WARC-Type: revisit") == 1
    assert text.count("y" * 1200) == 1 and "WARC-Refers-To: <urn:page:2>" in text


def test_archives_are_read_by_as_many_tasks(spark):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat(cast(id AS string), 600) AS html").repartition(4)
    folder, manifest = warc.write_archives(pages, archive_bytes=1)
    chunks = warc.read_archives(folder, manifest)
    n = manifest.select("archive").distinct().count()
    assert n >= 8 and chunks.rdd.getNumPartitions() == n
    assert chunks.filter("last").count() == 40
