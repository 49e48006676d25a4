import gzip
import hashlib

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG, SMALL = "<p>" + "é" * 600 + "</p>", "<p>tiny</p>"
PAGES = [
    (1, "http://a/1", BIG), (5, "http://a/5", BIG), (3, None, BIG), (2, "http://a/2", SMALL), (4, "http://a/4", SMALL), (6, "http://a\r\nX: y", None), (7, "http://a/7", ""),
    (8, "http://a/8", "z" * 100_000), (None, "http://n", BIG),
]


def brute(pages):
    payloads = [(i, (h or "").encode()) for i, _, h in pages]
    out = []
    for i, p in payloads:
        same = [j for j, q in payloads if q == p and j is not None]
        keeper = max(same) if len(p) >= 1000 and len([1 for _, q in payloads if q == p]) > 1 and same else i
        again = keeper != i
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages).collect()), key=str)
    assert got == brute(PAGES)


def test_repeated_rows_extra_columns_and_empty(spark):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(PAGES[:5], SCHEMA).withColumn("digest", F.lit("clash")).withColumn("keeper", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(spark, pages.unionByName(pages)).collect()), key=str)
    assert got == brute(PAGES[:5] * 2)
    assert warc.round_trip(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_reads_single_records(spark, monkeypatch):
    """Each index row is a gzip member of its own; selected records come by coalesced ranges."""
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    index = warc.write(spark.createDataFrame(PAGES, SCHEMA))
    rows = index.collect()
    assert len({r.file for r in rows}) > 1
    for r in rows:
        with open(r.file.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            raw = gzip.decompress(f.read(r.length))
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
    got = warc.read(index.filter("page_id in (2, 8)")).collect()
    assert sorted((r.page_id, r.url, len(r.payload)) for r in got) == [(2, "http://a/2", len(SMALL)), (8, "http://a/8", 100_000)]


def test_whole_file_is_a_valid_archive(spark):
    index = warc.write(spark.createDataFrame(PAGES[:3], SCHEMA).coalesce(1))
    path = index.first().file.removeprefix("file://")
    text = gzip.open(path).read()
    assert text.count(b"WARC/1.1\r\n") == 4 and b"WARC-Type: warcinfo" in text
    assert text.count(b"WARC-Type: revisit") == 2
