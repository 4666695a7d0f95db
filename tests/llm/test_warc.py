import hashlib
import struct
import time

import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import DATA
from diffloom.llm import warc
from diffloom.llm.queries import ORACLE_SQL, QUERIES
from duck import connect, same

BIG = "<html>" + "same words " * 20 + "é日本</html>"
PAGES = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (1, "u\r\nX: y", "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99), (10, "u", "long " * 300_000), (9, None, BIG), (None, "u", BIG)]
SCHEMA = "page_id long, url string, html string"


def expected(pages):
    first = {}
    for i, _, html in pages:
        if i is not None and html and len(html.encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        refers = first.get(html) if html in first and first[html] != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    pages = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert got(QUERIES["op7_warc_dictionary"](spark, DATA)) == expected(pages)


def test_odd_pages(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "first", "frame", "h")})
    assert got(warc.archive(df)) == expected(PAGES)
    assert warc.archive(spark.createDataFrame([], SCHEMA)).collect() == []


def test_files_are_plain_zstandard_with_the_dictionary_in_front(spark, tmp_path):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    warc.write(pages, f"file://{tmp_path}/archives")
    n = 0
    for path in (tmp_path / "archives").glob("part-*"):
        data = path.read_bytes()
        magic, size = struct.unpack_from("<II", data)
        assert magic == warc.DICT_MAGIC
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        whole = press.stream_reader(data, read_across_frames=True).read()
        assert whole.count(b"WARC/1.1\r\n") == len(list(warc.records(data)))
        n += whole.count(b"WARC/1.1\r\n")
    assert n == pages.count()


def test_the_dictionary_helps(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    content = warc.train_dictionary(pages)
    raw = [warc.record(r["page_id"], r["url"], r["html"].encode(), "0" * 64, None) for r in pages.collect()]
    size = lambda c: sum(len(c.compress(x)) for x in raw)
    assert size(zstandard.ZstdCompressor(6, dict_data=zstandard.ZstdCompressionDict(content))) < 0.9 * size(zstandard.ZstdCompressor(6))


def test_query_equals_sql(spark):
    same(QUERIES["op7_warc_dictionary"](spark, DATA), connect(DATA), ORACLE_SQL["op7_warc_dictionary"])


def test_archives_are_bounded(spark, tmp_path):
    """By rows and by bytes; every one has the dictionary in front, and all records come back."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").coalesce(1)
    for name, bounds in (("rows", {"most_rows": 40}), ("bytes", {"most_bytes": 12_000, "most_rows": 1000})):
        warc.write(pages, f"file://{tmp_path}/{name}", **bounds)
        files = [p.read_bytes() for p in (tmp_path / name).glob("part-*")]
        assert len(files) > 1 and all(struct.unpack_from("<I", f)[0] == warc.DICT_MAGIC for f in files)
        each = [sum(1 for _ in warc.records(f)) for f in files]
        assert sum(each) == pages.count() and (name == "bytes" or max(each) <= 40)
        assert got(warc.read_back(spark, f"file://{tmp_path}/{name}")) == got(warc.archive(pages))
    assert max(map(len, files)) < 12_000 + 65_536 + 8 * 1000


def test_reading_takes_linear_time():
    press = zstandard.ZstdCompressor(3)
    body = bytes(range(256)) * 7
    one = [press.compress(warc.record(i, "u", body + str(i * i).encode() * 20, "0" * 64, None)) for i in range(16_000)]
    began = time.perf_counter()
    assert sum(1 for _ in warc.records(b"".join(one))) == 16_000
    assert time.perf_counter() - began < 3


def test_a_truncated_archive_is_an_error():
    data = zstandard.ZstdCompressor(3).compress(warc.record(1, "u", b"x" * 1000, "0" * 64, None))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(data[:-3]))
