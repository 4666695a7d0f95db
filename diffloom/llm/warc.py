"""Dictionary-compressed WARC archives, written and read by Spark.

An archive is a sequence of Zstandard frames: a skippable frame that holds the
dictionary, then one frame per WARC record, each compressed on its own with
that dictionary, so a record can be read from its offset alone. The dictionary
is trained on a bounded sample of the records to be archived.

Executors have no file system in common but Spark's, so the archives go through
its text writer, one row per frame. That writer puts a separator behind each
row; the separator chosen here is an empty skippable frame, which every
Zstandard reader passes over. It also begins a new file after a set number of
rows: a dictionary comes first in each, and an archive that has its bytes is
filled up with empty rows. So an archive is bounded, however much a task writes.
Archives are read back whole by the binary file source, one archive per row,
and parsed record by record.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffloom.llm.common import Scratch, scratch_path, sliced

DICT_MAGIC = 0x184D2A5D  # fixed value: the skippable frame of an archive's dictionary
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
REVISIT_LEAST = 100  # payloads below this many bytes are always archived whole
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE_ROWS, ARCHIVE_BYTES = 8_192, 64_000_000  # an archive has at most so many frames, and bytes but for its last record
EPOCH = "1970-01-01T00:00:00Z"  # a fixed date: equal pages give equal archives


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC/1.1 record. first: for a revisit the page that holds the payload."""
    name = "null" if page_id is None else str(page_id)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}')}>",
        f"WARC-Page-ID: {name}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page: {first}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if first is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record, and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError("a record of the wrong length")
    fields["payload"] = None if fields["WARC-Type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
    return fields


def train_dictionary(pages: DataFrame, rows: int = 400, row_bytes: int = 16_384, size: int = 65_536) -> bytes:
    """A Zstandard dictionary from `rows` records at most, the ones of the smallest hashes.

    A bound on the hash lets about twice as many through, however many pages
    and tasks there are, and repeated pages count once. Of each a slice of at
    most row_bytes goes into training, from a place in the whole payload that
    the hash decides, so the driver gets at most rows * row_bytes bytes (7 MB as
    set here). Too few rows to train on give a raw dictionary of their own
    bytes; none, an empty one.
    """
    total = pages.count()
    h = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 40))
    some = pages.where((F.length("html") > 0) & (h < int((1 << 40) * min(1.0, 2 * rows / max(1, total)))))
    data = F.encode("html", "UTF-8")
    at = F.pmod(F.xxhash64("html"), F.greatest(F.lit(0), F.octet_length("html") - row_bytes) + 1).cast("int") + 1
    some = some.select(h.alias("h"), F.struct("page_id", "url", F.substring(data, at, F.lit(row_bytes)).alias("payload")).alias("page"))
    some = some.groupBy("h").agg(F.min("page").alias("page")).orderBy("h").limit(rows).select("page.*").collect()
    samples = [record(r["page_id"], r["url"], p := bytes(r["payload"]), hashlib.sha256(p).hexdigest(), None) for r in some]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


def revisits(pages: DataFrame) -> DataFrame:
    """(digest, first): the smallest page_id of each payload of REVISIT_LEAST bytes or more that occurs twice or more."""
    long = pages.where(F.octet_length("html") >= REVISIT_LEAST).select(F.sha2("html", 256).alias("digest"), "page_id")
    return long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, path: str, level: int = 6, most_rows: int = ARCHIVE_ROWS, most_bytes: int = ARCHIVE_BYTES) -> None:
    """Archive pages (page_id, url, html) under path, in one archive or more per task.

    A null html is an empty payload. Of equal payloads of 100 bytes or more the
    smallest page_id is archived, the others become revisits that refer to it;
    rows that repeat a page_id and its html are archived as often as they occur,
    and null ids, of which none is the smallest, refer to the page that has one.
    The payloads move once at most, to meet their digest's first page; a
    digest that a third of the pages share is split by the skew join, and no
    payload moves if repeated digests are few enough to be broadcast. Other
    columns are ignored; no pages, no archive.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    content = train_dictionary(pages)
    head = struct.pack("<II", DICT_MAGIC, len(content)) + content if content else b""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level, dict_data=_dictionary(content)) if content else zstandard.ZstdCompressor(level)
        rows = held = sent = 0
        out: list[bytes] = []
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
        for batch in sliced(batches, 64):
            for values in zip(*batch.columns, strict=True):
                if rows == 0:
                    out.append(head)
                    rows, held = 1, len(head)
                page_id, url, html, digest, first = (v.as_py() for v in values)
                out.append(press.compress(record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)))
                rows, held, sent = rows + 1, held + len(out[-1]), sent + len(out[-1])
                if rows < most_rows and held >= most_bytes:
                    out += [b""] * (most_rows - rows)
                    rows = most_rows
                if rows == most_rows:
                    rows = 0
                if sent > 8_000_000:
                    yield batch_of()
                    out, sent = [], 0
        yield batch_of()

    with Scratch(pages.sparkSession) as scratch:
        firsts = scratch(revisits(pages), "warc-first")
        rows = pages.withColumn("digest", F.sha2("html", 256)).join(firsts, "digest", "left")
        rows = rows.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))
        lines = rows.mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
        lines.write.option("lineSep", SEPARATOR.decode()).option("compression", "none").option("maxRecordsPerFile", most_rows).text(path)


def _frame(press: zstandard.ZstdDecompressor, data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the frame that begins there, and where it ends. Only the last piece read can reach beyond the frame."""
    part, out, step = press.decompressobj(), [], 1 << 13
    while not part.eof:
        if at >= len(data):
            raise ValueError("an archive that ends within a record")
        piece = data[at : at + step]
        out.append(part.decompress(piece))
        at, step = at + len(piece), min(2 * step, 1 << 22)
    return b"".join(out), at - len(part.unused_data)


def records(data: bytes) -> Iterator[dict]:
    """Parsed records of one archive, in one pass over it."""
    at, content, view = 0, b"", memoryview(data)
    press = None
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICT_MAGIC and at == 0:
                content = data[8 : 8 + size]
            at += 8 + size
            continue
        press = press or zstandard.ZstdDecompressor(dict_data=_dictionary(content) if content else None)
        raw, at = _frame(press, view, at)
        yield parse(raw)


def read_back(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all archives under path.

    A response's digest and length are computed from its payload and must equal
    its header; a revisit's are those of its header.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for data in batch.column(0):
                out = []
                for r in records(data.as_py()):
                    digest, length = r["WARC-Payload-Digest"].removeprefix("sha256:"), int(r["WARC-Payload-Length"])
                    if r["payload"] is not None and (hashlib.sha256(r["payload"]).hexdigest(), len(r["payload"])) != (digest, length):
                        raise ValueError(f"page {r['WARC-Page-ID']}: the payload differs from its digest")
                    page, first = r["WARC-Page-ID"], r.get("WARC-Refers-To-Page")
                    out.append((None if page == "null" else int(page), length, digest, r["WARC-Type"], None if first is None else int(first)))
                columns = [pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    return files.mapInArrow(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write pages to archives in the shared folder and return what reading them back gives."""
    path = scratch_path(pages.sparkSession, name)
    write(pages, path)
    return read_back(pages.sparkSession, path)


def archive_sql(table: str = "pages") -> str:
    """What archive() returns of a table whose page ids are distinct."""
    return f"""WITH d AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM {table}),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_LEAST} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
