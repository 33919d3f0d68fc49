"""WARC archives of records compressed one by one with a dictionary of their own.

An archive is a ``.warc.zst`` file: a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary, then one frame for each record. Pages of a site share markup
that a frame of one record can't refer to, so the dictionary is trained from the
records that the archive is about to hold. A reader takes the dictionary from the
first frame; nothing else is needed to read any record by its offset.

Pages are dealt into archives by a hash of their id; a task writes one archive of about
``ARCHIVE`` bytes and puts the file in place whole. A payload that occurs again is
stored once: the others are ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .lineage import checkpoint_dir, cut

MAGIC = 0x184D2A5D
#: Payload bytes of an archive, about; of payloads that are stored once; of a dictionary; level. A dictionary is trained from records of 100 times its size at most.
ARCHIVE, LEAST, DICTIONARY, LEVEL = 16 << 20, 1000, 64 << 10, 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None, page: int | None) -> str:
    """A target URI of one line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page}"


def _record_id(page: int | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record: a response, or with refers_to a revisit without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, kind)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url, page)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", f"X-Page-ID: {'' if page is None else page}",
    ]
    block = http + payload
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to, 'response')}", f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict:
    """Trained from records at even distances; for too few to train from, their beginnings as they are."""
    total = sum(map(len, records))
    step = max(1, -(-total // (100 * size)))
    try:
        return zstandard.train_dictionary(size, records[::step], level=LEVEL)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(r[:1024] for r in records[:16])[:size].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    d = dictionary(records)
    d.precompute_compress(level=level)
    c = zstandard.ZstdCompressor(dict_data=d, level=level, write_checksum=True)
    raw = d.as_bytes()
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *(c.compress(r) for r in records)])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, in order."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary in front of the records")
    raw = data[8 : 8 + size]
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    at, view, piece = 8 + size, memoryview(data), 1 << 15
    while at < len(data):
        frame, out = d.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the last record is cut off")
            fed = view[at : at + piece]
            out.append(frame.decompress(fed))
            at += len(fed)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of a record, and head and payload of its HTTP message."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block, end = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def write_archives(pages: DataFrame, folder: str, id_: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of pages to archives in folder; (archive, records, bytes) of each archive.

    Of rows with equal payloads (the html in UTF-8) of at least ``least`` bytes that with
    the largest id is a response and the others revisit it; all others are responses.

    * A null html is an empty payload; a null url becomes ``urn:page:`` and the id.
    * A null id never is the largest; if all ids of equal payloads are null, all are
      responses. So are rows that share the largest id.
    * An empty table writes no archive. Other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    n = max(1, -(-total // archive_bytes))
    brief = rows.where(F.octet_length("payload") >= least).select("page_id", F.sha1("payload").alias("digest"))
    target = brief.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "target")
    again = brief.join(target, "digest").where("target is not null and not page_id <=> target")
    # pages and what they refer to are dealt together: a task is an archive
    left = rows.select("page_id", "url", "payload", F.lit(False).alias("refers"), F.lit(None).cast("long").alias("to"))
    right = again.select("page_id", F.lit(None).cast("string").alias("url"), F.unhex("digest").alias("payload"), F.lit(True).alias("refers"), F.col("target").alias("to"))
    dealt = left.unionByName(right).repartition(n, "page_id").withColumn("archive", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        number = t.column("archive")[0].as_py()
        refer = {(p, d): to for p, d, to in zip(*(t.filter(pa.compute.field("refers")).column(c).to_pylist() for c in ("page_id", "payload", "to")))}
        left = t.filter(~pa.compute.field("refers")).sort_by([("page_id", "ascending"), ("url", "ascending")])
        if not left.num_rows:
            raise ValueError("a revisit without its page")
        records = []
        for p, u, x in zip(*(left.column(c).to_pylist() for c in ("page_id", "url", "payload"))):
            digest = hashlib.sha1(x).digest()
            records.append(record(p, u, x, digest, refer.get((p, digest))))
        data = archive(records)
        files.write(folder, f"pages-{number:08d}.warc.zst", data)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(records)], pa.int64()), pa.array([len(data)], pa.int64())], names=["archive", "records", "bytes"])

    return cut(dealt.mapInArrow(run, "archive long, records long, bytes long"))


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record; the payload of a revisit is null.

    Each payload is held against the digest of its record.
    """

    def rows(content: bytes) -> Iterable[tuple]:
        for data in records_of(content):
            h, http, payload = parse(data)
            digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:"))
            size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
            response = h["WARC-Type"] == "response"
            if response and (hashlib.sha1(payload).digest() != digest or len(payload) != size):
                raise ValueError(f"{h['WARC-Record-ID']}: another payload than it says")
            refers = h.get("X-Refers-To-Page-ID")
            yield int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Target-URI"], size, digest.hex(), h["WARC-Type"], int(refers) if refers else None, payload if response else None

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                some: list[tuple] = []
                size = 0
                for r in rows(content.as_buffer().to_pybytes()):
                    some.append(r)
                    size += r[2]
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def warc_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes pages as archives, in a new folder of the shared one unless named, and reads them back."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files.write(folder, "_BEGUN", b"")
    write_archives(pages, folder, **options)
    return read_archives(spark, folder)
