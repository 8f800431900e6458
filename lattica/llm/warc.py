"""WARC: deduplicated archives by revisit resolution.

Headers alone are shuffled by payload digest to find the original of each group
of equal payloads; revisit records then carry no payload. The archives are
written by Spark's text writer, which commits whole files and reaches every
file system that Spark reaches: a record is one "line" whose separator is the
two line ends that close a WARC record. Each file is one gzip member.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import removed, written

#: Shared payloads up to which their originals are sent to all executors.
SMALL = 1 << 18

# Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n"

RECORDS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to_id", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("digest_read", T.StringType()),
    ]
)


def _salts(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(n)])))


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest); a null html is empty."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )


def originals(headers: DataFrame, least_bytes: int) -> DataFrame:
    """(payload_digest, original) of each payload that several records share."""
    return (
        headers.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 and original is not null")
        .select("payload_digest", "original")
    )


def _record_id(page_id: Column, digest: Column) -> Column:
    """A name-based UUID (version 5 layout) of the page and its payload."""
    h = F.sha1(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100, date: str | None = None, salts: int = 8) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) to gzipped WARC files under ``path``.

    Of records with equal payloads of at least ``least_bytes`` bytes, the one
    with the smallest page_id is a response and the others are revisits of it.
    Rows that repeat that page_id with the same payload are responses too; a
    null page_id is never the original while another exists, and a group of
    null page_ids alone is all responses. A null html is an empty payload, a
    null url the target ``urn:page:<page_id>``. ``date`` is the time of writing
    unless given. Other columns are ignored; rows repeated whole share a record id.

    Only digests and page_ids are shuffled. The originals of shared payloads go
    to the pages where they are few; beyond ``SMALL`` of them the pages are
    shuffled to them, over ``salts`` parts, since one digest may own a third of
    all rows.
    """
    rows = payloads(pages)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    first = written(originals(rows.select("page_id", "payload_digest", "payload_bytes"), least_bytes), "originals")
    if first.limit(SMALL + 1).count() <= SMALL:
        joined = rows.join(F.broadcast(first), "payload_digest", "left")  # at most SMALL rows of some 100 bytes
    else:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        joined = salted.join(_salts(first, salts), ["payload_digest", "salt"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    size = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(END + END))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), r"[\x00-\x20\x7F]", "%20")
    head = F.concat_ws(
        END,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <"), _record_id(F.col("page_id"), F.col("payload_digest")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <"), _record_id(F.col("original"), F.col("payload_digest")), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + size).cast("string")),
    )
    record = F.concat(head, F.lit(END + END), http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    out = joined.select(record.alias("value"))
    out.write.option("lineSep", END + END).option("compression", "gzip").option("maxRecordsPerFile", 2000).text(path)
    removed(pages.sparkSession, first)


class _Stream:
    """Bytes of a gzip file of any number of members, a part at a time."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.have = memoryview(raw), 0, bytearray()
        self.pos = 0
        self.inflate = zlib.decompressobj(31)

    def fill(self, n: int) -> bool:
        """At least n bytes are at hand from pos on, unless the file ends."""
        if self.pos > 1 << 20:
            del self.have[: self.pos]
            self.pos = 0
        while len(self.have) - self.pos < n:
            if self.inflate.eof:
                rest = self.inflate.unused_data
                self.at -= len(rest)
                self.inflate = zlib.decompressobj(31)
            if self.at >= len(self.raw):
                return False
            part = bytes(self.raw[self.at : self.at + (1 << 16)])
            self.at += len(part)
            self.have += self.inflate.decompress(part)
        return True

    def until(self, mark: bytes) -> bytes | None:
        n = 1024
        while (k := self.have.find(mark, self.pos)) < 0:
            if not self.fill(n):
                return None
            n += 4096
        out = bytes(self.have[self.pos : k])
        self.pos = k + len(mark)
        return out

    def read(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError("a WARC record ends too early")
        out = bytes(self.have[self.pos : self.pos + n])
        self.pos += n
        return out


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of one gzipped WARC file: their headers and blocks."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a WARC record has no end")
        yield fields, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path`` (see ``RECORDS``); payload sizes and digests of responses are measured anew."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for f, block in parse(raw.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    own = f["warc-type"] == "response"
                    page = f.get("x-page-id")
                    rows.append(
                        (
                            f["warc-record-id"].strip("<>"),
                            int(page) if page else None,
                            f["warc-target-uri"],
                            f["warc-type"],
                            f["warc-payload-digest"].partition(":")[2],
                            f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None,
                            len(payload) if own else None,
                            hashlib.sha256(payload).hexdigest() if own else None,
                        )
                    )
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=RECORDS.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def resolve(records: DataFrame, salts: int = 8) -> DataFrame:
    """Join revisit records to the responses they refer to.

    Returns (page_id, payload_bytes, payload_digest, record_type, refers_to,
    url): sizes and digests as measured on the response's payload. A revisit
    whose response is missing keeps a null size and refers_to. The hot
    responses' lookups are salted; a response repeated in the input counts once.
    """
    found = records.filter("record_type = 'response'").groupBy("record_id").agg(F.min("page_id").alias("to_page"), F.max("payload_bytes").alias("to_bytes"), F.max("digest_read").alias("to_digest"))
    wanted = records.filter("record_type = 'revisit'").select("refers_to_id").distinct()
    found = found.join(wanted, found.record_id == wanted.refers_to_id, "left_semi")
    salted = records.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    to = _salts(found.withColumnRenamed("record_id", "to_id"), salts).withColumnRenamed("salt", "to_salt")
    joined = salted.join(to, (salted.refers_to_id == to.to_id) & (salted.salt == to.to_salt), "left")
    own = F.col("record_type") == "response"
    return joined.select(
        "page_id",
        F.when(own, F.col("payload_bytes")).otherwise(F.col("to_bytes")).alias("payload_bytes"),
        F.when(own, F.col("digest_read")).otherwise(F.coalesce("to_digest", "payload_digest")).alias("payload_digest"),
        "record_type",
        F.when(~own, F.col("to_page")).alias("refers_to"),
        "url",
    )
