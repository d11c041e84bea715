"""WARC archives without repeated payloads: writing, reading, and revisit resolution.

One pass over the pages writes a table of headers (page id, URL, payload length,
SHA-1). Only headers are shuffled by digest to find payloads that occur more than
once; of each, the record with the largest page id stays a ``response`` and the
others become ``revisit`` records that refer to it. Payloads shorter than
``min_bytes`` are always written out. The verdicts, one row a repeated digest,
then meet the pages of at least that size, which don't move while that table is
small enough to broadcast.

Archives are written by Spark's own text writer, with the end of a WARC record
as line separator, so any store that Spark reaches will do and lost tasks are
written anew. Records are written by size class, of each as many to an archive as
fit into ``archive_bytes`` at the class's largest, so an archive never holds more
than that, or a single larger record. Headers are fresh: the date is that of
writing, and a record's id is a name-based UUID of its page id, URL and digest,
so only records alike in all three share one. Reading takes an archive at a time,
walks it by Content-Length, checks every payload against its digest, and joins
revisits to the responses whose ids they refer to; one without raises an error.

Defined results
- null html: an empty payload. Null url: no target header. Null page_id: a record without page header, less than any other.
- repeated rows: each is a record; rows that repeat the largest page id of a payload are all responses.
- very long html: a record of its own in an archive of its own.
- an empty table: no archive, empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bare, forget, new_path, small_batches, written

MIN_BYTES = 1000
ARCHIVE_BYTES = 16 << 20
#: Size classes of records, by their largest; what is larger is the last class.
CLASSES = tuple(1 << k for k in range(14, 25, 2))
#: More than the headers of a record but its URL have.
HEADER_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
FIELDS = "record_id string, page_id long, url string, record_type string, refers_to_record string, payload_bytes long, payload_digest string"


def headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit(""))
    return pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))


def repeated(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(d, z, original, original_url) for each digest and size that several records have."""
    found = heads.where(F.col("size") >= min_bytes).select(F.col("digest").alias("d"), F.col("size").alias("z"), F.struct("page_id", "url").alias("page"))
    found = found.groupBy("d", "z").agg(F.max("page").alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select("d", "z", F.col("o.page_id").alias("original"), F.col("o.url").alias("original_url"))


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    told = lambda x: F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit("-"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws("|", told(page_id), told(url), digest)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def record(date: str, original: Column, original_url: Column) -> Column:
    """A record of headers() up to the two line ends that close it; a revisit if another page is its original."""
    page_id, url, digest, size = (F.col(n) for n in ("page_id", "url", "digest", "size"))
    revisit = original.isNotNull() & ~page_id.eqNullSafe(original)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(page_id, url, digest)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]+", "%0A")),
        line("X-Page-ID", page_id.cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(revisit, record_id(original, original_url, digest))),
        line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def size_class(size: Column, url: Column, min_bytes: int) -> Column:
    """-1 for small records that are never revisits, else an index into CLASSES and one beyond, by the record's bytes."""
    whole = size + F.coalesce(F.octet_length(url), F.lit(0)) + HEADER_BYTES
    out = F.lit(len(CLASSES))
    for k, most in reversed(list(enumerate(CLASSES))):
        out = F.when(whole <= most, k).otherwise(out)
    return F.when((size < min_bytes) & (whole <= CLASSES[0]), -1).otherwise(out)


def write_archives(pages: DataFrame, path: str | None = None, *, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str | None = None) -> str:
    """Writes deduplicated archives of (page_id, url, html) and returns their folder."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = headers(bare(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long")))
    sized = lambda df: df.withColumn("class", size_class(F.col("size"), F.col("url"), min_bytes))
    heads = written(sized(full.drop("payload")), "warc-headers")
    again = written(repeated(heads, min_bytes), "warc-repeated")
    spark.createDataFrame([], "value string").write.text(path)  # the folder, also where there are no pages
    for k in sorted(r["class"] for r in heads.select("class").distinct().collect()):  # len(CLASSES) + 2 at most
        rows = sized(full).where(F.col("class") == k)
        if k < 0:
            text = record(date, F.lit(None).cast("long"), F.lit(None).cast("string"))
        else:
            rows = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("z")) & (F.col("size") >= min_bytes), "left")
            text = record(date, F.col("original"), F.col("original_url"))
        most = CLASSES[max(k, 0)] if k < len(CLASSES) else archive_bytes
        rows.select(text.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, archive_bytes // most)).text(path)
    forget(heads, again)
    return path


def parsed(content: memoryview | bytes) -> Iterator[tuple]:
    """The fields of each record of an archive."""
    data, at = bytes(content), 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        first, at = stop + 4, stop + 4 + int(fields["Content-Length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record doesn't end at byte {at}")
        own, page = fields["WARC-Record-ID"], fields.get("X-Page-ID")
        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), None
        if fields["WARC-Type"] == "response":
            payload = data.index(b"\r\n\r\n", first) + 4
            size = at - payload
            if hashlib.sha1(memoryview(data)[payload:at]).hexdigest() != digest:
                raise ValueError(f"payload of {own} doesn't match its digest")
        yield own, None if page is None else int(page), fields.get("WARC-Target-URI"), fields["WARC-Type"], fields.get("WARC-Refers-To"), size, digest
        at += 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in a folder; payload_bytes is null for revisits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(zip(*parsed(content.as_buffer()), strict=True)) or [[]] * 7
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
                names = [x.split()[0] for x in FIELDS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).where("length > 0").select("content").mapInArrow(read, FIELDS)


def resolved(records: DataFrame) -> DataFrame:
    """Records with every revisit's payload_bytes and refers_to, taken from the response whose id it refers to and whose digest it has."""
    own = records.where("record_type = 'response'")
    original = own.select(F.col("record_id").alias("r"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("od"), F.col("payload_bytes").alias("ob")).distinct()
    again = records.where("record_type = 'revisit'").drop("payload_bytes")
    again = again.join(original, (F.col("refers_to_record") == F.col("r")) & (F.col("payload_digest") == F.col("od")), "left")
    lost = F.raise_error(F.concat(F.lit("revisit without its response: "), F.col("record_id"))).cast("long")
    again = again.withColumn("payload_bytes", F.when(F.col("r").isNull(), lost).otherwise(F.col("ob")))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
    return own.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again.select(*columns))


def archived(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the archives, reads them back, and returns page_id, payload_bytes, payload_digest, record_type, refers_to and url."""
    spark = pages.sparkSession
    path = write_archives(pages, path)
    with small_batches(spark):
        records = written(read_records(spark, path), "warc-records")
    return resolved(records)
