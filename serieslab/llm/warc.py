"""WARC archives as Spark tables: written by Spark's text writer, read back by Content-Length, and rewritten without repeated payloads.

Records are laid out by column expressions and written as text whose line end is the record's end, so archives go through Spark's commit
protocol to any store that Spark reaches; a task's archive is as large as its part of the input. Reading takes archives as binary files and
parses them as a stream, so a task holds one archive in its stored form and one record.

For revisits only headers are shuffled by payload digest. Each digest keeps one original by a partial aggregate, revisit records are joined
to it, and then the archives are written anew under fresh headers, every payload once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslab.core import shared_dir
from serieslab.llm.common import materialise, sized

#: Fixed values of the format: version, line end, end of a record, profile of revisits, and the alphabets of base 32 digits.
VERSION, CRLF, END = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Records and bytes of payload that a task hands on at a time.
RECORDS, BYTES = 5_000, 16 << 20
#: Header fields that a record's columns come from.
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to",
    "refers_to_uri": "warc-refers-to-target-uri", "refers_to_date": "warc-refers-to-date", "declared_digest": "warc-payload-digest", "content_type": "content-type", "key": "warc-x-key",
}


def digest(payload: Column) -> Column:
    """SHA-1 in upper-case base 32, as archives name payloads."""
    h = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*fives), DIGITS, BASE32)


def urn(*parts: Column) -> Column:
    """A record id that depends on its parts alone, so that a task that runs again writes the same record."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def one_line(value: Column) -> Column:
    """A value as a header holds it: line ends and other control characters become spaces."""
    return F.regexp_replace(value.cast("string"), r"[\x00-\x1F\x7F]", " ")


def record(fields: dict[str, Column], payload: Column, http: Column) -> Column:
    """The bytes of a record, without its end, as a string column: headers (null ones are left out), an HTTP head unless that is null, and
    the payload."""
    head = F.coalesce(F.concat(http.cast("string"), F.lit(END)), F.lit(""))
    size = F.octet_length(head) + F.octet_length(payload)
    lines = [F.concat(F.lit(f"{name}: "), one_line(v)) for name, v in fields.items()]
    return F.concat(F.concat_ws(CRLF, F.lit(VERSION), *lines, F.concat(F.lit("Content-Length: "), size.cast("string"))), F.lit(END), head, payload.cast("string"))


def write_archives(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes a table with the one column of `record`, an archive for each partition."""
    records.write.option("lineSep", END).option("compression", compression).text(path)


def response(key: Column, uri: Column, date: Column, payload: Column) -> Column:
    """A response record of a page. A null uri or key is left out, a null payload is empty. The key goes along in a field of its own."""
    body = F.coalesce(payload.cast("binary"), F.lit(b""))
    sha = digest(body)
    fields = {
        "WARC-Type": F.lit("response"), "WARC-Record-ID": urn(F.lit("response"), key, uri, sha), "WARC-Date": date, "WARC-Target-URI": uri, "WARC-X-Key": key,
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), sha), "Content-Type": F.lit("application/http; msgtype=response"),
    }
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(body).cast("string"))
    return record(fields, body, http)


def parsed(raw: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked stream, headers by lower-case name, block) of each record. A stream that is no archive, or ends inside a
    record, raises: whole results need whole archives."""
    at = 0
    while True:
        line = raw.readline()
        while line in (b"\r\n", b"\n"):
            at, line = at + len(line), raw.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at offset {at}")
        start, headers = at, {}
        while line not in (b"\r\n", b"\n"):
            if not line:
                raise ValueError(f"the headers of the record at offset {start} have no end")
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
            at, line = at + len(line), raw.readline()
        size = int(headers.get("content-length", "0"))
        block = raw.read(size)
        if len(block) < size:
            raise ValueError(f"the record at offset {start} is cut short")
        at += len(line) + size
        yield start, headers, block


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives below a path, plain or gzip (whole or by record): file, offset in the unpacked archive, the
    columns of FIELDS, payload_digest and payload_bytes, computed from what is stored, and with `payload` also http (the head of an HTTP
    message, else null) and payload. Fields that a record lacks are null; a folder without archives gives no rows; an archive that is no
    WARC or is cut short fails the job."""
    names = list(FIELDS)
    kinds = [("file", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in names], ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    kinds += [("http", pa.binary()), ("payload", pa.binary())] * payload
    schema = pa.schema(kinds)

    def records(file: str, content: bytes) -> Iterator[tuple]:
        raw = io.BytesIO(content)
        for offset, headers, block in parsed(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw):
            http, body = None, block
            if headers.get("content-type", "").startswith("application/http"):
                http, _, body = block.partition(b"\r\n\r\n")
            sha = base64.b32encode(hashlib.sha1(body).digest()).decode()
            yield (file, offset, *[headers.get(FIELDS[c]) for c in names], sha, len(body), *([http, body] if payload else []))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for r in records(file.as_py(), content.as_py()):
                    held.append(r)
                    size += len(r[-1] or b"") if payload else 0
                    if len(held) >= RECORDS or size > BYTES:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

    def packed(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    kind = ", ".join(f"{c} {'long' if t == pa.int64() else t}" for c, t in kinds)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, kind)


def resolved(headers: DataFrame, least: int = 0, order: tuple[Column, ...] = ()) -> DataFrame:
    """Adds `original`, a struct of key, record_id, uri, date, file and offset, to the records of read_archives whose payload another record
    holds; null for all others. The last response by `order` (record_id if none is given, and where it ties) holds the payload of its digest.
    Other responses of the digest with at least `least` bytes, and revisit records that declare it, refer to it; of a revisit whose digest no
    response has nothing is known. One original for each digest comes from partial aggregates; a digest that a third of all records share is
    split by adaptive execution in the join."""
    web, again = F.col("record_type") == "response", F.col("record_type") == "revisit"
    by = F.struct(*order, F.col("record_id"), F.col("file"), F.col("offset"))
    original = F.struct(*[F.col(c) for c in ("key", "record_id", "uri", "date", "file", "offset")])
    held = headers.where(web).groupBy(F.col("payload_digest").alias("_sl_digest")).agg(F.max_by(original, by).alias("_sl_held"))
    digests = F.when(web & (F.col("payload_bytes") >= least), F.col("payload_digest")).when(again, F.regexp_replace("declared_digest", "^sha1:", ""))
    own = headers.withColumn("_sl_digest", digests)
    asking = own.where("_sl_digest is not null").join(held, "_sl_digest", "left")
    other = (F.col("_sl_held.file") != F.col("file")) | (F.col("_sl_held.offset") != F.col("offset"))
    asking = asking.withColumn("original", F.when(other, F.col("_sl_held"))).drop("_sl_held", "_sl_digest")
    return asking.unionByName(own.where("_sl_digest is null").drop("_sl_digest"), allowMissingColumns=True)


def fresh_id(file: Column, offset: Column) -> Column:
    return urn(F.lit("deduplicated"), file, offset)


def deduplicate_archives(spark: SparkSession, source: str, target: str, least: int = 0, order: tuple[Column, ...] = (), compression: str = "gzip") -> None:
    """Writes the archives below `source` to `target` with every payload held once: other responses become revisit records that refer to its
    holder, and older revisit records refer to it too. All records get fresh headers; HTTP heads stay. `least` and `order` as in `resolved`;
    records of other types are copied as they are. Payloads stay in place while the table of revisits can be broadcast (a checked size);
    beyond that they are shuffled once, unsorted."""
    found = materialise(resolved(read_archives(spark, source), least, order).where("original is not null").select("file", "offset", "original"))
    records = read_archives(spark, source, payload=True).join(sized(found.hint("shuffle_hash")), ["file", "offset"], "left")
    again = F.col("original").isNotNull()
    fresh = fresh_id(F.col("original.file"), F.col("original.offset"))
    fields = {
        "WARC-Type": F.when(again, F.lit("revisit")).otherwise(F.col("record_type")),
        "WARC-Record-ID": fresh_id(F.col("file"), F.col("offset")),
        "WARC-Date": F.col("date"),
        "WARC-Target-URI": F.col("uri"),
        "WARC-X-Key": F.col("key"),
        "WARC-Payload-Digest": F.when(F.col("record_type") == "revisit", F.col("declared_digest")).otherwise(F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        "WARC-Profile": F.when(F.coalesce(F.col("record_type"), F.lit("")).isin("revisit") | again, F.lit(PROFILE)),
        "WARC-Refers-To": F.when(again, fresh).otherwise(F.col("refers_to")),
        "WARC-Refers-To-Target-URI": F.when(again, F.col("original.uri")).otherwise(F.col("refers_to_uri")),
        "WARC-Refers-To-Date": F.when(again, F.col("original.date")).otherwise(F.col("refers_to_date")),
        "Content-Type": F.col("content_type"),
    }
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))
    write_archives(records.select(record(fields, body, F.col("http")).alias("value")), target, compression)


def followed(headers: DataFrame) -> DataFrame:
    """The records of read_archives, those of revisits with payload_bytes and payload_digest of the response that they refer to and with
    its key as original_key (null for all others). A revisit of a record that is not there gets nulls."""
    revisits = headers.where("record_type = 'revisit'").drop("payload_digest", "payload_bytes")
    holders = headers.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest", "payload_bytes", F.col("key").alias("original_key"))
    rest = headers.where("record_type is distinct from 'revisit'").withColumn("original_key", F.lit(None).cast("string"))
    return rest.unionByName(revisits.join(holders, "refers_to", "left"))


def archived_pages(pages: DataFrame, least: int = 0, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archives pages, removes repeated payloads from the archives and reads the result back: followed records, the original being the one
    with the largest key. Null payloads are empty; null keys are the least; of rows with equal key and payload one is the original. An
    empty table gives no rows. Other columns are not read. Both sets of archives lie in the shared folder."""
    spark = pages.sparkSession
    first, second = (f"{shared_dir(spark)}/{uuid.uuid4().hex}" for _ in range(2))
    page = pages.select(F.col(key).alias("k"), F.col(uri).alias("u"), F.col(payload).alias("p"))
    write_archives(page.select(response(F.col("k"), F.col("u"), F.lit(date), F.col("p")).alias("value")), first)
    kind = dict(pages.dtypes)[key]
    deduplicate_archives(spark, first, second, least, (F.col("key").cast(kind),))
    return followed(materialise(read_archives(spark, second)))
