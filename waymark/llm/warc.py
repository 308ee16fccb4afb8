"""Web archives: captures written as WARC records, read back, and put together again.

A capture is written as three records: its response, or a revisit where an equal payload is
stored elsewhere in the archive, then the request and the metadata, which name the first by
WARC-Concurrent-To. `read_archive` gives a row for each record of any archive; `captures`
joins records through these names, in whichever direction they point, and gives one nested
row for each response, revisit or resource, with its requests, its metadata, and the
response that a revisit refers to.

Records are made by column expressions and written by Spark's text writer, so files appear
only when a task has committed them, on any file system. They are gzip files of whole
records. Reading goes by a stream of Hadoop's lines from one file to one task: of a file only
the open record is held, so a very long payload costs a few times its size, and an archive none. A
gzip file isn't split, so many files make many tasks; a file that Spark would split (an
uncompressed one above spark.sql.files.maxPartitionBytes) is refused.

Which payloads are stored once is found from their hashes alone, summed up before a shuffle.
A payload that a third of all rows have is one row of that table; where it is small by
its size on disk Spark sends it out, else it is joined, and Spark splits the large partition.
Revisits meet their response at SPREAD places, of which each has a copy of it.

Nulls: a payload counts as empty, a key or URI is left out of the records and comes back null.
White space and control characters of a URI become %20. Rows that agree in key, URI and
payload are the same record, under one name; each is written and gives a row. Of equal payloads with
the same largest key, the largest URI is the response; the other is a revisit. Empty tables give no records.
Other columns of the input are left out, whatever their names. Chunked or compressed bodies
of foreign archives stay as they are stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ._store import deleted, dropped, shared_dir, written
from ._workers import batchwise

#: Payloads of at least so many bytes are stored once.
LEAST = 1000
#: Bytes of payloads, and records, that a worker gives on together.
SLAB, ROWS = 1 << 22, 1 << 10
#: Places that the revisits of one response are joined at.
SPREAD = 32
#: Fixed values of the format.
VERSION, SEPARATOR = "WARC/1.1", "\r\n\r\n"
REQUEST_TYPE, RESPONSE_TYPE, FIELDS_TYPE = "application/http;msgtype=request", "application/http;msgtype=response", "application/warc-fields"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Kinds of records that stand for a capture.
MAIN = ("response", "revisit", "resource")

_PAIRS = "array<struct<name:string,value:string>>"
RECORD = f"file string, id string, type string, date string, uri string, concurrent_to array<string>, refers_to string, headers {_PAIRS}, http_head string, fields {_PAIRS}, complete boolean, digest_ok boolean, payload_bytes long, payload_digest string"


# --- writing


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record's text without the separator behind it; headers without a value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")) for name, value in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(SEPARATOR))
    return F.concat(F.lit(VERSION + "\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], size, block)


def _name(*parts: Column) -> Column:
    """A record's id, made of what it is about, so that a task that runs again gives the same."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))


def stored_once(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """content, key and uri of the response, for each payload of at least so many bytes that several rows have."""
    large = pages.filter(F.col("size") >= least)
    sums = large.groupBy("content").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "uri")).alias("first"))
    return sums.filter("n > 1").select("content", F.col("first.key").alias("first_key"), F.col("first.uri").alias("first_uri"))


def write_archive(pages: DataFrame, key: str, uri: str, payload: str, folder: str | None = None, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", media_type: str = "text/html; charset=utf-8") -> str:
    """The folder of an archive with a capture of each row. payload: a text or binary column."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit(""))
    own = pages.select(F.col(f"`{key}`").cast("string").alias("key_text"), F.col(f"`{key}`").alias("key"), F.regexp_replace(F.col(f"`{uri}`").cast("string"), r"[\x00-\x20\x7f]", "%20").alias("uri"), body.alias("body"))
    own = own.withColumns({"size": F.octet_length("body"), "content": F.sha2(F.col("body").cast("binary"), 256)})
    once = written(stored_once(own, least), "stored")
    # short payloads, of which many may be equal, have a place of their own in the join
    spread = F.when(F.col("size") >= least, F.col("content")).otherwise(F.xxhash64("key", "uri").cast("string"))
    # the response's key and URI may be null, so a mark tells whether there is one
    rows = own.withColumn("place", spread).join(once.withColumn("found", F.lit(True)).withColumnRenamed("content", "place"), "place", "left")
    again = F.col("found") & ~(F.col("key").eqNullSafe(F.col("first_key")) & F.col("uri").eqNullSafe(F.col("first_uri")))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False))).withColumn("sha1", F.concat(F.lit("sha1:"), F.sha1(F.col("body").cast("binary"))))
    own_name = _name(F.lit("capture"), F.col("key"), F.col("uri"), F.col("content"))
    rows = rows.withColumn("name", own_name).withColumn("first_name", _name(F.lit("capture"), F.col("first_key"), F.col("first_uri"), F.col("content")))
    again = F.col("again")
    head = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {media_type}\r\nContent-Length: "), F.col("size").cast("string"), F.lit(SEPARATOR))
    about = [("WARC-Date", date), ("WARC-Target-URI", F.col("uri"))]
    main = _record(
        [
            ("WARC-Type", F.when(again, "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("name")),
            *about,
            ("WARC-Profile", F.when(again, PROFILE)),
            ("WARC-Refers-To", F.when(again, F.col("first_name"))),
            ("WARC-Refers-To-Target-URI", F.when(again, F.col("first_uri"))),
            ("WARC-Payload-Digest", F.col("sha1")),
            ("Content-Type", RESPONSE_TYPE),
        ],
        F.concat(head, F.when(again, F.lit("")).otherwise(F.col("body"))),
    )
    path = F.coalesce(F.nullif(F.regexp_extract("uri", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.coalesce(F.regexp_extract("uri", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    asked = F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(SEPARATOR))
    joined = lambda kind: [("WARC-Type", kind), ("WARC-Record-ID", _name(F.lit(kind), F.col("name"))), *about, ("WARC-Concurrent-To", F.col("name"))]
    request = _record([*joined("request"), ("Content-Type", REQUEST_TYPE)], asked)
    facts = F.concat(F.coalesce(F.concat(F.lit("key: "), F.regexp_replace("key_text", r"[\r\n]", " "), F.lit("\r\n")), F.lit("")), F.lit("bytes: "), F.col("size").cast("string"), F.lit("\r\n"))
    metadata = _record([*joined("metadata"), ("Content-Type", FIELDS_TYPE)], facts)
    text = F.concat(main, F.lit(SEPARATOR), request, F.lit(SEPARATOR), metadata)
    rows.select(text.alias("value")).write.option("lineSep", SEPARATOR).option("compression", "gzip").text(folder)
    dropped(once)
    return folder


# --- reading


class Records:
    """Records of one file, from its bytes in order; only the open one is held."""

    def __init__(self, file: str):
        self.file, self.data, self.seen, self.head, self.size = file, bytearray(), 0, None, 0

    def feed(self, more: bytes) -> Iterator[tuple[list, bytes, bool]]:
        """Headers, block, and whether it is whole, of each record that ends in what came so far."""
        self.data += more
        while True:
            if self.head is None:
                skip = len(self.data) - len(self.data.lstrip(b"\r\n"))
                if skip:
                    del self.data[:skip]
                    self.seen = 0
                end = self.data.find(SEPARATOR.encode(), max(0, self.seen - 3))
                if end < 0:
                    self.seen = len(self.data)
                    return
                self.head, self.size = self._head(bytes(self.data[:end]))
                del self.data[: end + 4]
            if len(self.data) < self.size:
                return
            block, head = bytes(memoryview(self.data)[: self.size]), self.head
            del self.data[: self.size]
            self.head, self.seen = None, 0
            yield head, block, True

    def close(self) -> Iterator[tuple[list, bytes, bool]]:
        """The record that the file breaks off in."""
        if self.head is not None:
            yield self.head, bytes(self.data), False
        elif self.data.strip():
            yield self._head(bytes(self.data))[0], b"", False

    def _head(self, head: bytes) -> tuple[list, int]:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"{self.file}: no record begins with {first[:40]!r}")
        found = pairs(lines)
        size = next((v for k, v in found if k.lower() == "content-length"), "")
        if not size.isdigit():
            raise ValueError(f"{self.file}: a record has no length")
        return found, int(size)


def pairs(lines: list[str]) -> list[tuple[str, str]]:
    """Names and values of header lines; a line that begins with white space goes on with the one before."""
    found: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and found:
            found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            name, _, value = line.partition(":")
            found.append((name.strip(), value.strip()))
    return found


def row_of(file: str, headers: list, block: bytes, complete: bool) -> dict:
    """A record's row, payload included."""
    get = {k.lower(): v for k, v in reversed(headers)}
    kind, media = get.get("warc-type", ""), get.get("content-type", "").replace(" ", "").lower()
    head, payload = None, block
    if media.startswith("application/http"):
        end = block.find(SEPARATOR.encode())
        end = len(block) if end < 0 else end
        head, payload = block[:end].decode("utf-8", "replace"), block[end + 4 :]
    fields = pairs(block.decode("utf-8", "replace").split("\r\n")) if media.startswith(FIELDS_TYPE) else []
    sha1 = hashlib.sha1(payload, usedforsecurity=False)
    claim = get.get("warc-payload-digest", "").lower().removeprefix("sha1:")
    ok = None if not claim or kind == "revisit" else claim in (sha1.hexdigest(), base64.b32encode(sha1.digest()).decode().lower())
    named = lambda pairs: [{"name": k, "value": v} for k, v in pairs]
    return {
        "file": file, "id": get.get("warc-record-id"), "type": kind, "date": get.get("warc-date"), "uri": get.get("warc-target-uri"),
        "concurrent_to": [v for k, v in headers if k.lower() == "warc-concurrent-to"], "refers_to": get.get("warc-refers-to"), "headers": named(headers),
        "http_head": head, "fields": named(fields), "complete": complete, "digest_ok": ok, "payload_bytes": len(payload), "payload_digest": sha1.hexdigest(), "payload": payload,
    }


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archive's files (gzip, or small plain ones); payload: with its bytes.

    complete tells whether a record's length is there, digest_ok whether the payload has the digest
    that is claimed (null without a claim, and for revisits). A file that holds other things is an error.
    """
    lines = spark.read.option("lineSep", SEPARATOR).text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    schema = T.StructType.fromDDL(RECORD + (", payload binary" if payload else ""))
    arrow = to_arrow_schema(schema)

    def run(batches):
        stream, rows, size = Records(""), [], 0
        for batch in batches:
            for value, file, start in zip(*batch.columns, strict=True):
                if start.as_py():
                    raise ValueError(f"{file} is split; compress it or raise spark.sql.files.maxPartitionBytes")
                file = file.as_py()
                found = []
                if file != stream.file:
                    found += [(stream.file, *x) for x in stream.close()]
                    stream = Records(file)
                found += [(file, *x) for x in stream.feed(value.as_py() + SEPARATOR.encode())]
                for x in found:
                    rows.append(row_of(*x))
                    size += rows[-1]["payload_bytes"] if payload else 0
                    if not payload:
                        del rows[-1]["payload"]
                    if size >= SLAB or len(rows) >= ROWS:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
        rows += [row_of(stream.file, *x) for x in stream.close()]
        yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], arrow)

    return lines.mapInArrow(batchwise(run), schema)


def captures(records: DataFrame) -> DataFrame:
    """A nested row for each response, revisit and resource: main, requests, metadata and original.

    requests and metadata hold the distinct records of these kinds that name the main one by
    WARC-Concurrent-To or are named by it, in order of their ids; an id that no record has leads
    nowhere. original is the response that a revisit refers to, with fields of its metadata.
    """
    names = [c for c in records.columns if c not in ("concurrent_to",)]
    main = records.filter(F.col("type").isin(*MAIN))
    other = records.filter(F.col("type").isin("request", "metadata"))
    ahead = other.select(F.col("id").alias("other"), F.explode("concurrent_to").alias("capture"))
    back = main.select(F.explode("concurrent_to").alias("other"), F.col("id").alias("capture"))
    links = ahead.union(back).distinct()
    with_link = other.withColumnRenamed("id", "other").join(links, "other").withColumnRenamed("other", "id")
    own = F.struct(*names)
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("type") == kind, own)), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0))
    near = with_link.groupBy("capture").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = F.array().cast(near.schema["requests"].dataType)
    rows = main.select("id", F.struct(*names).alias("main")).join(near.withColumnRenamed("capture", "id"), "id", "left")
    rows = rows.select("id", "main", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata"))
    whole = rows.filter(F.col("main.type") == "response").select("id", F.struct("main.*", F.flatten("metadata.fields").alias("about")).alias("original"))
    # only revisits look for an original; those of one original are spread over SPREAD places
    again, rest = rows.filter(F.col("main.refers_to").isNotNull()), rows.filter(F.col("main.refers_to").isNull())
    again = again.withColumns({"refers_to": F.col("main.refers_to"), "spread": F.pmod(F.xxhash64("id"), F.lit(SPREAD))})
    named = again.select("refers_to").distinct()
    found = whole.withColumnRenamed("id", "refers_to").join(named, "refers_to", "left_semi").groupBy("refers_to").agg(F.first("original").alias("original"))
    found = found.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    again = again.join(found, ["refers_to", "spread"], "left").select("main", "requests", "metadata", "original")
    return again.unionByName(rest.select("main", "requests", "metadata"), allowMissingColumns=True)


def field(pairs: Column, name: str) -> Column:
    """The first value of a name."""
    return F.get(F.filter(pairs, lambda x: x["name"] == name), F.lit(0))["value"]


def digests(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the captures of an archive of pages, as read back."""
    spark = pages.sparkSession
    folder = write_archive(pages, key, uri, payload)
    records = written(read_archive(spark, folder, payload=False), "records")
    deleted(spark, folder)
    rows = captures(records)
    kind = dict(pages.dtypes)[key]
    full = lambda name: F.coalesce(F.col(f"original.{name}"), F.col(f"main.{name}"))
    out = rows.select(
        field(F.flatten("metadata.fields"), "key").cast(kind).alias(key),
        full("payload_bytes").alias("payload_bytes"),
        full("payload_digest").alias("payload_digest"),
        F.col("main.type").alias("record_type"),
        field(F.col("original.about"), "key").cast(kind).alias("refers_to"),
    )
    done = written(out, "captures")
    dropped(records)
    return done
