"""WARC archives with revisit resolution.

Headers (identifier, payload digest, payload length) are shuffled by digest; of equal payloads of at least `min_bytes`, the
record with the largest identifier is the response, and the others become revisit records that refer to it and hold no payload. Payloads
move only where the engine cannot send the list of revisits to them. Archives are written by Spark's own writer, so that lost tasks
are repeated and any store that Spark can write will do: a WARC record ends in two line ends, which is the writer's line separator.

Defined results: a null payload is empty; a null URL is written as 'about:blank'; control characters in a URL are percent-encoded. Rows that repeat the
largest identifier with the same payload are all responses. A null identifier is smaller than any other and never replaces one. An empty table gives an empty archive. Columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import shared_dir, staged

END = "\r\n\r\n"


def records_of(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    """A response record for every row: id, url, payload, payload_bytes, payload_digest (lower-case hex SHA-1)."""
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    return pages.select(
        F.col(record_id).cast("long").alias("id"),
        F.coalesce(F.col(url).cast("string"), F.lit("about:blank")).alias("url"),
        body.alias("payload"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha1(body.cast("binary")).alias("payload_digest"),
    )


def resolve_revisits(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """records with record_type and refers_to; a revisit's payload is empty, its length and digest are those of the full payload."""
    heads = records.select("id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    originals = heads.groupBy("payload_digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    again = heads.join(originals, "payload_digest").where(F.coalesce(F.col("id") != F.col("refers_to"), F.col("refers_to").isNotNull()))
    again = staged(again.select(F.col("id").alias("r_id"), F.col("payload_digest").alias("r_digest"), "refers_to").distinct(), "revisits")  # used once for each group of sizes
    out = records.join(again, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left").drop("r_id", "r_digest")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")).withColumn(
        "payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    )


def _record_uri(record_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws("|", F.lit("tideline"), F.coalesce(record_id.cast("string"), F.lit("")), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def formatted(resolved: DataFrame, date: str) -> DataFrame:
    """Each record as one WARC/1.1 text with fresh headers, without the two line ends that close it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.col("payload"))
    url = F.col("url")
    for c, to in ((r"\r", "%0D"), (r"\n", "%0A"), (r"\x00", "%00")):
        url = F.regexp_replace(url, c, to)
    revisit = F.col("record_type") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_uri(F.col("id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_uri(F.col("refers_to"), F.col("payload_digest")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Refers-To-Number: "), F.col("refers_to").cast("string"))),
        F.concat(F.lit("X-Record-Number: "), F.col("id").cast("string")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


#: Payload bytes of an archive, unpacked, unless a single record has more: a reader's task holds a whole archive.
FILE_BYTES = 256 << 20
#: Records up to each of these sizes are written together, each group with so many to a file as its largest size allows; larger ones have a file each.
SIZES = (16 << 10, 1 << 20, 64 << 20)


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES, sizes: Sequence[int] = SIZES) -> None:
    """Write gzip archives of at most file_bytes of payload; a larger record has one of its own. Groups of sizes without a record are not written.

    A revisit goes by its full payload's size, so that groups are known before the join.
    """
    size = F.col("payload_bytes")
    group = F.lit(len(sizes))
    for n, most in reversed(list(enumerate(sizes))):
        group = F.when(size <= most, n).otherwise(group)
    found = sorted(r[0] for r in resolved.select(group.alias("g")).distinct().collect())  # four rows at most
    for n in found or [0]:
        per_file = max(1, file_bytes // sizes[n]) if n < len(sizes) else 1
        rows = formatted(resolved.where(group == n), date).write.mode("append").option("lineSep", END).option("compression", "gzip")
        rows.option("maxRecordsPerFile", per_file).text(path)


def _parsed(raw: Iterator[bytes], with_payload: bool) -> Iterator[tuple]:
    """Records of one archive, given as blocks of bytes; lengths rule, so that payloads may hold anything."""
    have, at = b"", 0
    blocks = iter(raw)

    def more(n: int) -> bool:
        """Whether n bytes from `at` on are there, after taking further blocks where they are not; what lies before `at` is let go only then."""
        nonlocal have, at
        if len(have) - at < n:
            got, size = [have[at:]], len(have) - at
            while size < n and (block := next(blocks, None)) is not None:
                got.append(block)
                size += len(block)
            have, at = b"".join(got), 0
        return len(have) - at >= n

    while more(1):
        while (end := have.find(b"\r\n\r\n", at)) < 0:
            if not more(len(have) - at + 1):
                raise ValueError("an archive ends within a record's header")
        head = dict(line.split(": ", 1) for line in have[at:end].decode().split("\r\n")[1:])
        at, size = end + 4, int(head["Content-Length"])
        if not more(size + 4):
            raise ValueError("an archive ends within a record")
        split = have.index(b"\r\n\r\n", at) + 4
        http, body = have[at:split].decode(), have[split : at + size]
        at += size + 4
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        length = int(http.split("Content-Length: ")[1].split("\r\n")[0])
        if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != length):
            raise ValueError(f"payload and digest differ in {head['WARC-Record-ID']}")
        number, to = head.get("X-Record-Number"), head.get("X-Refers-To-Number")
        yield (number and int(number), head["WARC-Target-URI"], length, digest, kind, to and int(to), body.decode() if with_payload else None)


def _inflated(raw: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Blocks of an archive, unpacked as they are asked for; none has more than `step` bytes, however well it was packed."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof:
            held = member.unconsumed_tail
            given = held or view[at : at + step]
            if not len(given):
                raise ValueError("an archive ends within a gzip member")
            at += 0 if held else len(given)
            if block := member.decompress(given, step):
                yield block
        at -= len(member.unused_data)


COLUMNS = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of all archives under path, each response checked against its digest; a file is a task's unit."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for row in _parsed(_inflated(content.as_py()), with_payload):
                    rows.append(row)
                    held += len(row[6] or "")
                    if len(rows) >= 5000 or held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=names)

    return files.mapInArrow(read, COLUMNS)


def deduplicated_archive(pages: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 1000, path: str | None = None) -> str:
    """Write the pages as archives with revisits resolved; returns their folder."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(resolve_revisits(records_of(pages, record_id, url, payload), min_bytes), path)
    return path
