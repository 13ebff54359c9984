"""WARC archives: writing with revisits, and reading by boundary-chain verification.

A reader that looks for the magic at the start of a record also finds it inside
payloads.  Here every magic is a candidate with the offset of its successor, which
follows from its header; pointer jumping from the start of each file keeps the
candidates that the chain reaches, in a logarithmic number of joins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.runtime import materialise, new_path

LEAST = 1000                # bytes from which equal payloads are stored once
RECORDS = 4000              # records of a file
COPIES = 200_000            # repeated digests that are broadcast, about 60 bytes each
ID = "urn:page:"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
END = b"\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def revisits(pages: DataFrame, page: str, payload: str) -> DataFrame:
    """``pages`` with _digest, _size and _original: of equal payloads of at least
    ``LEAST`` bytes that with the largest id is the original of the others."""
    pages = pages.withColumn("_body", F.coalesce(F.col(payload), F.lit("")))
    pages = pages.withColumns({"_digest": F.sha1("_body"), "_size": F.octet_length("_body")})
    copies = pages.filter(F.col("_size") >= LEAST).groupBy("_digest").agg(F.max(page).alias("_last"), F.count("*").alias("_n"))
    copies = materialise(copies.filter("_n > 1").drop("_n"))
    if copies.count() <= COPIES:
        copies = F.broadcast(copies)
    return pages.join(copies, "_digest", "left").withColumn(
        "_original", F.when(F.coalesce(F.col(page) < F.col("_last"), F.col("_last").isNotNull()), F.col("_last"))).drop("_last")


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[x for line in lines for x in (F.lit(line) if isinstance(line, str) else line, F.lit("\r\n"))])


def write_archives(pages: DataFrame, path: str, page: str = "page_id", url: str = "url", payload: str = "html",
                   records: int = RECORDS) -> None:
    """Write a record for each row, in files of at most ``records`` records.

    A null payload is empty, a null url is left empty, a null id is kept as such
    and never an original.  Repeated ids stay; all rows with the largest id of
    equal payloads are responses.
    """
    rows = revisits(pages.select(page, url, payload), page, payload)
    again = F.col("_original").isNotNull()
    head = F.concat(F.lit(HTTP + "Content-Length: "), F.col("_size"), F.lit("\r\n\r\n"))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(again, head).otherwise(F.concat(head, F.col("_body")))
    header = F.concat(
        _lines("WARC/1.0", F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
               F.concat(F.lit("WARC-Record-ID: "), name(page)), "WARC-Date: 1970-01-01T00:00:00Z",
               F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"\s", "")),
               F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("_digest"))),
        F.when(again, _lines(f"WARC-Profile: {PROFILE}", F.concat(F.lit("WARC-Refers-To: "), name("_original")))).otherwise(""),
        _lines("Content-Type: application/http; msgtype=response",
               F.concat(F.lit("Content-Length: "), F.octet_length("_block")), ""))
    (rows.withColumn("_block", block).select(F.concat(header, F.col("_block")).alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records).text(path))


# --- reading -----------------------------------------------------------------

FIELDS = ("file string, at long, next long, size long, record_type string, page_id string, refers_to string, "
          "digest string, payload_bytes long, payload_digest string")


def _field(header: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?mi)^" + name + rb":[ \t]*([^\r\n]*?)[ \t]*\r?$", header)
    return found and found[1]


def parse(data: bytes, at: int) -> tuple | None:
    """The record at a magic: successor, type, id, reference, stated digest, payload's
    length and digest; None if it isn't a whole record."""
    stop = data.find(END, at)
    if stop < 0:
        return None
    header = data[at:stop]
    length = _field(header, b"Content-Length")
    if length is None or not length.isdigit():
        return None
    start, follows = stop + len(END), stop + len(END) + int(length) + len(END)
    if data[follows - len(END):follows] != END:
        return None
    kind = (_field(header, b"WARC-Type") or b"").decode("utf-8", "replace")
    texts = [(_field(header, f) or b"").decode("utf-8", "replace").strip("<>").removeprefix(ID).removeprefix("sha1:")
             for f in (b"WARC-Record-ID", b"WARC-Refers-To", b"WARC-Payload-Digest")]
    if kind != "response":
        return follows, kind, *texts, None, None
    body = data.find(END, start, follows - len(END))
    begin = body + len(END) if body >= 0 else start
    payload = memoryview(data)[begin:follows - len(END)]
    return follows, kind, *texts, len(payload), hashlib.sha1(payload).hexdigest()


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every magic in the files below ``path`` that heads a whole record, payloads' ones included."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = content.as_py()
                found = [(name, m.start(), r[0], len(data), *r[1:]) for m in MAGIC.finditer(data) if (r := parse(data, m.start()))]
                columns = list(zip(*found)) or [[]] * 10
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 [f.split()[0] for f in FIELDS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, FIELDS)


def reachable(found: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, next) on the chain from offset 0 of each file.

    Round k knows the first 2^k records of each file and, for every candidate, the
    one 2^k further on.
    """
    jumps = materialise(found.select("file", "at", F.col("next").alias("to")))
    reached = materialise(jumps.filter("at = 0").select("file", "at"))
    while True:
        more = materialise(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
                           .join(found.select("file", "at"), ["file", "at"], "left_semi"))
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = materialise(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("then").alias("to")))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, page_id, payload_bytes, payload_digest, record_type, refers_to, verified) per record.

    A revisit takes length and digest from the response it refers to, and is
    verified if that response has the digest that the revisit states; a response
    is verified if its payload has its stated digest.  Bytes after a broken record
    of a file are out of the chain's reach.
    """
    found = materialise(candidates(spark, path))
    records = found.join(reachable(found), ["file", "at"], "left_semi")
    first = (records.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"))
             .agg(F.max("payload_bytes").alias("_bytes")))
    whole = records.join(first, ["refers_to", "digest"], "left")
    own = F.col("record_type") == "response"
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).try_cast("long")
    return whole.select(
        "file", "at", number("page_id").alias("page_id"), F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
        F.when(own, F.col("payload_digest") == F.col("digest")).otherwise(F.col("_bytes").isNotNull()).alias("verified"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) in the shared folder and read the archives back."""
    path = new_path(pages.sparkSession)
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
