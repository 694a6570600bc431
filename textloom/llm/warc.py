"""WARC files of pages, and reading them back by boundary-chain verification.

Every task lists the places in its split that look like a record, with the offset of the successor that the record's own length gives. Chains are
shortened inside the split, then over splits by pointer jumping from the start of each file; only records on such a chain count, so a record's magic inside a payload is no boundary.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, new_path, stage_table, text_or_empty

#: Up to so many repeated payloads (about 100 bytes each) are broadcast to the pages; beyond it they are joined.
BROADCAST_PAYLOADS = 200_000
SPLIT_BYTES = 4 << 20
#: Bytes behind a split that are read with it; where a header ends later, more is read until it ends.
HEADER_BYTES = 64 << 10
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d{1,18})[ \t]*(?=\r\n)", re.IGNORECASE)
HEX_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
NO_ID = "none"


def sha1_base32(text: Column) -> Column:
    digest = F.sha1(text.cast("binary"))
    part = lambda k: F.translate(F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0"), HEX_DIGITS, BASE32)
    return F.concat(*map(part, range(4)))


def record_id(ident: Column) -> Column:
    h = F.md5(ident)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def with_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``_id, _url, _html, _digest, _bytes, _first``: the smallest page_id with that payload, null where none repeats or the payload is under least_bytes."""
    rows = pages.select(F.col("page_id").cast("long").alias("_id"), F.col("url").cast("string").alias("_url"), text_or_empty("html").alias("_html"))
    rows = rows.withColumn("_digest", sha1_base32(F.col("_html"))).withColumn("_bytes", F.octet_length("_html").cast("long"))
    own = rows.where(F.col("_bytes") >= least_bytes).groupBy(F.col("_digest").alias("_d"), F.col("_bytes").alias("_b")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = stage_table(own.where("_n > 1 AND _first IS NOT NULL").select("_d", "_b", "_first"), "payloads")
    few = firsts.count() <= BROADCAST_PAYLOADS
    return rows.join(F.broadcast(firsts) if few else firsts, (F.col("_digest") == F.col("_d")) & (F.col("_bytes") == F.col("_b")), "left").drop("_d", "_b")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """A WARC record for each row of pages(page_id, url, html), in the partitions they are in.

    Of rows with equal payloads that of the smallest page_id is a response (all rows that share that id), the others revisit it. A null html is an empty payload; a
    null page_id has no number, and revisits if its payload has a numbered response; a null url is written as urn:none; extra columns are ignored.
    """
    rows = with_records(pages, least_bytes)
    again = F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    ident = F.coalesce(F.col("_id").cast("string"), F.lit(NO_ID))
    number, line = F.col("_bytes").cast("string"), lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), number, F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("_html")))
    refers = F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_id(F.col("_first").cast("string"))), line("WARC-Refers-To-Page", F.col("_first").cast("string")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(ident)),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("_url", r"[\r\n]+", " "), F.lit("urn:none"))),
        line("WARC-Page", ident),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Payload-Length", number),
        F.when(again, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def splits_of(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, size, begin`` for each split of the files under path; their contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    return files.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))))


def open_file(uri: str) -> pa.NativeFile:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return system.open_input_file(name)


class Headers:
    """Headers in the data of a file from begin on, which grows until a header ends; positions must ascend."""

    def __init__(self, file: pa.NativeFile, begin: int, n: int):
        file.seek(begin)
        self.file, self.data, self.end, self.length = file, file.read(n), -1, None

    def grow(self, n: int) -> bool:
        more = self.file.read(n)
        self.data += more
        return bool(more)

    def at(self, at: int) -> tuple[int, int] | None:
        """Sizes of the header that begins at at and of its block; None where it isn't a header."""
        if self.end < at:
            end, seen = self.data.find(b"\r\n\r\n", at), len(self.data)
            while end < 0 and self.grow(max(HEADER_BYTES, seen)):
                end, seen = self.data.find(b"\r\n\r\n", max(at, seen - 3)), len(self.data)
            if end < 0:
                return None
            self.end, self.length = end, LENGTH.search(self.data, at, end + 2)
        elif self.length and self.length.start() < at:
            self.length = LENGTH.search(self.data, at, self.end + 2)
        return (self.end + 4 - at, int(self.length[1])) if self.length else None


def candidates(splits: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, offset, exit``: where following successors from a candidate leaves its split; candidates whose chain breaks inside the split are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                end = min(row["begin"] + split_bytes, row["size"])
                found = []
                with open_file(row["file"]) as f:
                    headers = Headers(f, row["begin"], split_bytes + HEADER_BYTES)
                    for m in MAGIC.finditer(headers.data):
                        if m.start() >= split_bytes:
                            break
                        if sizes := headers.at(m.start()):
                            at = row["begin"] + m.start()
                            found.append((at, at + sum(sizes) + 4))
                leaves: dict[int, int] = {}
                for at, after in reversed(found):
                    if after >= end:
                        leaves[at] = after
                    elif after in leaves:
                        leaves[at] = leaves[after]
                yield pa.RecordBatch.from_arrays([pa.array([row["file"]] * len(leaves), pa.string()), pa.array(list(leaves), pa.int64()), pa.array(list(leaves.values()), pa.int64())], names=["file", "offset", "exit"])

    return splits.mapInArrow(run, "file string, offset long, exit long")


def entries(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``file, size, begin, entry``: the first record of each split that is reachable from the file's start.

    Jumps grow with the number of records, and compress so well that Spark would think them small: they are joined by merging at every size.
    """
    splits = stage_table(splits_of(spark, path, split_bytes), "splits")
    width = max(64, spark.sparkContext.defaultParallelism * 4)
    jump = stage_table(candidates(splits.repartition(width, "file", "begin"), split_bytes), "jumps")
    reached = splits.where("begin = 0").select("file", F.lit(0).cast("long").alias("offset"))
    longest = splits.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    rounds = math.ceil(math.log2(longest)) if longest > 1 else 0
    for k in range(rounds):
        more = reached.join(jump.hint("merge"), ["file", "offset"]).select("file", F.col("exit").alias("offset"))
        reached = stage_table(reached.union(more).distinct(), "reached")
        if k + 1 < rounds:
            ahead = jump.select("file", F.col("offset").alias("exit"), F.col("exit").alias("far"))
            jump = stage_table(jump.join(ahead.hint("merge"), ["file", "exit"]).select("file", "offset", F.col("far").alias("exit")), "jumps")
    own = reached.withColumn("begin", (F.floor(F.col("offset") / split_bytes) * split_bytes).cast("long")).groupBy("file", "begin").agg(F.min("offset").alias("entry"))
    out = stage_table(own.join(splits, ["file", "begin"]).select("file", "size", "begin", "entry"), "entries")
    drop_table(splits)
    return out


def read_warc(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record under path; a response whose payload has another digest than its header says raises."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    width = max(64, spark.sparkContext.defaultParallelism * 4)

    def records(row: dict) -> Iterator[tuple]:
        end = min(row["begin"] + split_bytes, row["size"])
        with open_file(row["file"]) as f:
            headers = Headers(f, row["begin"], split_bytes + HEADER_BYTES)
            at = row["entry"] - row["begin"]
            while row["begin"] + at < end:
                sizes = headers.at(at) if MAGIC.match(headers.data, at) else None
                if sizes is None:
                    raise ValueError(f"no WARC record at {row['begin'] + at} of {row['file']}")
                first, last = at + sizes[0], at + sum(sizes)
                if last > len(headers.data):
                    headers.grow(last - len(headers.data))
                data = headers.data
                head = dict(x.split(": ", 1) for x in data[at : at + sizes[0]].decode().split("\r\n")[1:] if ": " in x)
                payload = data[data.index(b"\r\n\r\n", first, last) + 4 : last]
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"the payload at {row['begin'] + at} of {row['file']} isn't what its digest says")
                size = len(payload) if kind == "response" else int(head["WARC-Payload-Length"])
                yield None if head["WARC-Page"] == NO_ID else int(head["WARC-Page"]), size, digest, kind, int(head["WARC-Refers-To-Page"]) if kind == "revisit" else None
                at = last + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                out = list(records(row))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return entries(spark, path, split_bytes).repartition(width, "file", "begin").mapInArrow(run, schema)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives into the shared folder and returns what reading them gives; an empty table gives an empty table, other cases are those of write_warc()."""
    path = new_path(pages.sparkSession, "warc")
    write_warc(pages, path, least_bytes)
    return read_warc(pages.sparkSession, path)


WARC_SQL = """
WITH own AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
coded AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  ((('0x' || substr(d, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER + 1, 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS f FROM own)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM coded
"""
