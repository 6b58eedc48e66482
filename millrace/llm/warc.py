"""Content-addressed web archive: payload bytes once by digest, exact record heads beside them, joined to whole records."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import removed, shared_dir, table, text_chunks, written

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 1000
#: Records that meet one copy of their payload when they are read.
PART = 256
#: Rows of a digest from which its group goes to the records by broadcast: at least 1 / HOT of all rows, so HOT groups at most.
HOT = 100_000
#: Payload bytes that a Python worker restores at once; a larger payload is restored alone.
RESTORED_BYTES = 16 << 20
#: The time of capture of pages that have none.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _urn(*values: Column) -> Column:
    """A record id that depends on the values alone."""
    h = F.md5(F.to_json(F.struct(*values)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null value; line ends in a value are escaped, as they would end the line."""
    value = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_END)), F.lit(""))


def _head(date: str) -> Column:
    """The record's own head and that of its HTTP answer, up to where the payload begins."""
    revisit = F.col("kind") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("bytes")), F.lit(_END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    lines = [
        F.lit(f"WARC/1.1{_END}"), _line("WARC-Type", F.col("kind")), _line("WARC-Record-ID", F.col("urn")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("Page-ID", F.col("page")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Profile", F.when(revisit, F.lit(_PROFILE))), _line("WARC-Refers-To", F.when(revisit, F.col("of.urn"))), _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("of.url"))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))), _line("Refers-To-Page-ID", F.when(revisit, F.col("of.page"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")), _line("Content-Length", block), F.lit(_END), http,
    ]
    return F.concat(*lines)


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in text_chunks(batches, "payload"):
        yield pa.record_batch([batch.column("sha256"), pa.array([press.compress(v.as_buffer()) for v in batch.column("payload")], pa.binary())], names=["sha256", "payload"])


def _restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        first, size, own = 0, 0, []
        for row, v in enumerate(batch.column("payload")):
            own.append(press.decompress(v.as_buffer()))
            size += len(own[-1])
            if size >= RESTORED_BYTES or row == batch.num_rows - 1:
                yield pa.record_batch([batch.column("sha256").slice(first, len(own)), batch.column("head").slice(first, len(own)), pa.array(own, pa.binary())], names=["sha256", "head", "payload"])
                first, size, own = row + 1, 0, []


def store(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", date: str = DATE) -> None:
    """Writes the archive of all rows of pages: folder/payloads (sha256, copies, payload) and folder/records (sha256, part, head).

    A payload is kept once and compressed, under its SHA-256; that equal digests are equal payloads is verified by a second digest
    and the length, and an error stops the write.  Of the records with one payload of REVISIT_BYTES or more, that with
    the largest key (a null key is the least; of repeated rows, one) is a response, the others are revisits of it;
    smaller ones are all responses.  A null body is an empty payload, a null key or url has no header line, an empty
    table gives an empty archive; repeated rows keep a record each; extra columns are not read.  Line ends in a url
    are written as %0D and %0A.

    Groups of copies may be of any size: they are counted map-side, the largest go to their records by broadcast (at
    most HOT), and part deals the records of a payload so that at most about PART meet in the join of records().
    """
    own = pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload"))
    sha = F.unhex(F.sha2("payload", 256)).alias("sha256")
    rows = own.select(sha, F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"), "page", "url", F.monotonically_increasing_id().alias("row"))
    rows = written(rows.withColumn("urn", _urn(F.col("page"), F.col("url"), F.col("sha1"), F.col("row"))))
    groups = rows.groupBy("sha256").agg(F.count("*").alias("copies"), F.max(F.struct("page", "row", "url", "urn")).alias("of"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1"), F.min("bytes").alias("b0"), F.max("bytes").alias("b1"))
    same = (F.col("s0") == F.col("s1")) & (F.col("b0") == F.col("b1"))
    groups = written(groups.select("sha256", F.when(same, F.col("copies")).otherwise(F.raise_error(F.lit("two payloads have one digest")).cast("long")).alias("copies"), "of"))
    limit = max(PART, rows.count() // HOT)
    held = rows.join(F.broadcast(groups.where(F.col("copies") >= limit)), "sha256", "left")
    rest = held.where("copies is null").drop("copies", "of").join(groups.where(F.col("copies") < limit), "sha256")
    held = held.where("copies is not null").unionByName(rest)
    held = held.withColumn("kind", F.when((F.col("bytes") >= REVISIT_BYTES) & (F.col("row") != F.col("of.row")), "revisit").otherwise("response"))
    part = F.expr(f"pmod(xxhash64(row), (copies + {PART - 1}) div {PART})").alias("part")
    held.select("sha256", part, _head(date).alias("head")).write.parquet(f"{folder}/records")
    # Partial aggregates leave one copy a task of each payload.
    payloads = own.select(sha, F.col("payload").cast("string").alias("payload")).mapInArrow(_squeezed, "sha256 binary, payload binary").groupBy("sha256").agg(F.first("payload").alias("payload"))
    payloads.join(groups.select("sha256", "copies").hint("shuffle_hash"), "sha256").select("sha256", "copies", "payload").write.parquet(f"{folder}/payloads")
    removed(rows, groups)


def _field(name: str) -> Column:
    found = F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("head").rlike(rf"(?m)^{name}: "), found)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(head, payload) of every record of an archive: the bytes as they were, revisits with the payload that they repeat.

    Every payload is verified by its digest as it is restored; an error tells of a damaged one.
    """
    kept = spark.read.parquet(f"{folder}/payloads")
    kept = kept.select("sha256", "payload", F.explode(F.expr(f"sequence(0L, (copies + {PART - 1}) div {PART} - 1)")).alias("part"))
    found = spark.read.parquet(f"{folder}/records").join(kept, ["sha256", "part"]).select("sha256", "head", "payload").mapInArrow(_restored, "sha256 binary, head string, payload binary")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return found.select("head", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("binary")).alias("payload"))


def fields(found: DataFrame) -> DataFrame:
    """records() with what their heads say: record_id, record_type, target, page, refers_to (pages), digest, block_bytes."""
    http = F.instr("head", _END * 2)
    names = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target": "WARC-Target-URI", "page": "Page-ID", "refers_to": "Refers-To-Page-ID", "digest": "WARC-Payload-Digest"}
    found = found.withColumns({k: _field(v) for k, v in names.items()}).withColumn("digest", F.regexp_replace("digest", "^sha1:", ""))
    return found.withColumn("block_bytes", F.regexp_extract(F.substring(F.col("head"), F.lit(1), http + 1), r"(?m)^Content-Length: ([0-9]+)\r\n", 1).cast("long"))


def export(spark: SparkSession, folder: str, out: str, records_per_file: int = 10_000) -> None:
    """The archive as .warc text files: whole responses, revisits without payload; a file holds at most so many records."""
    block = F.when(F.col("head").contains(f"{_END}WARC-Type: revisit{_END}"), F.lit("")).otherwise(F.col("payload").cast("string"))
    # Every record ends with two line ends, which are the separator of the lines here.
    records(spark, folder).select(F.concat("head", block)).write.option("lineSep", _END * 2).option("maxRecordsPerFile", records_per_file).text(out)


def _parse(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"\r\nContent-Length: *([0-9]+)\r\n", data[at:end], re.I)[1])
        block = data[end : end + size]
        body = block.find(b"\r\n\r\n") + 4
        yield data[at : end + body].decode(), block[body:]
        at = end + size + 4


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            found = list(_parse(content.as_py()))
            yield pa.record_batch([pa.array([h for h, _ in found], pa.string()), pa.array([p for _, p in found], pa.binary())], names=["head", "payload"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(head, payload) of the records of .warc files as export() writes them; revisits have an empty payload.  A file is read
    by one task, so export() bounds its records."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_files, "head string, payload binary")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    store(table(spark, sf_dir, "pages"), folder)
    found = fields(records(spark, folder)).withColumn("sha1", F.sha1("payload"))
    sound = F.when(F.col("sha1") == F.col("digest"), F.col("sha1")).otherwise(F.raise_error(F.lit("a record's payload differs from its head")).cast("string"))
    return found.select(F.col("page").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), sound.alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {"op12_warc": op12_warc}
#: DuckDB has no SHA-1 of its own; tests/llm hold all columns against hashlib.
ORACLE: dict[str, str] = {}
