"""Content-addressed WARC archive.

At rest a payload lies once under its SHA-256, and record headers lie apart, exactly as they stand in a
WARC file. Records are put together again by a join on the digest and exported as WARC 1.1 files of a bounded
number of records; read_records() reads such files as streams, by Content-Length, and verifies each payload against
its header's digest. A task holds one record at a time, whatever the size of a file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, shared_path, stored

CRLF = "\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are always stored with their record.
LEAST = 100
#: Records of a file.
RECORDS = 20_000


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{CRLF}{name}: "), value)


def _urn(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(">"))


def store(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str = "1970-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """(headers, payloads), both written to the shared folder.

    headers: key, digest, record_type, header; a row per row of pages. payloads: digest, payload, first.
    Of rows with equal payloads of at least that many bytes, those with the smallest key are responses and the
    others revisit it; without any key all are responses. A null payload is empty; a null url has no header line,
    and line breaks in one are percent-encoded. Repeated rows give repeated records, and an empty table gives empty ones.
    Other columns are not read.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    payloads = stored(rows.groupBy("digest").agg(F.first("payload").alias("payload"), F.min("key").alias("first")), "payloads")
    rows = rows.select("key", "url", "digest", F.octet_length("payload").cast("long").alias("size"))
    rows = rows.join(payloads.select("digest", "first"), "digest")
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    rows = rows.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    clean = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat(
        F.lit("WARC/1.1"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", _urn(F.col("key"))),
        _line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", clean)).otherwise(""),
        F.when(again, F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _urn(F.col("first"))))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, "").otherwise(_line("Content-Type", F.lit("text/html"))),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(END),
    )
    headers = rows.select(F.col("key").alias(key), "digest", "record_type", header.cast("binary").alias("header"))
    return stored(headers, "headers"), payloads


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """header and block of each record: its payload for a response, nothing for a revisit."""
    full = headers.where("record_type = 'response'").join(payloads.select("digest", "payload"), "digest")
    full = full.select("header", F.col("payload").alias("block"))
    return full.union(headers.where("record_type = 'revisit'").select("header", F.lit(b"").alias("block")))


def export(made: DataFrame, path: str, compression: str = "gzip", most: int = RECORDS) -> None:
    """WARC files of at most that many records under path; what ends a record is the writer's separator."""
    lines = made.select(F.concat("header", "block").cast("string").alias("value"))
    lines.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(path)


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """A record at a time, from the pieces of whole files between separators.

    A block may hold separators, and one that ends in a line break shifts where the next are found, so records are cut from
    the bytes themselves. Where a file ends shifted, one separator too many stands before the next."""
    end = END.encode()
    rest = b""
    while True:
        while rest.startswith(end):
            rest = rest[len(end) :]
        if (stop := rest.find(end)) < 0:
            piece = next(pieces, None)
            if piece is None:
                if rest:
                    raise ValueError(f"a record's header doesn't end: {rest[:80]!r}")
                return
            rest += piece + end
            continue
        lines = rest[:stop].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record begins with {lines[0][:80]!r}")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        name, size = fields["warc-record-id"], int(fields["content-length"])
        held = [rest[stop + len(end) :]]
        lack = size + len(end) - len(held[0])
        while lack > 0:
            if (piece := next(pieces, None)) is None:
                raise ValueError(f"{name}: the file ends within the block")
            held.append(piece + end)
            lack -= len(held[-1])
        whole = b"".join(held)
        block, rest = whole[:size], whole[size + len(end) :]
        if whole[size : size + len(end)] != end:
            raise ValueError(f"{name}: the block has not its Content-Length")
        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
            raise ValueError(f"{name}: the payload has another digest than its header says: {digest}")
        number = lambda x: None if x is None or x == "<urn:x-page:none>" else int(x[12:-1])
        yield number(name), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), digest, block


def read_records(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """key, url, record_type, refers_to, digest, size, and with blocks also block, of each record of the files under path.

    Files are as export() writes them, compressed (and so read whole, as a stream, by one task) or plain and of at most
    spark.sql.files.maxPartitionBytes. A digest or length that differs is an error. No files give no rows.
    """
    names = ["key", "url", "record_type", "refers_to", "digest", "size", "block"][: 7 if blocks else 6]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

        rows, held = [], 0
        for *head, block in _parse(x.as_py() for batch in batches for x in batch.column(0)):
            rows.append((*head, len(block), block) if blocks else (*head, len(block)))
            held += len(block) * blocks + 200
            if held > 4 << 20:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)

    pieces = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path).select(F.col("value").cast("binary").alias("piece"))
    schema = "key long, url string, record_type string, refers_to long, digest string, size long" + ", block binary" * blocks
    return mapped(pieces, run, schema)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Archives pages and reads the WARC files back: a row per record.

    key, payload_bytes and payload_digest of the full payload (a revisit has those of the response it refers to),
    record_type, refers_to. Keys are whole numbers or null; see store() for nulls, ties and repeated rows. An
    empty table gives an empty one.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    export(records(*store(pages, key, url, payload)), path)
    back = stored(read_records(spark, path, blocks=False), "records")
    full = back.where("record_type = 'response'")
    once = full.groupBy(F.col("key").alias("refers_to")).agg(F.first("size").alias("size"), F.first("digest").alias("found"))
    again = back.where("record_type = 'revisit'").drop("size").join(once, "refers_to")
    checked = F.when(F.col("digest") == F.col("found"), F.col("digest")).otherwise(F.raise_error(F.lit("a revisit refers to another payload")).cast("string"))
    columns = lambda digest: [F.col("key").alias(key), F.col("size").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to"]
    return full.select(*columns(F.col("digest"))).union(again.select(*columns(checked)))
