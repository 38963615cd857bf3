"""WARC archives written and read as tables of record chunks.

A payload longer than ``CHUNK_CHARS`` is written as WARC segments: a first record and
continuations, each a row of (record, chunk). Reading gives the same rows back, and digests of
segmented payloads are carried from chunk to chunk, so no step holds a whole record.

Archives are written by Spark's text writer, a row per record and the blank lines that end a
record as row ends. They are read back by the start of the next record. That start never stands
inside a payload: there the payload is cut into two segments, in the middle of it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm.common import utf8
from cartulary.session import scratch_root

CHUNK_CHARS = 256 << 10
MIN_REVISIT_BYTES = 100
_VERSION = "WARC/1.1"
_END = "\r\n\r\n"


def chunks(payload: Column, chars: int = CHUNK_CHARS) -> Column:
    """The payload in pieces of at most ``chars`` characters, none of which starts a record."""
    pieces = F.split(payload, r"(?<=WA)(?=RC/1\.1\r\n)", -1)
    return F.flatten(
        F.transform(
            pieces,
            lambda p: F.transform(
                F.sequence(F.lit(0), F.greatest((F.char_length(p) - 1) / chars, F.lit(0)).cast("int")),
                lambda i: F.substr(p, i * chars + 1, F.lit(chars)),
            ),
        )
    )


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in a value become spaces."""
    clean = F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit("\r\n")), F.lit(""))


def _record_id(row: Column, segment: Column | None = None) -> Column:
    parts = [F.lit("<urn:record:"), row["page"].cast("string"), F.lit(":"), row["row"].cast("string")]
    if segment is not None:
        parts += [F.lit(":"), segment.cast("string")]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts], F.lit(">"))


def record_rows(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    chunk_chars: int = CHUNK_CHARS,
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """The chunk table: ``record``, ``chunk`` and the text of a WARC record for it.

    Of payloads equal in all bytes and at least ``min_revisit_bytes`` long, the one with the
    smallest id is a response, the others are revisits of it without a payload. Of rows that
    repeat an id one is the response and the others revisit it. Null payloads are empty; null
    ids and urls leave their header out, and a null id counts as the smallest.
    """
    payload = F.coalesce(F.col(payload_column), F.lit(""))
    rows = pages.select(
        F.struct(
            F.col(id_column).alias("page"), F.monotonically_increasing_id().alias("row")
        ).alias("record"),
        F.col(url_column).alias("url"),
        payload.alias("payload"),
        F.sha2(payload.cast("binary"), 256).alias("digest"),
    )
    large = F.octet_length("payload") >= min_revisit_bytes
    firsts = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.min("record").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    typed = rows.join(firsts, "digest", "left").select(
        "*", (large & F.col("first").isNotNull() & (F.col("record") != F.col("first"))).alias("again")
    )
    cut = typed.select(
        "record",
        "url",
        "digest",
        "again",
        F.col("first"),
        F.octet_length("payload").alias("length"),
        F.when(F.col("again"), F.array(F.lit(""))).otherwise(chunks(F.col("payload"), chunk_chars)).alias("chunks"),
    ).select("*", F.size("chunks").alias("n"), F.posexplode("chunks").alias("chunk", "block"))
    number = F.col("chunk") + 1
    start, several = F.col("chunk") == 0, F.col("n") > 1
    kind = (
        F.when(F.col("again"), F.lit("revisit")).when(start, F.lit("response")).otherwise(F.lit("continuation"))
    )
    head = F.concat(
        F.lit(f"{_VERSION}\r\n"),
        _header("WARC-Type", kind),
        _header("WARC-Record-ID", F.when(start, _record_id(F.col("record"))).otherwise(_record_id(F.col("record"), number))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Page-ID", F.col("record.page")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Refers-To", F.when(F.col("again"), _record_id(F.col("first")))),
        _header(
            "WARC-Profile",
            F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        _header("WARC-Segment-Number", F.when(several, number)),
        _header("WARC-Segment-Origin-ID", F.when(~start, _record_id(F.col("record")))),
        _header("WARC-Segment-Total-Length", F.when(several & (number == F.col("n")), F.col("length"))),
        _header("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return cut.select("record", "chunk", F.concat(head, F.col("block")).alias("value"))


def write_archives(rows: DataFrame, path: str | None = None) -> str:
    """Write chunk rows as compressed archives into a new folder and return it."""
    folder = path or f"{scratch_root(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows.select("value").write.option("lineSep", _END).option("compression", "gzip").text(folder)
    return folder


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table of archives: a row per WARC record with its headers and its block.

    Columns: ``record`` (the id of the record or of the one it continues), ``chunk`` from 0,
    ``record_type``, ``page_id``, ``url``, ``digest``, ``refers_to`` (a record id), ``several``
    and ``block``.
    """
    lines = spark.read.option("lineSep", f"{_END}{_VERSION}\r\n").text(path)
    head = F.substring_index("value", _END, 1)
    split = lines.select(
        F.concat(F.lit("\r\n"), head, F.lit("\r\n")).alias("head"),
        F.substr("value", F.char_length(head) + 5).alias("rest"),
    )

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"\r\n{name}: ([^\r]*)\r\n", 1)
        return F.when(F.instr("head", f"\r\n{name}: ") > 0, found)

    length = field("Content-Length").cast("int")
    segment = field("WARC-Segment-Number").cast("int")
    return split.select(
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
        F.coalesce(segment - 1, F.lit(0)).alias("chunk"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        field("WARC-Refers-To").alias("refers_to"),
        segment.isNotNull().alias("several"),
        # The last record of an archive still has the end of a record behind it.
        F.when(F.octet_length("rest") > length, F.substr("rest", F.lit(1), F.char_length("rest") - 4))
        .otherwise(F.col("rest"))
        .alias("block"),
    )


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths and digests of segmented payloads from sorted chunks, one chunk at a time."""
    record, state, length = None, None, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"record": [record], "payload_bytes": pa.array([length], pa.int64()), "payload_digest": [state.hexdigest()]}
        )

    for batch in batches:
        for name, block in zip(batch.column("record").to_pylist(), utf8(batch.column("block")), strict=True):
            if name != record:
                if state:
                    yield out()
                record, state, length = name, hashlib.sha256(), 0
            state.update(block)
            length += len(block)
    if state:
        yield out()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row per page: ids, url, ``payload_bytes``, ``payload_digest``, type and ``refers_to``.

    Length and digest are computed from what the archives hold, for revisits from the response
    they refer to; ``refers_to`` is that response's page. Payloads of one chunk are digested where
    they are read; chunks of segmented ones are brought together in order.
    """
    rows = read_chunks(spark, path)
    whole = rows.where("not several and record_type = 'response'").select(
        "record",
        F.octet_length("block").cast("long").alias("payload_bytes"),
        F.sha2(F.col("block").cast("binary"), 256).alias("payload_digest"),
        "page_id",
        "url",
    )
    many = (
        rows.where("several")
        .select("record", "chunk", "block")
        .repartition("record")
        .sortWithinPartitions("record", "chunk")
        .select("record", "block")
        .mapInArrow(_carried, "record string, payload_bytes long, payload_digest string")
    )
    heads = rows.where("several and chunk = 0").select("record", "page_id", "url")
    responses = whole.unionByName(many.join(heads, "record"))
    again = rows.where("record_type = 'revisit'").select(
        F.col("page_id"), F.col("url"), F.col("refers_to").alias("record")
    )
    targets = responses.select("record", "payload_bytes", "payload_digest", F.col("page_id").alias("target"))
    first = responses.select(
        "page_id", "url", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    return first.unionByName(
        again.join(targets, "record").select(
            "page_id", "url", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"),
            F.col("target").alias("refers_to"),
        )
    )
