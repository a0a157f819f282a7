"""WARC archives as a table of payload chunks, written and read by Spark's text files.

A record's payload becomes rows (record, chunk number, bytes) of bounded size. The first chunk is the record itself,
the others are the standard's continuation records (WARC-Segment-Number, WARC-Segment-Origin-ID), so a payload of any
size crosses the writer in pieces. A record is one line of a text file whose line end is the standard's record end;
reading splits at a record end that a version line follows, so that one archive can be read by many tasks. Chunks are
cut so that no chunk holds that mark, nor makes it with the header's end before it or the record end behind it. Payloads of one chunk are digested by a column expression; those of more are
digested incrementally over their rows in chunk order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import scratch_path, written

VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
#: A chunk is cut inside this mark, after its first 6 characters; its line ends may be those around the chunk.
MARK = RECORD_END + VERSION
CUT = r"(?<=(?:\r\n\r\n|\A\r\n|\A)WA)(?=RC/1\.1(?:\r\n|\z))"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, chunk_bytes: int = 1 << 18) -> DataFrame:
    """One row per chunk: record_id, page_id, url, record_type, refers_to, payload_bytes, payload_digest, chunk_no, n_chunks, chunk.

    Null payloads are empty, an empty payload has one empty chunk. Of records with equal payloads of at least
    least_bytes, the one with the smallest id is the response and the others are revisits without payload; rows that
    repeat that id are responses too, a null id is never the smallest, and where all are null all are responses.
    The table of repeated payloads is written first, so that Spark knows its size and sends it to all tasks only
    where it is small; else the join shuffles.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("_payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("_payload").cast("long"), "payload_digest": F.sha2("_payload", 256)})
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    first = written(first.where("_n > 1 and _first is not null").drop("_n"), "payloads")
    rows = rows.join(first, "payload_digest", "left").withColumn("_row", F.monotonically_increasing_id())
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    record = F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_row").cast("string"), F.lit(">"))
    kind, refers = F.when(again, "revisit").otherwise("response"), F.when(again, F.col("_first"))
    rows = rows.withColumns({"record_type": kind, "refers_to": refers, "record_id": record, "_payload": F.when(again, F.lit(b"")).otherwise(F.col("_payload"))})
    head = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    # Places come before bytes: a task holds one chunk of a payload beside it, never all of them.
    marked = F.contains("_payload", F.lit(VERSION[:8].encode()))
    n = F.greatest(F.ceil(F.octet_length("_payload") / chunk_bytes), F.lit(1)).cast("int")
    plain = rows.where(~marked).select(*head, n.alias("n_chunks"), "_payload", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    plain = plain.select(*head, "n_chunks", "chunk_no", F.substring("_payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))
    # Payloads that hold a version line are cut at the mark too, which the ends of a chunk can make; a character is a byte there.
    pieces = F.expr(f"""
        flatten(transform(sequence(0, greatest(octet_length(_payload) - 1, 0) div {chunk_bytes}), i ->
            transform(split(decode(substring(_payload, cast(i * {chunk_bytes} + 1 as int), {chunk_bytes}), 'ISO-8859-1'), {_sql(CUT)}, -1), p -> encode(p, 'ISO-8859-1'))))
    """)
    cut = rows.where(marked).select(*head, pieces.alias("_chunks"))
    return plain.unionByName(cut.select(*head, F.size("_chunks").alias("n_chunks"), F.posexplode("_chunks").alias("chunk_no", "chunk")))


def _sql(pattern: str) -> str:
    return "r'" + pattern + "'"


def write_archives(chunks: DataFrame, path: str) -> None:
    """A folder of WARC 1.1 files, one per task, with a record per chunk. No shuffle."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    first = F.col("chunk_no") == 0
    revisit = F.col("record_type") == "revisit"
    http = F.when(first, F.lit(HTTP)).otherwise(F.lit(""))
    clean = F.regexp_replace("url", r"[\r\n]", " ")
    header = F.concat(
        F.lit(VERSION),
        line("WARC-Type", F.when(first, F.col("record_type")).otherwise("continuation")),
        line("WARC-Record-ID", F.when(first, F.col("record_id")).otherwise(F.concat(F.expr("substring(record_id, 1, length(record_id) - 1)"), F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">")))),
        F.lit("WARC-Date: 2000-01-01T00:00:00Z\r\n"),
        line("WARC-Target-URI", clean),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha256:"), F.col("payload_digest")))),
        line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Segment-Number", F.when(F.col("n_chunks") > 1, (F.col("chunk_no") + 1).cast("string"))),
        line("WARC-Segment-Origin-ID", F.when(~first, F.col("record_id"))),
        line("X-Segments", F.when(first, F.col("n_chunks").cast("string"))),
        line("X-Payload-Length", F.when(first, F.col("payload_bytes").cast("string"))),
        line("Content-Type", F.when(first, F.lit("application/http;msgtype=response"))),
        line("Content-Length", (F.octet_length("chunk") + F.octet_length(http)).cast("string")),
        F.lit("\r\n"),
        http,
    )
    record = F.concat(F.encode(header, "UTF-8"), F.col("chunk")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", RECORD_END).text(path)


def read_chunks(spark, path: str) -> DataFrame:
    """Records of the archives as they were written, a row per chunk, with the payload bytes that each holds."""
    body = F.col("value").cast("binary")
    lines = spark.read.option("lineSep", MARK).text(path).where("length(value) > 0")
    # The first record of a file still has its version line; the others lost it to the line end.
    lines = lines.select(F.when(F.startswith("value", F.lit(VERSION)), F.substring(body, F.lit(len(VERSION) + 1), F.octet_length(body))).otherwise(body).alias("raw"))
    head = F.substring_index(F.col("raw").cast("string"), RECORD_END, 1)
    lines = lines.select("raw", head.alias("head"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    first = field("WARC-Type") != "continuation"
    skip = F.octet_length("head") + len(RECORD_END) + F.when(first, len(HTTP)).otherwise(0)
    size = field("Content-Length").cast("int") - F.when(first, len(HTTP)).otherwise(0)
    return lines.select(
        F.when(first, field("WARC-Record-ID")).otherwise(field("WARC-Segment-Origin-ID")).alias("record_id"),
        F.nullif(F.regexp_extract("head", r"(?m)^WARC-Record-ID: <urn:x-page:([^:]*):", 1), F.lit("null")).alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        F.when(first, field("WARC-Type")).alias("record_type"),
        F.regexp_extract("head", r"(?m)^WARC-Refers-To: <urn:x-page:([^>]*)>", 1).alias("refers_to"),
        F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha256:(\w+)", 1).alias("header_digest"),
        field("X-Payload-Length").cast("long").alias("header_bytes"),
        F.coalesce(field("X-Segments").cast("int"), F.lit(0)).alias("n_chunks"),
        (F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)) - 1).alias("chunk_no"),
        F.substring("raw", skip + 1, size).alias("chunk"),
    )


RECORD = "record_id string, page_id string, url string, record_type string, refers_to string, header_digest string, header_bytes bigint, payload_bytes bigint, payload_digest string"


def read_archives(spark, path: str) -> DataFrame:
    """One row per record: page_id (text), url, record_type, refers_to (text), payload_bytes, payload_digest, intact.

    A response's size and digest come from the bytes read; a revisit's are those its header states. intact says that
    they agree with the header. Records of several chunks, and only these, are shuffled by record and digested chunk
    by chunk as they stream by.
    """
    chunks = read_chunks(spark, path)
    whole = chunks.where("n_chunks = 1").select(
        "record_id", "page_id", "url", "record_type", "refers_to", "header_digest", "header_bytes",
        F.when(F.col("record_type") == "revisit", F.col("header_bytes")).otherwise(F.octet_length("chunk").cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("header_digest")).otherwise(F.sha2("chunk", 256)).alias("payload_digest"),
    )
    parts = chunks.where("n_chunks <> 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    names = [f.split(" ")[0] for f in RECORD.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, running, size = None, None, 0
        kinds = [pa.int64() if n.endswith("_bytes") else pa.string() for n in names]

        def done() -> pa.RecordBatch:
            row = {**head, "payload_bytes": size, "payload_digest": running.hexdigest()}
            return pa.RecordBatch.from_arrays([pa.array([row[n]], k) for n, k in zip(names, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                record = batch.column("record_id")[i].as_py()
                if head is None or record != head["record_id"]:
                    if head is not None:
                        yield done()
                    head = {n: batch.column(n)[i].as_py() for n in names[:7]}
                    running, size = hashlib.sha256(), 0
                chunk = batch.column("chunk")[i].as_py()
                running.update(chunk)
                size += len(chunk)
        if head is not None:
            yield done()

    out = whole.unionByName(parts.mapInArrow(digest, RECORD))
    return out.select(
        "page_id", "url", "record_type", F.nullif("refers_to", F.lit("")).alias("refers_to"), "payload_bytes", "payload_digest",
        ((F.col("payload_bytes") == F.col("header_bytes")) & (F.col("payload_digest") == F.col("header_digest"))).alias("intact"),
    )


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes pages as archives in a new folder (of the scratch folder, or path) and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, intact. Options as for chunk_table(). Other
    columns of pages are not archived. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    id_type = pages.schema[options.get("id_col", "page_id")].dataType
    write_archives(chunk_table(pages, **options), path)
    out = read_archives(spark, path)
    return out.select(F.col("page_id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"), "url", "intact")
