"""WARC archives: writing captures as records, reading records, and assembling transactions.

Each capture becomes three records: the response (or a revisit of an equal payload), the request and a
metadata record, the last two naming the first through ``WARC-Concurrent-To``. Writing is a plain text
sink whose line separator is the record's end mark; reading frames records by ``Content-Length`` alone,
so payloads may hold anything, record heads included. Assembly joins the records of a transaction into
one nested row.

Defined results: a null payload is empty; a null URL is written as an empty target; equal payloads
shorter than ``least`` bytes stay responses, of longer ones the largest id is the response (every row of that id,
if it is repeated); null ids are written as empty ids and read back null;
columns other than those named are not read; an empty table gives an empty archive and an empty result.
A record cut off by the end of its file raises ``ValueError``. Archive files are bounded by bytes: pages of like size share
a file, very long ones have one of their own. Columns other than those named may bear any name.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.arrow import bound_batches, named
from tarn.plans.scratch import cut, scratch_path

END = "\r\n\r\n"
#: Payload bytes below which captures share a file, and how many do: readers hold one file at a time.
SIZES = ((1 << 16, 1000), (1 << 20, 64), (1 << 62, 1))
RECORDS = "record_id string, type string, concurrent_to array<string>, refers_to string, target string, date string, fields map<string,string>, block binary, block_sha1 string, block_bytes bigint"
MIME = "application/http; msgtype="
OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def repeated(pages: DataFrame, id_col: str, payload_col: str, least: int = 1000) -> DataFrame:
    """``(digest, response)`` of payloads of ``least`` bytes or more that several rows hold; the largest id is the response."""
    payload = named(payload_col).cast("string")
    rows = pages.where(F.octet_length(payload) >= least).select(F.sha1(payload).alias("digest"), named(id_col).alias("id"))
    return rows.groupBy("digest").agg(F.max("id").alias("response"), F.count("*").alias("n")).where("n > 1").select("digest", "response")


def choose_revisits(pages: DataFrame, first: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = 1000) -> DataFrame:
    """``(id, url, payload, digest, n_bytes, refers_to)``; ``refers_to`` names the response, of ``first``, that a revisit repeats."""
    payload = F.coalesce(named(payload_col).cast("string"), F.lit(""))
    rows = pages.select(named(id_col).alias("id"), named(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    long = rows.where(F.col("n_bytes") >= least).join(first, "digest", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("response")), F.col("response"))
    # short payloads, the many empty ones above all, do not meet under their digests
    short = rows.where(F.col("n_bytes") < least).withColumn("refers_to", F.lit(None).cast(first.schema["response"].dataType))
    return short.unionByName(long.withColumn("refers_to", refers).drop("response"))


def _record(kind, record_id: Column, block: Column, headers: list[tuple[str, Column]]) -> Column:
    lines = [F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), record_id, F.lit(">\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    lines += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*lines)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write three records a row below ``path`` as gzip archives, a folder for each class of ``SIZES``."""
    first, above = cut(repeated(pages, id_col, payload_col, least), "responses"), -1
    size = F.coalesce(F.octet_length(named(payload_col).cast("string")), F.lit(0))
    for below, captures in SIZES:
        some = choose_revisits(pages.where((size > above) & (size <= below)), first, id_col, url_col, payload_col, least)
        lines = some.select(_records(date).alias("value")).write.option("lineSep", END).option("compression", "gzip")
        lines.option("maxRecordsPerFile", captures).text(f"{path}/to-{below}")
        above = below


def _records(date: str) -> Column:
    """The three records of a row of ``choose_revisits``."""
    own = F.coalesce(F.col("id").cast("string"), F.lit(""))
    urn = lambda what, of: F.concat(F.lit(f"urn:x-capture:{what}:"), of)
    angled = lambda c: F.concat(F.lit("<"), c, F.lit(">"))
    target = ("WARC-Target-URI", F.coalesce(F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit("")))
    stamp = ("WARC-Date", F.lit(date))
    revisit = F.col("refers_to").isNotNull()
    main = _record(
        F.when(revisit, "revisit").otherwise("response"),
        urn("main", own),
        F.when(revisit, F.lit(OK)).otherwise(F.concat(F.lit(OK), "payload")),
        [
            target, stamp, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Payload-Bytes", F.col("n_bytes").cast("string")),
            ("WARC-Refers-To", F.when(revisit, angled(urn("main", F.col("refers_to").cast("string"))))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit(MIME + "response")),
        ],
    )
    concurrent = ("WARC-Concurrent-To", angled(urn("main", own)))
    request = _record(F.lit("request"), urn("request", own), F.lit("GET / HTTP/1.1\r\n\r\n"), [target, stamp, concurrent, ("Content-Type", F.lit(MIME + "request"))])
    about = F.concat(F.lit("capture-id: "), own, F.lit("\r\npayload-bytes: "), F.col("n_bytes").cast("string"), F.lit("\r\n"))
    metadata = _record(F.lit("metadata"), urn("metadata", own), about, [target, stamp, concurrent, ("Content-Type", F.lit("application/warc-fields"))])
    return F.concat_ws(END, main, request, metadata)


def parse(data: bytes):
    """Records of one archive, plain or gzip (one member or one a record), as (header pairs, block)."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data) + member.flush())
            if not member.eof:
                raise ValueError("a gzip member is cut off")
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        if data.startswith((b"\r\n", b"\n"), at):
            at += 1 + (data[at] == 13)
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record head at byte {at}")
        pairs = [line.split(":", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line]
        pairs = [(k.strip().lower(), v.strip()) for k, v in pairs]
        n = int(dict(pairs).get("content-length", 0))
        if end + 4 + n > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield pairs, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def _bare(value: str | None) -> str | None:
    return value.strip().strip("<>") if value is not None else None


SCHEMA = pa.schema(
    [
        ("record_id", pa.string()),
        ("type", pa.string()),
        ("concurrent_to", pa.list_(pa.string())),
        ("refers_to", pa.string()),
        ("target", pa.string()),
        ("date", pa.string()),
        ("fields", pa.map_(pa.string(), pa.string())),
        ("block", pa.binary()),
        ("block_sha1", pa.string()),
        ("block_bytes", pa.int64()),
    ]
)


def _row(pairs: list[tuple[str, str]], block: bytes, with_blocks: bool) -> dict:
    head = dict(pairs)
    if head.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    return {
        "record_id": _bare(head.get("warc-record-id")),
        "type": head.get("warc-type"),
        "concurrent_to": [_bare(v) for k, v in pairs if k == "warc-concurrent-to"],
        "refers_to": _bare(head.get("warc-refers-to")),
        "target": head.get("warc-target-uri"),
        "date": head.get("warc-date"),
        "fields": list(head.items()),
        "block": block if with_blocks else None,
        "block_sha1": hashlib.sha1(block).hexdigest(),
        "block_bytes": len(block),
    }


def read_archives(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """Every record below ``path``; files are read by Spark, from any store, each wholly in one task.

    ``block`` is the content after the HTTP head for HTTP records, else the whole block; it is null
    without ``with_blocks``, its digest and length are there all the same.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for pairs, block in parse(content.as_py()):
                    rows.append(_row(pairs, block, with_blocks))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    bound_batches(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``record_id, target, date, response, request, metadata``.

    The capture's main record is a response, revisit, resource or conversion. Requests and metadata join
    it where either names the other in ``WARC-Concurrent-To``; of several the smallest record id is kept.
    Metadata that names only the request reaches the main record through it.
    """
    main = records.where(F.col("type").isin("response", "revisit", "resource", "conversion"))
    side = records.where(F.col("type").isin("request", "metadata"))
    packed = lambda: F.struct("record_id", "type", "concurrent_to", "refers_to", "fields", "block", "block_sha1", "block_bytes")
    named = main.select(F.explode("concurrent_to").alias("side_id"), F.col("record_id").alias("main_id"))
    # a side record's key: the main record that names it, else what it names itself
    keyed = side.select(packed().alias("r"), F.explode_outer("concurrent_to").alias("names")).join(named, F.col("r.record_id") == F.col("side_id"), "left")
    keyed = keyed.select("r", F.coalesce("main_id", "names").alias("key"))
    asked = keyed.where("r.type = 'request'")
    requests = asked.groupBy("key").agg(F.min_by("r", "r.record_id").alias("request"))
    via = asked.groupBy(F.col("r.record_id").alias("key")).agg(F.min("key").alias("via"))
    noted = keyed.where("r.type = 'metadata'").join(via, "key", "left").withColumn("key", F.coalesce("via", "key"))
    notes = noted.groupBy("key").agg(F.min_by("r", "r.record_id").alias("metadata"))
    whole = main.select("record_id", "target", "date", packed().alias("response"))
    whole = whole.join(requests.withColumnRenamed("key", "record_id"), "record_id", "left").join(notes.withColumnRenamed("key", "record_id"), "record_id", "left")
    return whole


def captures(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write ``pages`` to archives, read them back and assemble: digest columns of every capture."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    whole = assemble(cut(read_archives(spark, path, with_blocks=False), "records"))  # the joins read the records four times
    revisit = F.col("response.type") == "revisit"
    head = F.col("response.fields")
    return whole.select(
        F.regexp_extract("record_id", r"main:(-?\d+)$", 1).try_cast("long").alias("page_id"),
        F.when(revisit, head["warc-payload-bytes"].try_cast("long")).otherwise(F.col("response.block_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_extract(head["warc-payload-digest"], "sha1:(.*)", 1)).otherwise(F.col("response.block_sha1")).alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.regexp_extract("response.refers_to", r"main:(-?\d+)$", 1).try_cast("long").alias("refers_to"),
        (F.col("request").isNotNull() & F.col("metadata").isNotNull()).alias("complete"),
        "target",
    )
