"""Operator 9: WARC revisit resolution.

Records are rows (record_id, record_type, url, date, digest, content_type, http_head, payload and what
a record says of the one it refers to: refers_to, refers_to_url, refers_to_date; all but the first five may
be missing). Only headers are shuffled, by payload digest: of a digest's responses the first (date, then
record_id) is the original, later ones are the same payload again and become revisits, and
revisit records are joined to the original. Records of other types (request, metadata,
warcinfo, resource, conversion) stay what they are. Records get fresh headers (a new WARC-Record-ID derived
from the old one; WARC-Refers-To, -Target-URI and -Date of the original as written) and are
written as gzip members of one archive for each partition. HTTP heads are kept as they came, also in
revisits; payloads are bytes and are never decoded.

Payloads are read once more and never leave their scan: each header carries the number of its
input partition, the decisions are written in one folder for each partition, and the task that reads
the partition again reads that folder. So ``records`` must have the same partitions whenever
it is read, as a table does; a record that isn't met again fails the job.

A revisit whose digest no response has is unresolved: it is written with what it says of its
original, if anything. A reference to a record of the input gets that record's new id.

``read_archives`` reads archives back, member by member. Archives are written under another
name and renamed, so a repeated task replaces an archive by the same records.

Defined results: a response with a null payload counts as one with an empty payload; records without a digest
(null) are never the same as another; repeated rows with one record_id are one record (the
first by partition), and records without an id are left out; of two responses with one digest and date
the one with the lesser id is the original; very long payloads are written one at a time; an
empty table gives no archive and an empty result; further columns are ignored. The test tables
have no archives, so ``captures`` makes records of ``pages``: a response for each page, and for
each a later visit that found the same payload.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = ["record_id", "record_type", "url", "date", "digest", "refers_to", "refers_to_url", "refers_to_date"]
_BODY = ["content_type", "http_head", "payload"]
_HTTP = "application/http; msgtype=response"
_INDEX = "record_id string, file string, offset bigint, length bigint"


def _urn(c: Column) -> Column:
    h = F.md5(c)
    parts = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(c.isNotNull(), F.concat(F.lit("urn:uuid:"), parts))  # concat_ws skips nulls


def captures(pages: DataFrame) -> DataFrame:
    """A response and a later revisit for each page."""
    day = lambda days: F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)) + F.lit(86_400 * days)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    digest = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("html", F.lit("")), 256))
    key = F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")))
    payload = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    row = lambda kind, days: pages.select(
        _urn(F.concat(F.lit(kind + " "), key)).alias("record_id"), F.lit(kind).alias("record_type"), "url", day(days).alias("date"), digest.alias("digest"), F.lit(_HTTP).alias("content_type"),
        (head if kind == "response" else F.lit(None).cast("string")).alias("http_head"), (payload if kind == "response" else F.lit(None).cast("binary")).alias("payload"),
    )
    return row("response", 0).unionAll(row("revisit", 30))


def _whole(records: DataFrame) -> DataFrame:
    """All columns of a record, those that are missing as null."""
    kind = lambda c: "binary" if c == "payload" else "string"
    return records.select(*((F.col(c) if c in records.columns else F.lit(None)).cast(kind(c)).alias(c) for c in _HEADERS + _BODY))


def _decisions(records: DataFrame) -> DataFrame:
    """Fresh headers, and the input partition of each record."""
    one = _whole(records).where("record_id is not null").select(F.spark_partition_id().alias("part"), *_HEADERS)
    h = one.groupBy("record_id").agg(F.min(F.struct("part", *_HEADERS[1:])).alias("h")).select("record_id", "h.*")
    first = h.where("record_type = 'response' and digest is not null").groupBy("digest").agg(F.min(F.struct("date", "record_id", "url")).alias("o"))
    # what has no digest or reference gets a key of its own, so nulls don't meet in one task
    own = lambda c: F.coalesce(c, F.concat(F.lit("none "), "record_id"))
    both = h.withColumn("k", own("digest")).join(first.withColumnRenamed("digest", "k"), "k", "left")
    known = h.select(F.col("record_id").alias("known"))
    both = both.withColumn("r", own("refers_to")).join(known, F.col("r") == F.col("known"), "left")
    response = F.col("record_type") == "response"
    again = (F.col("record_type") == "revisit") | (response & F.col("o").isNotNull() & (F.col("o.record_id") != F.col("record_id")))
    found = again & F.col("o").isNotNull()
    fresh = lambda c: _urn(F.concat(F.lit("fresh "), c))
    return both.select(
        "part",
        fresh(F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("old_id"),
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        "url",
        "date",
        "digest",
        F.when(found, fresh(F.col("o.record_id"))).when(F.col("known").isNotNull(), fresh(F.col("refers_to"))).otherwise(F.col("refers_to")).alias("refers_to"),
        F.when(found, F.col("o.url")).otherwise(F.col("refers_to_url")).alias("refers_to_url"),
        F.when(found, F.col("o.date")).otherwise(F.col("refers_to_date")).alias("refers_to_date"),
    )


def resolved(records: DataFrame) -> DataFrame:
    """Fresh headers: (record_id, old_id, record_type, url, date, digest, refers_to, refers_to_url, refers_to_date)."""
    return _decisions(records).drop("part")


def record_bytes(r: dict) -> bytes:
    """One WARC record, not compressed."""
    head = r["http_head"].rstrip("\r\n").encode() + b"\r\n\r\n" if r["http_head"] is not None else b""
    kind, payload = r["record_type"], r["payload"] or b""
    block = head if kind == "revisit" else head + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Target-URI", r["url"]), ("WARC-Date", r["date"]), ("WARC-Payload-Digest", r["digest"])]
    if kind == "revisit":
        fields.append(("WARC-Profile", PROFILE))
    fields += [("WARC-Refers-To", f"<{r['refers_to']}>" if r["refers_to"] else None), ("WARC-Refers-To-Target-URI", r["refers_to_url"]), ("WARC-Refers-To-Date", r["refers_to_date"])]
    fields += [("Content-Type", r["content_type"] or (_HTTP if head else "application/octet-stream")), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields if v)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _decided(where: str, part: int) -> dict[str, dict]:
    """The decisions of one input partition, by the record's old id."""
    files, path = fs.FileSystem.from_uri(where)
    path = f"{path}/part={part}"
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    rows = pq.read_table(path, filesystem=files, partitioning=None).to_pylist()
    return {r["old_id"]: r for r in rows}


def _write(folder: str, decisions: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        todo = _decided(decisions, part)
        if not todo:
            return
        at, where, path = 0, *fs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}.warc.gz"
        temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
        where.create_dir(path, recursive=True)
        with where.open_output_stream(temporary) as out:
            for b in C.slices(batches, "payload"):
                index = []
                for old_id, *body in zip(*(b.column(c).to_pylist() for c in ("record_id", *_BODY))):
                    if (r := todo.pop(old_id, None)) is None:
                        continue
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(record_bytes(r | dict(zip(_BODY, body)))) + z.flush()
                    out.write(data)
                    index.append((r["record_id"], name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array([i[k] for i in index], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["record_id", "file", "offset", "length"])
        if todo:
            raise RuntimeError(f"{len(todo)} records of partition {part} are not there when it is read again; write the records as a table first")
        where.move(temporary, f"{path}/{name}")

    return run


def write_archives(records: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """(fresh headers, place of each record, folder) of the written archives."""
    spark = records.sparkSession
    folder = C.uri(spark, folder or C.shared_dir(spark) + "-warc")
    decisions = C.shared_dir(spark) + "-decisions"
    _decisions(records).repartition("part").write.partitionBy("part").parquet(decisions)
    C.on_exit(spark, decisions)
    index = C.written(_whole(records).select("record_id", *_BODY).mapInArrow(_write(folder, decisions), _INDEX), "places")
    schema = ", ".join(f"{c} string" for c in ("record_id", "old_id", *_HEADERS[1:]))
    return spark.read.schema(schema).parquet(decisions).drop("part"), index, folder


def _members(stream) -> Iterator[bytes]:
    """Uncompressed gzip members of a stream."""
    z, held = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            held.append(z.decompress(data))
            data = z.unused_data
            if z.eof:
                yield b"".join(held)
                z, held = zlib.decompressobj(31), []
    if any(held):
        raise ValueError("the archive ends within a record")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    h = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(h.get("content-length", 0))]
    kind = h.get("warc-type")
    of = lambda k: h[k].strip("<>") if k in h else None
    http = None
    if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http") and block:
        http, _, block = block.partition(b"\r\n\r\n")
    return {
        "record_id": of("warc-record-id"), "record_type": kind, "url": h.get("warc-target-uri"), "date": h.get("warc-date"), "digest": h.get("warc-payload-digest"),
        "refers_to": of("warc-refers-to"), "refers_to_url": h.get("warc-refers-to-target-uri"), "refers_to_date": h.get("warc-refers-to-date"),
        "content_type": h.get("content-type"), "http_head": http.decode("utf-8", "replace") if http is not None else None, "payload": None if kind == "revisit" else block,
    }


def read_archives(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Records of .warc.gz files (payload as bytes), one task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("uri").to_pylist():
                where, path = fs.FileSystem.from_uri(uri)
                with where.open_input_stream(path, compression=None) as f:
                    held = []
                    for m in _members(f):
                        held.append(parse_record(m))
                        if len(held) == 256:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    schema = pa.schema([(c, pa.binary() if c == "payload" else pa.string()) for c in _HEADERS + _BODY])
    files = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, len(uris)))
    return files.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'payload' else 'string'}" for c in _HEADERS + _BODY))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh headers of all records of the archives written."""
    return write_archives(captures(C.table(spark, sf_dir, "pages")))[0]


_URN = "'urn:uuid:' || substr(md5({0}), 1, 8) || '-' || substr(md5({0}), 9, 4) || '-' || substr(md5({0}), 13, 4) || '-' || substr(md5({0}), 17, 4) || '-' || substr(md5({0}), 21, 12)"
_KEY = "coalesce(page_id::VARCHAR, '-') || ' ' || coalesce(url, '-')"
SQL = f"""
WITH record AS (
  SELECT {_URN.format("kind || ' ' || " + _KEY)} AS old_id, kind, url, strftime(make_timestamp((1700000000 + coalesce(page_id, 0) + 86400 * days) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS date,
    'sha256:' || sha256(coalesce(html, '')) AS digest
  FROM pages, (VALUES ('response', 0), ('revisit', 30)) v(kind, days)),
first AS (SELECT digest, date AS odate, old_id AS oid, url AS ourl FROM record WHERE kind = 'response' QUALIFY row_number() OVER (PARTITION BY digest ORDER BY date, old_id) = 1),
both_ AS (SELECT *, kind = 'response' AND oid = old_id AS original FROM record LEFT JOIN first USING (digest))
SELECT {_URN.format("'fresh ' || old_id")} AS record_id, old_id, CASE WHEN original THEN 'response' ELSE 'revisit' END AS record_type, url, date, digest,
  CASE WHEN NOT original THEN {_URN.format("'fresh ' || oid")} END AS refers_to, CASE WHEN NOT original THEN ourl END AS refers_to_url, CASE WHEN NOT original THEN odate END AS refers_to_date
FROM both_
"""
