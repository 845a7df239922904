"""Operator 7, WARC: seekable Zstandard bundles.

Records are grouped into independent Zstandard frames.  A bundle is a file of such frames,
then two skippable frames: the record map (record id, frame, offset in the frame, length)
and, last, the seek table of the public Zstandard seekable format.  A reader takes the seek
table from the end of the open file, finds a record in the map, and reads only its frame.

Payloads of at least ``REVISIT_BYTES`` bytes that occur more than once are stored once, with
the largest page id; the other records are revisits of it.  The owner of a payload is found by
an aggregation (combined on the map side) and joined back; hot payloads are salted by page.

Tasks write bundles under names no other attempt uses, and the table of written bundles is
committed by Spark's own writer.  Bundles of lost or repeated attempts are not in that table,
and the reader leaves their records out.

Defined results: null html is an empty payload; a null page id is smaller than any other and
written as ``null``; rows that repeat the owner's id and payload are all responses; a null url
has no target header; an empty table gives no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from secspark.llm.common import NO_ID, key_id, scratch, table

REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
TASK_BUNDLES = 16
SALTS = 32
DATE = "2026-01-01T00:00:00Z"
MAP_MAGIC = 0x184D2A50
# Fixed values of the public seekable format.
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = ("bundle string, page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, url string, payload binary")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and the id each record refers to (null: a response)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    owners = (rows.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest", "bytes")
                  .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
                  .filter("n > 1 and owner is not null")
                  .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(owners.drop("n"), ["digest", "bytes", "salt"], "left")
    refers = F.when(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return joined.withColumn("refers_to", refers).select(
        key_id("page_id").alias("page_id"), "url", "payload", "digest", key_id("refers_to").alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "null" else int(text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)),
            ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="/:?#[]@!$&'()*+,;=%~")))
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_record(raw: bytes) -> dict:
    """Fields of one record; raises ValueError if it is damaged."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload does not fit its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": page_of(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest,
            "record_type": kind, "refers_to": None if refers is None else page_of(refers),
            "url": fields.get("WARC-Target-URI"), "payload": payload if kind == "response" else None}


class BundleWriter:
    """Collects records into frames and writes one bundle."""

    def __init__(self, stream):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=3)
        self.records: list[bytes] = []
        self.pending = self.written = 0
        self.seek: list[tuple[int, int]] = []
        self.places: list[tuple[str, int, int, int]] = []

    def add(self, name: str, record: bytes) -> None:
        self.places.append((name, len(self.seek), self.pending, len(record)))
        self.records.append(record)
        self.pending += len(record)
        if self.pending >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.records:
            frame = self.packer.compress(b"".join(self.records))
            self.stream.write(frame)
            self.seek.append((len(frame), self.pending))
            self.written += len(frame)
            self.records, self.pending = [], 0

    def close(self) -> None:
        self.flush()
        places = self.packer.compress(json.dumps(self.places).encode())
        self.stream.write(struct.pack("<II", MAP_MAGIC, len(places)) + places)
        self.seek.append((len(places) + 8, 0))
        table = b"".join(struct.pack("<II", *s) for s in self.seek)
        self.stream.write(struct.pack("<II", SEEK_MAGIC, len(table) + 9) + table
                          + struct.pack("<IBI", len(self.seek), 0, FOOTER_MAGIC))
        self.stream.close()


class Bundle:
    """Random access to a bundle: an open file is read at its end first, then only where wanted records are."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, io.SEEK_END)
        n, _, magic = struct.unpack("<IBI", self.part(size - 9, size))
        if magic != FOOTER_MAGIC:
            raise ValueError("no seek table")
        sizes = struct.iter_unpack("<II", self.part(size - 9 - 8 * n, size - 9))
        self.frames, at = [], 0
        for packed, _ in sizes:
            self.frames.append((at, at + packed))
            at += packed
        start, stop = self.frames.pop()
        self.places = json.loads(zstandard.ZstdDecompressor().decompress(self.part(start + 8, stop)))

    def part(self, start: int, stop: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(stop - start)

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.part(*self.frames[k]))

    def records(self, wanted: set[str] | None = None) -> Iterator[bytes]:
        """The records (only those with wanted ids), reading each frame once and only if needed."""
        held, raw = -1, b""
        for name, k, offset, length in self.places:
            if wanted is None or name in wanted:
                if k != held:
                    held, raw = k, self.frame(k)
                yield raw[offset:offset + length]


def reachable(out: str) -> str:
    """A folder as pyarrow wants it: with a full scheme, or an absolute path."""
    return out if "://" in out or out.startswith("/") else out.replace("file:", "", 1)


def write_archives(pages: DataFrame, out: str) -> DataFrame:
    """Write one record per row into bundles under ``out/bundles``; returns the committed bundle table."""
    def write(batches):
        files, root = arrow_fs.FileSystem.from_uri(out)
        files.create_dir(f"{root}/bundles", recursive=True)
        writer, name, n = None, "", 0
        done = []
        for pdf in batches:
            for page_id, url, payload, digest, refers in pdf.itertuples(index=False):
                if writer is None:
                    name, n = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = BundleWriter(files.open_output_stream(f"{root}/bundles/{name}", compression=None))
                page_id = None if page_id == NO_ID else int(page_id)
                refers = None if refers == NO_ID else int(refers)
                writer.add(record_id(page_id), record_bytes(page_id, url, bytes(payload), digest, refers))
                n += 1
                if writer.written >= BUNDLE_BYTES:
                    writer.close()
                    done.append((name, n))
                    writer = None
        if writer is not None:
            writer.close()
            done.append((name, n))
        yield pd.DataFrame(done, columns=["bundle", "n_records"])

    spark = pages.sparkSession
    out = reachable(out)
    schema = "bundle string, n_records long"
    plan_records(pages).mapInPandas(write, schema).write.parquet(f"{out}/committed")
    return spark.read.schema(schema).parquet(f"{out}/committed")


def read_archives(spark: SparkSession, out: str, ids: list[int | None] | None = None) -> DataFrame:
    """All records of the committed bundles, or only those of some page ids (a short list).

    Tasks get names of bundles and open them themselves: of each they read the seek table, the record
    map and the frames that hold wanted records.
    """
    out = reachable(out)
    wanted = None if ids is None else {record_id(i) for i in ids}

    def table_of(bundle: str, rows: list[dict]) -> pd.DataFrame:
        columns = {k: [r[k] for r in rows] for k in ("page_id", "payload_bytes", "payload_digest", "record_type",
                                                     "refers_to", "url", "payload")}
        return pd.DataFrame({"bundle": bundle} | columns | {
            k: pd.array(columns[k], "Int64") for k in ("page_id", "refers_to")}, index=range(len(rows)))

    def parse(batches):
        files, root = arrow_fs.FileSystem.from_uri(out)
        for pdf in batches:
            for name in pdf["bundle"]:
                with files.open_input_file(f"{root}/bundles/{name}") as stream:
                    rows, size = [], 0
                    for raw in Bundle(stream).records(wanted):
                        rows.append(read_record(raw))
                        size += len(raw)
                        if size >= BATCH_BYTES:
                            yield table_of(name, rows)
                            rows, size = [], 0
                    if rows:
                        yield table_of(name, rows)

    committed = spark.read.schema("bundle string").parquet(f"{out}/committed")
    n = committed.count()
    if not n:
        return spark.createDataFrame([], RECORDS)
    tasks = min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // TASK_BUNDLES))
    return committed.repartition(tasks).mapInPandas(parse, RECORDS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"), out)
    return read_archives(spark, out).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
     o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN
                       max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS owner FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner IS NOT NULL AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM o
"""
