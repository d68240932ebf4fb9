"""WARC archives written from and read into a chunked record table.

A record's payload is a run of rows (record, chunk_no, data) of at most CHUNK bytes, so
neither writer nor reader holds a whole payload: the writer feeds each record's gzip
member chunk by chunk, the reader inflates and emits chunk by chunk, carrying the
SHA-256 of the payload so far in each row.

Of records with equal payloads of at least SAME bytes, that of the smallest page id is
the response and the others revisit it: they keep the HTTP header, with the length, and
the digest.  Shorter payloads are always responses.  Rows repeating that smallest id
with the same payload are responses as well.

The digest that a record's header needs before its payload is Spark's, of the html that
the table holds in one value; all after it goes by chunks.

Null html is an empty payload, a null url becomes about:blank, control characters and
spaces in urls are percent-encoded.  Page ids are whole numbers; a null one comes after
all others and is read back as null.  An empty table gives no records.  Other columns,
also of the names used here, are not read.  File names carry the writing attempt and only listed files count, so a
task that runs again leaves no double.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenstrand.llm import repeats, scratch
from evenstrand.llm.tokenfile import file_system
from evenstrand.ship import ship

CHUNK = 1 << 16
SAME = 100
URN = "urn:x-page:"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunk_table(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """Rows page, no_id, url, digest, size, kind, refers_to, chunk_no, last, data; a record's rows follow one another."""
    records = pages.select(
        repeats.doc_key(id_col).alias("page"),
        F.col(id_col).isNull().alias("no_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    firsts = records.where(F.col("size") >= SAME).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = records.join(scratch.table(firsts, "payloads"), "digest", "left")
    revisit = (F.col("first") != F.col("page")) & (F.col("size") >= SAME)
    marked = joined.select("page", "no_id", "url", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"), "payload")
    kept = F.when(F.col("kind") == "response", F.col("size")).otherwise(0)
    count = F.greatest(F.lit(1), F.ceil(kept / chunk)).cast("int")
    piece = lambda i: F.when(F.col("kind") == "response", F.substring("payload", i * chunk + 1, F.lit(chunk))).otherwise(F.lit("").cast("binary"))
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("chunk_no"), (i == count - 1).alias("last"), piece(i).alias("data")))
    # the payload ends here: rows hold their chunk alone
    return marked.select("page", "no_id", "url", "digest", "size", "kind", "refers_to", F.explode(chunks).alias("x")).select("page", "no_id", "url", "digest", "size", "kind", "refers_to", "x.chunk_no", "x.last", "x.data")


def _name(page: int | None) -> str:
    return f"<{URN}{'null' if page is None or page == repeats.NO_ID else page}>"


def _header(row: dict) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] else "about:blank"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['size']}\r\n\r\n".encode()
    revisit = row["kind"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['kind']}",
        f"WARC-Record-ID: {_name(None if row['no_id'] else row['page'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(row['refers_to'])}"] if revisit else []),
        f"Content-Length: {len(http) + (0 if revisit else row['size'])}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


def write_archives(chunks: DataFrame, out: str) -> DataFrame:
    """Write the chunk table as .warc.gz files, one gzip member per record; gives the list of files and their record counts."""
    ship(chunks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = file_system(out)
        system.create_dir(folder, recursive=True)
        file, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0
        with system.open_output_stream(f"{folder}/{file}", compression=None) as sink:
            info = f"software: evenstrand\r\nfilename: {file}\r\n".encode()
            member = zlib.compressobj(6, zlib.DEFLATED, 31)
            sink.write(member.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n") + member.flush())
            for batch in batches:
                for i in range(batch.num_rows):  # a row at a time: a chunk, never a whole payload
                    row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                    if not row["chunk_no"]:
                        member = zlib.compressobj(6, zlib.DEFLATED, 31)
                        sink.write(member.compress(_header(row)))
                    sink.write(member.compress(row["data"]))
                    if row["last"]:
                        sink.write(member.compress(b"\r\n\r\n") + member.flush())
                        records += 1
        yield pa.RecordBatch.from_pydict({"file": [f"{out}/{file}"], "records": pa.array([records], pa.int64())})

    return scratch.table(chunks.mapInArrow(run, "file string, records long"), "archives").where("records > 0")


class _Inflate:
    """The bytes of a file of gzip members, asked for in pieces."""

    def __init__(self, source):
        self.source, self.raw, self.ready, self.member = source, b"", b"", None
        self.offset = 0  # of the member that the next record starts

    def more(self) -> bool:
        while True:
            if self.member is None or self.member.eof:
                if self.member is not None:
                    self.raw = self.member.unused_data
                if not self.raw:
                    self.raw = self.source.read(1 << 16)
                if not self.raw:
                    return False
                self.member = zlib.decompressobj(31)
            elif not self.raw:
                self.raw = self.source.read(1 << 16)
                if not self.raw:
                    raise ValueError("archive ends within a record")
            got = self.member.decompress(self.raw, 1 << 16)
            self.raw = b"" if self.member.eof else self.member.unconsumed_tail
            if got:
                self.ready += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """The bytes up to mark; None at the end of the file."""
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                if self.ready:
                    raise ValueError("archive ends within a header")
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.ready and not self.more():
                raise ValueError("archive ends within a block")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(name: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", name or "")
    return int(m[1]) if m else None


SCHEMA = "file string, record_no long, page_id long, url string, record_type string, refers_to long, payload_bytes long, declared_digest string, chunk_no int, last boolean, digest_so_far string, data binary"


def read_archives(spark: SparkSession, files: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives.

    A record has a row per chunk; the last has last = true, and for a response the whole
    payload's digest in digest_so_far.  payload_bytes is the full payload's length, of
    revisits too.  without with_data, only last rows come, and without data.
    """
    ship(spark)
    paths = files.select("file").repartition(max(1, files.count()), "file")
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def records(source, file: str) -> Iterator[dict]:
        stream, number = _Inflate(source), 0
        while (head := stream.until(b"\r\n\r\n")) is not None:
            warc = _fields(head)
            left = int(warc["content-length"])
            if warc["warc-type"] not in ("response", "revisit"):
                for _ in stream.take(left + 4):
                    pass
                continue
            raw = stream.until(b"\r\n\r\n")
            http = _fields(raw)
            left -= len(raw) + 4
            revisit = warc["warc-type"] == "revisit"
            base = {"file": file, "record_no": number, "page_id": _page(warc["warc-record-id"]), "url": warc["warc-target-uri"], "record_type": warc["warc-type"], "refers_to": _page(warc.get("warc-refers-to")), "payload_bytes": int(http["content-length"]) if revisit else left, "declared_digest": warc["warc-payload-digest"].removeprefix("sha256:")}
            digest, held, n, total = hashlib.sha256(), [], 0, 0
            for part in stream.take(left):
                while part:
                    some, part = part[: chunk - total], part[chunk - total :]
                    held.append(some)
                    total += len(some)
                    digest.update(some)
                    left -= len(some)
                    if total == chunk and left:
                        if with_data:
                            yield base | {"chunk_no": n, "last": False, "digest_so_far": digest.hexdigest(), "data": b"".join(held)}
                        held, total, n = [], 0, n + 1
            yield base | {"chunk_no": n, "last": True, "digest_so_far": None if revisit else digest.hexdigest(), "data": b"".join(held) if with_data else None}
            for _ in stream.take(4):
                pass
            number += 1

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                system, name = file_system(file)
                with system.open_input_stream(name, compression=None) as source:
                    rows, size = [], 0
                    for row in records(source, file):
                        rows.append(row)
                        size += len(row["data"] or b"") + 200
                        if size > 4 * chunk:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return paths.mapInArrow(run, SCHEMA).select(*names)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write_archives(chunk_table(pages), scratch.new_path(spark, "warc"))
    back = read_archives(spark, files).where("last")
    return back.select("page_id", "payload_bytes", F.coalesce("digest_so_far", "declared_digest").alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id = page_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
