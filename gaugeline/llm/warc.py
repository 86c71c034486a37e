"""WARC archives: writing pages with revisit records for equal payloads, and a sequential reader.

An archive is a chain of gzip members, one per record. The reader walks it in order: it inflates in steps of ``STEP`` bytes,
so it holds one record at a time, cuts the record by its Content-Length, and checks block and payload digests.

Archives lie in the shared folder, which Arrow opens by itself. Of an ``s3a://`` folder it takes endpoint and region from the session's
``spark.hadoop.fs.s3a.endpoint`` and ``.endpoint.region``, and credentials from the executors' environment or instance role; ``hdfs://``
needs libhdfs there. A task writes its archives under names of its own and returns them as rows; only the
rows of the tasks that Spark counted as done are kept, so a repeated or speculative task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlencode

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.session import materialize, scratch_dir

STEP = 1 << 18
LEAST = 100  # smallest payload that is recorded as a revisit
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, sha256: str, first: int | None) -> bytes:
    """One record: a response with the payload, or a revisit (``first`` given) with only its HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = "".join(c for c in url or "" if c not in "\r\n") or "about:blank"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {_sha1(block)}", f"WARC-Payload-Digest: sha256:{sha256}", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{first}')}>", f"X-Refers-To-Page-Id: {first}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after another."""
    inflate, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(STEP)
        rest = b""
        if not data:
            break
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            rest, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and the block of one record; its length and block digest are checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is not its Content-Length")
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"] != _sha1(block):
        raise ValueError("the block does not match its digest")
    return fields, block


def s3_settings(spark: SparkSession) -> str:
    """Endpoint and region of the session's S3 settings, as Arrow takes them behind an address."""
    scheme, mark, host = spark.conf.get("spark.hadoop.fs.s3a.endpoint", "").rpartition("://")
    given = {"endpoint_override": host, "scheme": scheme if mark else "", "region": spark.conf.get("spark.hadoop.fs.s3a.endpoint.region", "")}
    return urlencode({k: v for k, v in given.items() if v})


def place(uri: str, settings: str = "") -> str:
    """The address of a folder or file as Arrow spells it."""
    scheme, mark, rest = uri.partition("://")
    if not mark:
        return f"file://{uri}"
    if scheme not in ("s3", "s3a", "s3n"):
        return uri
    return f"s3://{rest}?{settings}" if settings else f"s3://{rest}"


def _write(folder: str, settings: str):
    def run(batches):
        files, path = fs.FileSystem.from_uri(place(folder, settings))
        name, n, out = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                for row in range(batch.num_rows):
                    page, url, html, sha, first = (batch.column(c)[row].as_py() for c in range(5))
                    if out is None:
                        files.create_dir(path, recursive=True)
                        out = files.open_output_stream(name, compression=None)
                    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
                    out.write(squeeze.compress(record(page, url, (html or "").encode(), sha, first)) + squeeze.flush())
                    n += 1
        finally:
            if out is not None:
                out.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n], pa.int64())], ["archive", "records"])

    return run


def _read(settings: str):
    def run(batches):
        for batch in batches:
            for uri, records in zip(*(batch.column(c).to_pylist() for c in ("archive", "records"))):
                files, path = fs.FileSystem.from_uri(place(uri, settings))
                n, rows = 0, []
                with files.open_input_stream(path, compression=None, buffer_size=STEP) as stream:
                    for raw in members(stream):
                        fields, block = parse(raw)
                        head, _, body = block.partition(b"\r\n\r\n")
                        kind, sha = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                        said = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        if kind == "response" and (len(body) != said or hashlib.sha256(body).hexdigest() != sha):
                            raise ValueError("the payload does not match its digest")
                        page, first = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), said, sha, kind, None if first is None else int(first), fields["warc-target-uri"], body if kind == "response" else None))
                        n += 1
                        if len(rows) == 256:
                            yield _rows(rows)
                            rows = []
                if n != records:
                    raise ValueError(f"{uri} holds {n} records, not {records}")
                if rows:
                    yield _rows(rows)

    return run


_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _rows(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes an archive per partition below the shared folder and returns ``archive, records``, one row per archive. Runs jobs.

    Of records with equal payloads of at least 100 bytes, the one with the smallest id is a response and the others revisit
    it; all smaller payloads are responses. Null html is an empty payload. Records with a null id are responses, as are
    further rows of the id that is the response of its payload. Other columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").alias("html"))
    sha = F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256)
    large = rows.where(f"octet_length(html) >= {LEAST} and page is not null").select("page", sha.alias("sha"))
    # First the digests with more than one page, combined before the shuffle; then the pages that revisit, without any html.
    firsts = materialize(large.groupBy("sha").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first != last").select("sha", "first"), "firsts")
    again = materialize(large.join(firsts, "sha").where("page != first").distinct(), "revisits")
    marked = rows.withColumn("sha", sha).join(again, ["page", "sha"], "left").select("page", "url", "html", "sha", "first")
    folder = scratch_dir(pages.sparkSession, "warc")
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    return materialize(marked.mapInArrow(_write(folder, s3_settings(pages.sparkSession)), "archive string, records long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """Records of ``archives(archive, records)``: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload``.

    One task reads whole archives from start to end. A damaged archive, a wrong digest or a missing record raises. A revisit has
    no payload; its length and digest are those of the full payload, as its HTTP header and record header give them.
    """
    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 2, "archive").mapInArrow(_read(s3_settings(archives.sparkSession)), _SCHEMA)
