"""Deterministic sharded WARC writer, and a reader.

Records are range-sorted by page id into shards of about equal bytes, whose bounds follow from the data alone. A task writes a shard
as files of gzip members, one per record, and starts another file when the compressed size is reached. Headers and digests are made
anew from the payload; ids and dates are functions of the page, so the same pages give the same files, byte by byte.

Files are written under names of the attempt. What a task wrote is in a table that Spark commits, so a lost or repeated attempt leaves
at most files that no manifest names. A second job gives the files their final names and commits the manifest; it can be repeated.
Readers take what the manifest names. Files go through a file system that executors share, by its address.

Of pages with equal payloads of at least ``least_revisit`` bytes, the one with the smallest id is a response, the others revisit it;
pages without an id revisit one that has an id. Null payloads are empty, null addresses are made from the id. A page repeated in full
is written as often as it occurs, each time as the same kind of record. Other columns are not read; no pages make no files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.tables import materialise, new_path
from setscope.llm.common import fields, partitions

#: Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
SPACE_OF_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:page")
FILE_BYTES, LEAST_SHARD, MOST_SHARD, CELLS = 64 << 20, 1 << 20, 1 << 30, 4096
READ_BYTES = 1 << 20
MANIFEST = pa.schema(
    [("shard", pa.int32()), ("part", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
)
MANIFEST_SQL = "shard int, part int, temporary string, name string, records bigint, bytes bigint, sha256 string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_OF_IDS, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record: a response, or a revisit if it refers to a page. The HTTP head tells the payload's length in both."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    lines = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Page-ID": "" if page_id is None else page_id,
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{base32(hashlib.sha1(payload).digest())}",
        "WARC-Block-Digest": f"sha1:{base32(hashlib.sha1(block).digest())}",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        lines |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page": refers_to}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time or a name."""
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


class _File:
    """One file in the making, under its temporary name."""

    def __init__(self, store: fs.FileSystem, root: str, shard: int, part: int):
        self.shard, self.part, self.records, self.bytes, self.sum = shard, part, 0, 0, hashlib.sha256()
        self.name = f"shard-{shard:06d}-{part:04d}.warc.gz"
        self.temporary = f"temporary/{self.name}.{uuid.uuid4().hex}"
        self.stream = store.open_output_stream(f"{root}/{self.temporary}", compression=None)

    def add(self, packed: bytes) -> None:
        self.stream.write(packed)
        self.sum.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> tuple:
        self.stream.close()
        return self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sum.hexdigest()


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(MANIFEST.names, r, strict=True)) for r in rows], schema=MANIFEST)


def shard_bounds(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """First ids of the shards after the first, for ``(page_id, payload_bytes)``. Cells of ids that hold more than a shard are cut
    again into cells, so what the driver gets is bounded by the number of shards, not of pages."""
    low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
    todo, cells = [(low, high)] if low is not None else [], []
    while todo:
        lo, hi = todo.pop()
        width = (hi - lo) // CELLS + 1
        inside = sizes.filter(F.col("page_id").between(lo, hi))
        grouped = inside.groupBy(F.expr(f"(page_id - {lo}) div {width}").alias("cell")).agg(F.sum("payload_bytes").alias("n"))
        for cell, n in grouped.collect():
            first = lo + cell * width
            if n > shard_bytes and width > 1:
                todo.append((first, min(hi, first + width - 1)))
            else:
                cells.append((first, n))
    out, held = [], 0
    for first, n in sorted(cells):
        if held and held + n > shard_bytes:
            out.append(first)
            held = 0
        held += n
    return out


def write_warc(pages: DataFrame, folder: str, *, least_revisit: int = 0, shard_bytes: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; returns the committed manifest. Without ``shard_bytes`` there are about
    two shards for each partition."""
    spark = pages.sparkSession
    rows = fields(pages, page_id="bigint", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    narrow = materialise(
        rows.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("bigint").alias("payload_bytes")), "warc-digests"
    )
    total = narrow.agg(F.sum("payload_bytes")).first()[0] or 0
    shard_bytes = shard_bytes or min(MOST_SHARD, max(LEAST_SHARD, total // (2 * partitions(spark))))
    # A record's headers count like bytes of it, or many empty pages would be one shard.
    bounds = shard_bounds(narrow.select("page_id", (F.col("payload_bytes") + 512).alias("payload_bytes")), shard_bytes)
    first = narrow.filter(F.col("payload_bytes") >= least_revisit).groupBy("digest").agg(F.min("page_id").alias("first"))
    again = narrow.filter(F.col("payload_bytes") >= least_revisit).join(first, "digest")
    again = again.filter(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull()).select("page_id", "digest", "first").distinct()
    # Marks of revisits travel with the pages and sort before them, so the texts are shuffled once.
    marked = rows.select("page_id", F.sha1("html").alias("digest"), F.lit(None).cast("bigint").alias("first"), "url", "html")
    marks = again.select("page_id", "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    shard = F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col("page_id"))), F.lit(0)).cast("int")
    dealt = marked.unionByName(marks).withColumn("shard", shard)
    dealt = dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "digest", F.col("html").isNotNull())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/temporary")
        file, mark = None, (None, None, None)
        for b in batches:
            done = []
            for page_id, digest, refers_to, url, html, number in zip(*[b[c] for c in ("page_id", "digest", "first", "url", "html", "shard")], strict=True):
                page_id, digest, number = page_id.as_py(), digest.as_py(), number.as_py()
                if not html.is_valid:
                    mark = page_id, digest, refers_to.as_py()
                    continue
                if file is not None and (file.shard != number or file.bytes >= file_bytes):
                    done.append(file.close())
                    file = _File(store, root, number, file.part + 1 if file.shard == number else 0)
                file = file or _File(store, root, number, 0)
                refers = mark[2] if mark[:2] == (page_id, digest) else None
                file.add(member(record(page_id, url.as_py(), html.as_py().encode(), refers)))
            if done:
                yield _manifest(done)
        if file is not None:
            yield _manifest([file.close()])

    pending = materialise(dealt.mapInArrow(write, MANIFEST_SQL), "warc-pending")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for row in b.to_pylist():
                final = store.get_file_info(f"{root}/{row['name']}")
                if final.type == fs.FileType.NotFound or final.size != row["bytes"]:
                    store.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
            yield b

    return materialise(pending.mapInArrow(commit, MANIFEST_SQL), "warc-manifest")


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a stream of gzip members; memory holds one record."""
    unpack, out = zlib.decompressobj(31), bytearray()
    for chunk in chunks:
        while chunk:
            out += unpack.decompress(chunk)
            if not unpack.eof:
                break
            yield bytes(out)
            chunk, unpack, out = unpack.unused_data, zlib.decompressobj(31), bytearray()
    if out:
        raise ValueError("an archive ends within a record")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(VERSION) or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("not a record")
    lines = (line.split(": ", 1) for line in head[len(VERSION) :].decode().split("\r\n"))
    headers = {x[0]: x[1] if len(x) > 1 else "" for x in lines}
    block = rest[:-4]
    if len(block) != int(headers["Content-Length"]) or f"sha1:{base32(hashlib.sha1(block).digest())}" != headers["WARC-Block-Digest"]:
        raise ValueError(f"a record does not match its headers: {headers['WARC-Record-ID']}")
    return headers, block


READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def read_warc(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the files that a manifest names. A revisit has no payload of its own, but its length and digest.

    Digests of blocks and payloads are computed anew and compared with the headers; a difference fails the read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def chunks(name: str) -> Iterator[bytes]:
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                while chunk := stream.read(READ_BYTES):
                    yield chunk

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

        for b in batches:
            for name in b["name"].to_pylist():
                rows, held = [], 0
                for data in records_of(chunks(name)):
                    headers, block = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    length = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if headers["WARC-Type"] == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
                        raise ValueError(f"a payload does not match its headers: {headers['WARC-Record-ID']}")
                    page, refers = headers["WARC-Page-ID"], headers.get("WARC-Refers-To-Page")
                    kept = payload if payloads and headers["WARC-Type"] == "response" else None
                    rows.append((int(page) if page else None, headers["WARC-Target-URI"], length, digest, headers["WARC-Type"], int(refers) if refers else None, kept))
                    held += len(kept or b"") + 200
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    names = manifest.select("name").repartition(partitions(manifest.sparkSession))
    return names.mapInArrow(read, schema)


def archive_round_trip(pages: DataFrame, *, least_revisit: int = 0) -> DataFrame:
    """Write ``pages`` to a new folder in the shared one and read the archives back, without the payloads."""
    folder = new_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_warc(write_warc(pages, folder, least_revisit=least_revisit), folder, payloads=False).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p),
b AS (
  SELECT page_id, html, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, i * 5 + j + 1, 1) AS BIGINT) << (4 - j))) AS BIGINT), 1)), '')
    AS payload_digest
  FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM b)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
