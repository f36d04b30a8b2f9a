"""WARC archives written in shards and read back.

Records are range-sorted by page id, one gzip member each; a file is closed
when its compressed size passes the limit. Every header and digest is made anew
from the row: record id, date, target, type, lengths, SHA-1 of block and
payload. Nothing depends on time, machine or attempt, so a repeated task writes
the same bytes; files get their names only when complete, and a manifest lists
them.

Of records with equal payloads of at least ``least_bytes`` bytes the one with
the largest page id is the response; the others are revisits that refer to it
and hold no payload. Which ones those are is decided on ids and digests alone;
the decisions travel to the writer in the same shuffle as the pages.

Defined cases: a null payload is an empty one; equal rows stay, and of equal
payloads under the same largest id the first is the response and the others
refer to that id; a null page id sorts first, is written as ``none``, and is
never referred to unless all ids of the payload are null (then nothing can be
referred to and all are responses); a null target is written as ``urn:none``
and line breaks in one are percent-encoded; no rows give no files; further
columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm.outputs import Output, opened, save_manifest, spread

MANIFEST = "part int, number int, file string, records bigint, bytes bigint"
DATE = "1970-01-01T00:00:00Z"
#: Base of the record ids, which are derived from page id, digest and place among equals.
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:temblor:warc")
READ_BYTES = 1 << 20


def sha1(data: bytes) -> str:
    """SHA-1 in base 32, as WARC headers have it."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, ' '.join(map(str, parts)))}>"


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(page: str, url: str | None, payload: bytes, kind: str, refers: str | None, again: int) -> bytes:
    """A response or revisit record; ``again`` tells equal rows apart."""
    digest, head = sha1(payload), http_head(len(payload))
    block = head + payload if kind == "response" else head
    target = "urn:none" if url is None else "".join(
        c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    headers = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page, digest, kind, again)), ("WARC-Date", DATE),
               ("WARC-Target-URI", target), ("X-Page-ID", page), ("WARC-Payload-Digest", f"sha1:{digest}"),
               ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http;msgtype=response")]
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("WARC-Refers-To", record_id(refers, digest, "response", 0)), ("X-Refers-To-Page-ID", refers)]
    return member(headers, block)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html",
               least_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write all pages below ``folder``; returns the manifest, one row per file."""
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    keepers = (keyed.where(F.col("size") >= least_bytes).groupBy("digest")
               .agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
               .where("n > 1 and keeper is not null").select("digest", "keeper"))
    decisions = keyed.select("page_id", "digest").join(keepers, "digest").distinct().select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
        F.lit(0).alias("kind"), "digest", "keeper")
    bodies = rows.select("page_id", "url", "payload", F.lit(1).alias("kind"), F.lit(None).cast("string").alias(
        "digest"), F.lit(None).cast("bigint").alias("keeper"))
    dealt = (decisions.unionByName(bodies).repartitionByRange("page_id")
             .sortWithinPartitions("page_id", "kind", "digest", "url", "payload")
             .select(F.col("page_id").cast("string").alias("page"), "kind", "digest",
                     F.col("keeper").cast("string").alias("keeper"), "url", "payload"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, records, out, name = TaskContext.get().partitionId(), 0, 0, None, ""
        here, keeper_of, seen = object(), {}, {}
        for rows in frames:
            for page, kind, digest, keeper, url, payload in rows.itertuples(index=False):
                page = "none" if page is None or page != page else page
                if page != here:
                    here, keeper_of, seen = page, {}, {}
                if kind == 0:
                    keeper_of[digest] = keeper
                    continue
                payload = bytes(payload)
                digest = hashlib.sha1(payload).hexdigest()
                again = seen[digest] = seen.get(digest, -1) + 1
                keeper = keeper_of.get(digest)
                first = keeper is None or (keeper == page and again == 0)
                if out is not None and out.size >= file_bytes:
                    out.commit()
                    yield pd.DataFrame([(part, number, name, records, out.size)], columns=MANIFEST_NAMES)
                    out, number, records = None, number + 1, 0
                if out is None:
                    name = f"shard-{part:06d}-{number:04d}.warc.gz"
                    out = Output(folder, name)
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", part, number)),
                                      ("WARC-Date", DATE), ("WARC-Filename", name),
                                      ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                out.write(record(page, None if url is None or url != url else url, payload,
                                 "response" if first else "revisit", keeper, again))
                records += 1
        if out is not None:
            out.commit()
            yield pd.DataFrame([(part, number, name, records, out.size)], columns=MANIFEST_NAMES)

    return save_manifest(dealt.mapInPandas(write, MANIFEST), folder)


MANIFEST_NAMES = ["part", "number", "file", "records", "bytes"]
RECORDS = ("page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
           "refers_to bigint, payload binary")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked one by one."""
    data = stream.read(READ_BYTES)
    while data:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not data:
                raise ValueError("a gzip member ends early")
            parts.append(unpacker.decompress(data))
            data = unpacker.unused_data or stream.read(READ_BYTES)
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a wrong length or digest raises."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(headers["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("broken record")
    if (want := headers.get("WARC-Block-Digest")) and want != f"sha1:{sha1(block)}":
        raise ValueError("broken block")
    return headers, block


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record but the file heads; ``payload`` is null for revisits."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = opened(folder)
        held, size = [], 0

        def out():
            return pd.DataFrame(held, columns=[x.split()[0] for x in RECORDS.split(", ")]).astype(
                {"page_id": "Int64", "refers_to": "Int64"})

        for rows in frames:
            for name in rows["file"]:
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream):
                        headers, block = parse(data)
                        kind = headers["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and sha1(payload) != digest:
                            raise ValueError("broken payload")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        page, refers = headers["X-Page-ID"], headers.get("X-Refers-To-Page-ID")
                        url = headers["WARC-Target-URI"]
                        held.append((None if page == "none" else int(page), None if url == "urn:none" else url, length,
                                     digest, kind, None if refers is None else int(refers),
                                     payload if kind == "response" else None))
                        size += len(payload)
                        if size > READ_BYTES * 8 or len(held) >= 5000:
                            yield out()
                            held, size = [], 0
        if held:
            yield out()

    return spread(spark.read.parquet(f"{folder}/manifest").select("file")).mapInPandas(read, RECORDS)
