"""A deterministic, sharded WARC writer, and its reader.

Pages are dealt by ranges of (page_id, payload digest) over shards of about ``shard_bytes`` of payload,
sorted, and written as one gzip member a record; a file is rolled when its compressed size passes
``file_bytes``. Headers and digests are made anew from the payload (the html in UTF-8). Of equal payloads
the page with the largest page_id is the response, the others are revisits that refer to it. Range bounds
come from a sample of the keys, chosen by hash and weighed by bytes, dates and ids from the page, so a
rerun writes the same bytes. Each file is written under a temporary name and renamed; the manifest,
written the same way and last, lists the files that count.

A null html is an empty payload. Pages that repeat the page_id of a response with the same payload are
responses too; a page without page_id revisits if another page has one, else it is a response. Null and
odd urls are written percent-encoded. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import new_path, written
from tracewright.llm.token_store import file_system

SHARD_BYTES = 32 << 20
FILE_BYTES = 64 << 20
#: Keys that the bounds of shards come from, at most about so many; beyond as many shards, shards get larger.
SAMPLE_KEYS = 100_000
#: Bytes of a record besides its payload, about.
HEAD_BYTES = 700
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 6


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id if page_id is not None else digest}'.encode()).digest(), version=3)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record."""
    digest = base32_sha1(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = {"WARC-Type": "response", "WARC-Record-ID": record_id(page_id, digest), "WARC-Date": DATE, "WARC-Target-URI": quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%~")}
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if refers_to is None:
        block += payload
    else:
        head |= {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest), "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive is cut short")
            parts.append(z.decompress(view[at : at + 65536]))
            at = min(at + 65536, len(view)) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
            raise ValueError("a record is damaged")
        yield fields, block


MANIFEST = "shard int, seq int, name string, first_id long, records long, bytes long, sha1 string"


def bounds(keys: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (page_id, k) of the shards after the first. keys: page_id, k (hash of the digest), bytes; one row for each (page_id, k).

    A key stands for all its bytes, so a page_id with very many payloads is cut between them. Null ids come first.
    """
    total = keys.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    shards = max(1, -(-(total["bytes"] or 0) // shard_bytes))
    some = keys.where(F.pmod(F.xxhash64("page_id", "k"), F.lit(max(1, total["n"] // SAMPLE_KEYS))) == 0).select(F.coalesce("page_id", F.lit(LEAST)).alias("page_id"), "k", "bytes").toPandas().sort_values(["page_id", "k"])
    ids, k = some["page_id"].to_numpy(np.int64), some["k"].to_numpy(np.int64)
    if not len(ids) or shards == 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.cumsum(some["bytes"].to_numpy(np.int64))
    cut = np.unique(np.searchsorted(size, np.arange(1, shards) * int(size[-1]) / shards, "right"))
    cut = cut[(cut > 0) & (cut < len(ids))]
    return ids[cut], k[cut]


LEAST = -(1 << 63)


def shard_number(page_id: np.ndarray, k: np.ndarray, bound_ids: np.ndarray, bound_k: np.ndarray) -> np.ndarray:
    """How many bounds are at or below each (page_id, k)."""
    low, high = np.searchsorted(bound_ids, page_id, "left"), np.searchsorted(bound_ids, page_id, "right")
    for i in np.unique(page_id[high > low]):
        mine = np.flatnonzero(page_id == i)
        a, b = int(low[mine[0]]), int(high[mine[0]])
        low[mine] = a + np.searchsorted(bound_k[a:b], k[mine], "right")
    return low.astype(np.int32)


def write(pages: DataFrame, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, uri: str | None = None) -> tuple[str, list[dict]]:
    """Write the archives of all pages; returns the folder and the manifest, in page_id order."""
    uri = uri or new_path(pages.sparkSession, "op9-warc")
    fs, root = file_system(uri)
    fs.create_dir(root)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    keys = pages.select("page_id", digest.alias("digest"), F.octet_length("html").alias("size")).groupBy("page_id", "digest").agg(F.sum(F.col("size") + HEAD_BYTES).alias("bytes"), F.count("*").alias("n"))
    keys = written(keys, "op9-keys")
    groups = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.sum("n").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    groups = written(groups, "op9-groups")
    revisits = keys.join(groups, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    at = bounds(keys.select("page_id", F.xxhash64("digest").alias("k"), "bytes"), shard_bytes)

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series(shard_number(page_id.to_numpy(np.int64), k.to_numpy(np.int64), *at))

    number = shard_of(F.coalesce("page_id", F.lit(LEAST)), F.xxhash64("digest")) if len(at[0]) else F.lit(0)
    # what is known of a page's digest comes just before the page in the sorted stream, so the html moves once
    marks = revisits.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    full = pages.select("page_id", "url", "html", digest.alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    both = marks.union(full).withColumn("shard", number).withColumn("k", F.xxhash64("digest"))
    both = both.repartitionById(len(at[0]) + 1, "shard").sortWithinPartitions("shard", "page_id", "k", "digest", F.desc_nulls_last("refers_to"), "url")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        out, rows, seq, shard, mark = None, [], 0, None, None

        def close():
            out.close()
            fs.move(f"{root}/{temporary}", f"{root}/{name}")
            rows.append((shard, seq, name, first, count, size, digest.hexdigest()))

        for b in batches:
            for page_id, url, html, key, refers_to, s in zip(*(b.column(k).to_pylist() for k in range(6))):
                if html is None:
                    mark = (page_id, key, refers_to)
                    continue
                if out is not None and (s != shard or size >= file_bytes):
                    close()
                    out, seq = None, seq + 1 if s == shard else 0
                if out is None:
                    seq = seq if s == shard else 0
                    shard, first, count, size, digest = s, page_id, 0, 0, hashlib.sha1()
                    name = f"pages-{shard:06d}-{seq:05d}.warc.gz"
                    temporary = f".{name}.{uuid.uuid4().hex}.tmp"
                    out = fs.open_output_stream(f"{root}/{temporary}", compression=None)
                data = member(record(page_id, url, html.encode(), mark[2] if mark and mark[:2] == (page_id, key) else None))
                out.write(data)
                digest.update(data)
                count, size = count + 1, size + len(data)
        if out is not None:
            close()
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")])

    # one row per file
    manifest = sorted((r.asDict() for r in both.select("page_id", "url", "html", "digest", "refers_to", "shard").mapInArrow(files, MANIFEST).collect()), key=lambda m: (m["shard"], m["seq"]))
    with fs.open_output_stream(f"{root}/.manifest.json.tmp") as out:
        out.write(json.dumps(manifest).encode())
    fs.move(f"{root}/.manifest.json.tmp", f"{root}/manifest.json")
    return uri, manifest


def read(spark: SparkSession, uri: str) -> DataFrame:
    """Per record of the manifest's files: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    fs, root = file_system(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.load(f)
    out = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not manifest:
        return spark.createDataFrame([], out)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        length = re.compile(rb"\r\nContent-Length: (\d+)\r\n")
        for b in batches:
            for name in b.column("name").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    data = f.read()
                rows = []
                for head, block in records(data):
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(length.search(http + b"\r\n")[1])
                    if head["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
                        raise ValueError("a payload is damaged")
                    rows.append((int(head["X-Page-ID"]) if "X-Page-ID" in head else None, n, digest, head["WARC-Type"], int(head["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in head else None))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in out.split(", ")])

    return spark.createDataFrame([(m["name"],) for m in manifest], "name string").repartition(len(manifest)).mapInArrow(parsed, out)
