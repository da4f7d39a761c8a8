"""Token ids in compressed files that give back one short document without reading the others.

A file holds documents in ascending doc_id order: a head (magic, SHA-256 of the dictionary), the
documents' ids as little-endian unsigned 32-bit integers, each compressed on its own with a shared
zstandard dictionary, then the index (doc_ids, which of them are null, offsets, counts) and a foot with
the index's place. The dictionary is trained on the serialised ids of a bounded sample of documents and
written once as ``dictionary-<sha>.bin``. Files are written under temporary names and renamed; only
those in the manifest count, so a task that runs twice leaves one file that is read.

Null text is empty: its end id only. Rows that repeat a doc_id are kept, in the order of their text's
hash; null ids come first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import drawn, new_path, sampled
from tracewright.llm.tokens import encoder, groups_of

MAGIC = b"TWTOKEN1"
END_ID = 2
SAMPLE_DOCUMENTS = 2000
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 65536
FILE_BYTES = 32 << 20
READ_BYTES = 4 << 20
LEVEL = 3
FOOT = struct.Struct("<QQ8s")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI or local path; works in the driver and in tasks."""
    return pafs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def train_dictionary(docs: DataFrame, end_id: int = END_ID, path: str | None = None) -> bytes:
    """A zstandard dictionary of the ids of at most SAMPLE_DOCUMENTS documents (least hash of doc_id), SAMPLE_CHARS characters of each from a place drawn by the hash."""
    some = sampled(docs.select("doc_id", drawn(F.col("text"), F.col("doc_id"), SAMPLE_CHARS).alias("text")).where("text <> ''"), ["doc_id"], SAMPLE_DOCUMENTS, ["text"])
    end = np.array([end_id], "<u4").tobytes()
    samples = [x + end for x in encoder(path).encode([r.text for r in some.collect()])]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 16:
        return b"".join(samples)[:DICTIONARY_BYTES] or end * 8  # too little to train on: a raw content dictionary
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


class FileWriter:
    """One file; ``add`` documents, then ``close`` gives its manifest row."""

    def __init__(self, uri: str, words: bytes):
        self.fs, root = file_system(uri)
        self.name = f"ids-{uuid.uuid4().hex}.bin"
        self.path, self.temporary = f"{root}/{self.name}", f"{root}/.{self.name}.tmp"
        self.out = self.fs.open_output_stream(self.temporary)
        self.out.write(MAGIC + hashlib.sha256(words).digest())
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(words), write_content_size=True)
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.at = [len(MAGIC) + 32]

    def add(self, doc_id: int | None, ids: bytes) -> None:
        part = self.squeeze.compress(ids)
        self.out.write(part)
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.at.append(self.at[-1] + len(part))

    def close(self) -> tuple:
        index = np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes() + np.array(self.at, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes()
        self.out.write(index + FOOT.pack(self.at[-1], len(self.ids), MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)
        known = [x for x in self.ids if x is not None]
        return self.name, known[0] if known else None, len(self.ids), sum(self.counts), self.at[-1] + len(index) + FOOT.size


MANIFEST = "part int, name string, first_id long, documents long, ids long, bytes long"


def write(docs: DataFrame, end_id: int = END_ID, path: str | None = None, uri: str | None = None) -> tuple[str, list[dict]]:
    """Write the ids of all documents; returns the folder and the manifest: a row per file, in ascending doc_id order."""
    spark = docs.sparkSession
    uri = uri or new_path(spark, "op4-ids")
    fs, root = file_system(uri)
    fs.create_dir(root)
    words = train_dictionary(docs, end_id, path)
    name = f"dictionary-{hashlib.sha256(words).hexdigest()}.bin"
    with fs.open_output_stream(f"{root}/{name}") as out:
        out.write(words)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(uri)
        with fs.open_input_stream(f"{root}/{name}") as f:
            words = f.read()
        end = np.array([end_id], "<u4").tobytes()
        writer, rows, part = None, [], 0
        for b in batches:
            texts, ids = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            part = b.column("part")[0].as_py() if b.num_rows else part
            for first, last in groups_of(texts):
                for doc_id, got in zip(ids[first:last], encoder(path).encode(texts[first:last])):
                    if writer is None:
                        writer = FileWriter(uri, words)
                    writer.add(doc_id, got + end)
                    if writer.at[-1] >= FILE_BYTES:
                        rows.append((part, *writer.close()))
                        writer = None
        if writer is not None:
            rows.append((part, *writer.close()))
        if rows:
            kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["part", "name", "first_id", "documents", "ids", "bytes"])

    # documents without a doc_id, or with one and the same, are dealt by their texts
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tk"))
    dealt = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "tk").sortWithinPartitions(F.asc_nulls_first("doc_id"), "tk").select("doc_id", "text", F.spark_partition_id().alias("part"))
    # one row per file of up to FILE_BYTES, the files of a part in their order
    manifest = [r.asDict() for r in dealt.mapInArrow(files, MANIFEST).collect()]
    order = {id(m): k for k, m in enumerate(manifest)}
    manifest.sort(key=lambda m: (m["part"], order[id(m)]))
    start = 0
    for m in manifest:
        m["start"] = start
        start += m["ids"]
    with fs.open_output_stream(f"{root}/.manifest.json.tmp") as out:
        out.write(json.dumps({"dictionary": name, "end_id": end_id, "files": manifest}).encode())
    fs.move(f"{root}/.manifest.json.tmp", f"{root}/manifest.json")
    return uri, manifest


class FileReader:
    """A file's index; ``document(k)`` reads and unpacks the k-th document alone: of the file only its foot, its index and that frame."""

    def __init__(self, file: pa.NativeFile, words: bytes):
        size = file.size()
        head, foot = file.read_at(40, 0), file.read_at(FOOT.size, max(0, size - FOOT.size))
        if head[:8] != MAGIC or head[8:] != hashlib.sha256(words).digest():
            raise ValueError("not a file of this format, or of another dictionary")
        place, n, magic = FOOT.unpack(foot)
        if magic != MAGIC:
            raise ValueError("the file is cut short")
        index = file.read_at(size - FOOT.size - place, place)
        self.file, self.n = file, n
        self.ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n)
        self.at = np.frombuffer(index, "<u8", n + 1, 9 * n)
        self.counts = np.frombuffer(index, "<u4", n, 17 * n + 8)
        self.open = zstandard.ZstdDecompressor(dict_data=dictionary(words))

    def unpacked(self, k: int, frame: bytes) -> bytes:
        got = self.open.decompress(frame)
        if len(got) != 4 * self.counts[k]:
            raise ValueError(f"document {k} of the file is damaged")
        return got

    def document(self, k: int) -> bytes:
        return self.unpacked(k, self.file.read_at(int(self.at[k + 1] - self.at[k]), int(self.at[k])))

    def documents(self) -> Iterator[bytes]:
        """All documents, read in stretches of about READ_BYTES."""
        first = 0
        while first < self.n:
            last = max(first + 1, int(np.searchsorted(self.at, self.at[first] + READ_BYTES, "right")) - 1)
            data, base = memoryview(self.file.read_at(int(self.at[last] - self.at[first]), int(self.at[first]))), int(self.at[first])
            for k in range(first, last):
                yield self.unpacked(k, data[int(self.at[k]) - base : int(self.at[k + 1]) - base])
            first = last


def read(spark: SparkSession, uri: str) -> DataFrame:
    """Per document, from the files of the manifest: doc_id, start, n_tokens, ids_crc32."""
    fs, root = file_system(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.load(f)
    with fs.open_input_stream(f"{root}/{manifest['dictionary']}") as f:
        words = f.read()
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["files"]:
        return spark.createDataFrame([], out)
    starts = spark.createDataFrame([(m["name"], m["start"]) for m in manifest["files"]], "name string, file_start long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("file_start").to_pylist()):
                fs, root = file_system(uri)
                with fs.open_input_file(f"{root}/{name}") as f:
                    r = FileReader(f, words)
                    crc = np.fromiter(map(zlib.crc32, r.documents()), np.int64, r.n)
                begin = start + np.concatenate([[0], np.cumsum(r.counts[:-1].astype(np.int64))])[: r.n]
                yield pa.RecordBatch.from_arrays([pa.array(r.ids, mask=r.null.astype(bool)), pa.array(begin), pa.array(r.counts.astype(np.int64)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts.repartition(len(manifest["files"])).mapInArrow(documents, out)
