"""Cross-tokenizer alignment by interval coalescing.

A text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B), both of which cover the
bytes of a space and the text. All tokens of both are sorted by where they start, the running maximum of
their ends is taken, and a group breaks where a start reaches it; within groups, overlapping tokens are
linked. A text is first cut where both vocabularies always break (before a single space or line feed
between two other characters): a group never reaches over such a cut, so the units between cuts are
aligned once each, many at a time, and kept in a bounded cache.

Link counts of id pairs are summed over the corpus. A document's links then meet them by buckets of B ids:
each task reads its bucket's counts first, then the documents' pairs, a batch at a time.

A null or empty text, or one whose A or B bytes differ from its own (as with U+2581, which B takes for a
space), has no tokens: zeros and an empty groups_sha256. A very long text is aligned a piece at a time. Rows
that repeat, also under one or no doc_id, count each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from tracewright.llm.common import written
from tracewright.llm.tokens import byte_characters, groups_of

A_VOCABULARY, B_VOCABULARY = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: B ids are dealt over so many buckets; a bucket's counts, at most 1,000 B ids with each A id, are held by one task.
BUCKETS = 32
#: Documents' pairs that a task reads beside a bucket's counts, about; a bucket with more is salted.
BUCKET_BYTES = 64 << 20
#: Units kept, and characters aligned at once.
CACHED, CHARS = 200_000, 1_000_000
#: Before a single space or line feed between two characters that are no white space.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
ODD_SPACE = re.compile(r"[ \n]{2}|[^\S \n]|[ \n]\Z")
UNIT_BEFORE = "▁"


class Aligner:
    """Aligned units of texts. Fields of a unit: its row in ``numbers`` (n_a, n_b, n_groups, n_links), its groups in words, its links (A id << 16 | B id)."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_path or public_tokenizers.path(A_VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_VOCABULARY))
        byte_of = {c: k for k, c in enumerate(byte_characters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte_of.get(c, 0) for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(UNIT_BEFORE, " ").encode() for k, p in enumerate(pieces)]
        if len(self.a_bytes) > 1 << 16 or len(pieces) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        # A breaks before a space by its split pattern, B if no piece goes on over one; else texts are not cut
        alone = self.b.encode("\nab", out_type=str)[:2] == [UNIT_BEFORE, "<0x0A>"]
        split = "".join(x for x, _ in self.a.pre_tokenizer.pre_tokenize_str("ab cd\nef")) == "abĠcdĊef" and len(self.a.pre_tokenizer.pre_tokenize_str("ab cd\nef")) == 4
        self.cuts = split and alone and not any(re.search(f"[^{UNIT_BEFORE}]{UNIT_BEFORE}|\n", p) for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers = np.zeros((1024, 4), np.int64)
        self.bad: set[int] = set()
        self.words: list[bytes] = []
        self.links: list[bytes] = []

    def units(self, spaced: str) -> list[str]:
        """The units of a text that begins with a space."""
        if not self.cuts:
            return [spaced]
        if ODD_SPACE.search(spaced):
            return CUT.split(spaced)
        # the first character is a space, others stand single: the space is left out of the units that have one
        return spaced.replace("\n", " \n").split(" ")[1:]

    def prepare(self, texts: list[str | None]) -> None:
        """Align the new units of some texts at once; texts beyond CHARS are read by the piece."""
        self.room()
        self.learn({u for t in texts if t and len(t) <= CHARS for u in self.units(" " + t)})

    def places(self, units: list[str]) -> list[int]:
        """The rows of units, after those that are not known have been aligned."""
        try:
            return list(map(self.known.__getitem__, units))
        except KeyError:
            self.learn(set(units))
            return list(map(self.known.__getitem__, units))

    def learn(self, units: set[str]) -> None:
        new = sorted(units.difference(self.known))
        if not new:
            return
        # a unit without its space, or with its line feed, white space or several words
        full = [u if u[:1] in ("\n", " ") else " " + u for u in new]
        a_ids = [e.ids for e in self.a.encode_batch_fast(full, add_special_tokens=False)]
        b_ids = self.b.encode([u if u[0] == "\n" else u[1:] for u in full], num_threads=1)
        b_ids = [ids[1:] if u[0] == "\n" else ids for u, ids in zip(full, b_ids)]
        first, n = len(self.words), len(new)
        self.known.update(zip(new, range(first, first + n)))
        while len(self.numbers) < first + n:
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
        self.words += [b""] * n
        self.links += [b""] * n
        good = []
        for k, u in enumerate(full):
            data = u.encode()
            if b"".join([self.a_bytes[i] for i in a_ids[k]]) == data == b"".join([self.b_bytes[i] for i in b_ids[k]]):
                good.append(k)
            else:
                self.bad.add(first + k)
        if good:
            self.align([a_ids[k] for k in good], [b_ids[k] for k in good], np.array(good) + first)

    def align(self, a_ids: list[list[int]], b_ids: list[list[int]], rows: np.ndarray) -> None:
        """Coalesce the tokens of units that follow one another; each unit's A and B tokens cover the same bytes."""
        na, nb = np.array([len(x) for x in a_ids]), np.array([len(x) for x in b_ids])
        a, b = np.array([i for x in a_ids for i in x]), np.array([i for x in b_ids for i in x])
        a_size, b_size = (np.array([len(t[i]) for i in x.tolist()], np.int64) for t, x in ((self.a_bytes, a), (self.b_bytes, b)))
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        a_start, b_start = a_end - a_size, b_end - b_size
        starts, ends, kind = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((kind, starts))
        reach = np.maximum.accumulate(ends[order])
        breaks = np.concatenate([[True], starts[order][1:] >= reach[:-1]])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(breaks)
        # overlaps: the B tokens from the first that ends behind an A token's start to the last that starts before its end
        low, high = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")
        each = high - low
        link_a = np.repeat(np.arange(len(a)), each)
        link_b = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(low, each)
        links = (a[link_a].astype(np.uint32) << np.uint32(16)) | b[link_b].astype(np.uint32)
        tokens_at = np.concatenate([[0], np.cumsum(na + nb)])
        links_at = np.searchsorted(link_a, np.concatenate([[0], np.cumsum(na)]))
        self.numbers[rows] = np.stack([na, nb, np.add.reduceat(breaks, tokens_at[:-1]), np.diff(links_at)], 1)
        # in words: group by group, its A tokens before its B tokens
        told = np.lexsort((starts, kind, group))
        ids, g, k = np.concatenate([a, b])[told], group[told], kind[told]
        after = np.where(g[1:] != g[:-1], 2, k[1:] - k[:-1])
        said = [f"{i}{',|;'[s]}" for i, s in zip(ids.tolist(), [*after.tolist(), 2])]
        raw = links.tobytes()
        for j, row in enumerate(rows.tolist()):
            self.words[row] = "".join(said[tokens_at[j] : tokens_at[j + 1]])[:-1].encode()
            self.links[row] = raw[4 * links_at[j] : 4 * links_at[j + 1]]

    def pieces(self, text: str) -> Iterator[str]:
        """A spaced text in pieces of about CHARS characters, cut between units."""
        at, spaced = 0, " " + text
        while at < len(spaced):
            m = CUT.search(spaced, at + CHARS) if self.cuts and len(spaced) - at > CHARS else None
            end = m.start() if m else len(spaced)
            yield spaced[at:end]
            at = end

    def read(self, text: str | None) -> Iterator[tuple[np.ndarray, bytes, bytes]]:
        """(numbers, groups in words, links) of each piece of a text; nothing for a text without tokens."""
        if not text:
            return
        cut = list(self.pieces(text)) if len(text) > CHARS else [" " + text]
        # the first piece begins with its space, later ones with theirs or a line feed
        units = lambda p: self.units(p) if p[0] == " " else CUT.split(p)
        for p in cut if len(cut) > 1 else ():
            self.room()
            if not self.bad.isdisjoint(self.places(units(p))):
                return
        for p in cut:
            if len(cut) > 1:
                self.room()
            at = self.places(units(p))
            if self.bad and not self.bad.isdisjoint(at):
                return
            yield self.numbers[at].sum(0), b";".join(map(self.words.__getitem__, at)), b"".join(map(self.links.__getitem__, at))

    def room(self) -> None:
        if len(self.known) > CACHED:
            self.clear()


_ALIGNERS: dict[tuple[str | None, str | None], Aligner] = {}


def aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """The aligner of this worker process."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


class Counts:
    """Counts of link codes, summed in arrays of bounded length."""

    def __init__(self, most: int = 2_000_000):
        self.codes, self.n, self.size, self.most = [], [], 0, most

    def add(self, codes: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.codes.append(codes)
        self.n.append(n)
        self.size += len(codes)
        if self.size > 2 * self.most:
            codes, n = self.summed()
            self.codes, self.n, self.size = [codes], [n], len(codes)
            if self.size > self.most:
                yield self.take()

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(np.concatenate(self.codes), return_inverse=True)
        return codes, np.bincount(at, np.concatenate(self.n), len(codes)).astype(np.int64)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.summed()
        self.codes, self.n, self.size = [], [], 0
        return out


#: Rows of the first step. kind 0: a document; 1: pairs of some documents with B ids of a bucket; 2: counts.
NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def first_schema(doc_id: str) -> str:
    return f"kind int, row long, doc_id {doc_id}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, bucket int, size long, body binary, code long, n long"


def packed(rows: np.ndarray, codes: np.ndarray, n: np.ndarray) -> bytes:
    """Row numbers (sorted), codes and counts of pairs."""
    planes = [np.array([len(rows)], np.int64), rows[:1], np.diff(rows).astype(np.uint32), codes, n.astype(np.uint32)]
    return zstandard.compress(b"".join(p.tobytes() for p in planes), 1)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.decompress(body)
    size = int(np.frombuffer(raw, np.int64, 1)[0])
    steps = np.frombuffer(raw, np.uint32, size - 1, 16).astype(np.int64)
    rows = np.cumsum(np.concatenate([np.frombuffer(raw, np.int64, 1, 8), steps]))
    return rows, np.frombuffer(raw, np.uint32, size, 12 + 4 * size), np.frombuffer(raw, np.uint32, size, 12 + 8 * size)


def aligned(batches: Iterator[pa.RecordBatch], schema: pa.Schema, a_path: str | None, b_path: str | None) -> Iterator[pa.RecordBatch]:
    known, counts, row = aligner(a_path, b_path), Counts(), TaskContext.get().partitionId() << 40
    known.clear()

    def made(count: int, /, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns and not isinstance(columns[f.name], pa.Array) else columns.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)

    def pairs(rows: list[int], links: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Rows of kind 1, and of kind 2 where there are enough."""
        size = np.array([len(x) // 4 for x in links])
        start = rows[0] if rows else 0
        codes = np.frombuffer(b"".join(links), np.uint32)
        if not len(codes):
            return
        both, n = np.unique((np.repeat(np.array(rows) - start, size).astype(np.uint64) << np.uint64(32)) | codes, return_counts=True)
        codes, at = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), (both >> np.uint64(32)).astype(np.int64) + start
        for c, k in counts.add(codes, n):
            yield made(len(c), kind=np.full(len(c), 2), code=c.astype(np.int64), n=k)
        bucket = (codes & np.uint32(0xFFFF)) % np.uint32(BUCKETS)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(BUCKETS + 1))
        full = [(k, packed(at[o], codes[o], n[o])) for k in range(BUCKETS) if len(o := order[edges[k] : edges[k + 1]])]
        yield made(len(full), kind=[1] * len(full), bucket=[k for k, _ in full], size=[len(x) for _, x in full], body=[x for _, x in full])

    for b in batches:
        ids, texts = b.column("doc_id"), b.column("text").to_pylist()
        for first, last in groups_of(texts, CHARS):
            known.prepare(texts[first:last])
            found, held, links = [], [], []
            for text in texts[first:last]:
                numbers, sha, some = np.zeros(4, np.int64), None, False
                for k, words, codes in known.read(text):
                    numbers = numbers + k
                    if sha is None:
                        sha = hashlib.sha256()
                    else:
                        sha.update(b";")
                    sha.update(words)
                    held.append(row)
                    links.append(codes)
                    if len(text) > CHARS:
                        yield from pairs(held, links)
                        held, links = [], []
                found.append((row, *numbers.tolist(), sha.hexdigest() if sha else ""))
                row += 1
            cols = list(zip(*found))
            yield made(last - first, kind=[0] * (last - first), row=cols[0], doc_id=ids.slice(first, last - first), groups_sha256=cols[5], **dict(zip(NUMBERS, cols[1:5])))
            yield from pairs(held, links)
    if counts.size:
        codes, n = counts.take()
        for k in range(0, len(codes), 100_000):
            c = codes[k : k + 100_000]
            yield made(len(c), kind=np.full(len(c), 2), code=c.astype(np.int64), n=n[k : k + 100_000])


def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, n_best, count_sum) from rows sorted by (bucket, salt), counts (by code) before pairs: one row for a document and batch."""
    place, codes, n, best, held = None, [], [], [], None
    for b in batches:
        bucket, salt, code = (b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "salt", "code"))
        is_count = ~np.isnan(code) if code.dtype.kind == "f" else np.ones(len(code), bool)
        edges = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(salt) != 0)) + 1).tolist(), len(bucket)]
        for x, y in zip(edges, edges[1:]):
            if x == y:
                continue
            if (bucket[x], salt[x]) != place:
                place, codes, n, best, held = (bucket[x], salt[x]), [], [], [], None
            at = x + np.flatnonzero(is_count[x:y])
            if len(at):
                codes.append(code[at].astype(np.uint32))
                n.append(b.column("n").take(pa.array(at)).to_numpy())
                best.append(b.column("best").take(pa.array(at)).to_numpy(zero_copy_only=False).astype(bool))
            for k in x + np.flatnonzero(~is_count[x:y]):
                if held is None:
                    held = np.concatenate(codes), np.concatenate(n), np.concatenate(best)
                    codes, n, best = [], [], []
                rows, c, times = unpacked(b.column("body")[k].as_py())
                found = np.searchsorted(held[0], c)
                times = times.astype(np.int64)
                starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
                sums = [np.add.reduceat(v, starts) for v in (times * held[2][found], times * held[1][found])]
                yield pa.RecordBatch.from_arrays([pa.array(rows[starts]), *map(pa.array, sums)], names=["row", "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    read = docs.select("doc_id", "text")
    kind = dict(read.dtypes)["doc_id"]
    schema = docs.sparkSession.createDataFrame([], first_schema(kind)).schema
    arrow = to_arrow_schema(schema)
    first = written(read.mapInArrow(lambda b: aligned(b, arrow, a_path, b_path), schema), "op13-aligned")
    counts = written(first.where("kind = 2").groupBy("code").agg(F.sum("n").alias("n")).withColumn("b", F.col("code").bitwiseAND(0xFFFF)), "op13-counts")
    top = counts.groupBy("b").agg(F.max("n").alias("top"))
    marked = counts.join(top, "b").select((F.col("b") % BUCKETS).cast("int").alias("bucket"), "code", "n", (F.col("n") == F.col("top")).alias("best"))
    total = first.where("kind = 1").agg(F.sum("size").alias("s")).first().s or 0
    salts = 1 + total // (BUCKETS * BUCKET_BYTES)
    marked = marked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1).cast("int")))).withColumn("body", F.lit(None).cast("binary"))
    pairs = first.where("kind = 1").select("bucket", F.lit(None).cast("long").alias("code"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), F.pmod(F.xxhash64("body"), F.lit(salts)).cast("int").alias("salt"), "body")
    order = ["bucket", "salt", F.col("code").asc_nulls_last()]
    sums = marked.unionByName(pairs).repartition("bucket", "salt").sortWithinPartitions(*order).mapInArrow(looked_up, "row long, n_best long, count_sum long")
    sums = sums.groupBy(F.col("row").alias("of")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = first.where("kind = 0").join(sums, F.col("row") == F.col("of"), "left")
    return found.select("doc_id", *NUMBERS, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
