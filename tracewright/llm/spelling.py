"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Texts are cut into maximal runs of letters, counted, and words of some length and count make the
vocabulary. Words of one length share a blocked Bloom filter (a shard). Every word generates its deletions
and its replacements by a greater letter; an insertion is the other word's deletion, a smaller letter the
other word's replacement, so each pair of near words is generated once. An edit's hash is had from the
word's in one step, without making its letters. Only edits that a filter lets through become words, are
shuffled and joined with the vocabulary, which removes the false ones. What is broadcast is bounded: filters
of more than ``filter_bytes`` are parted by hash and probed in several passes.

Null and empty texts have no words, a null doc_id is written ``null``. A very long text is read whole, in
pieces that end between words. Of equal counts the smaller word is the form. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tracewright.llm.common import written

SHORTEST = 7
#: Words longer than this share the last filter.
LONGEST_SHARD = 64
#: A filter's bits a word, in blocks of eight 64-bit words, each of which has one bit of a key.
BITS, BLOCK_BITS = 16, 512
FILTER_BYTES = 64 << 20
#: Blocks of a filter that are filled in one group: some 16,000 words.
SEGMENT = 512
PIECE = 4 << 20
COUNTED = 300_000
#: Words whose edits a task makes, about.
TASK_WORDS = 25_000
#: Letters are bytes of Latin-1; other characters become "?" there, which is no letter.
LETTERS = rb"a-z\xC0-\xFF"
NOT_LETTER = re.compile(rb"[^" + LETTERS + rb"]")

ONE = np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEP_BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
#: A 32-bit factor for each word of a block, from which the key's bit comes.
FACTORS = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a letter adds to a word's hash, before its place's power.
VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * STEP)


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[ONE], np.full(max(n - 1, 0), STEP)]), dtype=np.uint64)[:n]


def hashes(letters: np.ndarray) -> np.ndarray:
    """Hash of each row of letters, not yet mixed: the sum of values times the powers of their places, modulo 2**64."""
    return (VALUES[letters] * powers(letters.shape[1])).sum(1, dtype=np.uint64)


def shard_of(length: int) -> int:
    return min(length, LONGEST_SHARD)


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def bit_of(h: np.ndarray, word: int) -> np.ndarray:
    low = ((h & np.uint64(0xFFFFFFFF)) * FACTORS[word]) & np.uint64(0xFFFFFFFF)
    return ONE << (low >> np.uint64(26))


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return mixed(h ^ STEP) % np.uint64(parts)


def passing(h: np.ndarray, filters: dict[int, np.ndarray], parts: int) -> np.ndarray:
    """Places of the mixed hashes that a filter at hand lets through. filters: by part."""
    found = []
    of = part_of(h, parts) if parts > 1 else None
    for part, words in filters.items():
        at = np.arange(len(h)) if of is None else np.flatnonzero(of == part)
        base = block_of(h[at], len(words) // 8).astype(np.int64) * 8
        for k in range(8):
            hit = (words[base + k] & bit_of(h[at], k)) != 0
            at, base = at[hit], base[hit]
        found.append(at)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def counted(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    """(word, n): partial counts."""
    run = re.compile(rb"[" + LETTERS + rb"]{%d,}" % shortest)
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return b

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = (text.as_py() or "").encode("latin-1", "replace").lower()
            base, at = zlib.crc32(f"{key}:".encode()), 0
            while at < len(data):
                end = NOT_LETTER.search(data, at + PIECE) if len(data) - at > PIECE else None
                end = end.end() if end else len(data)
                for w, c in Counter(run.findall(data, at, end)).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
                    if h % 31 == 0:
                        i = h % len(w)
                        w = w[:i] + w[i + 1 :]
                        if len(w) < shortest:
                            continue
                    counts[w] += c
                at = end
                if len(counts) > COUNTED:
                    yield out()
    if counts:
        yield out()


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = 2) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters, after deletions, with at least ``least`` occurrences in all texts."""
    parts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("key"), "text").mapInArrow(lambda b: counted(b, shortest), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, letters) for each length of words: row numbers and a matrix of Latin-1 bytes; at most PIECE letters, or one word, at a time."""
    data = [w.encode("latin-1") for w in words.to_pylist()]
    rows = defaultdict(list)
    for k, w in enumerate(data):
        rows[len(w)].append(k)
    for length, at in rows.items():
        step = max(1, PIECE // 4 // length)
        for k in range(0, len(at), step):
            some = at[k : k + step]
            yield np.array(some), np.frombuffer(b"".join([data[i] for i in some]), np.uint8).reshape(-1, length)


def keyed(batches: Iterator[pa.RecordBatch], plan: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(shard, part, segment, h) of the words. plan: parts and blocks of a part, by shard."""
    for b in batches:
        for _, letters in by_length(b.column(0)):
            shard = shard_of(letters.shape[1])
            parts, blocks = plan[shard]
            h = mixed(hashes(letters))
            cols = [np.full(len(h), shard, np.int32), part_of(h, parts).astype(np.int32), (block_of(h, blocks) // np.uint64(SEGMENT)).astype(np.int32), h.view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "part", "segment", "h"])


def filled(plan: dict[int, tuple[int, int]]):
    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, part, segment = (int(k) for k in key)
        blocks = plan[shard][1]
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        words = np.zeros(min(SEGMENT, blocks - segment * SEGMENT) * 8, np.uint64)
        base = block_of(h, blocks).astype(np.int64) - segment * SEGMENT
        for k in range(8):
            np.bitwise_or.at(words, base * 8 + k, bit_of(h, k))
        return pd.DataFrame({"shard": [shard], "part": [part], "segment": [segment], "bits": [words.tobytes()]})

    return fill


def planned(sizes: dict[int, int], filter_bytes: int) -> tuple[dict[int, tuple[int, int]], list[list[tuple[int, int]]]]:
    """Parts and blocks of a part by shard, and the passes: the (shard, part) whose filters are broadcast together, of at most ``filter_bytes``."""
    most = max(1, filter_bytes * 8 // BLOCK_BITS)
    plan, passes, room = {}, [], 0
    for shard, n in sorted(sizes.items()):
        blocks = -(-n * BITS // BLOCK_BITS)
        parts = -(-blocks // most)
        blocks = -(-blocks // parts)
        plan[shard] = (parts, blocks)
        for part in range(parts):
            if blocks > room:
                passes.append([])
                room = most
            passes[-1].append((shard, part))
            room -= blocks
    return plan, passes


def edits(letters: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray, int, np.ndarray]]:
    """(kind, rows, places, letter, mixed hashes) of each row's deletions, and of its replacements by a greater letter of the alphabet."""
    m, length = letters.shape
    power = powers(length)
    parts = VALUES[letters] * power
    whole = parts.sum(1, dtype=np.uint64)
    before = np.cumsum(parts, axis=1, dtype=np.uint64) - parts
    # a letter less: what stands behind moves up by one; of a run of equal letters the last alone is deleted
    shorter = before + (whole[:, None] - before - parts) * STEP_BACK
    rows, places = np.nonzero(np.concatenate([letters[:, 1:] != letters[:, :-1], np.ones((m, 1), bool)], 1))
    yield "deleted", rows, places, 0, mixed(shorter[rows, places])
    for letter in alphabet.tolist():
        rows, places = np.nonzero(letters < letter)
        yield "replaced", rows, places, letter, mixed(whole[rows] + VALUES[letter] * power[places] - parts[rows, places])


def probed(batches: Iterator[pa.RecordBatch], filters, parts: dict[int, int], alphabet: np.ndarray, shortest: int) -> Iterator[pa.RecordBatch]:
    """(a, na, b): words with their edits that a filter lets through. filters: a broadcast of the pass's filters by (shard, part)."""
    held: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
    for (shard, part), bits in filters.value.items():
        held[shard][part] = np.frombuffer(bits, np.uint64)
    for batch in batches:
        words, n = batch.column(0), batch.column(1)
        for at, letters in by_length(words):
            length = letters.shape[1]
            # made in steps, so that what passes is never more than some megabytes
            step = max(1, PIECE // 16 // length)
            for low in range(0, len(at), step):
                some, here = at[low : low + step], letters[low : low + step]
                for kind, rows, places, letter, h in edits(here, alphabet):
                    size = length - (kind == "deleted")
                    shard = shard_of(size)
                    if size < shortest or shard not in held:
                        continue
                    hit = passing(h, held[shard], parts[shard])
                    if not len(hit):
                        continue
                    rows, places = rows[hit], places[hit]
                    for k in range(0, len(hit), most := max(1, PIECE // length)):
                        r, p = rows[k : k + most], places[k : k + most]
                        made = here[r]
                        if kind == "deleted":
                            made = made[np.arange(length) != p[:, None]].reshape(-1, size)
                        else:
                            made[np.arange(len(r)), p] = letter
                        text = made.tobytes().decode("latin-1")
                        take = pa.array(some[r])
                        yield pa.RecordBatch.from_arrays([words.take(take), n.take(take), pa.array([text[x : x + size] for x in range(0, len(text), size)], pa.string())], names=["a", "na", "b"])


def near_pairs(words: DataFrame, shortest: int = SHORTEST, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(a, na, b, nb): every pair of near words once. words: (word, n), distinct, a table that is read more than once."""
    spark = words.sparkSession
    # at most LONGEST_SHARD rows and 90 letters come to the driver
    sizes = {r.shard: r.n for r in words.groupBy(F.least(F.length("word"), F.lit(LONGEST_SHARD)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    used = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect()
    alphabet = np.array(sorted(ord(r.c) for r in used if r.c), np.uint8)
    plan, passes = planned(sizes, filter_bytes)
    shards = {s: p for s, (p, _) in plan.items()}
    keys = words.select("word").mapInArrow(lambda b: keyed(b, plan), "shard int, part int, segment int, h long")
    segments = written(keys.groupBy("shard", "part", "segment").applyInPandas(filled(plan), "shard int, part int, segment int, bits binary"), "op12-filters")
    dealt = words.repartition(1 + sum(sizes.values()) // TASK_WORDS, "word")
    found = []
    for chosen in passes:
        # the filters of a pass, of filter_bytes at most
        bits: dict[tuple[int, int], bytearray] = {(s, p): bytearray(plan[s][1] * BLOCK_BITS // 8) for s, p in chosen}
        wanted = reduce(lambda x, y: x | y, [(F.col("shard") == s) & (F.col("part") == p) for s, p in chosen])
        for r in segments.where(wanted).toLocalIterator():
            at = r.segment * SEGMENT * BLOCK_BITS // 8
            bits[r.shard, r.part][at : at + len(r.bits)] = r.bits
        filters = spark.sparkContext.broadcast({k: bytes(v) for k, v in bits.items()})
        edited = dealt.mapInArrow(lambda b, f=filters: probed(b, f, shards, alphabet, shortest), "a string, na long, b string")
        found.append(written(edited, "op12-edits"))
        filters.unpersist()
    if not found:
        return spark.createDataFrame([], "a string, na long, b string, nb long")
    return reduce(DataFrame.union, found).join(words.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b").select("a", "na", "b", "nb")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of each word with a form (columns word, form): its last form. A form is more frequent by a factor, so chains end and are short."""
    cur = written(forms.select("word", F.col("form").alias("root")), "op12-roots")
    while True:
        seen = Observation()
        onward = cur.withColumnsRenamed({"word": "at", "root": "to"})
        step = cur.join(onward, F.col("root") == F.col("at"), "left").observe(seen, F.count("to").alias("moved"))
        cur = written(step.select("word", F.coalesce("to", "root").alias("root")), "op12-roots")
        if not seen.get["moved"]:
            return cur


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = 2, factor: int = 10, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per word of the vocabulary: word, form (its most frequent near word, if at least ``factor`` times as frequent), root, n, n_near, form_n."""
    words = written(vocabulary(docs, shortest, least), "op12-words")
    pairs = written(near_pairs(words, shortest, filter_bytes), "op12-pairs")
    ways = pairs.select(F.col("a").alias("near_of"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = ways.groupBy("near_of").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = words.join(best, F.col("word") == F.col("near_of"), "left")
    has = -F.col("best.m") >= factor * F.col("n")
    joined = written(joined.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.m")).alias("form_n")), "op12-forms")
    last = roots(joined.where("form is not null")).withColumnRenamed("word", "of")
    return joined.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
