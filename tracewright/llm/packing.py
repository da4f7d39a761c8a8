"""Packing of tokenised documents into sequences of at most ``capacity`` tokens.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt evenly over
packing shards of bounded size by a hash, and each shard is packed on its own by a linear grouping
scheme: its large pieces are sorted and parted into groups of equal cardinality, lengths are rounded up
to the largest of their group, the few-size problem over whole-sequence patterns is solved by column
generation, patterns are rounded down and filled with actual pieces of each group, and what is left is
put, largest first, where it fits best. A shard wastes at most a few sequences more than the scheme.

Null text is empty and has its end id only. Rows that repeat a doc_id are documents of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import written
from tracewright.llm.tokens import encoder, groups_of, release

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 8192
GROUPS = 24
#: Lengths are rounded up to multiples of this where patterns are priced.
UNIT = 16
#: A filled pattern may leave one part in so many of a sequence open.
SLACK = 32
PIECES = "doc_id long, tk long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """A row for each piece of each document: PIECES."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts = b.column("text").to_pylist()
            rows, out = [], []
            for first, last in groups_of(texts):
                for k, ids in enumerate(encoder(path).encode(texts[first:last]), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append(k)
                        out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [[]] * 4
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("tk").take(at), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "tk", "piece", "start", "length", "ids_crc32"])
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text").mapInArrow(cut, PIECES)


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of ``sizes`` (units) within ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(int(sizes.min()), room + 1):
        fits = np.flatnonzero(sizes <= r)
        v = best[r - sizes[fits]] + worth[fits]
        k = int(v.argmax())
        if v[k] > best[r - 1] + 1e-12:
            best[r], pick[r] = v[k], fits[k]
        else:
            best[r] = best[r - 1]
    pattern, r = np.zeros(len(sizes), int), room
    while r > 0:
        if pick[r] < 0:
            r -= 1
            continue
        pattern[pick[r]] += 1
        r -= int(sizes[pick[r]])
    return float(best[room]), pattern


def patterns(sizes: np.ndarray, need: np.ndarray, room: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Whole-sequence patterns and how often, rounded down from the optimum of the fractional problem (column generation)."""
    n = len(sizes)
    basis = np.diag((room // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, pattern = best_pattern(sizes, inverse.sum(0), room)  # prices: each pattern costs one sequence
        if value <= 1 + 1e-7:
            break
        way, have = inverse @ pattern, inverse @ need
        steps = np.where(way > 1e-9, np.maximum(have, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(steps.argmin())
        if not np.isfinite(steps[out]):
            break
        basis[:, out] = pattern
    have = np.floor(np.linalg.solve(basis, need) + 1e-9).astype(int)
    return [(basis[:, k].astype(int), int(have[k])) for k in range(n) if have[k] > 0]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length. Without ``groups`` all is put where it fits best."""
    n = len(lengths)
    where, offset = np.full(n, -1), np.zeros(n, int)
    used: list[int] = []
    order = np.argsort(-lengths, kind="stable")
    full = order[lengths[order] == capacity]
    where[full] = np.arange(len(full))
    used += [capacity] * len(full)
    large = order[(lengths[order] < capacity) & (lengths[order] > capacity // 8)]
    groups = min(groups, len(large))
    if groups:
        parts = np.array_split(large, groups)
        sizes = np.array([-(-int(lengths[p[0]]) // UNIT) for p in parts])
        # a group whose rounded length passes the room in units still fits alone
        room = max(capacity // UNIT, int(sizes.max()))
        spans = [(int(lengths[p[-1]]), int(lengths[p[0]])) for p in parts]
        of_length: list[list[int]] = [[] for _ in range(capacity + 1)]
        for m in large[::-1]:
            of_length[lengths[m]].append(int(m))
        there = sum(1 << k for k in range(capacity + 1) if of_length[k])
        for pattern, times in patterns(sizes, np.array([len(p) for p in parts], float), room):
            slots = [spans[g] for g in range(groups) for _ in range(pattern[g])]
            for _ in range(times):
                at, members = 0, []
                for k, (low, high) in enumerate(slots):
                    # the last slot takes whatever large piece fits best
                    low, high = (0, capacity - at) if k == len(slots) - 1 else (low, min(high, capacity - at))
                    found = (there & ((1 << (high + 1)) - 1)).bit_length() - 1
                    if found < max(low, 1):
                        continue
                    m = of_length[found].pop()
                    if not of_length[found]:
                        there ^= 1 << found
                    members.append(m)
                    at += found
                # a sequence that the actual pieces leave too open is not used: its pieces go to the best fit below
                tight = at >= capacity - capacity // SLACK
                at = 0
                for m in members:
                    if tight:
                        where[m], offset[m] = len(used), at
                        at += int(lengths[m])
                    else:
                        of_length[lengths[m]].append(m)
                        there |= 1 << int(lengths[m])
                if tight:
                    used.append(at)
                else:
                    break
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for s, u in enumerate(used):
        room_of[capacity - u].append(s)
        mask |= 1 << (capacity - u)
    for m in order[where[order] < 0]:
        size = int(lengths[m])
        fit = mask >> size
        if size and fit:
            r = size + ((fit & -fit).bit_length() - 1)
            s = room_of[r].pop()
            if not room_of[r]:
                mask &= ~(1 << r)
        else:
            s, r = len(used), capacity
            used.append(0)
        where[m], offset[m] = s, used[s]
        used[s] += size
        room_of[r - size].append(s)
        mask |= 1 << (r - size)
    return where, offset


def best_fit(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. sequence_id: shard number in the high 32 bits."""
    cut = written(pieces(docs, capacity, end_id, path), "op5-pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "tk", "piece"), F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tk", "ascending"), ("piece", "ascending")])
        where, offset = pack(table.column("length").to_numpy(), capacity)
        sequence = (table.column("shard").to_numpy() << 32) + where
        return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
