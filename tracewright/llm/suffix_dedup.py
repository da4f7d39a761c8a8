"""Removal of repeated passages with suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that starts at two places of the corpus goes. The
steps, all exact and none quadratic in a group:

1. Anchors. In each window of ``LENGTH`` bytes the least hash of its ``GRAM``-byte strings is chosen
   (leftmost on ties). Equal windows choose equal anchors, so a window whose anchor occurs once in the
   corpus is not repeated and its text is never moved. The windows that share one chosen anchor are
   consecutive and make one *snippet*.
2. Equal snippets are counted before anything is moved (partial aggregation), one of each is kept as
   its representative.
3. Shards. The snippets of an anchor go to one shard. A shard is read in blocks of bounded size; each
   block gets a suffix array by Larsson-Sadakane refinement and Kasai's common prefixes, which tell
   the repeated windows. An anchor whose snippets stretch over blocks is merged by binary search of
   its windows in the sorted windows of the blocks before.
4. The snippets of an anchor with more than ``group_limit`` different ones (one passage in very many
   contexts) are compared with one of them, its lead. The windows that both have are settled; those left
   can only be found again in snippets that leave the lead at the same place by the same byte, so they
   go to smaller groups that share more bytes. Nothing is dropped, and a snippet stays about one row.

Null text is empty. Documents shorter than ``LENGTH`` have no window. Rows that repeat a doc_id, with
equal or other texts, are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import chunks, kept_columns, packed_words, quoted, written

LENGTH = 200
GRAM = 32
#: Bytes of one suffix array; ranks of this many places fit 21 bits.
BLOCK_BYTES = 1 << 20
GROUP_LIMIT = 2000
PIECE = 1 << 22
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place."""
    w = packed_words(data)
    n = len(data) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        x = w[8 * k : 8 * k + n] * ODD[k]
        h += x ^ (x >> np.uint64(29))
        h *= ODD[3 - k]
    return h ^ (h >> np.uint64(32))


def snippets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The snippets of the documents data[at[i]:at[i+1]], at most 2**24 bytes in all.

    Returns anchor hash, document, first window (place in data), windows, anchor's distance from the first window.
    """
    nothing = tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    n = len(data)
    if n < LENGTH:
        return nothing
    h = gram_hashes(data)
    v = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, got = LENGTH - GRAM + 1, 1
    while 2 * got <= width:
        v = np.minimum(v[:-got], v[got:])
        got *= 2
    if got < width:
        v = np.minimum(v[: len(v) - (width - got)], v[width - got :])
    anchor = (v & np.uint64((1 << 24) - 1)).astype(np.int64)
    step = np.zeros(n - LENGTH + 2, np.int32)
    full = np.flatnonzero(np.diff(at) >= LENGTH)
    if not len(full):
        return nothing
    step[at[full]] += 1
    np.add.at(step, at[full + 1] - LENGTH + 1, -1)
    valid = np.cumsum(step[:-1]) > 0
    new = np.empty(len(anchor), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new & valid)
    last = np.empty(len(anchor), bool)
    last[-1] = True
    last[:-1] = new[1:] | ~valid[1:]
    windows = np.flatnonzero(last & valid) - first + 1
    return h[anchor[first]], np.searchsorted(at, first, "right") - 1, first, windows, anchor[first] - first


#: A document's equal snippets are one row, with the places of all of them.
ANCHORS = "h long, sh long, doc_id long, tk long, lo array<long>, n int, back int"


def find_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, keys = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
        ids = b.column(0)
        for c in chunks(b.column(2), PIECE):
            # a longer text is read in pieces that overlap by all but one byte of a window
            for base in range(0, max(1, len(c.data) - LENGTH + 1), PIECE) if len(c.rows) == 1 else (0,):
                data = c.data[base : base + PIECE + LENGTH - 1]
                at = c.at if len(c.rows) > 1 else np.array([0, len(data)])
                h, doc, lo, n, back = snippets(data, at)
                if not len(h):
                    continue
                raw = memoryview(data)
                sh = np.fromiter((xxhash.xxh3_64_intdigest(raw[a : a + m + LENGTH - 1]) for a, m in zip(lo.tolist(), n.tolist())), np.uint64, len(lo))
                doc_of = doc.copy()
                order = np.lexsort((lo, sh, h, doc))
                new = np.ones(len(order), bool)
                for x in (doc, h, sh):
                    x[:] = x[order]
                new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (sh[1:] != sh[:-1])
                one = np.flatnonzero(new)
                places = pa.ListArray.from_arrays(pa.array(np.append(one, len(order)).astype(np.int32)), pa.array((lo - at[doc_of] + base)[order]))
                row = c.rows[doc[one]]
                yield pa.RecordBatch.from_arrays([pa.array(h[one].view(np.int64)), pa.array(sh[one].view(np.int64)), ids.take(pa.array(row)), pa.array(keys[row]), places, pa.array(n[order[one]].astype(np.int32)), pa.array(back[order[one]].astype(np.int32))], names=["h", "sh", "doc_id", "tk", "lo", "n", "back"])


# --- suffix arrays -------------------------------------------------------------------------------

BITS = 21
LOW = np.uint64((1 << BITS) - 1)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks of symbols 0..256, by Larsson-Sadakane refinement: double the known prefix, sort only places whose rank is shared."""
    n = len(text)
    pad = np.concatenate([text.astype(np.uint64), np.zeros(4, np.uint64)])
    key = pad[:n] << np.uint64(27) | pad[1 : n + 1] << np.uint64(18) | pad[2 : n + 2] << np.uint64(9) | pad[3 : n + 3]
    key = np.sort(key << np.uint64(BITS) | np.arange(n, dtype=np.uint64))
    sa = (key & LOW).astype(np.int64)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (key[1:] >> np.uint64(BITS)) != (key[:-1] >> np.uint64(BITS))
    rank = np.zeros(n + 1, np.int64)  # the rank of a group is one more than the place of its first member; 0: past the end
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    h = 4
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return sa, rank[:n] - 1
        at = sa[open_]
        key = np.sort(rank[at].astype(np.uint64) << np.uint64(2 * BITS) | rank[np.minimum(at + h, n)].astype(np.uint64) << np.uint64(BITS) | at.astype(np.uint64))
        sa[open_] = at = (key & LOW).astype(np.int64)
        first = np.empty(len(key), bool)
        first[0] = True
        first[1:] = (key[1:] >> np.uint64(BITS)) != (key[:-1] >> np.uint64(BITS))
        new[open_] |= first
        place = open_[np.flatnonzero(first)][np.cumsum(first) - 1]
        rank[at] = place + 1
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, rank: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the suffix array, at most ``most``: lcp[r] of sa[r-1] and sa[r].

    One lane for each stretch between two of ``starts``; all lanes take their next place together.
    Within a lane a prefix is at least one less than at the place before.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pad = np.concatenate([text.astype(np.uint64), np.full(most + 16, 300, np.uint64)])
    m = n + most + 8
    w = np.zeros(m, np.uint64)
    for k in range(7):
        w |= pad[k : k + m] << np.uint64(9 * (6 - k))
    ends = np.append(starts[1:], n)
    order = np.argsort(starts - ends, kind="stable")
    starts, size = starts[order], (ends - starts)[order]
    have = np.zeros(len(starts), np.int64)
    limits = [np.uint64(1 << (9 * k)) for k in range(1, 7)]
    for t in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -t, "left"))
        i = starts[:live] + t
        j = before[i]
        have = np.maximum(have[:live] - 1, 0)
        have[j < 0] = 0
        todo = np.flatnonzero(j >= 0)
        while len(todo):
            l = have[todo]
            x = w[i[todo] + l] ^ w[j[todo] + l]
            same = x == 0
            step = np.full(len(todo), 7, np.int64)
            if not same.all():
                y = x[~same]
                less = np.full(len(y), 6, np.int64)
                for q in limits:
                    less -= y >= q
                step[~same] = less
            have[todo] = l = np.minimum(l + step, most)
            todo = todo[same & (l < most)]
        lcp[rank[i]] = have
    return lcp


def repeated(snips: list[bytes], owned: list[int], times: np.ndarray) -> tuple[np.ndarray, ...]:
    """The first ``owned`` windows of each snippet: snippet, window, place in sorted order, class of equal windows; and how often each class is found.

    times: how often the corpus has each snippet.
    """
    sizes = np.array([len(s) + 1 for s in snips])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"\0".join(snips) + b"\0", np.uint8)
    text = raw.astype(np.uint16) + 1
    text[starts + sizes - 1] = 0
    sa, rank = suffix_array(text)
    lcp = common_prefixes(text, sa, rank, starts, LENGTH)
    group = np.cumsum(lcp < LENGTH) - 1
    own = np.array(owned)
    which = np.repeat(np.arange(len(snips)), own)
    window = np.arange(len(which)) - np.repeat(np.cumsum(own) - own, own)
    place = starts[which] + window
    cls = group[rank[place]]
    seen = np.bincount(cls, weights=times[which], minlength=int(group[-1]) + 1)
    return which, window, rank[place], cls, seen


def as_strings(snips: list[bytes], which: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The windows themselves, as fixed-length byte strings that compare by their bytes."""
    return np.array([snips[a][b : b + LENGTH] for a, b in zip(which.tolist(), window.tolist())], f"S{LENGTH}")


def shard_blocks(rows: list[tuple[int, int, int, int, bytes]]) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """The runs of repeated windows of each (key, snippet hash, times, windows, bytes); rows are sorted by key.

    Blocks of BLOCK_BYTES each get a suffix array; a key that goes on from one block to the next is merged by binary search.
    """
    blocks, at = [], 0
    while at < len(rows):
        size, first = 0, at
        while at < len(rows) and (at == first or size + len(rows[at][4]) + 1 <= BLOCK_BYTES):
            size += len(rows[at][4]) + 1
            at += 1
        blocks.append((first, at))
    twice = [np.zeros(r[3], bool) for r in rows]
    # of the key that the next block goes on with: its sorted distinct windows and where each is
    run_key, run_text, run_where = None, None, []
    for k, (a, b) in enumerate(blocks):
        part = rows[a:b]
        snips = [r[4] for r in part]
        which, window, place, cls, seen = repeated(snips, [r[3] for r in part], np.array([r[2] for r in part], float))
        hit = seen[cls] >= 2
        for i, j in zip(which[hit].tolist(), window[hit].tolist()):
            twice[a + i][j] = True
        goes_on = part[-1][0] if b < len(rows) and rows[b][0] == part[-1][0] else None
        if run_key is None and goes_on is None:
            continue
        keys = np.array([r[0] for r in part])
        for key in dict.fromkeys(x for x in (run_key, goes_on) if x is not None):
            mine = np.flatnonzero(keys[which] == key)
            mine = mine[np.argsort(place[mine], kind="stable")]
            lead = np.ones(len(mine), bool)
            lead[1:] = cls[mine][1:] != cls[mine][:-1]
            heads = mine[lead]
            text = as_strings(snips, which[heads], window[heads])
            members = np.split(mine, np.flatnonzero(lead)[1:]) if len(mine) else []
            where = [[(a + int(which[m]), int(window[m])) for m in ms] for ms in members]
            if key == run_key and len(run_text):
                found = np.searchsorted(run_text, text)  # the merge
                there = (found < len(run_text)) & (run_text[np.minimum(found, len(run_text) - 1)] == text)
                for x in np.flatnonzero(there):
                    for row, w in [*run_where[found[x]], *where[x]]:
                        twice[row][w] = True
                    run_where[found[x]] = run_where[found[x]][:1]
                rest = np.flatnonzero(~there)
                text = np.concatenate([run_text, text[rest]])
                where = run_where + [where[x] for x in rest]
                order = np.argsort(text, kind="stable")
                text, where = text[order], [where[x] for x in order]
            if key == goes_on:
                run = (key, text, where)
        run_key, run_text, run_where = run if goes_on is not None else (None, None, [])
    out = []
    for r, t in zip(rows, twice):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], t.view(np.int8), [0]])))
        out.append((r[0], r[1], list(zip(edge[::2].tolist(), edge[1::2].tolist()))))
    return out


RUNS = "h long, sh long, runs array<struct<a:int,b:int>>"
RUNS_ARROW = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])


def runs_of_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of (h, sh, c, n, body), sorted by h: gathers some blocks' worth of rows, cut only between keys where that is possible."""
    rows: list[tuple[int, int, int, int, bytes]] = []
    size = 0

    def solved(some):
        got = shard_blocks(some)
        return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([[{"a": a, "b": b} for a, b in g[2]] for g in got], RUNS_ARROW.field("runs").type)], schema=RUNS_ARROW)

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(5))):
            if rows and size > 4 * BLOCK_BYTES and r[0] != rows[-1][0]:
                yield solved(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[4]) + 1
    if rows:
        yield solved(rows)


SNIPPET = "h long, sh long, c long, n int, back int, body binary"
SNIPPET_ARROW = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("c", pa.int64()), ("n", pa.int32()), ("back", pa.int32()), ("body", pa.binary())])

RUN = pa.struct([("a", pa.int32()), ("b", pa.int32())])
PART = pa.struct([("ph", pa.int64()), ("ps", pa.int64()), ("shift", pa.int32()), ("n", pa.int32()), ("back", pa.int32()), ("body", pa.binary())])
COMPARED = "h long, sh long, c long, own array<struct<a:int,b:int>>, lead_sh long, lead array<struct<a:int,b:int>>, parts array<struct<ph:long,ps:long,shift:int,n:int,back:int,body:binary>>"
COMPARED_ARROW = pa.schema([("h", pa.int64()), ("sh", pa.int64()), ("c", pa.int64()), ("own", pa.list_(RUN)), ("lead_sh", pa.int64()), ("lead", pa.list_(RUN)), ("parts", pa.list_(PART))])


def same_start(x: bytes, y: bytes) -> int:
    """How many bytes x and y begin with alike."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n - 1
    while low < high:
        k = (low + high + 1) // 2
        low, high = (k, high) if x[:k] == y[:k] else (low, k - 1)
    return low


def long_of(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def against_lead(h: int, n: int, back: int, body: bytes, lead_n: int, lead_back: int, lead: bytes) -> tuple[tuple[int, int] | None, tuple[int, int] | None, list[dict]]:
    """A snippet against the lead of its anchor: windows that both have (in each) and the parts with the snippet's other windows.

    A window at distance d has d bytes before the anchor and LENGTH - GRAM - d after it. With ``left`` and ``right`` bytes alike
    around the anchor the windows of distances LENGTH - GRAM - right to left are the lead's too. A window that reaches
    farther left can only be found again in snippets that leave the lead at the same place by the same byte, likewise on
    the right, so each side's windows are a part under the hash of the bytes up to there.
    """
    left = same_start(body[:back][::-1], lead[:lead_back][::-1])
    right = same_start(body[back + GRAM :], lead[lead_back + GRAM :])
    low, least = LENGTH - GRAM - right, back - n + 1
    own = lead_has = None
    if low <= left:
        own, lead_has = (back - left, back - low + 1), (lead_back - left, lead_back - low + 1)
    parts = []

    def part(far, near, side, key):
        # windows of distances far down to near
        if far >= near:
            w = back - far
            text = body[w : back - near + LENGTH]
            parts.append({"ph": long_of(xxhash.xxh3_64_intdigest(key, (h ^ side) & 0xFFFFFFFFFFFFFFFF)), "ps": long_of(xxhash.xxh3_64_intdigest(text)), "shift": w, "n": far - near + 1, "back": far, "body": text})

    part(back, max(left + 1, least), 0x4C, body[max(0, back - left - 1) : back])
    part(min(left, low - 1), least, 0x52, body[back + GRAM : back + GRAM + right + 1])
    return own, lead_has, parts


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of snippets with their leads (SNIPPET, lead_sh, lead_n, lead_back, lead_body): COMPARED."""
    as_runs = lambda x: [] if x is None else [{"a": x[0], "b": x[1]}]
    for b in batches:
        out = []
        for h, sh, c, n, back, body, lead_sh, lead_n, lead_back, lead in zip(*(b.column(k).to_pylist() for k in range(10))):
            if sh == lead_sh:
                own, has, parts = (0, n) if c > 1 else None, None, []
            else:
                own, has, parts = against_lead(h, n, back, body, lead_n, lead_back, lead)
                own = (0, n) if c > 1 else own
            out.append((h, sh, c, as_runs(own), lead_sh, as_runs(has), parts))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), COMPARED_ARROW.types)], schema=COMPARED_ARROW)


def solve(snips: DataFrame, group_limit: int) -> DataFrame:
    """(h, sh, runs) for distinct snippets (SNIPPET columns), of which each h has two or more; a snippet may have several rows.

    A snippet of an anchor with more than ``group_limit`` of them is compared with one of them, the anchor's lead. What
    both have is settled; the few windows left go to parts that share more bytes, and so on until no group is large.
    """
    hot = snips.groupBy("h").agg(F.count("*").alias("nv"), F.min("sh").alias("lead_sh")).where(F.col("nv") > group_limit).select("h", "lead_sh")
    hot = written(hot, "op3-hot")
    if hot.isEmpty():
        return by_shards(snips)
    cool = by_shards(snips.join(hot, "h", "left_anti"))
    leads = snips.withColumnRenamed("sh", "lead_sh").join(hot, ["h", "lead_sh"]).select("h", "lead_sh", *(F.col(x).alias(f"lead_{x}") for x in ("n", "back", "body")))
    leads = written(leads, "op3-leads")
    both = snips.join(leads, "h").select("h", "sh", "c", "n", "back", "body", "lead_sh", "lead_n", "lead_back", "lead_body")
    compared = written(both.mapInArrow(compare, COMPARED), "op3-compared")
    own = compared.where(F.size("own") > 0).select("h", "sh", F.col("own").alias("runs"))
    # the runs of a lead differ in their two ends only, so there are some thousands at most
    of_leads = compared.where(F.size("lead") > 0).groupBy("h", "lead_sh").agg(F.array_distinct(F.flatten(F.collect_set("lead"))).alias("runs")).select("h", F.col("lead_sh").alias("sh"), "runs")
    parts = compared.select("h", "sh", "c", F.explode("parts").alias("p")).select("h", "sh", "c", "p.*")
    kinds = parts.groupBy("ph", "ps").agg(F.sum("c").alias("c"), *(F.first(x).alias(x) for x in ("n", "back", "body"))).select(F.col("ph").alias("h"), F.col("ps").alias("sh"), "c", "n", "back", "body")
    kinds = written(kinds, "op3-parts")
    per = written(kinds.groupBy("h").agg(F.count("*").alias("nv"), F.sum("c").alias("total")).where("total > 1"), "op3-per")
    alone = kinds.select("h", "sh", "n").join(per.where("nv = 1").select("h"), "h", "left_semi").select("h", "sh", F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("runs"))
    below = solve(written(kinds.join(per.where("nv > 1").select("h"), "h", "left_semi"), "op3-below"), group_limit)
    settled = written(alone.union(below.where(F.size("runs") > 0)), "op3-settled")
    found = parts.select("ph", "ps", "shift", "h", "sh").join(settled.select(F.col("h").alias("ph"), F.col("sh").alias("ps"), "runs"), ["ph", "ps"])
    up = found.select("h", "sh", F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b"))).alias("runs"))
    return cool.union(own).union(of_leads).union(up)


def by_shards(snips: DataFrame) -> DataFrame:
    dealt = snips.select("h", "sh", "c", "n", "body").repartition("h").sortWithinPartitions("h", "sh")
    return dealt.mapInArrow(runs_of_shard, RUNS)


def repeated_spans(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, tk, spans): for each document with repeated passages its byte runs, unmerged and unsorted. tk: hash of the text."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tk"), "text")
    anchors = written(keyed.mapInArrow(find_snippets, ANCHORS), "op3-anchors")
    # a hot anchor is met in a join that adaptive execution can split, as both sides are read from tables
    again = anchors.groupBy("h").agg(F.sum(F.size("lo")).alias("c"), F.min("sh").alias("low"), F.max("sh").alias("high")).where("c > 1")
    again = written(again.select("h", (F.col("low") == F.col("high")).alias("same")), "op3-again")
    rows = written(anchors.join(again, "h"), "op3-rows")
    # an anchor with equal snippets only: all of their windows are found again
    span = lambda a, b: F.struct(a.cast("long").alias("a"), (b - 1 + LENGTH).cast("long").alias("b"))
    whole = rows.where("same").select("doc_id", "tk", F.transform("lo", lambda lo: span(lo, lo + F.col("n"))).alias("spans"))
    mixed = rows.where("not same")
    kinds = mixed.groupBy("h", "sh").agg(F.sum(F.size("lo")).alias("c"), F.min(F.struct("doc_id", "tk", F.get("lo", F.lit(0)).alias("lo"), "n", "back")).alias("at"))
    wanted = kinds.select("h", "sh", "c", "at.*").groupBy("doc_id", "tk").agg(F.collect_list(F.struct("h", "sh", "c", "lo", "n", "back")).alias("want"))
    texts = keyed.join(wanted.withColumnsRenamed({"doc_id": "wid", "tk": "wtk"}), F.col("doc_id").eqNullSafe(F.col("wid")) & (F.col("tk") == F.col("wtk")))
    snips = written(texts.select("want", "text").mapInArrow(cut_snippets, SNIPPET), "op3-snips")
    runs = written(solve(snips, group_limit).where(F.size("runs") > 0), "op3-runs")
    parted = mixed.select("h", "sh", "doc_id", "tk", "lo").join(runs, ["h", "sh"]).select("doc_id", "tk", F.flatten(F.transform("lo", lambda lo: F.transform("runs", lambda r: span(lo + r["a"], lo + r["b"])))).alias("spans"))
    # every copy of a row has the same spans: each array is kept once, so they don't grow with the number of copies
    return whole.union(parted).groupBy("doc_id", "tk").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def cut_snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, out = 0, []
        for want, text in zip(b.column(0), b.column(1).cast(pa.binary()) if not pa.types.is_large_string(b.column(1).type) else b.column(1).cast(pa.large_binary())):
            data = text.as_py() or b""
            for w in want.as_py():
                body = data[w["lo"] : w["lo"] + w["n"] - 1 + LENGTH]
                out.append((w["h"], w["sh"], w["c"], w["n"], w["back"], body))
                size += len(body)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), SNIPPET_ARROW.types)], schema=SNIPPET_ARROW)
                size, out = 0, []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), SNIPPET_ARROW.types)], schema=SNIPPET_ARROW)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def with_kept(docs: DataFrame, group_limit: int) -> DataFrame:
    """(rest, text, spans) of every document: rest has its other columns, spans the byte runs to remove or null."""
    spans = repeated_spans(docs, group_limit).withColumnsRenamed({"doc_id": "span_id", "tk": "span_tk"})
    keyed = docs.select(kept_columns(docs).alias("rest"), "text", F.xxhash64("text").alias("tk"))
    both = keyed.join(spans, F.col("rest.doc_id").eqNullSafe(F.col("span_id")) & (F.col("tk") == F.col("span_tk")), "left")
    return both.select("rest", "text", "spans")


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, spans in zip(b.column("text"), b.column("spans")):
            data = (text.as_py() or "").encode()
            kept, at, runs = hashlib.sha256(), 0, merged(spans.as_py())
            for x, y in runs:
                kept.update(data[at:x])
                at = y
            kept.update(data[at:])
            rows.append((len(data), sum(y - x for x, y in runs), len(runs), kept.hexdigest(), [{"a": x, "b": y} for x, y in runs]))
        cols = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (byte offsets)."""
    both = with_kept(docs.select("doc_id", "text"), group_limit).select(F.col("rest.doc_id").alias("doc_id"), "text", "spans")
    return both.mapInArrow(digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>")


def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for text, spans in zip(b.column("text"), b.column("spans")):
            value = text.as_py()
            if value is not None and spans.is_valid:
                data, at, out = value.encode(), 0, []
                for x, y in merged(spans.as_py()):
                    out.append(data[at:x].decode(errors="ignore"))
                    at = y
                value = "".join([*out, data[at:].decode(errors="ignore")])
            texts.append(value)
        yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.string())], names=["rest", "text"])


def deduplicated(docs: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """The documents with their repeated passages cut from text, all columns kept. A character of which a byte went goes whole; null stays null."""
    both = with_kept(docs, group_limit)
    cut = both.mapInArrow(cut_texts, both.select("rest", "text").schema)
    return cut.select(*("text" if c == "text" else F.col(f"rest.{quoted(c)}").alias(c) for c in docs.columns))
