"""Language identification by a linear-chain conditional random field over words.

A word's features are its byte n-grams with one boundary on either side (so those at the edges are its
affixes) and the word itself as an entry of a learned lexicon, all hashed into weight tables, one weight
a language. Neighbouring words are tied by learned transitions. Forward-backward gives each word the
probability of each language, so code-switched text is labelled word by word; a text's language is the
one with the largest mean over its words that hold a letter, which is also its score; on a tie the
language that comes first in the order of names.

Training takes a bounded sample of texts with a known language that are not held out, cuts spans from
them and strings spans of several texts together, so that the chain sees languages change. A text of
any length is read whole: it is cut into segments whose transfer matrices are multiplied first, then
forward and backward run in all segments at once; the result is that of one pass. A text beyond
PIECE_CHARS goes through in pieces, so its features are never held at once (a word that is longer is
read as several). A null text, or one
without a letter, is ``und`` with score 0. If nothing can be learned from, every text is ``und``. Every
row is labelled, also where doc_ids repeat or are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import drawn, sampled
from tracewright.llm.quality_model import bucket
from tracewright.llm.tokens import groups_of

BUCKETS = 1 << 16
LEXICON = 1 << 16
ORDERS = (2, 3, 4)
SAMPLE = 3000
#: Words of one training text, of a span of it, and spans in a training sequence.
TEXT_WORDS, SPAN_WORDS, SPANS = 60, 20, 3
ROUNDS, RATE, DECAY = 40, 0.5, 1e-4
SEGMENT = 128
#: Characters of a text that are held as features at once; a piece ends between words, or within one that is longer.
PIECE_CHARS = 1_000_000
LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UND = "und"
SPACES = " \t\n\r\x0b\x0c"


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lower-cased words: n-gram buckets (orders x places; 0: none), first place of each word, lexicon entries, has a letter."""
    stream = b" " + b" ".join(words) + b" \0\0\0"
    data = np.frombuffer(stream, np.uint8)
    n = len(data) - 4  # places: a word's begin at the space before it and end with its last byte
    space = data == 32
    start = np.flatnonzero(space[:n])
    grams = np.zeros((len(ORDERS), n), np.int64)
    code = data[:n].astype(np.uint32)
    inner = np.ones(n, bool)
    at = 0
    for k in range(1, max(ORDERS)):
        code = (code * np.uint32(0x01000193)) ^ data[k : k + n]
        if k > 1:
            inner &= ~space[k - 1 : k - 1 + n]
        if k + 1 in ORDERS:
            mixed = code * np.uint32(0x9E3779B1)
            grams[at] = np.where(inner & ~(space[:n] & space[k : k + n] & (k == 1)), (mixed >> np.uint32(16)) % np.uint32(BUCKETS - 1) + 1, 0)
            at += 1
    grams[:, data[:n] == 0] = 0
    size = np.diff(np.append(start, n))
    powers = np.uint64(0x9E3779B97F4A7C15)
    mult = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max(initial=1)), powers)]).astype(np.uint64))
    place = np.arange(n) - np.repeat(start, size)
    total = np.add.reduceat((data[:n].astype(np.uint64) + np.uint64(7)) * mult[place], start) if len(start) else np.zeros(0, np.uint64)
    total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return grams, start, ((total >> np.uint64(32)) % np.uint64(LEXICON)).astype(np.int64), np.logical_or.reduceat(_IS_LETTER[data[:n]], start) if len(start) else np.zeros(0, bool)


def through_of(potential: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The transfer matrix of a stretch of words, up to a factor."""
    m = (potential[:, None, :] * tie).reshape(-1, *tie.shape)
    while len(m) > 1:
        if len(m) % 2:
            m = np.concatenate([m, np.eye(len(tie))[None]])
        m = m[::2] @ m[1::2]
        m = m / m.sum((1, 2), keepdims=True)
    return m[0]


def chain(potential: np.ndarray, sizes: np.ndarray, tie: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid end to end: the probabilities of each word's labels, and the expected transitions in all.

    potential: word x label, positive; sizes: words of each sequence; tie: label x label. The label before a sequence is
    uniform. Where there is one sequence only, ``before`` and ``after`` are what its text before and after it says.
    """
    n, labels = potential.shape
    gamma = np.zeros((n, labels))
    if not n:
        return gamma, np.zeros((labels, labels))
    sizes = sizes[sizes > 0]
    first = np.cumsum(sizes) - sizes
    parts = -(-sizes // SEGMENT)
    seq = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[seq] + nth * SEGMENT
    length = np.minimum(SEGMENT, sizes[seq] - nth * SEGMENT)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]
    # transfer matrix of each segment
    through = np.broadcast_to(np.eye(labels), (len(begin), labels, labels)).copy()
    for t, k in enumerate(live):
        m = (through[:k].reshape(-1, labels) @ tie).reshape(k, labels, labels) * potential[begin[:k] + t][:, None, :]
        through[:k] = m / m.sum((1, 2), keepdims=True)
    enter, leave = np.full((len(begin), labels), 1 / labels), np.ones((len(begin), labels))
    head = np.cumsum(parts) - parts
    if before is not None:
        enter[where[0]], leave[where[-1]] = before, after
    for k in range(1, int(parts.max())):
        some = np.flatnonzero(parts > k)
        here, prior = where[head[some] + k], where[head[some] + k - 1]
        v = np.einsum("si,sij->sj", enter[prior], through[prior])
        enter[here] = v / v.sum(1, keepdims=True)
    for k in range(int(parts.max()) - 2, -1, -1):
        some = np.flatnonzero(parts > k + 1)
        here, after = where[head[some] + k], where[head[some] + k + 1]
        v = np.einsum("sij,sj->si", through[after], leave[after])
        leave[here] = v / v.sum(1, keepdims=True)
    alpha = np.zeros((n, labels))
    a = enter.copy()
    for t, k in enumerate(live):
        v = (a[:k] @ tie) * potential[begin[:k] + t]
        a[:k] = v / v.sum(1, keepdims=True)
        alpha[begin[:k] + t] = a[:k]
    b, moves = leave.copy(), np.zeros((labels, labels))
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        at = begin[:k] + t
        g = alpha[at] * b[:k]
        gamma[at] = g / g.sum(1, keepdims=True)
        right = potential[at] * b[:k]
        prior = alpha[at - 1] if t else enter[:k]
        scale = np.einsum("si,ij,sj->s", prior, tie, right)
        moves += np.einsum("si,sj->ij", prior / scale[:, None], right) * tie
        v = right @ tie.T
        b[:k] = v / v.sum(1, keepdims=True)
    return gamma, moves


def piece_places(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE_CHARS characters that end before white space, or where a word alone is longer."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE_CHARS)
        if end < len(text):
            last = max((text.rfind(c, at + 1, end) for c in SPACES), default=-1)
            end = last if last > at else end
        yield at, end
        at = end


@dataclass
class Model:
    languages: list[str]
    grams: np.ndarray
    lexicon: np.ndarray
    tie: np.ndarray

    def potential(self, grams, start, lexicon) -> np.ndarray:
        total = self.grams[grams[0]]
        for g in grams[1:]:
            total += self.grams[g]
        s = np.add.reduceat(total, start) + self.lexicon[lexicon] if len(start) else np.zeros((0, len(self.languages)), np.float32)
        return np.exp((s - s.max(1, keepdims=True)).clip(-30)).astype(float)

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. Of a text beyond PIECE_CHARS only a piece at a time is held as features."""
        names, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        sums = np.zeros((len(texts), len(self.languages)))
        short = [k for k, t in enumerate(texts) if t and len(t) <= PIECE_CHARS]
        sums[short] = self.sums([texts[k].lower().encode().split() for k in short])
        for k, t in enumerate(texts):
            if t and len(t) > PIECE_CHARS:
                sums[k] = self.long_sums(t)
            if t and LETTER.search(t) and sums[k].sum() > 0:
                best = int(sums[k].argmax())
                names[k], scores[k] = self.languages[best], float(min(1.0, sums[k, best] / sums[k].sum()))
        return names, scores

    def sums(self, split: list[list[bytes]], before=None, after=None) -> np.ndarray:
        """Of each text's words that hold a letter the summed probabilities of the languages."""
        sizes = np.array([len(w) for w in split], np.int64)
        if not sizes.sum():
            return np.zeros((len(split), len(self.languages)))
        grams, start, lexicon, letters = word_features([w for ws in split for w in ws])
        gamma, _ = chain(self.potential(grams, start, lexicon), sizes, self.tie, before, after)
        row = np.repeat(np.arange(len(split)), sizes)[letters]
        return np.stack([np.bincount(row, gamma[letters, k], len(split)) for k in range(len(self.languages))], 1)

    def long_sums(self, text: str) -> np.ndarray:
        """The same of one long text: its pieces' transfer matrices first, then each piece between what comes before and after it."""
        at = list(piece_places(text))
        words = lambda i, j: text[i:j].lower().encode().split()
        through = []
        for i, j in at:
            ws = words(i, j)
            through.append(through_of(self.potential(*word_features(ws)[:3]), self.tie) if ws else np.eye(len(self.languages)))
        before = [np.full(len(self.languages), 1 / len(self.languages))]
        for m in through[:-1]:
            before.append((v := before[-1] @ m) / v.sum())
        after = [np.ones(len(self.languages))]
        for m in through[:0:-1]:
            after.append((v := m @ after[-1]) / v.sum())
        return sum(self.sums([words(i, j)], b, a)[0] for (i, j), b, a in zip(at, before, after[::-1]))

    def words(self, text: str) -> list[tuple[str, str]]:
        """Each word of a text with its own language."""
        words = text.split()
        grams, start, lexicon, _ = word_features(text.lower().encode().split())
        gamma, _ = chain(self.potential(grams, start, lexicon), np.array([len(start)]), self.tie)
        return [(w, self.languages[k]) for w, k in zip(words, gamma.argmax(1))]


def learn(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """Fit to (text, language) pairs."""
    languages = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(seed)
    spans = []
    for text, lang in texts:
        words = text.lower().encode().split()
        at = int(rng.integers(0, max(1, len(words) - TEXT_WORDS + 1)))
        words = words[at : at + TEXT_WORDS]
        spans += [(words[k : k + SPAN_WORDS], languages.index(lang)) for k in range(0, len(words), SPAN_WORDS)]
    spans = [spans[k] for k in rng.permutation(len(spans))]
    sequences = [spans[k : k + SPANS] for k in range(0, len(spans), SPANS)]
    n = len(languages)
    m = Model(languages, np.zeros((BUCKETS, n), np.float32), np.zeros((LEXICON, n), np.float32), np.full((n, n), 1 / max(1, n)))
    words = [w for s in sequences for ws, _ in s for w in ws]
    if n < 2 or not words:
        return m
    truth = np.array([y for s in sequences for ws, y in s for _ in ws])
    sizes = np.array([sum(len(ws) for ws, _ in s) for s in sequences])
    grams, start, lexicon, _ = word_features(words)
    of_place = np.repeat(np.arange(len(start)), np.diff(np.append(start, grams.shape[1])))
    heads = np.cumsum(sizes) - sizes
    follow = np.setdiff1d(np.arange(len(truth)), heads)
    seen = np.zeros((n, n))
    np.add.at(seen, (truth[follow - 1], truth[follow]), 1)
    for head in truth[heads[sizes > 0]]:
        seen[:, head] += 1 / n
    ties, square, square_lex, square_tie = np.zeros((n, n)), np.full(m.grams.shape, 1e-3, np.float32), np.full(m.lexicon.shape, 1e-3, np.float32), np.full((n, n), 1e-3)
    wanted = np.eye(n)[truth]
    for _ in range(ROUNDS):
        m.tie = np.exp(ties - ties.max())
        gamma, moves = chain(m.potential(grams, start, lexicon), sizes, m.tie)
        d = wanted - gamma
        for k in range(n):
            g = sum(np.bincount(row, d[of_place, k], BUCKETS) for row in grams)
            g[0] = 0
            g -= DECAY * len(truth) / 1000 * m.grams[:, k]
            square[:, k] += g * g
            m.grams[:, k] += RATE * 0.2 * g / np.sqrt(square[:, k])
            g = np.bincount(lexicon, d[:, k], LEXICON) - DECAY * len(truth) / 1000 * m.lexicon[:, k]
            square_lex[:, k] += g * g
            m.lexicon[:, k] += RATE * 0.2 * g / np.sqrt(square_lex[:, k])
        g = seen - moves
        square_tie += g * g
        ties += RATE * g / np.sqrt(square_tie)
    m.tie = np.exp(ties - ties.max())
    return m


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` texts (least hash of doc_id) with a language that are not held out; of each a piece from a place drawn by the hash."""
    rows = docs.where(F.col("lang").isNotNull() & (F.col("text") != "") & (bucket(F.col("doc_id"), 4) != 2))
    rows = rows.select("doc_id", "lang", drawn(F.col("text"), F.col("doc_id"), 20 * TEXT_WORDS).alias("text"))
    got = sampled(rows, ["doc_id"], sample, ["text"]).collect()
    return learn([(r.text, r.lang) for r in got])


def labelled(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = fit(docs, sample)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names, scores = b.column("text").to_pylist(), [], []
            for i, j in groups_of(texts, 1_000_000):
                got = model.texts(texts[i:j])
                names += got[0]
                scores += got[1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(label, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
