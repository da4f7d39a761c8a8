"""Token ids of whole texts, by the tokenizers library, through bounded caches of recurring parts.

The vocabulary used here drops white space and splits a text at it before anything else, so the ids of
a text are the ids of its parts between spaces and line feeds, one after the other. A part of plain
Latin characters is split on into the vocabulary's own pieces, and a piece is given to the library's
model; any other part is encoded by the library as a whole. Null text is empty.
"""

from __future__ import annotations

from array import array

import public_tokenizers
import regex
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
CACHED = 400_000
LONG_PART = 48
#: Characters of which lower case, composition and class need no Unicode tables beyond Python's.
PLAIN = regex.compile(r"[\x21-\x7E¡-¬®-ɏ]+")
#: The vocabulary's split pattern.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


#: Texts by which a vocabulary's splitting is known.
PROBES = ["Don't WE'LL it's a'b", "x1234 +-*/ ab12cd ... $5.00", "Äpfel, déjà-vu ¿qué? ß½ µ", "two  spaces\tand\nlines "]


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


def splits_as_assumed(tokenizer: Tokenizer) -> bool:
    """Whether a vocabulary's own normaliser and pre-tokenizer do with PROBES what this module does: lower case, white space dropped, PIECE."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return False
    letters = byte_characters()
    for text in PROBES:
        got = [p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text))]
        if got != ["".join(letters[b] for b in p.encode()) for part in text.split() for p in PIECE.findall(part.lower())]:
            return False
    return True


class Parts(dict):
    """The ids of parts; a part that is not there is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__({"": b""})
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(self) < CACHED and len(part) <= LONG_PART:
            self[part] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(VOCABULARY))
        #: Whether the file prepares and splits texts as is assumed here; if not, the library encodes whole texts.
        self.known_kind = splits_as_assumed(self.tokenizer)
        self.model = self.tokenizer.model
        self.letters = byte_characters()
        self.parts = Parts(self._part)
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        letters = self.letters
        ids = array("I", [t.id for t in self.model.tokenize("".join([letters[b] for b in piece.encode()]))]).tobytes()
        if len(self.pieces) < CACHED and len(piece) <= LONG_PART:
            self.pieces[piece] = ids
        return ids

    def _part(self, part: str) -> bytes:
        if "<|" in part or not PLAIN.fullmatch(part):
            return array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        known = self.pieces
        return b"".join([known[p] if p in known else self._piece(p) for p in PIECE.findall(part.lower())])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.known_kind:
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        known = self.parts.__getitem__
        return [b"".join(map(known, (t or "").replace("\n", " ").split(" "))) for t in texts]


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def release() -> None:
    """Give back the memory of this worker's encoders, which outlives its tasks otherwise."""
    _ENCODERS.clear()


def groups_of(texts: list[str | None], most: int = 2_000_000):
    """(first, last) of runs of texts of at most ``most`` characters, a longer text alone."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > first and size + n > most:
            yield first, k
            first, size = k, 0
        size += n
    if texts:
        yield first, len(texts)
