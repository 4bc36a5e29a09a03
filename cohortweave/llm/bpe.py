"""Token ids of whole texts by the tokenizers library, with a bounded table of pieces already known.

Byte-level BPE merges only inside the pieces its pattern cuts a text into, so equal pieces have
equal ids. Texts are cut by the same pattern, and the library's model encodes every piece once per
worker while the table lasts. The table has a newer and an older half: what is asked for stays in the
newer one, and the older one goes when that is full. So its memory is bounded, and pieces that come
often are not lost with those that came once; ids do not depend on it.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

TABLE_PIECES = 600_000  # in both halves together

#: The vocabulary the queries use; a path of another byte-level file may be passed instead.
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


#: The pattern of the pieces for the standard library, which is faster. It differs for numbers that are
#: no decimal digits and for four control characters; texts with these are cut by the first pattern.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _unlike() -> frozenset[str]:
    """Characters the two patterns do not agree on."""
    numbers = {c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) in ("No", "Nl")}
    return frozenset(numbers | set("\x1c\x1d\x1e\x1f"))


_UNLIKE_ASCII = re.compile("[\x1c-\x1f]").search  # those of ASCII, found faster


def _byte_characters() -> dict[int, str]:
    """The character byte-level vocabularies write for each byte: itself if it shows, else one from 256 on."""
    shows = [b for b in range(256) if 33 <= b <= 126 or (b >= 161 and b != 173)]
    hidden = [b for b in range(256) if b not in shows]
    return {b: chr(b) for b in shows} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Packed ids by piece; a piece that is not there is taken from the older half or made."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self._make, self._older = make, {}

    def __missing__(self, piece: str) -> bytes:
        made = self._older.get(piece)
        if made is None:
            made = self._make(piece)
        if 2 * len(self) >= TABLE_PIECES:
            self._older = dict(self)
            self.clear()
        self[piece] = made
        return made


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each core a task of its own
        self._whole = Tokenizer.from_file(path)
        self._merged = self._whole.model.tokenize
        self._slow = regex.compile(public_tokenizers.PATTERN).findall
        self._unlike, self._bytes = _unlike(), _byte_characters()
        self._special = [t.content for t in self._whole.get_added_tokens_decoder().values()]
        self._known = _Pieces(self._encoded)

    def _cut(self, text: str) -> list[str]:
        alike = not _UNLIKE_ASCII(text) if text.isascii() else self._unlike.isdisjoint(text)
        return _FAST.findall(text) if alike else self._slow(text)

    def _encoded(self, piece: str) -> bytes:
        ids = [t.id for t in self._merged(piece.encode().decode("latin-1").translate(self._bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def packed(self, text: str) -> bytes:
        """Ids of a text as the library gives them without special tokens added, little-endian, 32 bits each."""
        if any(s in text for s in self._special):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self._known.__getitem__, self._cut(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), dtype="<u4").tolist()

    def array(self, text: str | None, end: int) -> np.ndarray:
        """Ids of a text (null: empty) and the end id, as little-endian unsigned 32-bit integers."""
        return np.frombuffer(self.packed(text or "") + struct.pack("<I", end), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]

