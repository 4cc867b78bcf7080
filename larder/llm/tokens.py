"""Whole texts to token ids of a byte-level BPE vocabulary, by cached pieces.

The vocabulary's splitting pattern never joins anything across a single space that stands between
other characters, so a text without double spaces is the concatenation of the tokens of its
space-separated pieces, each but the first with its leading space. Pieces repeat, so their ids are
kept in a bounded cache; texts with double spaces are encoded as they are. Both ways give the
ids that the tokenizers library gives (tests hold them against it).
"""

from __future__ import annotations

import base64
import sys
import zlib
from array import array

#: Entries of a worker's cache; pieces longer than LONG characters aren't kept.
CACHE, LONG = 100_000, 40

_ENCODERS: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit numbers, the piece's leading space included."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(self) < CACHE and len(piece) <= LONG:
            self[piece] = ids
        return ids


class Encoder:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        own = tiktoken.Encoding("larder", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._ids = own.encode_ordinary
        self.pieces = _Pieces(self.plain)

    def plain(self, text: str) -> bytes:
        ids = array("I", self._ids(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of text, four little-endian bytes each."""
        if "  " in text:
            return self.plain(text)
        first, _, rest = text.partition(" ")
        head = self.plain(first) if first else b""
        if len(first) == len(text):
            return head
        return head + b"".join(map(self.pieces.__getitem__, rest.split(" ")))


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
