"""Token ids of a byte-level BPE vocabulary, by way of a cache of pre-tokens.

The library's own encoder repeats the merges of every word. Here a text is split into pre-tokens and each pre-token is encoded
by the library once and remembered. Texts of Latin characters are split by the vocabulary's pattern; where regular-expression
engines may differ, as in any other script, the library's own pre-tokeniser splits. Only texts with the text of a special
token go to the library whole, so that results are the library's in every case.
"""

from __future__ import annotations

import hashlib
import os
import re
from struct import pack

import numpy as np
from tokenizers import Tokenizer

from .common import worker_cache

# fixed values: the pre-token pattern of byte-level BPE, written for the characters that _OTHER leaves
_LETTER, _MARK = r"a-zA-Zªµºà-öø-ɏÀ-ÖØ-ß", r"!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞"
_PIECE = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[{_MARK}]+|\s+(?!\S)|\s+")
_OTHER = re.compile(r"[^\t\n\r\x20-\x7e\xa0\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧‰-⁞]")
# fixed values: the bytes that a byte-level vocabulary writes as themselves; the others take the code points from 256 on
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES: dict[int, int] = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_SPACE = chr(_BYTES[0x20])


def tokenizer_json(name: str = "byte_bpe_50k.json") -> str:
    """The vocabulary file's text; it is broadcast, so that executors need no path to it. name: of a public vocabulary, or a path."""
    import public_tokenizers

    with open(name if os.path.isabs(name) else public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


class Pieces(dict):
    """Pre-token -> what the library makes of it. It holds at most two generations of `most` entries, none longer than `longest` characters; a piece in use moves to the younger."""

    def __init__(self, make, most: int = 300_000, longest: int = 128):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, piece: str):
        if len(piece) > self.longest:
            return self.make(piece)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        self[piece] = value
        return value


class Encoder:
    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.model = self.library.model
        self.lengths = Pieces(lambda p: len(self.piece_ids(p)))
        self.pieces = Pieces(lambda p: pack(f"<{len(ids := self.piece_ids(p))}I", *ids))

    def ids_of(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def piece_ids(self, piece: str) -> list[int]:
        """Ids of one pre-token, by the library's merges alone."""
        # of printable ASCII only the space is written otherwise
        shown = piece.replace(" ", _SPACE) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.model.tokenize(shown)]

    def split(self, text: str) -> list[str] | None:
        """The text's pre-tokens in order; None for a text that holds a special token's text."""
        if self.special and self.special.search(text):
            return None
        if not _OTHER.search(text):
            return _PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        pieces = self.split(text)
        return self.ids_of(text).tobytes() if pieces is None else b"".join(map(self.pieces.__getitem__, pieces))


def encoder(spec: str) -> Encoder:
    """One for each vocabulary and worker process."""
    return worker_cache(("encoder", hashlib.sha256(spec.encode()).hexdigest()), lambda: Encoder(spec))
