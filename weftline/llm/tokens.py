"""Encoding of whole texts with a public tokenizer file, fast on repeated words.

A text is cut at white space where the cut cannot change the ids, every distinct
piece is encoded once with the tokenizers library and kept in a bounded cache,
and the ids of the pieces are joined.
"""

from __future__ import annotations

import os
import re
from struct import Struct

import numpy as np

#: Pieces kept by one Python worker; the cache is emptied when it is full.
CACHE = 400_000
#: A word of Latin-1 letters with marks behind it: both vocabularies split it there and nowhere else.
_PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?|#$%&*()]*)")
#: White space other than spaces and line ends, and the cutting mark itself; there, and where spaces or line ends meet, the cut needs care.
_RARE = re.compile("[\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Before a lone space; around a lone line end.
_LONE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")


def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level vocabularies write bytes that have no printable form."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_LETTERS = _byte_letters()
_PACK = [Struct(f"<{n}I").pack for n in range(64)]


class _Known(dict):
    """The ids of pieces as bytes; an unknown piece is encoded when it is asked for."""

    def __init__(self, tokenizer, spaced: bool):
        super().__init__()
        self.whole, self.model, self.spaced = tokenizer.encode, tokenizer.model.tokenize, spaced

    def _ids(self, part: str) -> bytes:
        """The ids of a part that the vocabulary does not split before its merges."""
        if part.isascii():
            letters = "\u0120" + part[1:] if part[:1] == " " else part  # the letter for a space
        else:
            letters = part.encode().decode("latin-1").translate(_LETTERS)
        ids = [t.id for t in self.model(letters)]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        """Plain words go to the model at once; the rest through the library's whole chain."""
        if plain := _PLAIN.fullmatch(piece):
            word, marks = plain.groups()
            if self.spaced:
                word = word.lower()
            if marks:
                got = self[word] + (self.get(marks) or self.setdefault(marks, self._ids(marks)))
            else:
                got = self._ids(word) if word == piece else self[word]
        else:
            got = np.array(self.whole(piece, add_special_tokens=False).ids, "<u4").tobytes()
        self[piece] = got
        return got


class Encoder:
    """Texts to ids.

    ``spaced``: the tokenizer drops white space between words (pieces lose it);
    otherwise a piece keeps its leading space, as byte-level vocabularies ask.
    Strings of special tokens in a text give these tokens' ids, as the library has it
    by default; with ``ordinary`` they are text as any other.
    """

    def __init__(self, path: str, spaced: bool, cache: int = CACHE, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        self.spaced, self.cache, self.known = spaced, cache, _Known(self.tokenizer, spaced)

    def pieces(self, text: str) -> list[str]:
        if self.spaced:
            return text.replace("\n", " ").split(" ")
        if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or _RARE.search(text):
            return _LONE.split(text)
        return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01").split("\x01")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, little-endian unsigned 32-bit."""
        done, ids = {}, self.known.__getitem__
        for text in texts:
            if text not in done:
                done[text] = np.frombuffer(b"".join(map(ids, self.pieces(text))), "<u4")
                if len(self.known) > self.cache:
                    self.known.clear()
        return [done[text] for text in texts]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool, cache: int = CACHE, ordinary: bool = False) -> Encoder:
    """One encoder for each Python worker and file."""
    key = (path, spaced, cache, ordinary)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def in_slices(texts: list[str], limit: int = 4_000_000):
    """(start, end) of runs of texts with about ``limit`` characters, one text at least."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > limit:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
