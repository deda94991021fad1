"""Whole-text encoding with a public tokenizer, memoised by piece."""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces that one Python worker remembers (about 200 bytes each); the memory is emptied when full.
REMEMBERED = 600_000

# The letters and numbers up to U+017F, whose lower case stays among them; a chunk with any other character goes to the tokenizer itself.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
_PLAIN = re.compile("[ \n!-~¡-ſ]*")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
#: Piece patterns of the two kinds of vocabulary file, over those characters.
_BYTE_LEVEL = re.compile(rf"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_LOWER_WORDS = re.compile(rf"{_ENDINGS}|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\0]")

_encoders: dict[str, "PieceEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 as is, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    """Encodes whole texts to little-endian ids; equal to one ``encode`` call per text.

    Both kinds of public vocabulary cut text into pieces and merge within each. Over the characters up to U+017F the
    cut is one regular expression here; each distinct piece is merged once by the tokenizer's own model, and its ids
    are looked up from then on. A text with other characters is first cut at single spaces between other
    characters, which no piece crosses, and chunks that hold such characters go to the tokenizer itself, as do texts where
    that cut is unsafe (runs of white space, strings of added tokens).
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.added = [x.content for x in self.whole.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.lower = bool(json.load(f)["normalizer"])
        self.pattern = _LOWER_WORDS if self.lower else _BYTE_LEVEL
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        known, letters, merge, code = self.known, self.letters, self.whole.model.tokenize, self.code
        for p in pieces.difference(known):
            known[p] = array(code, [t.id for t in merge(p.encode().decode("latin-1").translate(letters))]).tobytes()

    def _plain(self, text: str) -> bytes:
        pieces = self.pattern.findall(text.lower() if self.lower else text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self._learn(set(pieces))
            return b"".join(map(self.known.__getitem__, pieces))

    def _cut(self, text: str) -> list[str]:
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or _OTHER_SPACE.search(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """One buffer of ids of ``self.dtype`` per text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for text in texts:
            if any(x in text for x in self.added):
                out.append(self._whole([text])[0])
            elif _PLAIN.fullmatch(text):
                out.append(self._plain(text))
            else:
                out.append(b"".join([self._plain(c) if _PLAIN.fullmatch(c) else self._whole([c])[0] for c in self._cut(text)]))
        return out


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
