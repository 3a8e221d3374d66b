"""Exact encoding with a public word-level BPE, word by word.

The tokenizer splits text into pieces that never cross white space, so a text's ids are those of its white-space parts
in order. Words repeat: each Python worker keeps the ids of the words it has met (a bounded dictionary of bytes), and
only new words reach the tokenizer. A new word that is a run of Latin letters, with or without ASCII punctuation behind
it, is one or two pieces and goes to the tokenizer's model at once; any other word takes the tokenizer's whole path.
Texts that could hold a special token's name before lower-casing take the whole path unsplit.
"""

from __future__ import annotations

import os
import re
from array import array


#: Words kept by one Python worker before its dictionary is emptied: about 140 MB.
KEPT_WORDS = 700_000
#: Lower-case ASCII and Latin-1 letters (normalised already), then ASCII punctuation.
SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, int]:
    """Code points that stand for bytes in a byte-level model: printable Latin-1 for itself, the others from 256 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - plain))}


class Words(dict):
    """Ids (as bytes) of lower-cased words; a word that isn't there is encoded and kept."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.tokenize = tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.ends: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        simple = SIMPLE.fullmatch(text.lower())
        if simple:
            letters, end = simple.groups()
            if not end:
                if not letters.isascii():
                    letters = letters.encode().decode("latin-1").translate(self.letters)
                ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
            else:
                if end not in self.ends:
                    self.ends[end] = self.whole(end)
                ids = self[word[: -len(end)]] + self.ends[end]
        else:
            ids = self.whole(text)
        self[word] = ids
        return ids


class Encoder:
    """``encode(texts)`` gives, for each text (bytes or None), its ids as little-endian unsigned 32-bit bytes (the machines' own order)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = Words(Tokenizer.from_file(path))

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        if len(known.ends) > 10_000:
            known.ends.clear()
        get = known.__getitem__
        return [b"" if not t else known.whole(t.decode()) if b"<|" in t else b"".join(map(get, t.lower().split())) for t in texts]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
