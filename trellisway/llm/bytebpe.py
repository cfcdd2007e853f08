"""Byte-level BPE ids of whole texts, with a bounded cache of space-separated chunks."""

from __future__ import annotations

import json
import re
from array import array

import tiktoken

from .common import BoundedCache

#: The pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, mapped back to the byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}


class ByteBpe:
    """Encoder for a byte-level ``tokenizers`` JSON file whose ids are its merge ranks.

    A single space always starts a new pre-token when the characters around it are no white space, so a text
    falls into chunks that can be encoded one by one and kept; other texts go to the encoder whole.
    """

    def __init__(self, path: str, special_as_text: bool = False, limit: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in back for c in token)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {token: i for token, i in ranks.items() if i not in special.values()}
        self.plain = tiktoken.Encoding("trellisway", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {} if special_as_text else special
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.chunks = BoundedCache(lambda chunk: self._pack(" " + chunk), limit)

    def _pack(self, text: str) -> bytes:
        return array("I", self.plain.encode_ordinary(text)).tobytes()

    def _ordinary(self, text: str) -> bytes:
        if "  " in text or " \n" in text or "\n " in text or _ODD_SPACE.search(text):
            return self._pack(text)
        first, *rest = text.split(" ")
        return (self._pack(first) if first else b"") + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if self.split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(
            self.special[part].to_bytes(4, "little") if part in self.special else self._ordinary(part) for part in self.split.split(text) if part
        )


_encoders: dict = {}


def encoder(path: str, special_as_text: bool = False) -> ByteBpe:
    """One encoder per worker process, file and mode."""
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = ByteBpe(path, special_as_text)
    return _encoders[key]
