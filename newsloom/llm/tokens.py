"""Byte-pair token ids as little-endian 32-bit bytes.

The vocabulary file is that of a byte-level ``tokenizers`` model; its ids are the merge ranks,
so ``tiktoken`` gives the same ids several times faster.
"""

from __future__ import annotations

import array
import json
import re
import sys
import types

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def packed(ids: list[int]) -> bytes:
    out = array.array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in self.special}
        self.coder = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text; a special token's string becomes its id, as in ``tokenizers``."""
        parts = self.cut.split(text) if self.cut else [text]
        ids = (packed([self.special[p]] if i % 2 else self.coder.encode_ordinary(p)) for i, p in enumerate(parts))
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per Python worker rather than per task."""
    name = "_newsloom_encoders"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if path not in store:
        store[path] = Encoder(path)
    return store[path]
