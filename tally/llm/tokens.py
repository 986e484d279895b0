"""Byte-level BPE ids of whole texts, remembered word by word."""

from __future__ import annotations

import json
import re

import numpy as np

#: Words whose ids a Python worker remembers; beyond it starts anew, which bounds its memory.
REMEMBERED = 600_000
#: No split of the vocabulary's pattern runs from other characters into white space,
#: so a text may be cut before each run of white space.
_PIECE = re.compile(r"\s*\S+|\s+")
#: White space to Python, but not to the pattern.
_ODD = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Ids as the tokenizers library gives them for the vocabulary file, as little-endian unsigned 32-bit bytes.

    Words not met before are merged by tiktoken over the same vocabulary; texts that hold
    a special token's string, or characters on which the two libraries' white space
    differs, are encoded by the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.words = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = sorted(special)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or _ODD.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = _PIECE.findall(text)
        found = list(map(self.known.get, pieces))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for p in [p for p in set(pieces) if p not in self.known]:
                self.known[p] = np.array(self.words.encode_ordinary(p), "<u4").tobytes()
            found = list(map(self.known.__getitem__, pieces))
        return b"".join(found)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]
