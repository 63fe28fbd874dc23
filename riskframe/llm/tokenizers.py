"""Public tokenizers as encoders with a byte string for every id.

An encoder is a small picklable value that holds its vocabulary file's bytes,
so tasks need no file of their own; each Python worker builds the library's
object once. Files are read from a path on the driver; their size is that of
a vocabulary, not of the data.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass, field

#: Fixed value: how byte-level BPE splits a text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The piece alphabet's sign for a space.
SPACE_SIGN = "▁"
LONG_SPACE = re.compile(r"\s{1000}")
#: Words whose pieces a worker remembers.
MOST_WORDS = 200_000

_LOADED: dict[str, object] = {}


def _once(key: str, build):
    """One library object for each key and Python worker."""
    if key not in _LOADED:
        _LOADED[key] = build()
    return _LOADED[key]


def byte_alphabet() -> dict[str, int]:
    """The byte for each character of byte-level BPE: printable bytes stand
    for themselves, the others for 256, 257, ... in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class ByteLevelBpe:
    """Byte-level BPE from a JSON vocabulary whose ids follow the merges.
    Control strings inside texts are plain text; nothing is added."""

    raw: bytes = field(repr=False)

    @classmethod
    def from_file(cls, path: str) -> ByteLevelBpe:
        with open(path, "rb") as f:
            out = cls(f.read())
        model = json.loads(out.raw)["model"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(joined)):
            raise ValueError(f"ids of {os.path.basename(path)} do not follow its merges")
        return out

    @property
    def key(self) -> str:
        return "byte:" + hashlib.sha256(self.raw).hexdigest()

    def pieces(self) -> list[bytes]:
        """The bytes of every id."""
        data = json.loads(self.raw)
        byte = byte_alphabet()
        table = {i: bytes(byte[c] for c in t) for t, i in data["model"]["vocab"].items() if all(c in byte for c in t)}
        added = {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
        table |= added
        return [table.get(i, b"") for i in range(max(table) + 1)]

    def _build(self):
        import tiktoken

        data = json.loads(self.raw)
        byte = byte_alphabet()
        added = {t["content"] for t in data.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in added}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _slow(self):
        import tokenizers

        out = tokenizers.Tokenizer.from_str(self.raw.decode())
        out.encode_special_tokens = True
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        key = self.key
        one = _once(key, self._build).encode_ordinary
        # the fast library's pattern runs out of stack in long runs of space
        return [
            _once("slow-" + key, self._slow).encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else one(t)
            for t in texts
        ]


class _Words:
    """A piece model and what it made of the words it has seen."""

    def __init__(self, raw: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # no piece holds a space after another character: merges never cross
        # from one space-led word into the next, so words encode by themselves
        self.apart = all(SPACE_SIGN not in n.lstrip(SPACE_SIGN) for n in names)
        self.seen: dict[str, list[int]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        split = [t.split(" ") if self.apart and "  " not in f" {t} " and SPACE_SIGN not in t else None for t in texts]
        if len(self.seen) > MOST_WORDS:
            self.seen.clear()
        seen = self.seen
        new = list({w for words in split if words for w in words if w not in seen})
        seen.update(zip(new, self.model.encode(new, num_threads=1)))
        for i, words in enumerate(split):
            if words is None:
                out[i] = self.model.encode([texts[i]], num_threads=1)[0]
            else:
                ids: list[int] = []
                for w in words:
                    ids += seen[w]
                out[i] = ids
        return out


@dataclass(frozen=True)
class PieceBpe:
    """Sentence-piece BPE with byte fallback; it puts a space before a text."""

    raw: bytes = field(repr=False)

    @classmethod
    def from_file(cls, path: str) -> PieceBpe:
        with open(path, "rb") as f:
            return cls(f.read())

    @property
    def key(self) -> str:
        return "piece:" + hashlib.sha256(self.raw).hexdigest()

    def _words(self) -> _Words:
        return _once(self.key, lambda: _Words(self.raw))

    def pieces(self) -> list[bytes]:
        """The bytes of every id: the sign for a space as one, ``<0xHH>`` as
        that byte, others as they are written."""
        model = self._words().model
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        return [
            bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace(SPACE_SIGN, " ").encode()
            for i, n in enumerate(names)
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._words().encode(texts)
