"""Secret scans: keyword prefilter, anchored expressions, checksums.

One Aho-Corasick automaton finds the keywords of all kinds in one pass over a
text; a kind's regular expression is matched only at its keyword's hits, left
to right, past the end of the match before. Long runs of hex digits have no
keyword: a byte table finds them. Candidates with an embedded checksum must
pass it. Texts are scanned whole, each where it is: no shuffle.
"""

from __future__ import annotations

import binascii
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import free_name

#: The kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE,
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum_ok(body: bytes, check: bytes) -> bool:
    """The last six characters are the body's CRC-32 in base 62."""
    value = 0
    for c in check:
        value = value * 62 + _BASE62.index(c)
    return value == binascii.crc32(body)


@dataclass(frozen=True)
class _Keyed:
    """``valid(match)`` decides over a match; a failing one still takes its
    characters where ``consumes``."""

    kind: str
    keywords: tuple[str, ...]
    pattern: re.Pattern
    valid: object
    consumes: bool


_KEYED = (
    _Keyed(
        "assign",
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        _ASSIGN,
        lambda m: len(m[2]) >= 12,
        True,
    ),
    _Keyed("access", ("akia",), _ACCESS, lambda m: m.end() - m.start() >= 18, True),
    _Keyed(
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        _GITHUB,
        lambda m: checksum_ok(m[1], m[2]),
        False,
    ),
    _Keyed("npm", ("npm_",), _NPM, lambda m: checksum_ok(m[1], m[2]), False),
)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for i, k in enumerate(_KEYED):
        for w in k.keywords:
            a.add_word(w, (i, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _hex_runs(raw: bytes, least: int = 16) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` lower-case hex digits. Only places
    whose neighbours ``least - 1`` further on may belong to one are kept."""
    if len(raw) < least:
        return []
    is_hex = _HEX[np.frombuffer(raw, np.uint8)]
    # every run of 16 holds an aligned block of 8
    n = len(raw) // 8
    if not is_hex[: n * 8].reshape(n, 8).all(axis=1).any():
        return []
    edge = np.flatnonzero(np.diff(is_hex, prepend=False, append=False))
    starts, stops = edge[::2], edge[1::2]
    long = stops - starts >= least
    return list(zip(starts[long].tolist(), stops[long].tolist()))


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in code points, by start, then kind as listed.
    A null text has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    # bytes as characters, so that hits are byte positions
    low = raw.lower().decode("latin-1")
    found = [(BASE_KINDS.index("hex"), s, e) for s, e in _hex_runs(raw)]
    done = [0] * len(_KEYED)
    hits = sorted((end - n + 1, i) for end, (i, n) in _AUTOMATON.iter(low))
    for start, i in hits:
        k = _KEYED[i]
        if start < done[i]:
            continue
        m = k.pattern.match(raw, start)
        if m is None:
            continue
        good = k.valid(m)
        if good or k.consumes:
            done[i] = m.end()
        if good:
            found.append((KINDS.index(k.kind), m.start(), m.end()))
    if not found:
        return []
    if len(raw) != len(text):  # bytes to code points
        first = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        at = np.concatenate([[0], np.cumsum(first)])
        found = [(k, int(at[s]), int(at[e])) for k, s, e in found]
    found.sort(key=lambda x: (x[1], x[0], x[2]))
    return [(KINDS[k], s, e) for k, s, e in found]


SPANS = "array<struct<kind:string,start:int,end:int>>"


def spans_of(text: Column) -> Column:
    """The secrets of a text as an array of ``(kind, start, end)``."""

    @F.pandas_udf(SPANS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(t)] for t in texts]
        )

    return scan(text.cast("string"))


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """``docs`` plus the secrets of its texts (``out_col``, numbered if the
    name is taken): ``kind``, ``start`` and ``end`` in code points.

    Null and empty texts have none. Spans of different kinds may overlap.
    Repeated rows are scanned alike, and an empty table gives an empty result.
    """
    return docs.withColumn(free_name(docs, out_col), spans_of(F.col(f"`{text_col}`")))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans replaced by ``[SECRET:kind]`` of its
    first span."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[SECRET:{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with the secrets of its texts masked; other columns stay, but
    ``chars_col`` (if given) becomes the length of a text that has changed.
    No row goes; a null text stays null."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else mask(t, s) if (s := find_secrets(t)) else t for t in texts]
        )

    new, old = free_name(docs, "masked"), F.col(f"`{text_col}`")
    out = docs.withColumn(new, masked(old.cast("string")))
    if chars_col is not None:
        length = F.when(F.col(new) != old, F.length(new)).otherwise(F.col(f"`{chars_col}`"))
        out = out.withColumn(chars_col, length.cast(docs.schema[chars_col].dataType))
    return out.withColumn(text_col, F.col(new)).select(*docs.columns)
