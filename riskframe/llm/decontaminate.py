"""Benchmark decontamination by SimHash windows.

A benchmark item of n words is looked for in every n-word window of a text.
The window's 64-bit SimHash of its five-word shingles probes a multi-index:
the fingerprint is cut into four blocks of 16 bits, and two fingerprints at
most ``RADIUS`` bits apart have a block at most ``RADIUS // 4`` bits apart. Items
are listed under the block values up to half of that away from their own, a
window asks for those up to the other half away from its own, so their lists
hold all in the radius; about 15 % of unrelated pairs meet. Candidates are
verified by the exact weighted Jaccard similarity of the shingles (weight: how
often one occurs).
A much repeated shingle rules a fingerprint more than that similarity, so
items and windows with repeats (``_heavy``) are not left to fingerprints: they
are compared exactly, all windows in one sliding count an item.

Windows too poor in benchmark shingles for that similarity are not signed: a
similarity of s over a and b shingles takes s * (a + b) / (1 + s) common ones,
and a window cannot share more than it has of all items together. Nothing is
lost by it. Texts are scanned whole, each where it is: no shuffle. Items come
to the tasks in blocks of at most about ``BLOCK_CHARS`` characters or one item; a
pass over the texts holds one block, indexed once a worker.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import free_name, written

SHINGLE = 5
SIMILARITY = 0.8
#: Bits. Similarity 0.8 of distinct shingles means a cosine of 0.89, 9.7
#: differing bits on average and a deviation of 2.9: of pairs at just 0.8 about
#: one in a thousand is farther apart.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
BLOCK_CHARS = 4_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64."""
    factor = 0x9E3779B97F4A7C15
    both = [np.full(n, f, np.uint64) for f in (factor, pow(factor, -1, 1 << 64))]
    for p in both:
        p[0] = 1
        np.multiply.accumulate(p, out=p)
    return both[0], both[1]


#: Bytes hashed at once.
PIECE = 1 << 17
_POWER, _INVERSE = _powers(PIECE + 1)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, all words of a piece at once: differences
    of a running sum of byte values times powers, shifted back to power zero.
    Pieces end at white space; only a word longer than ``PIECE`` makes one
    longer."""
    data = np.frombuffer(raw, np.uint8)
    out = []
    at = 0
    while at < len(data):
        space = _SPACE[data[at : at + PIECE]]
        if at + PIECE < len(data):
            while not space.any():
                more = _SPACE[data[at + len(space) : at + 2 * len(space)]]
                if not len(more):
                    break
                space = np.concatenate([space, more])
            else:
                space = space[: len(space) - int(space[::-1].argmax())]
        n = len(space)
        power, inverse = (_POWER, _INVERSE) if n < len(_POWER) else _powers(n + 1)
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        starts, stops = edge[::2], edge[1::2]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data[at : at + n]] * power[:n], out=total[1:])
        out.append((total[stops] - total[starts]) * inverse[starts])
        at += n
    return _mix(np.concatenate(out)) if out else np.empty(0, np.uint64)


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words)
    if n < size:
        return np.empty(0, np.uint64)
    out = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : n - size + 1 + k]
    return _mix(out)


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").lower().encode("utf-8", "surrogatepass"))


def shingle_hashes(text: str | None) -> tuple[np.ndarray, int]:
    """Hashes of the five-word shingles of the lower-cased text, in order,
    and its number of words."""
    w = _words(text)
    return _shingles(w, SHINGLE), len(w)


def sign_windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``."""
    out = np.empty(len(starts), np.uint64)
    step = max(1, (1 << 16) // size)
    for i in range(0, len(starts), step):
        at = starts[i : i + step, None] + np.arange(size)
        bits = np.unpackbits(hashes[at].view(np.uint8).reshape(len(at), size, 8), axis=2, bitorder="little")
        votes = bits.sum(axis=1, dtype=np.int32)
        out[i : i + step] = np.packbits(2 * votes > size, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def _heavy(repeats: np.ndarray | int, size: int) -> np.ndarray | bool:
    """Whether ``size`` shingles with so many ``repeats`` (those beyond their
    distinct number) may be too uneven for a fingerprint. Weights w put the
    squared distance of two vectors up by at most their sums of w * (w - 1),
    each at most repeats * (repeats + 1): let pass to a 32nd of the size."""
    return repeats * (repeats + 1) * 32 > size


def _pairs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places whose shingle occurs before, and where it did last."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    return order[1:][same], order[:-1][same]


def _repeats(pairs: tuple[np.ndarray, np.ndarray], n: int, size: int) -> np.ndarray:
    """The repeats in each of the ``n`` windows of ``size`` shingles."""
    at, before = pairs
    first, last = np.maximum(at - size + 1, 0), np.minimum(before, n - 1)
    both = first <= last
    return np.cumsum(np.bincount(first[both], minlength=n + 1) - np.bincount(last[both] + 1, minlength=n + 1))[:n]


def _slide(hashes: list[int], starts: list[int], size: int, want: Counter):
    """For each of the ascending starts, the shingles its window has in common
    with ``want``."""
    have, common, at = Counter(), 0, -size
    for start in starts:
        if start - at >= size:
            have = Counter(hashes[start : start + size])
            common = (have & want).total()
        else:
            for old, new in zip(hashes[at:start], hashes[at + size : start + size]):
                common -= have[old] <= want.get(old, 0)
                have[old] -= 1
                have[new] += 1
                common += have[new] <= want.get(new, 0)
        at = start
        yield start, common


def _near_masks(bits: int) -> np.ndarray:
    """The block values with at most so many set bits."""
    values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
    return values[np.bitwise_count(values) <= bits]


class MultiIndex:
    """Lists of fingerprints by the block values near their own ones."""

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS):
        self.fps, self.radius = fingerprints, radius
        near = radius // BLOCKS
        listed = _near_masks(near // 2)
        self.asked = _near_masks(near - near // 2)
        self.lists = []  # by block: values in order, and the fingerprint of each
        for b in range(BLOCKS):
            values = (self.block(fingerprints, b)[:, None] ^ listed).reshape(-1).astype(np.uint16)
            order = np.argsort(values, kind="stable")
            self.lists.append((values[order], (order // len(listed)).astype(np.int32)))

    @staticmethod
    def block(fps: np.ndarray, b: int) -> np.ndarray:
        return (fps >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)

    def candidates(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of places in ``fps`` and in the index that meet in a list."""
        found = []
        for b, (values, owner) in enumerate(self.lists):
            asked = (self.block(fps, b)[:, None] ^ self.asked).reshape(-1).astype(np.uint16)
            first = np.searchsorted(values, asked)
            n = np.searchsorted(values, asked, "right") - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            who = np.repeat(np.arange(len(asked)) // len(self.asked), n)
            found.append(np.unique(who * len(self.fps) + owner[at]))
        return np.divmod(np.unique(np.concatenate(found)), max(1, len(self.fps)))

    def near(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of places in ``fps`` and in the index that are at most
        ``radius`` bits apart."""
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = max(1, min(1024, (1 << 20) // max(1, len(self.fps))))
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            i, j = self.candidates(part)
            close = np.bitwise_count(part[i] ^ self.fps[j]) <= self.radius
            left.append(i[close] + at)
            right.append(j[close])
        return np.concatenate(left), np.concatenate(right)


class LeakIndex:
    """Benchmark items by length, ready to be looked up in texts. Items
    without words are left out, and without ``short_items`` those of fewer
    than five words, too; with it, all words of such an item are its single
    shingle, so it is found where they stand in a row."""

    def __init__(self, items: list[tuple[int | None, str | None]], similarity: float = SIMILARITY, short_items: bool = False):
        self.similarity = similarity
        by_size: dict[int, list[tuple[int | None, np.ndarray]]] = defaultdict(list)
        short: dict[int, dict[int, list[int | None]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in sorted(set(items), key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")):
            w = _words(text)
            if len(w) >= SHINGLE:
                hashes = _shingles(w, SHINGLE)
                by_size[len(hashes)].append((item_id, hashes))
            elif len(w) and short_items:
                short[len(w)][int(_shingles(w, len(w))[0])].append(item_id)
        # by number of words: hashes, and the items of each
        self.short = [(n, np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for n, x in sorted(short.items())]
        self.sizes = []
        for size, group in sorted(by_size.items()):
            signs = np.array([sign_windows(h, np.zeros(1, np.int64), size)[0] for _, h in group], np.uint64)
            counts = [Counter(h.tolist()) for _, h in group]
            heavy = [c for c, x in enumerate(counts) if _heavy(size - len(x), size)]
            self.sizes.append((size, [i for i, _ in group], counts, MultiIndex(signs), heavy))
        known = [h for g in by_size.values() for _, h in g]
        self.known = np.unique(np.concatenate(known)) if known else np.empty(0, np.uint64)
        bits = max(16, min(24, math.ceil(math.log2(len(self.known) + 1)) + 6))
        self.shift = np.uint64(64 - bits)
        self.filter = np.zeros(1 << bits, bool)
        self.filter[self.known >> self.shift] = True

    def leaks(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        """``(item_id, similarity, first_word, n_words)`` of each item's most
        similar window (ties: the first) at the similarity or above."""
        words = _words(text)
        out = self._short_leaks(words) + self._long_leaks(_shingles(words, SHINGLE))
        return sorted(out, key=lambda x: (x[0] is None, x[0] or 0))

    def _short_leaks(self, words: np.ndarray) -> list[tuple[int | None, float, int, int]]:
        out = []
        for n, known, ids in self.short:
            runs = _shingles(words, n)
            at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
            there = np.flatnonzero(known[at] == runs)
            which, first = np.unique(at[there], return_index=True)
            out += [(i, 1.0, int(there[f]), n) for k, f in zip(which, first) for i in ids[k]]
        return out

    def _long_leaks(self, hashes: np.ndarray) -> list[tuple[int | None, float, int, int]]:
        if not len(hashes) or not len(self.known):
            return []
        hit = self.filter[hashes >> self.shift]
        if not hit.any():
            return []
        some = hashes[hit]
        at = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
        hit[hit] = self.known[at] == some
        if not hit.any():
            return []
        seen = np.concatenate([[0], np.cumsum(hit)])
        s = self.similarity
        out = []
        pairs, all_of, listed = None, Counter(), []
        for size, ids, counts, index, heavy_items in self.sizes:
            here = min(size, len(hashes))  # a shorter text is one window
            need = s * (size + here) / (1 + s)
            starts = np.flatnonzero(seen[here:] - seen[:-here] >= need - 1e-9)
            if not len(starts):
                continue
            best: dict[int, tuple[float, int]] = {}

            def offer(c: int, start: int, common: int) -> None:
                got = common / (here + size - common)
                if got >= s - 1e-12 and (c not in best or (-got, start) < (-best[c][0], best[c][1])):
                    best[c] = (got, start)

            if pairs is None:
                pairs = _pairs(hashes)
            uneven = _heavy(_repeats(pairs, len(hashes) - here + 1, here)[starts], here)
            even = starts[~uneven]
            if len(even):
                for i, c in zip(*(x.tolist() for x in index.near(sign_windows(hashes, even, here)))):
                    start = int(even[i])
                    offer(c, start, (Counter(hashes[start : start + here].tolist()) & counts[c]).total())
            if heavy_items or uneven.any():
                if not listed:
                    listed = hashes.tolist()
                    all_of = Counter(listed)
                exact = dict.fromkeys(range(len(counts)), starts[uneven].tolist()) if uneven.any() else {}
                exact |= dict.fromkeys(heavy_items, starts.tolist())
                for c, some in exact.items():
                    # what the whole text has bounds what a window has
                    if sum(min(k, all_of.get(h, 0)) for h, k in counts[c].items()) >= need - 1e-9:
                        for start, common in _slide(listed, some, here, counts[c]):
                            offer(c, start, common)
            out += [(ids[c], got, start, here + SHINGLE - 1) for c, (got, start) in best.items()]
        return out


LEAKS = "array<struct<item_id:bigint,similarity:double,first_word:int,n_words:int>>"


def _lookups(
    benchmark: DataFrame,
    similarity: float,
    short_items: bool,
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> Iterator[Callable[[Column], Column]]:
    """For each block of the benchmark, which is read here, a function from a
    text to the block's items in it."""
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("long").alias("item_id"),
        F.col(f"`{item_text_col}`").cast("string").alias("text"),
    ).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(chars / block_chars))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    context = benchmark.sparkSession.sparkContext
    for b in range(n_blocks):
        rows = items.where(block == b).collect()  # about block_chars at most
        if n_blocks == 1 or rows:
            yield _lookup(context.broadcast([tuple(r) for r in rows]), similarity, short_items)


def leaks_of(
    text: Column,
    benchmark: DataFrame,
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    block_chars: int = BLOCK_CHARS,
    short_items: bool = False,
) -> Column:
    """The benchmark items in a text, as an array (empty: clean). One
    expression with all blocks, so a task goes through all of them: for
    benchmarks of a few blocks. Item ids are cast to long."""
    looks = _lookups(benchmark, similarity, short_items, item_col, item_text_col, block_chars)
    found = [look(text.cast("string")) for look in looks]
    return found[0] if len(found) == 1 else F.concat(*found)


_INDEX: dict[str, LeakIndex] = {}


def worker_index(token: str, items, similarity: float, short_items: bool) -> LeakIndex:
    """The index of a block, built once a worker; the last one is kept. Called
    by its name in tasks, so that it is the module's own and not a copy sent
    along with each."""
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = LeakIndex(items.value, similarity, short_items)
    return _INDEX[token]


def _lookup(items, similarity: float, short_items: bool) -> Callable[[Column], Column]:
    token = uuid.uuid4().hex

    @F.pandas_udf(LEAKS)
    def look(texts: pd.Series) -> pd.Series:
        index = worker_index(token, items, similarity, short_items)
        names = ("item_id", "similarity", "first_word", "n_words")
        return pd.Series([[dict(zip(names, x)) for x in index.leaks(t)] for t in texts])

    # nondeterministic to the optimiser, which would else run it again to
    # filter on what it returns
    return look.asNondeterministic()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    short_items: bool = False,
    **benchmark_options,
) -> DataFrame:
    """One row per document row and benchmark item in it: ``id_col, item_id,
    similarity, first_word, n_words`` of the most similar window.

    Null and empty texts hold nothing. Items of one to four words are looked
    for only with ``short_items``, as these words in a row (similarity 1); other
    items are not found in texts of fewer than five words. Repeated rows are
    each reported; repeated items once for each item id and text. Extra columns
    are not read. Document ids may be of any type, item ids are cast to long. An
    empty table on either side gives an empty result. ``benchmark_options``:
    ``item_col``, ``item_text_col``, ``block_chars``; each block of the benchmark
    is looked for in a scan of its own.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = [
        rows.select("id", look(F.col("text")).alias("leaks")).select("id", F.explode("leaks").alias("leak"))
        for look in _lookups(benchmark, similarity, short_items, **benchmark_options)
    ] or [rows.where("false").select("id", F.lit(None).cast(LEAKS).alias("x")).select("id", F.explode("x").alias("leak"))]
    return reduce(DataFrame.unionAll, found).select(F.col("id").alias(id_col), "leak.*")


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    similarity: float = SIMILARITY,
    short_items: bool = False,
    **benchmark_options,
) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item (as ``find_leaks`` finds
    them, with its options), columns unchanged. With several blocks the rows
    left are written between the passes."""
    leaks = free_name(docs, "leaks")
    out, passes = docs, 0
    for look in _lookups(benchmark, similarity, short_items, **benchmark_options):
        if passes:
            out = written(out, "clean")
        found = look(F.col(f"`{text_col}`").cast("string"))
        out = out.withColumn(leaks, found).where(F.size(leaks) == 0).drop(leaks)
        passes += 1
    return out
