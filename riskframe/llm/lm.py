"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for every uni- and bigram of the training texts, its count
on a log scale: a gram of level q (count 2**(q-1) to 2**q - 1) is entered
under 1 to q, and probing 1, 2, ... until one is missing reads the level back.
False positives only raise a level. The filter grows with the training tokens
(``BITS_PER_TOKEN``), so their share stays the same at every size; it is cut
into segments by hash and never gathered. Probabilities are smoothed from the
quantised counts c:

    P(v)     = (c(v) + 1) / (N + V + 1)
    P(v | u) = (c(u v) + PRIOR * P(v)) / (c(u) + PRIOR)

Scale. Texts are read once and written in batches of about ``BATCH_BYTES`` as
a dictionary of the batch's tokens and one code per token. Token counts are
summed over dictionaries, not over documents, so a token costs a row per
batch, never a row per occurrence, and each batch gets the exact totals of its
own tokens back.

The filter is made of training grams alone. Each batch's distinct ones are cut
by at most ``RADIX_BITS`` of their hash a step; between steps as many batches
are merged as a step has values, so a step has at most ``2 ** RADIX_BITS`` rows
a batch, a group never holds more grams than a batch has, and rows grow in
proportion to the batches. The buckets at the end fill a segment each, written
as a table: the model. Scoring probes it by slices of at most ``SLICE_BYTES``:
the grams that each batch asks for are written by slice, a pass broadcasts one
slice and reads their levels, so every gram is probed once, in one pass. There
is a row for each batch and slice (one slice for some 16 batches).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.frames import scratch_path
from riskframe.llm.common import written

BATCH_BYTES = 16 << 20
#: Bits of the filter: at least ``BITS_PER_TOKEN`` for each training token,
#: up to a power of two.
MIN_BITS = 1 << 20
BITS_PER_TOKEN = 6
PROBES = 3
#: Pseudo-count of the unigram distribution in a bigram's.
PRIOR = 200.0
#: Buckets per batch, and at least.
BUCKETS_PER_BATCH, MIN_BUCKETS = 4, 256
#: Most bits of a radix step.
RADIX_BITS = 8
#: Most bytes of the filter broadcast at once (through the driver, too).
SLICE_BYTES = 32 << 20
#: Parts of a slice's questions.
PROBE_TASKS = 32
#: Grams worked on at once.
CHUNK = 1 << 19
#: The end token; words are never empty.
END = b""
#: Hash bits of a gram within its bucket. A bucket has some 10**5 to 10**6
#: grams at every size, so an unseen one seldom shares them with a seen one.
REST_BITS = 32
#: Most bits that ``build_filter`` gathers.
WHOLE_BITS = 1 << 29

_BATCH = (
    "batch long, ids array<long>, train array<boolean>, lengths array<int>, "
    "tokens array<string>, n_train array<long>, hashes binary, codes binary, taught long"
)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, 7) for t in tokens), np.uint64, len(tokens))


#: History of a text's first token.
_BEGIN = np.uint64(0x9E3779B97F4A7C15)


def bigram_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return _mix(left * np.uint64(3) + np.uint64(1) + _mix(right))


def unigram_hashes(tokens: np.ndarray) -> np.ndarray:
    return _mix(tokens ^ np.uint64(0x5851F42D4C957F2D))


def _pack(codes: np.ndarray) -> bytes:
    """Codes as byte planes, packed: high planes are mostly zero."""
    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.Codec("zstd", 1).decompress(packed, 4 * n, asbytes=True)
    planes = np.frombuffer(raw, np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


class _Batch:
    """Texts as codes into a dictionary of their tokens."""

    def __init__(self):
        self.codes: dict[bytes, int] = {END: 0}
        self.ids: list = []
        self.train: list[bool] = []
        self.parts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id, text: str | None, train: bool) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        words = raw.split()
        codes = self.codes
        part = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint32, len(words))
        self.parts.append(np.append(part, np.uint32(0)))
        self.ids.append(doc_id)
        self.train.append(bool(train))
        self.bytes += len(raw) + 16

    def row(self, batch: int) -> pa.RecordBatch:
        lengths = np.fromiter(map(len, self.parts), np.int32, len(self.parts))
        codes = np.concatenate(self.parts)
        taught = np.repeat(np.array(self.train, bool), lengths)
        n_train = np.bincount(codes[taught], minlength=len(self.codes))
        hashes = token_hashes(list(self.codes))
        self.parts.clear()
        tokens = [t.decode("utf-8", "surrogatepass") for t in self.codes]
        values = [[batch], [self.ids], [self.train], [lengths], [tokens], [n_train], [hashes.tobytes()], [_pack(codes)], [int(n_train.sum())]]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
        names = [c.split()[0] for c in _BATCH.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)


def _encode(batch_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # unique within the one committed attempt of each task
        number = TaskContext.get().partitionId() << 32
        batch = _Batch()
        for rows in batches:
            ids, texts, train = (rows.column(i) for i in range(3))
            for i in range(len(rows)):
                batch.add(ids[i].as_py(), texts[i].as_py(), train[i].as_py())
                if batch.bytes >= batch_bytes:
                    yield batch.row(number)
                    batch, number = _Batch(), number + 1
        if batch.ids:
            yield batch.row(number)

    return encode


def _pieces(codes: np.ndarray, lengths: np.ndarray, hashes: np.ndarray):
    """The texts of a batch, about ``CHUNK`` tokens at a time: first and last
    text, first and last token, and each token's bigram hash (the history of
    a text's first token is ``_BEGIN``)."""
    ends = np.cumsum(lengths)
    first = start = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, start + CHUNK, "right")))
        stop = int(ends[last - 1])
        right = hashes[codes[start:stop]]
        left = np.empty_like(right)
        left[1:] = right[:-1]
        left[ends[first:last] - lengths[first:last] - start] = _BEGIN
        yield first, last, start, stop, bigram_hashes(left, right)
        first, start = last, stop


#: Grams are told apart by all bits but the last, which marks training ones
#: while a batch is counted.
_LAST = np.uint64(1)


def _batch_grams(
    codes: np.ndarray, lengths: np.ndarray, train: np.ndarray, hashes: np.ndarray, n_train: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted, last bit 0) of a batch's uni- and bigrams and how often
    each occurs in its training texts."""
    lengths = lengths.astype(np.int64)
    pairs = np.empty(len(codes), np.uint64)
    for first, last, start, stop, both in _pieces(codes, lengths, hashes):
        pairs[start:stop] = (both & ~_LAST) | np.repeat(train[first:last], lengths[first:last])
    pairs.sort()
    cuts = np.flatnonzero(np.concatenate([[True], pairs[1:] >> _LAST != pairs[:-1] >> _LAST]))
    n_two = np.add.reduceat((pairs & _LAST).astype(np.int64), cuts)
    two = pairs[cuts] & ~_LAST
    del pairs
    grams = np.concatenate([unigram_hashes(hashes) & ~_LAST, two])
    order = np.argsort(grams, kind="stable")
    return grams[order], np.concatenate([n_train, n_two])[order]


def _columns(rows: pa.RecordBatch) -> Iterator[dict]:
    """Each batch row's columns: lists as arrays, binaries as bytes."""
    for i in range(len(rows)):
        out = {}
        for name in rows.schema.names:
            cell = rows.column(name)[i]
            if pa.types.is_list(cell.type):
                keep = name == "ids"  # may hold nulls
                out[name] = cell.values if keep else cell.values.to_numpy(zero_copy_only=False)
            else:
                out[name] = cell.as_py()
        yield out


def encoded(docs: DataFrame) -> DataFrame:
    """``docs(id, text, train)`` as written batches."""
    rows = docs.select(
        F.col("id").cast("long"), F.col("text").cast("string"), F.coalesce("train", F.lit(False))
    )
    return written(rows.mapInArrow(_encode(BATCH_BYTES), _BATCH), "batches")


# --- exact token counts -----------------------------------------------------


def token_totals(batches: DataFrame) -> DataFrame:
    """For each batch the training counts of its dictionary's tokens
    (``totals``: array of ``pos, c``), and its share of ``n`` (training
    tokens) and ``v`` (distinct ones); every token is in the share of one
    batch only. A token's rows are at most one per batch."""
    rows = batches.select(
        "batch", F.posexplode(F.arrays_zip("tokens", "n_train")).alias("pos", "t")
    ).select("batch", "pos", F.col("t.tokens").alias("token"), F.col("t.n_train").alias("n"))
    by = Window.partitionBy("token")
    rows = rows.select(
        "batch",
        "pos",
        F.row_number().over(by.orderBy("batch")).alias("i"),
        F.sum("n").over(by.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("c"),
    )
    once = F.col("i") == 1
    return written(
        rows.groupBy("batch").agg(
            F.collect_list(F.struct("pos", "c")).alias("totals"),
            F.sum(F.when(once, F.col("c")).otherwise(0)).alias("n"),
            F.sum(F.when(once & (F.col("c") > 0), 1).otherwise(0)).alias("v"),
        ),
        "totals",
    )


# --- the filter -------------------------------------------------------------


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]


def quantised(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range, 0 for 0."""
    low = np.ldexp(0.5, level)
    return np.where(level > 0, np.where(level > 1, 1.5 * low - 0.5, 1.0), 0.0)


@dataclass
class LogBloom:
    """Bits in ``2**bucket_bits`` segments; a gram's hash names its segment
    and, with the level, its places there."""

    bits: np.ndarray
    bucket_bits: int
    segment: int  # bits of a segment, a power of two of at least 64

    @staticmethod
    def places(rest: np.ndarray, level: int, segment: int) -> np.ndarray:
        """Bit places in the segment, one row per probe."""
        base = _mix(rest + np.uint64((level * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        step = (base >> np.uint64(32)) | np.uint64(1)
        return np.stack([(base + step * np.uint64(k)) & np.uint64(segment - 1) for k in range(PROBES)])

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """Levels of the grams, 0 for one that is not there."""
        start = (hashes >> np.uint64(64 - self.bucket_bits)) * np.uint64(self.segment)
        return _read(self.bits, _rest(hashes, self.bucket_bits), start, self.segment)


def _read(bits: np.ndarray, rest: np.ndarray, start: np.ndarray, segment: int) -> np.ndarray:
    """Levels of the grams whose segments begin at the bits ``start``."""
    out = np.zeros(len(rest), np.uint8)
    for i in range(0, len(rest), CHUNK):
        r, s = rest[i : i + CHUNK], start[i : i + CHUNK]
        left = np.arange(len(r))
        level = 1
        while len(left) and level <= 64:
            at = LogBloom.places(r[left], level, segment) + s[left]
            there = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            left = left[there.all(axis=0)]
            out[i + left] = level
            level += 1
    return out


def _rest(hashes: np.ndarray, bucket_bits: int) -> np.ndarray:
    return _lead(hashes, bucket_bits + REST_BITS) & np.uint64((1 << REST_BITS) - 1)


def _lead(hashes: np.ndarray, width: int) -> np.ndarray:
    return hashes >> np.uint64(64 - width)


def _pack_sorted(x: np.ndarray, width: int) -> bytes:
    """Sorted numbers of ``width`` bits by Elias and Fano: the low bits as they
    are, the high ones as the gaps between set bits."""
    n = len(x)
    low = max(0, width - n.bit_length())
    high = np.zeros(n + (1 << (width - low)), bool)
    high[(x >> np.uint64(low)).astype(np.int64) + np.arange(n)] = True
    parts = [n.to_bytes(4, "little"), np.packbits(high).tobytes()]
    for i in range(0, n, CHUNK // 8):
        some = x[i : i + CHUNK // 8].astype("<u8").view(np.uint8).reshape(-1, 8)
        parts.append(np.packbits(np.unpackbits(some, axis=1, bitorder="little")[:, :low]).tobytes())
    return b"".join(parts)


def _unpack_sorted(blob: bytes, width: int) -> tuple[np.ndarray, int]:
    """The numbers and where they end in ``blob``."""
    n = int.from_bytes(blob[:4], "little")
    low = max(0, width - n.bit_length())
    raw = np.frombuffer(blob, np.uint8)
    room = n + (1 << (width - low))
    at = 4 + (room + 7) // 8
    high = np.flatnonzero(np.unpackbits(raw[4:at], count=room)) - np.arange(n)
    out = high.astype(np.uint64) << np.uint64(low)
    for i in range(0, n, CHUNK // 8):
        k = min(CHUNK // 8, n - i)
        end = at + (k * low + 7) // 8
        bits = np.zeros((k, 64), np.uint8)
        bits[:, :low] = np.unpackbits(raw[at:end], count=k * low).reshape(k, low)
        out[i : i + k] |= np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
        at = end
    return out, at


def _blob(x: np.ndarray, counts: np.ndarray, width: int = REST_BITS) -> bytes:
    return _pack_sorted(x, width) + _pack(counts)


def _unblob(blob: bytes, width: int = REST_BITS) -> tuple[np.ndarray, np.ndarray]:
    x, end = _unpack_sorted(blob, width)
    return x, _unpack(blob[end:], len(x)).astype(np.int64)


def _merged(blobs: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of all blobs, sorted, and the sums of their counts."""
    parts = [_unblob(b.as_py(), width) for b in blobs]
    x = np.concatenate([p[0] for p in parts])
    order = np.argsort(x, kind="stable")
    x = x[order]
    cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[cuts], np.add.reduceat(np.concatenate([p[1] for p in parts])[order], cuts)


def _runs(x: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """Sorted numbers cut by their leading ``bits``: the values there are of
    these, the numbers without them, and where each value's are."""
    lead = (x >> np.uint64(width - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(lead, prepend=-1))
    places = [slice(a, b) for a, b in zip(cuts, np.append(cuts[1:], len(x)))]
    return lead[cuts], x & np.uint64((1 << (width - bits)) - 1), places


def _asked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    codes = _unpack(row["codes"], int(row["lengths"].sum()))
    hashes = np.frombuffer(row["hashes"], np.uint64)
    return _batch_grams(codes, row["lengths"], row["train"], hashes, row["n_train"])


_RADIX = "prefix long, batches long, blob binary"


def _radix_rows(x: np.ndarray, counts: np.ndarray, width: int, bits: int, prefix: int, batches: int) -> dict:
    lead, rest, places = _runs(x, width, bits)
    return {
        "prefix": pa.array((prefix << bits) + lead, pa.int64()),
        "batches": pa.array(np.full(len(lead), batches), pa.int64()),
        "blob": pa.array([_blob(rest[at], counts[at], width - bits) for at in places], pa.binary()),
    }


def _spread(width: int, bits: int):
    """A batch's training grams, cut by the first radix."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in _columns(rows):
                grams, counts = _asked(row)
                taught = counts > 0
                x = _lead(grams[taught], width)
                yield pa.RecordBatch.from_pydict(_radix_rows(x, counts[taught], width, bits, 0, row["batches"]))

    return spread


def _split(width: int, bits: int):
    """The grams of some batches that share a prefix, merged and cut by the
    next radix."""

    def split(key: tuple, table: pa.Table) -> pa.Table:
        prefix, batches = (k.as_py() for k in key)
        x, counts = _merged(table.column("blob"), width)
        return pa.table(_radix_rows(x, counts, width, bits, prefix, batches >> bits))

    return split


def _segment(segment: int, slice_shift: int):
    """The segment that a bucket's grams fill."""

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        rest, counts = _merged(table.column("blob"), REST_BITS)
        bits = np.zeros(segment, bool)
        level = levels(counts)
        for q in range(1, int(level.max(initial=0)) + 1):
            bits[LogBloom.places(rest[level >= q], q, segment).reshape(-1)] = True
        bucket = key[0].as_py()
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"bucket": [bucket], "bits": pa.array([packed], pa.binary()), "grams": [len(rest)], "slice": [bucket >> slice_shift]})

    return fill


def filter_shape(n_batches: int, n_tokens: int) -> tuple[int, int]:
    """Binary logarithm of the number of segments, and the bits of one."""
    buckets = max(MIN_BUCKETS, BUCKETS_PER_BATCH * n_batches)
    bucket_bits = (buckets - 1).bit_length()
    n_bits = 1 << max(0, BITS_PER_TOKEN * n_tokens - 1).bit_length()
    return bucket_bits, max(MIN_BITS, n_bits, 64 << bucket_bits) >> bucket_bits


def radix_steps(bucket_bits: int) -> list[int]:
    """The bits of each step, as even as can be."""
    n = max(1, -(-bucket_bits // RADIX_BITS))
    return [bucket_bits // n + (i < bucket_bits % n) for i in range(n)]


def slice_bits(bucket_bits: int, segment: int) -> int:
    """Binary logarithm of the number of slices; a segment is in one of them."""
    slices = -(-(segment << bucket_bits) // (8 * SLICE_BYTES))
    return min(bucket_bits, (slices - 1).bit_length())


@dataclass
class FilterTable:
    """The written filter: ``bucket, bits, grams``, by ``slice``."""

    rows: DataFrame
    bucket_bits: int
    segment: int
    slice_bits: int

    @property
    def width(self) -> int:
        """Bits of a hash that the filter tells apart."""
        return self.bucket_bits + REST_BITS

    def load(self, number: int) -> np.ndarray:
        """A slice, packed: at most ``SLICE_BYTES`` or one segment."""
        size = self.segment // 8
        per_slice = 1 << (self.bucket_bits - self.slice_bits)
        bits = np.zeros(size * per_slice, np.uint8)
        for row in self.rows.where(F.col("slice") == number).select("bucket", "bits").collect():
            at = (row["bucket"] - number * per_slice) * size
            bits[at : at + size] = np.frombuffer(row["bits"], np.uint8)
        return bits


def radix_rows(batches: DataFrame, n_batches: int, bucket_bits: int) -> list[DataFrame]:
    """The rows of each radix step; the last ones' prefixes are buckets."""
    steps = radix_steps(bucket_bits)
    width = bucket_bits + REST_BITS
    # batches that are merged before the second step share a number
    groups = max(1, n_batches >> steps[0])
    number = F.pmod(F.xxhash64("batch"), F.lit(groups)).alias("batches")
    rows = batches.where("taught > 0").select("lengths", "train", "n_train", "hashes", "codes", number)
    out = [rows.mapInArrow(_spread(width, steps[0]), _RADIX)]
    for done, bits in enumerate(steps[1:], 1):
        split = _split(width - sum(steps[:done]), bits)
        out.append(out[-1].groupBy("prefix", "batches").applyInArrow(split, _RADIX))
    return out


def write_filter(batches: DataFrame) -> FilterTable:
    """The filter of the batches' training grams as a table."""
    told = batches.agg(F.count("*"), F.sum("taught")).first()
    bucket_bits, segment = filter_shape(told[0], told[1] or 0)
    slices = slice_bits(bucket_bits, segment)
    grams = radix_rows(batches, told[0], bucket_bits)[-1]
    schema = "bucket long, bits binary, grams long, slice long"
    filled = grams.groupBy("prefix").applyInArrow(_segment(segment, bucket_bits - slices), schema)
    path = scratch_path(batches.sparkSession, "filter")
    filled.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(path)
    return FilterTable(batches.sparkSession.read.schema(schema).parquet(path), bucket_bits, segment, slices)


def build_filter(batches: DataFrame) -> tuple[LogBloom, int]:
    """The whole filter in one array and the number of training grams, to look
    at a small corpus; scoring never gathers it. Over ``WHOLE_BITS`` it
    raises."""
    table = write_filter(batches)
    if table.segment << table.bucket_bits > WHOLE_BITS:
        raise ValueError(f"{table.segment << table.bucket_bits} bits are too many to gather")
    bits = np.concatenate([table.load(i) for i in range(1 << table.slice_bits)])
    grams = table.rows.agg(F.sum("grams")).first()[0] or 0
    return LogBloom(bits, table.bucket_bits, table.segment), grams


def _ask(width: int, bits: int):
    """A batch's grams, held-out ones included, by the slice they are in."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in _columns(rows):
                lead, rest, places = _runs(_lead(_asked(row)[0], width), width, bits)
                blobs = [_pack_sorted(rest[at], width - bits) for at in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(lead), row["batch"])), pa.array(blobs, pa.binary()), pa.array(lead)],
                    names=["batch", "blob", "slice"],
                )

    return ask


def _probe(held, segment: int, width: int):
    """The levels of the grams asked for, read from the broadcast slice."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codec = held.value, pa.Codec("zstd", 1)
        for rows in batches:
            for number, blob in zip(rows.column("batch"), rows.column("blob")):
                x, _ = _unpack_sorted(blob.as_py(), width)
                start = (x >> np.uint64(REST_BITS)) * np.uint64(segment)
                read = _read(bits, x & np.uint64((1 << REST_BITS) - 1), start, segment)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number.as_py()], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([codec.compress(read.tobytes(), asbytes=True)], pa.binary())],
                    names=["batch", "n", "levels"],
                )

    return probe


def gram_levels(batches: DataFrame, table: FilterTable) -> DataFrame:
    """For each batch the filter's levels of its grams: ``found``, an array of
    ``slice, n, levels``. One pass a slice: it is broadcast, probed for the
    grams that are in it, and let go."""
    spark = batches.sparkSession
    schema = "batch long, blob binary, slice long"
    asked = batches.select("batch", "lengths", "train", "n_train", "hashes", "codes").mapInArrow(
        _ask(table.width, table.slice_bits), schema
    )
    questions, answers = scratch_path(spark, "questions"), scratch_path(spark, "levels")
    part = F.pmod(F.xxhash64("batch"), F.lit(PROBE_TASKS))
    asked.repartition("slice", part).write.mode("overwrite").partitionBy("slice").parquet(questions)
    asked = spark.read.schema(schema).parquet(questions)
    for number in range(1 << table.slice_bits):
        held = spark.sparkContext.broadcast(table.load(number))
        probe = _probe(held, table.segment, table.width - table.slice_bits)
        answered = asked.where(F.col("slice") == number).select("batch", "blob").mapInArrow(probe, "batch long, n int, levels binary")
        answered.write.mode("overwrite").parquet(f"{answers}/slice={number}")
        held.destroy()
    read = spark.read.schema("batch long, n int, levels binary, slice long").parquet(answers)
    return read.groupBy("batch").agg(F.collect_list(F.struct("slice", "n", "levels")).alias("found"))


# --- scores -----------------------------------------------------------------

_SCORES = "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(n: int, v: int, n_docs: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in _columns(rows):
                yield _score_batch(row, n, v, n_docs)

    return score


def _found(row: dict) -> np.ndarray:
    """The levels of a batch's grams, in the order of ``_batch_grams``."""
    codec, order = pa.Codec("zstd", 1), np.argsort(row["slice"])
    sent = zip(row["n"][order].tolist(), row["levels"][order])
    return np.concatenate([np.frombuffer(codec.decompress(x, k, asbytes=True), np.uint8) for k, x in sent])


def _score_batch(row: dict, n: int, v: int, n_docs: int) -> pa.RecordBatch:
    lengths = row["lengths"].astype(np.int64)
    codes = _unpack(row["codes"], int(lengths.sum()))
    hashes = np.frombuffer(row["hashes"], np.uint64)
    exact = np.zeros(len(hashes), np.int64)
    exact[row["pos"]] = row["c"]
    base = np.log10((exact + 1) / (n + v + 1))
    grams, _ = _batch_grams(codes, lengths, row["train"], hashes, exact)
    found = _found(row)
    level = lambda h: found[np.searchsorted(grams, h & ~_LAST)].astype(np.int32)
    rough = quantised(level(unigram_hashes(hashes)))
    single = PRIOR * (rough + 1) / (n + v + 1)
    n_known, base_score, score = np.zeros(len(lengths), np.int64), np.zeros(len(lengths)), np.zeros(len(lengths))
    for first, last, start, stop, pairs in _pieces(codes, lengths, hashes):
        part = codes[start:stop]
        firsts = np.cumsum(lengths[first:last]) - lengths[first:last]
        history = np.empty(len(part))
        history[1:] = rough[part[:-1]]
        history[firsts] = n_docs
        both = np.minimum(quantised(level(pairs)), history)
        p = np.log10(np.minimum((both + single[part]) / (history + PRIOR), 1.0))
        n_known[first:last] = np.add.reduceat((exact > 0)[part].astype(np.int64), firsts)
        base_score[first:last] = np.add.reduceat(base[part], firsts)
        score[first:last] = np.add.reduceat(p, firsts)
    arrays = [row["ids"], pa.array(~row["train"]), pa.array(lengths), pa.array(n_known), pa.array(base_score), pa.array(score)]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _SCORES.split(", ")])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_col: str = "train") -> DataFrame:
    """One row per row of ``docs``: ``id_col, held_out`` (not trained on),
    ``n_tokens, n_known, train_tokens, base_score, score``.

    Learns from the rows where ``train_col`` is true (null: not). Tokens are
    the words of the text, A-Z lower-cased, and one end; a null text is empty
    and has the end only. ``base_score`` sums log10((c + 1) / (N + V + 1)) over
    the tokens with exact counts; ``score`` is the model's log10 probability.
    Repeated rows count and score as often as they occur; ids are cast to long
    (text that is no number raises), may be null or repeat. Extra columns are not read. Without training rows all
    probabilities are one; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{train_col}`").alias("train"))
    batches = encoded(rows)
    totals = token_totals(batches)
    told = totals.agg(F.sum("n"), F.sum("v")).first()
    n, v = told[0] or 0, told[1] or 0
    n_docs = batches.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    found = gram_levels(batches, write_filter(batches)).select("batch", "found.slice", "found.n", "found.levels")
    met = batches.join(totals.select("batch", "totals.pos", "totals.c"), "batch").join(found, "batch").select(
        "ids", "train", "lengths", "hashes", "codes", "pos", "c", "slice", "n", "levels"
    )
    scored = met.mapInArrow(_score(n, v, n_docs), _SCORES)
    return scored.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
