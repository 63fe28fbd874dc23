"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same
bytes, and in how many documents each pair of ids does.

A text's bytes are cut where tokens of both sides end; all tokens of a piece
are linked with one another. An id pair's count is the number of documents
that link it, corpus-wide.

External spill counting. A task aligns documents until its buffer holds
``RUN_RECORDS`` (pair, document) records, sorts them by side A, side B and
document and spills them as one run: a zstd segment for each radix of the side
A id, with the run's own count for each pair. Segments of a radix meet in
k-way heap merges of at most ``MERGE_RUNS`` runs, round after round until one
is left; the merged stream is in side-major order, so an A id's pairs stand
together and its highest count is known when they end. The segments then pass
by their radix's counts and send each document's share back to its run.

Scale. The radix count is fixed, so segments grow in proportion to the input.
A run holds a pair once, however many of its documents have it, so a merge
never sees a hot pair's documents; merged counts are bounded by the two
vocabularies. A radix with more segment bytes than ``GROUP_BYTES`` is split
into as many groups of whole runs as it needs. Nothing is gathered.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written
from riskframe.llm.tokenizers import ByteLevelBpe, PieceBpe, _once

TOKENIZERS = "/opt/tokenizers"
RADIX_BITS = 6
#: Records and documents of a run, at most (but for its last document).
RUN_RECORDS = 3 << 20
DOC_BITS = 22
#: Characters aligned at once (or one text).
PART_CHARS = 1 << 20
MERGE_RUNS = 128
#: Entries that a merge takes from a run at once.
MERGE_BLOCK = 1 << 14
GROUP_BYTES = 16 << 20
#: Cells with more links are counted by their distinct ids.
LARGE_CELL = 1 << 12

_SEGMENT = "radix int, pairs binary, counts binary, docs binary, times binary, n_pairs int, n_records int, bytes long"


# --- packed integers --------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, zstd-packed; high planes are mostly zero."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(blob: bytes, n: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = pa.Codec("zstd", 1).decompress(blob, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(dtype).reshape(-1)


def _gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


# --- aligning texts ---------------------------------------------------------


class Aligner:
    """Both sides' tables, built once a worker."""

    def __init__(self, a: ByteLevelBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.bytes_a, self.bytes_b = a.pieces(), b.pieces()
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self.bits_a = max(RADIX_BITS + 1, len(self.bytes_a).bit_length())
        self.bits_b = len(self.bytes_b).bit_length()
        if self.bits_a + self.bits_b > 32:
            raise ValueError("id pairs of these vocabularies need more than 32 bits")
        # an id and what follows it: the same piece, the other side, the next piece
        self.texts = [b"%d%s" % (i, end) for i in range(len(self.bytes_a)) for end in (b",", b"|")]
        self.texts += [b"%d%s" % (i, end) for i in range(len(self.bytes_b)) for end in (b",", b";")]

    def order_a(self, a: np.ndarray) -> np.ndarray:
        """Side A ids with their radix (the low bits) in front."""
        high = self.bits_a - RADIX_BITS
        return ((a & ((1 << RADIX_BITS) - 1)) << high) | (a >> RADIX_BITS)

    def align(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """Per text ``n_a, n_b, n_groups, n_links`` and ``groups`` (bytes);
        for all texts the records ``keys`` (pair and text number, sorted) and
        ``times`` (links of the pair in the text)."""
        n = len(texts)
        some = [i for i, t in enumerate(texts) if t]
        led = [" " + texts[i] for i in some]
        ids_a, ids_b = self.a.encode(led), self.b.encode([texts[i] for i in some])
        whole = []
        for k, text in enumerate(led):
            raw = text.encode()
            if b"".join(map(self.bytes_a.__getitem__, ids_a[k])) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b[k])):
                whole.append(k)
        ids_a, ids_b = [ids_a[k] for k in whole], [ids_b[k] for k in whole]
        owner = np.array([some[k] for k in whole], np.int64)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        a, b = (np.fromiter((i for x in ids for i in x), np.int64, int(m.sum())) for ids, m in ((ids_a, n_a), (ids_b, n_b)))
        del ids_a, ids_b

        # both sides' bytes are the same, so ends can be told over all texts
        end_a, end_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        last_a = _in_sorted(end_a, end_b)
        last_b = _in_sorted(end_b, end_a)
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        first_b = np.cumsum(in_b) - in_b
        doc = np.repeat(np.arange(len(owner)), n_a)
        doc_of = doc[last_a]
        links = in_a * in_b

        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}
        out["n_a"][owner], out["n_b"][owner] = n_a, n_b
        out["n_groups"][owner] = np.bincount(doc_of, minlength=len(owner))
        np.add.at(out["n_links"], owner[doc_of], links)

        # the tokens of both sides in the order they are written
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + first_b[group_a]] = 2 * a + last_a
        code[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * (b + len(self.bytes_a)) + last_b
        groups, start = [b""] * n, 0
        for i, size in zip(owner.tolist(), (n_a + n_b).tolist()):
            groups[i] = b"".join(map(self.texts.__getitem__, code[start : start + size].tolist()))[:-1]
            start += size
        out["groups"] = groups

        key_a = self.order_a(a) << self.bits_b
        small = links <= LARGE_CELL
        wide = np.where(small, in_b, 0)[group_a]
        left = np.repeat(np.arange(len(a)), wide)
        step = np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide)
        right = first_b[group_a[left]] + step
        keys = ((key_a[left] | b[right]) << DOC_BITS) | owner[doc[left]]
        keys.sort()
        cuts = np.flatnonzero(np.diff(keys, prepend=-1))
        times = np.diff(cuts, append=len(keys))
        keys = keys[cuts]
        if not small.all():
            first_a = np.cumsum(in_a) - in_a
            more_keys, more_times = [keys], [times]
            for g in np.flatnonzero(~small):
                x, nx = np.unique(key_a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
                y, ny = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
                more_keys.append((((x[:, None] | y[None, :]) << DOC_BITS) | owner[doc_of[g]]).reshape(-1))
                more_times.append((nx[:, None] * ny[None, :]).reshape(-1))
            keys, place = np.unique(np.concatenate(more_keys), return_inverse=True)
            times = np.zeros(len(keys), np.int64)
            np.add.at(times, place, np.concatenate(more_times))
        return out | {"keys": keys, "times": times}


def _in_sorted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the sorted ``x`` the sorted ``y`` has."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _aligner(a: ByteLevelBpe, b: PieceBpe) -> Aligner:
    return _once(f"{a.key}+{b.key}", lambda: Aligner(a, b))


# --- runs -------------------------------------------------------------------


class _Run:
    """Documents and records of the run being filled."""

    def __init__(self, number: int):
        self.number = number
        self.docs: list[dict] = []
        self.ids: list[pa.Array] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n_docs = self.n_records = 0

    def add(self, ids: pa.Array, found: dict) -> None:
        self.ids.append(ids)
        self.docs.append(found)
        self.keys.append(found.pop("keys") + self.n_docs)
        self.times.append(found.pop("times"))
        self.n_docs += len(ids)
        self.n_records += len(self.keys[-1])

    def segments(self, aligner: Aligner) -> list[tuple]:
        if not self.n_records:
            return []
        keys, times = np.concatenate(self.keys), np.concatenate(self.times)
        self.keys.clear()
        self.times.clear()
        order = np.argsort(keys, kind="stable")  # merges the sorted parts
        keys, times = keys[order], times[order].astype("<u4")
        del order
        pairs, docs = (keys >> DOC_BITS).astype("<u4"), (keys & ((1 << DOC_BITS) - 1)).astype("<u4")
        del keys
        heads = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.diff(heads, append=len(pairs)).astype("<u4")
        # a pair's documents ascend: gaps, but for its first one
        gaps = _gaps(docs)
        gaps[heads] = docs[heads]
        pairs = pairs[heads]
        radix = (pairs >> np.uint32(aligner.bits_a + aligner.bits_b - RADIX_BITS)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(radix, prepend=-1))
        out = []
        for low, high in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs)]):
            first = int(heads[low])
            last = int(heads[high]) if high < len(heads) else len(docs)
            blobs = [pack(_gaps(pairs[low:high])), pack(counts[low:high]), pack(gaps[first:last]), pack(times[first:last])]
            out.append((int(radix[low]), *blobs, high - low, last - first, sum(map(len, blobs))))
        return out

    def rows(self, aligner: Aligner, digest: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for each segment."""
        n = self.n_docs
        groups = [g for d in self.docs for g in d["groups"]]
        if digest:
            groups = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
        else:
            groups = [g.decode() for g in groups]
        columns = {"run": pa.array(np.full(n, self.number)), "at": pa.array(np.arange(n, dtype=np.int32))}
        columns["id"] = pa.concat_arrays(self.ids)
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            columns[c] = pa.array(np.concatenate([d[c] for d in self.docs]))
        columns["groups"] = pa.array(groups, pa.string())
        self.docs.clear()
        yield _filled(columns, n, schema)
        parts = self.segments(aligner)
        if parts:
            names = [c.split()[0] for c in _SEGMENT.split(", ")]
            columns = {c: pa.array(v, schema.field(c).type) for c, v in zip(names, zip(*parts))}
            columns["run"] = pa.array(np.full(len(parts), self.number))
            yield _filled(columns, len(parts), schema)


def _filled(columns: dict, n: int, schema: pa.Schema) -> pa.RecordBatch:
    """All columns of the schema; null where there is none."""
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _spill(a: ByteLevelBpe, b: PieceBpe, digest: bool, run_records: int):
    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a, b)
        # unique within the one committed attempt of each task
        run = _Run(TaskContext.get().partitionId() << 32)
        schema = None
        for rows in batches:
            ids, texts = rows.column(0), rows.column(1)
            if schema is None:
                schema = _schema(ids.type)
            low = 0
            while low < len(rows):
                part, chars, high = [], 0, low
                while high < len(rows) and (high == low or chars < PART_CHARS):
                    part.append(texts[high].as_py())
                    chars += len(part[-1] or "") + 16
                    high += 1
                run.add(ids.slice(low, high - low), aligner.align(part))
                low = high
                if run.n_records >= run_records or run.n_docs >= 1 << (DOC_BITS - 1):
                    yield from run.rows(aligner, digest, schema)
                    run = _Run(run.number + 1)
        if run.n_docs:
            yield from run.rows(aligner, digest, schema)

    return spill


def _schema(id_type: pa.DataType) -> pa.Schema:
    binary = {c: pa.binary() for c in ("pairs", "counts", "docs", "times")}
    integer = {c: pa.int32() for c in ("radix", "n_pairs", "n_records")}
    doc = [("run", pa.int64()), ("at", pa.int32()), ("id", id_type)]
    doc += [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.string())]
    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    return pa.schema(doc + [(c, binary.get(c) or integer.get(c) or pa.int64()) for c in names])


# --- counting ---------------------------------------------------------------


def merge_runs(
    runs: list[tuple[np.ndarray, np.ndarray]], block: int = MERGE_BLOCK
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted runs of (pairs, counts) as one sorted stream, counts summed.

    The heap holds each run's next block by its last pair. The least of these
    bounds a step: every run gives what it has up to it.
    """
    at = [0] * len(runs)
    heap = [(int(pairs[min(block, len(pairs)) - 1]), i) for i, (pairs, _) in enumerate(runs) if len(pairs)]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        pairs, counts = [], []
        for i in [i for _, i in heap]:
            p, c = runs[i]
            low = at[i]
            at[i] = low + int(np.searchsorted(p[low : low + block], bound, "right"))
            pairs.append(p[low : at[i]])
            counts.append(c[low : at[i]])
        while heap and heap[0][0] <= bound:
            i = heapq.heappop(heap)[1]
            p = runs[i][0]
            if at[i] < len(p):
                heapq.heappush(heap, (int(p[min(at[i] + block, len(p)) - 1]), i))
        out, place = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(out), np.int64)
        np.add.at(total, place, np.concatenate(counts))
        yield out, total


def _runs_of(table: pa.Table, dtype: str) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for i in range(len(table)):
        row = {c: table.column(c)[i].as_py() for c in ("pairs", "counts", "n_pairs")}
        pairs = np.cumsum(unpack(row["pairs"], row["n_pairs"], "<u4"), dtype=np.int64)
        out.append((pairs, unpack(row["counts"], row["n_pairs"], dtype).astype(np.int64)))
    return out


def _merge(dtype: str, bits_b: int | None):
    """A group's runs as one; with ``bits_b``, the last merge, side A's best
    pairs are marked too."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        pairs, counts, best = [], [], []
        held: list[tuple[np.ndarray, np.ndarray]] = []  # an A id whose pairs may go on
        for p, c in merge_runs(_runs_of(table, dtype)):
            pairs.append(p)
            counts.append(c)
            if bits_b is None:
                continue
            held.append((p, c))
            p, c = (np.concatenate(x) for x in zip(*held))
            open_ = int(np.searchsorted(p, (p[-1] >> bits_b) << bits_b))
            held = [(p[open_:], c[open_:])]
            best.append(_best(p[:open_] >> bits_b, c[:open_]))
        if held:
            best.append(_best(held[0][0] >> bits_b, held[0][1]))
        p, c = np.concatenate(pairs), np.concatenate(counts)
        row = {"radix": [key[0].as_py()], "run": [key[1].as_py()], "pairs": [pack(_gaps(p.astype("<u4")))], "counts": [pack(c)]}
        row |= {"n_pairs": pa.array([len(p)], pa.int32()), "best": [np.packbits(np.concatenate(best)).tobytes() if best else None]}
        row["radix"] = pa.array(row["radix"], pa.int32())
        row["best"] = pa.array(row["best"], pa.binary())
        return pa.table(row)

    return merge


def _best(side: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which counts are the highest of their (sorted) side."""
    if not len(side):
        return np.empty(0, bool)
    heads = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    most = np.maximum.reduceat(counts, heads)
    return counts == np.repeat(most, np.diff(heads, append=len(side)))


def merged_counts(segments: DataFrame, n_runs: int, bits_b: int, merge_runs: int = MERGE_RUNS) -> DataFrame:
    """One row for each radix: ``radix, run, pairs, counts, n_pairs, best``,
    counts over all runs. Rounds of merges of about ``merge_runs`` runs."""
    merged, dtype = segments.select("radix", "run", "pairs", "counts", "n_pairs"), "<u4"
    out = "radix int, run long, pairs binary, counts binary, n_pairs int, best binary"
    while True:
        groups = -(-n_runs // merge_runs)
        last = groups <= 1
        dealt = merged.withColumn("run", F.pmod(F.xxhash64("run"), F.lit(max(1, groups))).cast("long"))
        merged = written(
            dealt.groupBy("radix", "run").applyInArrow(_merge(dtype, bits_b if last else None), out), "merged"
        )
        if last:
            return merged
        merged, dtype, n_runs = merged.drop("best"), "<i8", groups


# --- contributions ----------------------------------------------------------


def _contribute(segments: pa.Table, merged: pa.Table) -> pa.Table:
    """Each segment's share of its documents' sums, a row a segment."""
    runs, sums, bests, sizes = [], [], [], []
    if len(merged):
        (pairs, counts), = _runs_of(merged, "<i8")
        best = np.unpackbits(np.frombuffer(merged.column("best")[0].as_py(), np.uint8), count=len(pairs))
    for i in range(len(segments)):
        row = {c: segments.column(c)[i].as_py() for c in segments.schema.names}
        own = np.cumsum(unpack(row["pairs"], row["n_pairs"], "<u4"), dtype=np.int64)
        times = unpack(row["counts"], row["n_pairs"], "<u4").astype(np.int64)
        n = row["n_records"]
        gaps = unpack(row["docs"], n, "<u4").astype(np.int64)
        heads = np.cumsum(times) - times
        docs = np.cumsum(gaps)
        docs -= np.repeat(docs[heads] - gaps[heads], times)  # every pair starts anew
        links = unpack(row["times"], n, "<u4").astype(np.int64)
        at = np.searchsorted(pairs, own)
        width = int(docs.max()) + 1
        total, top = np.zeros(width, np.int64), np.zeros(width, np.int64)
        np.add.at(total, docs, links * np.repeat(counts[at], times))
        np.add.at(top, docs, links * np.repeat(best[at].astype(np.int64), times))
        runs.append(row["run"])
        sums.append(pack(total))
        bests.append(pack(top))
        sizes.append(width)
    return pa.table(
        {"run": pa.array(runs, pa.int64()), "sums": pa.array(sums, pa.binary()), "bests": pa.array(bests, pa.binary()), "width": pa.array(sizes, pa.int32())}
    )


def _add_up(docs: pa.Table, shares: pa.Table) -> pa.Table:
    """A run's documents with the sums of their shares."""
    n = len(docs)
    count_sum, n_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(len(shares)):
        width = shares.column("width")[i].as_py()
        count_sum[:width] += unpack(shares.column("sums")[i].as_py(), width, "<i8")
        n_best[:width] += unpack(shares.column("bests")[i].as_py(), width, "<i8")
    at = docs.column("at").to_numpy()
    out = docs.drop_columns(["run", "at"])
    return out.append_column("n_best", pa.array(n_best[at])).append_column("count_sum", pa.array(count_sum[at]))


def align_tokenizers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a: ByteLevelBpe | str = f"{TOKENIZERS}/byte_bpe_50k.json",
    b: PieceBpe | str = f"{TOKENIZERS}/piece_bpe_32k.model",
    groups: str = "text",
    run_records: int = RUN_RECORDS,
    merge_runs: int = MERGE_RUNS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_a, n_b`` (tokens), ``n_groups``,
    ``n_links, n_best, count_sum, groups``.

    Side A encodes a space and the text, side B the text, to which it adds the
    space itself. A group ends where tokens of both sides end; ``groups`` is
    ``a1,a2|b1;a3|b2,b3`` (with ``groups="sha256"`` its hex digest; without
    tokens empty). Links are all A-B token pairs of a group. An id pair counts
    the documents (rows) that link it; ``n_best`` are the links whose count is
    the highest of their A id (ties included), ``count_sum`` adds up the
    counts of all links.

    Texts that are null, empty, or whose tokens' bytes are not the space and
    the text (as with the piece alphabet's own space sign) have no tokens:
    zeros, and they count for no pair. Repeated rows are documents of their
    own; ids may be null or repeat. Other columns are not read. An empty table
    gives an empty result.
    """
    a = ByteLevelBpe.from_file(a) if isinstance(a, str) else a
    b = PieceBpe.from_file(b) if isinstance(b, str) else b
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    doc_columns = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups string"
    spilled = rows.mapInArrow(
        _spill(a, b, groups == "sha256", run_records), f"run long, at int, {doc_columns}, {_SEGMENT}"
    )
    spilled = written(spilled, "runs")
    told = spilled.where("at is not null").select("run", "at", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    segments = spilled.where("radix is not null").drop("at", "id", "n_a", "n_b", "n_groups", "n_links", "groups")
    n_runs = told.where("at = 0").count()  # one first document a run

    bits_b = len(b.pieces()).bit_length()
    merged = merged_counts(segments, n_runs, bits_b, merge_runs)
    # whole runs of a radix, as many groups as its bytes need
    parts = written(
        segments.groupBy("radix").agg(F.ceil(F.sum("bytes") / group_bytes).cast("long").alias("parts")), "parts"
    )
    dealt = segments.join(parts, "radix").withColumn("part", F.pmod(F.xxhash64("run"), F.col("parts")))
    left = dealt.select("radix", "part", "run", "pairs", "counts", "docs", "times", "n_pairs", "n_records")
    right = merged.join(parts, "radix").select(
        "radix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "pairs", "counts", "n_pairs", "best"
    )
    shares = left.groupBy("radix", "part").cogroup(right.groupBy("radix", "part")).applyInArrow(
        _contribute, "run long, sums binary, bests binary, width int"
    )
    out = told.groupBy("run").cogroup(shares.groupBy("run")).applyInArrow(
        _add_up, f"{doc_columns}, n_best long, count_sum long"
    )
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def pair_counts(
    docs: DataFrame,
    text_col: str = "text",
    a: ByteLevelBpe | str = f"{TOKENIZERS}/byte_bpe_50k.json",
    b: PieceBpe | str = f"{TOKENIZERS}/piece_bpe_32k.model",
    run_records: int = RUN_RECORDS,
    merge_runs: int = MERGE_RUNS,
) -> DataFrame:
    """The dictionary that the alignment yields: ``a_id, b_id, n_docs, best``
    for every linked pair, ``best`` where no pair of the A id has a higher
    count. Texts count as in ``align_tokenizers``."""
    a = ByteLevelBpe.from_file(a) if isinstance(a, str) else a
    b = PieceBpe.from_file(b) if isinstance(b, str) else b
    rows = docs.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    doc_columns = "id int, n_a long, n_b long, n_groups long, n_links long, groups string"
    spilled = written(
        rows.mapInArrow(_spill(a, b, True, run_records), f"run long, at int, {doc_columns}, {_SEGMENT}"), "runs"
    )
    n_runs = spilled.where("at = 0").count()
    bits_b = len(b.pieces()).bit_length()
    merged = merged_counts(spilled.where("radix is not null"), n_runs, bits_b, merge_runs)
    high = max(RADIX_BITS + 1, len(a.pieces()).bit_length()) - RADIX_BITS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (pairs, counts), bits in zip(_runs_of(pa.Table.from_batches([batch]), "<i8"), batch.column("best")):
                best = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(pairs)).astype(bool)
                side = pairs >> bits_b
                ids = ((side & ((1 << high) - 1)) << RADIX_BITS) | (side >> high)
                columns = [pa.array(x) for x in (ids.astype(np.int32), (pairs & ((1 << bits_b) - 1)).astype(np.int32), counts, best)]
                yield pa.RecordBatch.from_arrays(columns, names=["a_id", "b_id", "n_docs", "best"])

    return merged.select("pairs", "counts", "n_pairs", "best").mapInArrow(
        read, "a_id int, b_id int, n_docs long, best boolean"
    )
