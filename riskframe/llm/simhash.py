"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``max_bits + 1`` bits; the table
of a non-zero vector ``v`` looks only at positions whose vector has an odd
inner product with ``v``. ``max_bits`` differing positions span at most
``max_bits`` dimensions, so some ``v`` is orthogonal to all of them, and in
its table the two fingerprints agree: no pair within the radius is missed.
The masks are balanced, each keeps at least half of the 64 bits.

Scale. Only distinct fingerprints enter the tables. Bucket sizes are counted
by a pre-aggregated group-by; buckets of one fingerprint are dropped by the
join. A bucket of up to ``SMALL_BUCKET`` fingerprints is linked in one task
(a spanning forest, never all pairs). A larger one is covered again over its
free bits; the buckets of that second covering fix at least 48 of the 64 bits,
so they hold at most 2**16 fingerprints however large the table is, and are
linked by flooding the cube of their free bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import free_name, written
from riskframe.llm.components import connected_components

BITS = 64
SEED = 42
#: Fingerprints that one task compares blockwise; more are covered again.
SMALL_BUCKET = 8192
#: Fingerprints compared at once with the others of their bucket.
BLOCK = 256
#: Parts in which the equal copies of one row are aggregated first.
SALTS = 16
#: Kept row hashes (16 bytes and some 40 of overhead each) that are broadcast.
BROADCAST_ROWS = 500_000


def fingerprint(text: str | None, shingle_words: int = 4) -> int:
    """Majority of the shingles' XXH64 bits, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = len(words) - shingle_words + 1
    stops = ends[shingle_words - 1 :].tolist()
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for low in range(0, n, 1 << 16):  # bounded memory for very long texts
        high = min(n, low + (1 << 16))
        h = np.fromiter(
            (digest(joined[i:j], SEED) for i, j in zip(starts[low:high], stops[low:high])),
            np.uint64,
            high - low,
        )
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(
    docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", shingle_words: int = 4
) -> DataFrame:
    """``docs`` plus its fingerprint as a (signed) long; a null text counts
    as empty and has fingerprint zero."""

    @F.pandas_udf("long")
    def sign(texts: pd.Series) -> pd.Series:
        out = np.fromiter(
            (fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts)
        )
        return pd.Series(out.view(np.int64))

    return docs.withColumn(out_col, sign(F.col(text_col).cast("string")))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over the given bit positions such that any ``radius`` of them
    are all outside some mask."""
    span = (1 << (radius + 1)) - 1
    vectors = [1 + i % span for i in range(len(positions))]
    masks = []
    for v in range(1, span + 1):
        mask = 0
        for position, vector in zip(positions, vectors):
            if (vector & v).bit_count() % 2:
                mask |= 1 << position
        masks.append(mask)
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _spread(masks: list[int], fp: Column) -> Column:
    """One ``(t, key)`` for each mask."""
    return F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("key"))
                for i, m in enumerate(masks)
            ]
        )
    )


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints at most ``max_bits``
    apart: breadth first, each fingerprint leaves the rest once reached."""
    rest = np.unique(fps)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            block, front = front[:BLOCK], front[BLOCK:]
            near = np.bitwise_count(block[:, None] ^ rest[None, :]) <= max_bits
            hit = near.any(axis=0)
            if hit.any():
                a.append(block[near[:, hit].argmax(axis=0)])
                b.append(rest[hit])
                front = np.concatenate([front, rest[hit]])
                rest = rest[~hit]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (empty, empty)


def cube_forest(fps: np.ndarray, free: list[int], max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same links for fingerprints that differ in the ``free`` positions
    only (16 or 17 of them): labels flood the cube of these bits, ``max_bits``
    steps at a time, so the work does not depend on the number of pairs."""
    fps = np.unique(fps)
    at = np.zeros(len(fps), np.int64)
    for i, position in enumerate(free):
        at |= ((fps >> np.uint64(position)) & np.uint64(1)).astype(np.int64) << i
    none = len(fps)
    label = np.full(1 << len(free), none, np.int64)
    label[at] = np.arange(none)
    cells = np.arange(1 << len(free))
    while True:
        wave = label.copy()
        for _ in range(max_bits):
            near = wave.copy()
            for i in range(len(free)):
                np.minimum(near, wave[cells ^ (1 << i)], out=near)
            wave = near
        new = np.full_like(label, none)
        new[at] = wave[at]
        new[at] = new[at[new[at]]]  # a label's own label
        if (new == label).all():
            break
        label = new
    root = label[at]
    out = root != np.arange(none)
    return fps[root[out]], fps[out]


def _link_small(max_bits: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for fps in batch.column("fps"):
                x, y = forest(np.asarray(fps.values, np.int64).view(np.uint64), max_bits)
                a.append(x)
                b.append(y)
            yield _pairs(a, b)

    return link


def _link_cube(masks: list[int], max_bits: int):
    free = [[i for i in range(BITS) if not m >> i & 1] for m in masks]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for t, fps in zip(batch.column("t").to_pylist(), batch.column("fps")):
                fps = np.asarray(fps.values, np.int64).view(np.uint64)
                small = len(fps) <= 1024
                x, y = forest(fps, max_bits) if small else cube_forest(fps, free[t], max_bits)
                a.append(x)
                b.append(y)
            yield _pairs(a, b)

    return link


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    flat = [np.concatenate(x) if x else np.empty(0, np.uint64) for x in (a, b)]
    return pa.RecordBatch.from_arrays(
        [pa.array(x.astype(np.uint64).view(np.int64)) for x in flat], names=["a", "b"]
    )


def simhash_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Links ``(a, b)`` between the distinct longs of ``fps(fp)``: every two
    at most ``max_bits`` apart are joined by a path of such links."""
    masks = covering_masks(list(range(BITS)), max_bits)
    keyed = fps.select("fp", _spread(masks, F.col("fp")).alias("k")).select("k.t", "k.key", "fp")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Spark sizes a frame as before its explode and would broadcast all of it
    shared = written(keyed.join(sizes.hint("merge"), ["t", "key"]), "buckets")
    out = (
        shared.where(F.col("n") <= SMALL_BUCKET)
        .groupBy("t", "key")
        .agg(F.collect_list("fp").alias("fps"))
        .select("fps")
        .mapInArrow(_link_small(max_bits), "a long, b long")
    )
    hot = shared.where(F.col("n") > SMALL_BUCKET)
    if not hot.isEmpty():
        # each table's free bits, covered again
        again = [
            [m | s for s in covering_masks([i for i in range(BITS) if not m >> i & 1], max_bits)]
            for m in masks
        ]
        flat = [m for row in again for m in row]
        table = F.array(
            *[F.array(*[F.lit(_signed(m)) for m in row]) for row in again]
        )
        finer = (
            hot.select("t", "fp", F.posexplode(F.element_at(table, F.col("t") + 1)).alias("s", "m"))
            .select(
                (F.col("t") * len(again[0]) + F.col("s")).alias("t"),
                F.col("fp").bitwiseAND(F.col("m")).alias("key"),
                "fp",
            )
        )
        out = out.union(
            finer.groupBy("t", "key")
            .agg(F.collect_list("fp").alias("fps"))
            .where(F.size("fps") > 1)
            .select("t", "fps")
            .mapInArrow(_link_cube(flat, max_bits), "a long, b long")
        )
    return out


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    max_bits: int = 4,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` (long), ``fingerprint``
    (16 hex digits), ``root_fp`` (long, the same for all rows of a group) and
    ``component_id``, the smallest id of the group.

    Null texts count as empty; empty texts have fingerprint zero and link
    like any other. Rows with a null id belong to groups but never name one
    (a group of such rows only has a null ``component_id``). Repeated rows
    each give a row; equal ids with different texts stay separate unless
    their fingerprints link. Other columns are not read. An empty table
    gives an empty result.
    """
    rows = written(
        with_fingerprint(
            docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
            "text",
            "fp",
            shingle_words,
        ).select("id", "fp"),
        "fingerprints",
    )
    return rows.join(_named(rows, max_bits), "fp").select(
        F.col("id").alias(id_col),
        "fp",
        hex16(F.col("fp")).alias("fingerprint"),
        "root_fp",
        "component_id",
    )


def _named(rows: DataFrame, max_bits: int) -> DataFrame:
    """``(fp, root_fp, component_id)`` for each fingerprint of ``rows(id, fp)``."""
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("low")), "distinct")
    roots = connected_components(simhash_links(fps.select("fp"), max_bits))
    roots = roots.select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root_fp")
    )
    # one row per group, written: the join below can then split a hot group
    least = written(rooted.groupBy("root_fp").agg(F.min("low").alias("component_id")), "groups")
    return rooted.join(least, "root_fp").select("fp", "root_fp", "component_id")


def row_hashes(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of a whole row, 128 bits together: equal for rows
    that are equal in every column, nulls told apart from all values."""
    parts: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if any(t in field.dataType.simpleString() for t in ("map<", "variant")):
            c = F.to_json(F.struct(c))  # these have no hash of their own
        parts += [c.isNull(), c]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)]


def simhash_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 4,
    max_bits: int = 4,
) -> DataFrame:
    """``docs`` with one row left of each group of near-duplicates: the one
    with the smallest id (null ids last), then the smallest fingerprint, then
    the smallest 128-bit hash of the whole row. So rows that share an id and a
    text but differ in other columns have a defined survivor, and reruns agree;
    of rows equal in every column one stays. All columns are kept as they are.

    Texts are signed once. What stays is told by row hashes: up to
    ``BROADCAST_ROWS`` of them are broadcast and no text moves; beyond that the
    join shuffles the texts once. Only kept rows that have equal copies are
    aggregated; where these are too many to be broadcast too, their rows move
    once more, salted before they meet.
    """
    one, two = free_name(docs, "row_hash_a"), free_name(docs, "row_hash_b")
    h1, h2 = row_hashes(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h1.alias("h1"), h2.alias("h2"))
    rows = written(with_fingerprint(rows, "text", "fp", shingle_words).select("id", "fp", "h1", "h2"), "fingerprints")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp", "h1", "h2")
    first = rows.join(_named(rows, max_bits), "fp").groupBy("root_fp").agg(F.min(order).alias("k"))
    copies = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    keep = written(
        first.select("k.h1", "k.h2").join(copies, ["h1", "h2"], "left").select(
            F.col("h1").alias(one), F.col("h2").alias(two), F.col("n").isNotNull().alias("copied")
        ),
        "kept",
    )
    hashed = docs.withColumns({one: h1, two: h2})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    n = {r["copied"]: r["count"] for r in keep.groupBy("copied").count().collect()}
    plain, repeated = keep.where("not copied"), keep.where("copied")
    if n.get(False, 0) <= BROADCAST_ROWS:
        plain = F.broadcast(plain)
    out = hashed.join(plain, [one, two], "left_semi").select(*columns)
    if not n.get(True):
        return out
    if n[True] <= BROADCAST_ROWS:
        met = hashed.join(F.broadcast(repeated), [one, two], "left_semi")
    else:
        salt = free_name(hashed, "salt")
        salted = repeated.select(one, two, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
        some = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
        # exploded, so sized too low by Spark: not to be broadcast
        met = hashed.withColumn(salt, some).join(salted.hint("merge"), [one, two, salt], "left_semi").dropDuplicates([one, two, salt])
    return out.union(met.dropDuplicates([one, two]).select(*columns))
