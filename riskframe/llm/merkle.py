"""Merkle manifest of a dataset: every row's digest, its proof and the root.

Rows are the leaves of one tree for each value of a column, the trees' roots
are the leaves of a last tree. A node is the SHA-256 of its children's hex
digests, ``fanout`` of them, fewer in a level's last run.

Leaves are ranked by a range partitioning and the counts of its partitions,
then dealt into aligned blocks of ``fanout ** block_levels`` ranks. A block
computes its own subtree. After that blocks exchange subtree roots as in a
butterfly: in round j the blocks whose numbers differ in digit j alone swap
the roots of their aligned subtrees, and each hashes the parent for itself.
Ancestors are so hashed once for each block below them, and every block ends
with its tree's root and its own upper proof: nothing is sent down again.

Scale. A block has a bounded number of rows, whatever the tree; a round moves
one short row for each block, and the rounds grow with the logarithm of the
blocks. Each round's table is written. Only digests, ids and carried columns
are shuffled, never the rows themselves.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import written

FANOUT = 8
#: Levels that a block computes by itself: blocks of 4,096 leaves.
BLOCK_LEVELS = 4
_PROOF = "array<struct<before:string,after:string>>"


def row_digest(*columns: Column) -> Column:
    """Hex SHA-256 of the values, each as its UTF-8 byte count, ``:`` and its
    text (numbers decimal), or ``-`` if null."""
    texts = [c.cast("string") for c in columns]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(
        proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256)
    )


def siblings(proof: Column) -> Column:
    """All sibling digests of a proof in one text, leaf level first."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def n_levels(leaves: int, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


def _levels(leaves: list[str], n: int, fanout: int) -> list[list[str]]:
    """``n`` levels of nodes above the leaves, these first."""
    out = [leaves]
    for _ in range(n):
        low = out[-1]
        out.append([_digest("".join(low[i : i + fanout])) for i in range(0, len(low), fanout)])
    return out


def _block_levels(size: int, fanout: int, block_levels: int) -> int:
    """What a block of a tree with ``size`` leaves computes by itself."""
    return block_levels if size > fanout**block_levels else n_levels(size, fanout)


def _block_root(fanout: int, block_levels: int):
    def root(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        size = table.column("size")[0].as_py()
        nodes = _levels(table.column("leaf").to_pylist(), _block_levels(size, fanout, block_levels), fanout)
        return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "size": [size], "node": nodes[-1]})

    return root


def _block_proofs(fanout: int, block_levels: int, schema: pa.Schema):
    """Each leaf's proof: its siblings in the block, then the block's own."""

    def proofs(rows: pa.Table, above: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        size = rows.column("size")[0].as_py()
        upper = above.column("upper")[0].as_py()
        nodes = _levels(rows.column("leaf").to_pylist(), _block_levels(size, fanout, block_levels), fanout)
        before, after, starts = [], [], []
        for level in nodes[:-1]:
            starts.append(len(before))
            for i in range(len(level)):
                first = i - i % fanout
                before.append("".join(level[first:i]))
                after.append("".join(level[i + 1 : first + fanout]))
        n, depth = len(rows), len(starts) + len(upper)
        at = np.empty((n, depth), np.int64)
        leaf = np.arange(n)
        for j, start in enumerate(starts):
            at[:, j] = start + leaf // fanout**j
        for j, step in enumerate(upper):
            at[:, len(starts) + j] = len(before)
            before.append(step["before"])
            after.append(step["after"])
        flat = pa.array(at.reshape(-1))
        steps = pa.StructArray.from_arrays(
            [pa.array(x, pa.string()).take(flat) for x in (before, after)], names=["before", "after"]
        )
        proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), steps)
        same = {c: pa.array([above.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")}
        columns = {c: rows.column(c) for c in rows.schema.names if c not in ("tree", "block", "size")}
        return pa.table(columns | {"proof": proof} | same).select(schema)

    return proofs


def _ranked(leaves: DataFrame, order: list[str], name: str) -> DataFrame:
    """``leaves`` plus ``rank`` (from 0, within its ``tree``) and the tree's
    ``size``, in the order of ``order`` and ``leaf``.

    A range partitioning sorts all rows; a row's rank is its place in its
    partition and the counts of the partitions before. Equal rows are dealt by
    their place in the input, so that many of them make no large partition.
    """
    keys = ["tree", *[F.col(c).asc_nulls_first() for c in order], "leaf", "tie"]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    # after the sort: the partition's number and the row's place in it
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = written(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", place), name)
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    # one row for each partition of a tree
    by = Window.partitionBy("tree")
    before = by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "tree",
        "part",
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(by).alias("size"),
    )
    ranked = dealt.join(written(offsets, name + "-offsets"), ["tree", "part"])
    return ranked.withColumn("rank", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def butterfly(blocks: DataFrame, n_rounds: int, fanout: int = FANOUT) -> DataFrame:
    """``tree, block, upper, node`` from the block roots ``tree, block,
    n_blocks, node``: every block's proof from its root to the tree's, and
    that root.

    In round j a block stands for its aligned subtree of ``fanout ** j``
    blocks. Blocks at the same place of the subtrees below one parent swap
    these subtrees' roots, so a group has ``fanout`` members at most. A tree's
    last subtree may have fewer blocks than places: then each of them speaks
    for several places. A tree that has come to one node stays as it is.
    """
    state = blocks.select("tree", "block", "n_blocks", "node", F.array().cast(_PROOF).alias("upper"))
    for j in range(n_rounds):
        width = fanout**j
        child = F.floor(F.col("block") / width).cast("long")
        place = F.pmod(F.col("block"), F.lit(width)).cast("long")
        there = F.least(F.lit(width).cast("long"), F.col("n_blocks") - child * width)
        going = F.col("n_blocks") > width
        places = F.when(going, F.sequence(place, F.lit(width - 1).cast("long"), there)).otherwise(F.array(place))
        told = state.select("*", child.alias("child"), place.alias("own"), F.explode(places).alias("at"))
        # a member's proof travels with its own place only
        member = F.struct(
            F.col("child"),
            F.col("node"),
            F.when(F.col("own") == F.col("at"), F.struct("block", "n_blocks", "upper")).alias("self"),
        )
        parent = F.floor(F.col("child") / fanout).cast("long").alias("parent")
        groups = told.groupBy("tree", parent, "at").agg(F.collect_list(member).alias("run"))
        groups = groups.select("tree", F.array_sort("run", lambda a, b: a["child"].cast("int") - b["child"].cast("int")).alias("run"))
        text = lambda keep: F.array_join(F.transform(keep, lambda m: m["node"]), "")
        met = groups.select("tree", "run", F.explode(F.filter("run", lambda m: m["self"].isNotNull())).alias("me"))
        step = F.struct(
            text(F.filter("run", lambda m: m["child"] < F.col("me.child"))).alias("before"),
            text(F.filter("run", lambda m: m["child"] > F.col("me.child"))).alias("after"),
        )
        going = F.col("me.self.n_blocks") > width
        state = written(
            met.select(
                "tree",
                F.col("me.self.block").alias("block"),
                F.col("me.self.n_blocks").alias("n_blocks"),
                F.when(going, F.sha2(text(F.col("run")).cast("binary"), 256)).otherwise(F.col("me.node")).alias("node"),
                F.when(going, F.concat("me.self.upper", F.array(step))).otherwise(F.col("me.self.upper")).alias("upper"),
            ),
            f"round-{j}",
        )
    return state.select("tree", "block", "upper", "node")


def _trees(ranked: DataFrame, fanout: int, block_levels: int) -> DataFrame:
    """``tree, block, upper, node``: see ``butterfly``."""
    blocks = ranked.select("tree", "block", "size", "rank", "leaf").groupBy("tree", "block")
    roots = blocks.applyInArrow(
        _block_root(fanout, block_levels), "tree string, block long, size long, node string"
    )
    roots = written(
        roots.select("tree", "block", "node", F.ceil(F.col("size") / fanout**block_levels).alias("n_blocks")), "blocks"
    )
    most = roots.agg(F.max("n_blocks")).first()[0] or 0
    return butterfly(roots, n_levels(most, fanout), fanout)


def merkle_manifest(
    docs: DataFrame,
    columns: list[str],
    tree_col: str = "lang",
    id_col: str = "doc_id",
    carry: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``leaf`` (``row_digest`` of
    ``columns``), the columns of ``carry`` (computed from the row, for later
    checks), ``rank`` (from 0, in its tree), ``proof`` (from the leaf to the
    root, a level an entry: the run's digests ``before`` and ``after`` the
    own one), ``subroot`` (of its tree) and ``root``.

    Rows with one value of ``tree_col`` (as text) form a tree, its leaves
    ascending by id (null first), then by digest. While more than one node
    remains, every ``fanout`` consecutive ones become their digest. The
    trees' roots, ordered by value (null first, bytewise), lead to ``root``
    alike. A tree of one row has its leaf as root and no siblings there.

    Null values are leaves like others. Repeated rows each have a leaf; equal
    leaves are interchangeable. Columns not named are not read. An empty table
    gives an empty result.
    """
    carry = carry or {}
    clash = {c.lower() for c in carry} & {"tree", "id", "leaf", "rank", "size", "block", "proof", "subroot", "root", "part", "place", "shift", "tie", id_col.lower()}
    if clash:
        raise ValueError(f"carried columns have taken names: {sorted(clash)}")
    value = F.col(f"`{tree_col}`").cast("string")
    leaves = docs.select(
        # null before all, the rest bytewise
        F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), value)).alias("tree"),
        F.col(f"`{id_col}`").alias("id"),
        row_digest(*[F.col(f"`{c}`") for c in columns]).alias("leaf"),
        *[c.alias(name) for name, c in carry.items()],
    )
    block = F.floor(F.col("rank") / fanout**block_levels).cast("long")
    ranked = _ranked(leaves, ["id"], "leaves").withColumn("block", block)
    trees = _trees(ranked, fanout, block_levels)

    # the trees' roots are the leaves of the last tree
    subroots = trees.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("node").alias("leaf"))
    top = _ranked(subroots, ["id"], "subroots").withColumn("block", block)
    top_trees = _trees(top, fanout, block_levels).select("tree", "block", "upper", F.col("node").alias("root"))
    top_trees = top_trees.withColumn("subroot", F.lit(""))
    top_fields = "id string, leaf string, rank long, proof " + _PROOF + ", subroot string, root string"
    top_proofs = top.groupBy("tree", "block").cogroup(top_trees.groupBy("tree", "block")).applyInArrow(
        _block_proofs(fanout, block_levels, ["id", "leaf", "rank", "proof", "subroot", "root"]), top_fields
    )
    top_proofs = written(top_proofs.select(F.col("id").alias("tree"), "proof", "root"), "top")

    above = trees.join(top_proofs, "tree").select(
        "tree", "block", F.concat("upper", "proof").alias("upper"), F.col("node").alias("subroot"), "root"
    )
    names = ["id", "leaf", *carry, "rank", "proof", "subroot", "root"]
    types = {f.name: f.dataType.simpleString() for f in ranked.schema.fields}
    types |= {"proof": _PROOF, "subroot": "string", "root": "string"}
    out = ranked.groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInArrow(
        _block_proofs(fanout, block_levels, names), ", ".join(f"`{n}` {types[n]}" for n in names)
    )
    return out.withColumnRenamed("id", id_col)
