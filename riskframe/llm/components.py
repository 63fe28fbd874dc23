"""Connected components of a link table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)`` (long columns);
    ``root`` is the smallest node reachable.

    Alternating star contraction: each round first hangs a node's larger
    neighbours on its smallest one, then a node's smaller neighbours too,
    until no link changes; the rounds grow with the logarithm of the
    diameter. Minima are pre-aggregated before the shuffle and neighbours
    meet them in a join (which adaptive execution splits where a node is
    hot), so no node's neighbours are ever gathered. Each round's links are
    written to the shared folder. Null ends and self-links are ignored; an
    empty table gives an empty result.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        # large star: both directions; the larger neighbours of u go to u's minimum
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        edges = written(small, "links")
        after = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
