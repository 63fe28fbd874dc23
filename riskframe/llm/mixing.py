"""Mixing sources to target weights by hash-threshold histograms.

A document enters the mix when the hash of its id is below its source's
threshold. The threshold comes from nested histograms: sizes are summed by
source and leading digit of the hash (pre-aggregated before the shuffle), the
one digit in which the source's budget runs out is opened by its next digit,
and so on, until that bucket holds one hash value. Nothing is sorted beyond
the ``2**DIGIT_BITS`` buckets of a source, and only the boundary bucket's rows
are summed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import free_name, words, written

#: A hash has ``DIGITS`` digits of ``DIGIT_BITS`` bits (15 hex digits of MD5).
DIGIT_BITS = 12
DIGITS = 5
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2


def id_hash(value: Column) -> Column:
    """The first 60 bits of the MD5 of a value's text; null counts as empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, source_size)``.

    Sources in code point order (null last) take the weights in turn. They
    share ``share`` times all sizes by weight; a target stops at ``most``
    times its source's size and the excess goes to the others by weight until
    none is above. That is a common level L with target = min(most * size,
    L * weight): sources fill up in the order of most * size / weight, so one
    running sum over them finds L. One row per source enters this step.
    Should all sources be full, the rest of the total stays unspent.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("i", F.row_number().over(order) - 1).select(
        "source",
        "source_size",
        "i",
        F.element_at(cycle, (F.col("i") % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * most).cast("double").alias("cap"),
    )
    fill = Window.orderBy(F.col("cap") / F.col("w"), "i")
    whole = Window.orderBy(F.lit(1)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    stepped = (
        ranked.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open_w", F.sum("w").over(after))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("open_w"))
    )
    # the level of the first source that does not fill up
    found = F.min(
        F.when(
            F.col("level") * F.col("w") <= F.col("cap"),
            F.struct((F.col("cap") / F.col("w")).alias("r"), "i", "level"),
        )
    ).over(whole)
    return stepped.withColumn("found", found).select(
        "source",
        "source_size",
        F.when(F.col("found").isNull(), F.col("cap"))
        .otherwise(F.least("cap", F.col("found.level") * F.col("w")))
        .alias("target"),
    )


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, bar``: of each source, the documents with hash below ``bar``
    come nearest to its budget from ``budgets(source, budget)``.

    ``rows(source, size, h)`` with non-null h. A group of equal hashes enters
    when that leaves the sum no farther from the budget. A budget of the whole
    source or more has a bar above all hashes.
    """
    state = budgets.select(
        "source",
        "budget",
        F.lit(0).cast("long").alias("low"),  # first hash of the open bucket
        F.lit(0).cast("long").alias("below"),  # size of all hashes before it
        F.lit(None).cast("long").alias("bar"),
    )
    width = DIGIT_BITS * DIGITS
    for level in range(DIGITS):
        step = width - DIGIT_BITS * (level + 1)
        opened = F.shiftright("h", step + DIGIT_BITS) == F.shiftright("low", step + DIGIT_BITS)
        s = state.withColumnRenamed("source", "s_source")
        # source is null-safe; the open bucket's rows only
        part = rows.join(s, F.col("source").eqNullSafe(F.col("s_source")) & F.col("bar").isNull() & opened)
        hist = part.groupBy("s_source", F.shiftright("h", step).alias("digit")).agg(
            F.sum("size").alias("size"),
            F.min("h").alias("h_min"),
            F.max("h").alias("h_max"),
            F.first("budget").alias("budget"),
            F.first("below").alias("below"),
        )
        run = Window.partitionBy("s_source").orderBy("digit")
        hist = hist.withColumn(
            "start",
            F.col("below")
            + F.coalesce(
                F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0).cast("long"),
            ),
        ).where((F.col("start") <= F.col("budget")) & (F.col("start") + F.col("size") > F.col("budget")))
        one = F.col("h_min") == F.col("h_max")
        fits = F.col("start") * 2 + F.col("size") <= F.col("budget") * 2
        edge = hist.select(
            F.col("s_source").alias("e_source"),
            F.shiftleft("digit", step).alias("e_low"),
            F.col("start").alias("e_below"),
            F.when(one & fits, F.col("h_min") + 1).when(one, F.col("h_min")).alias("e_bar"),
        )
        top = F.lit(1 << width).cast("long")
        state = written(
            state.join(edge, F.col("source").eqNullSafe(F.col("e_source")), "left").select(
                "source",
                "budget",
                F.coalesce("e_low", "low").alias("low"),
                F.coalesce("e_below", "below").alias("below"),
                # no bucket where the budget runs out: all hashes are below the bar
                F.when(F.col("bar").isNotNull(), F.col("bar"))
                .when(F.col("e_below").isNull(), top)
                .otherwise(F.col("e_bar"))
                .alias("bar"),
            ),
            "bars",
        )
        if state.where("bar is null").isEmpty():
            break
    return state.select("source", "bar")


def source_bars(
    rows: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """``source, source_size, target, whole, bar`` from ``rows(source, size,
    h)``: a document is taken ``whole`` times, and once more if its hash is
    below ``bar`` (null: never). One row per source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = targets.withColumn("whole", whole.cast("long"))
    planned = planned.withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    bars = thresholds(
        rows.where("size > 0"),
        planned.where((F.col("budget") > 0) & (F.col("source_size") > 0)).select("source", "budget"),
    )
    bars = bars.withColumnRenamed("source", "b_source")
    return written(
        planned.join(bars, F.col("source").eqNullSafe(F.col("b_source")), "left").select(
            "source", "source_size", "target", "whole", "bar"
        ),
        "sources",
    )


def _copies(h: Column) -> Column:
    return F.col("whole") + F.when(h < F.col("bar"), 1).otherwise(0)


def mix_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
) -> DataFrame:
    """One row per row of ``docs``: ``id, source, size`` (words of the text,
    null: 0), ``source_size, target`` and ``copies``, how often the mix takes
    the document (0 to ``most``).

    Every document is taken ``floor(target / source_size)`` times, and those
    below the source's bar once more. Rows of one id share a hash, so repeated
    rows are taken alike and reruns agree. A null id hashes as empty text, a
    null source is a source of its own, a source without words has target 0
    and its documents are not taken. An empty table gives an empty result.
    """
    rows = _sized(docs, id_col, text_col, source_col)
    bars = source_bars(rows, weights, share, most).withColumnRenamed("source", "t_source")
    return rows.join(bars, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "id", "source", "size", "source_size", "target", _copies(F.col("h")).alias("copies")
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    copies_col: str = "copies",
) -> DataFrame:
    """The documents that the mix takes, all columns kept, plus how often it
    takes each (``copies_col``, numbered if ``docs`` has that name). Texts
    are filtered where they are: only the one row of their source meets them.
    """
    bars = source_bars(_sized(docs, id_col, text_col, source_col), weights, share, most)
    copies = free_name(docs, copies_col)
    bars = bars.select(F.struct("source", "whole", "bar").alias("mix_bar"))
    met = docs.alias("d").join(
        bars.alias("b"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("b.mix_bar.source"))
    )
    n = F.col("b.mix_bar.whole") + F.when(
        id_hash(F.col(f"d.`{id_col}`")) < F.col("b.mix_bar.bar"), 1
    ).otherwise(0)
    return met.select("d.*", n.alias(copies)).where(F.col(copies) > 0)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return written(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col).cast("string")).alias("size"),
            id_hash(F.col(id_col)).alias("h"),
        ),
        "sizes",
    )
