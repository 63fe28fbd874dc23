"""Profiling operators.

Each profile is one aggregate pass over the input (partial aggregation on
the map side, a tiny final merge) whose single wide result row is turned
into tidy rows with ``inline(array(struct...))`` — no per-column jobs and
nothing data-sized on the driver. Exact quartiles add two scans at most
(``exact_quantiles``), the same way for every size of table. Missing cells
(null, or NaN in a floating-point column) are left out everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import is_missing, numeric_columns
from riskframe.functions.frames import written

QUANTILES = (0.25, 0.5, 0.75)
# ``percentile_approx`` is off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
# Distinct values that one task may sort; more are split at so many quantiles.
BRACKET_ROWS = 10_000
SPLITS = 64


def _tidy(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    return one_row.select(F.inline(F.array(*structs)))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: position, name, Spark type, nullability and
    non-null count (``DataFrame.info()``)."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    return _tidy(
        counts,
        [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(f.nullable).alias("nullable"),
                F.col(f"c{i}").alias("non_null"),
            )
            for i, f in enumerate(fields)
        ],
    )


def table_shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols")
    )


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows. With ``order_by`` the answer is stable (planned as
    ``TakeOrderedAndProject``: each task keeps its n best, one merge)."""
    if order_by:
        return df.orderBy(*order_by).limit(n)
    return df.limit(n)


def _present(df: DataFrame, name: str) -> Column:
    """The column as double, null where it is missing."""
    return F.when(~is_missing(df, name), F.col(name).cast("double"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = QUANTILES) -> DataFrame:
    """Exact quantiles (linear interpolation between order statistics, as
    pandas and DuckDB ``quantile_cont``): ``(column_name, q_index, p,
    value)``, null for a column without values.

    The input is scanned three times at most, whatever its rows:

    1. one aggregate sketches all columns (``percentile_approx``, off by at
       most 1 / ACCURACY of the rows) and takes values a little below and above
       each wanted rank as its bracket;
    2. one aggregate counts the rows in and between the brackets, which proves
       where each rank lies, be it between two brackets. A rank in a bracket of
       one value is found;
    3. one group-by counts the values of the other segments that hold a rank,
       value by value. These counts are written.

    All else reads the written counts: parts with more than ``BRACKET_ROWS``
    values are split at their own quantiles until the part with the rank is
    small. Groups are pre-aggregated, so a value that a third of the rows have
    is one row a task. Values that are missing (null, NaN) are left out.
    """
    cols = list(cols)
    aggs = []
    for name in cols:
        x = _present(df, name)
        aggs += [F.count(x), F.min(x), F.max(x), _sketch(x, probs)]
    row = df.agg(*aggs).first() if cols else []
    return _exact_quantiles(df, cols, list(probs), [tuple(row[4 * i : 4 * i + 4]) for i in range(len(cols))])


def _sketch(x: Column, probs: Sequence[float]) -> Column:
    margin = 2.0 / ACCURACY
    shares = [F.lit(s) for p in probs for s in (max(0.0, p - margin), min(1.0, p + margin))]
    return F.percentile_approx(x, F.array(*shares), ACCURACY)


def _merged(pairs: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Brackets in order, those that meet as one."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(pairs):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _segment(x: Column, brackets: list[tuple[float, float]]) -> Column:
    """2j + 1 for a value in bracket j, 2j for one between it and the last."""
    out = F
    for j, (low, high) in enumerate(brackets):
        out = out.when(x < F.lit(low), 2 * j).when(x <= F.lit(high), 2 * j + 1)
    return out.when(x.isNotNull(), 2 * len(brackets))


def _rows_by_segment(df: DataFrame, xs: list[Column], brackets: dict[int, list[tuple[float, float]]], told) -> dict[tuple[int, int], int]:
    """``{(column, segment): rows}``."""
    bounds = [(i, test) for i, pairs in brackets.items() for low, high in pairs for test in (xs[i] < F.lit(low), xs[i] <= F.lit(high))]
    row = df.agg(*[F.count_if(test) for _, test in bounds]).first()
    out: dict[tuple[int, int], int] = {}
    for i in brackets:
        upto = [n for (c, _), n in zip(bounds, row) if c == i] + [told[i][0]]
        out.update({(i, seg): n - before for seg, (before, n) in enumerate(zip([0, *upto], upto))})
    return out


def _counted(
    df: DataFrame, xs: list[Column], brackets: dict[int, list[tuple[float, float]]], only: dict[int, set[int]]
) -> DataFrame:
    """``(c, seg, value, w)``: how many rows have each value of the segments
    in ``only``."""
    rows, some = [], F.lit(False)
    for i, segments in only.items():
        seg = _segment(xs[i], brackets[i])
        seg = F.when(seg.isin(*segments), seg)
        some |= seg.isNotNull()
        rows.append(F.struct(F.lit(i).alias("c"), seg.alias("seg"), xs[i].alias("value")))
    # most rows have no such value: they go before the others become long
    long = df.where(some).select(F.inline(F.array(*rows))).where("seg is not null")
    return written(long.groupBy("c", "seg", "value").agg(F.count(F.lit(1)).alias("w")), "quantiles")


def _exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], told) -> DataFrame:
    """``told``: count, minimum, maximum and sketch of each column."""
    xs = [_present(df, c) for c in cols]
    found: dict[tuple[int, int], float] = {}
    wanted: dict[int, list[int]] = {}
    brackets: dict[int, list[tuple[float, float]]] = {}
    for i, (n, low, high, proposed) in enumerate(told):
        ranks = sorted({r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}) if n else []
        if low == high:
            found.update({(i, r): low for r in ranks})
        elif ranks:
            wanted[i] = ranks
            brackets[i] = [(low, high)] if n <= BRACKET_ROWS else _merged(list(zip(proposed[::2], proposed[1::2])))
    if wanted:
        sizes = _rows_by_segment(df, xs, brackets, told)
        parts: dict[tuple[int, int], _Part] = {}
        only: dict[int, set[int]] = {}
        for i, ranks in wanted.items():
            for r in ranks:
                seg, local = _place(sizes, i, r)
                low, high = brackets[i][seg // 2] if seg % 2 else (None, None)
                if low is not None and low == high:
                    found[i, r] = low
                    continue
                only.setdefault(i, set()).add(seg)
                parts.setdefault((i, seg), _Part(i, seg, None, None, 0, {})).ranks[r] = local
        if only:
            table = _counted(df, xs, brackets, only)
            for row in table.groupBy("c", "seg").count().collect():  # a few of each column
                parts[row["c"], row["seg"]].size = row["count"]
            found.update(_at_ranks(table, list(parts.values())))
    rows = []
    for i, name in enumerate(cols):
        n = told[i][0]
        for q, p in enumerate(probs):
            value = None
            if n:
                h = (n - 1) * p
                low, high = found[i, math.floor(h)], found[i, math.ceil(h)]
                part = h - math.floor(h)
                value = low if low == high or not part else low + (high - low) * part
            rows.append((name, q, float(p), value))
    return df.sparkSession.createDataFrame(
        rows, "column_name string, q_index int, p double, value double"
    )


def _place(sizes: dict[tuple[int, int], int], i: int, rank: int) -> tuple[int, int]:
    """The segment with a column's value of this rank, and its rank there."""
    for c, seg in sorted(sizes):
        if c == i:
            if rank < sizes[c, seg]:
                return seg, rank
            rank -= sizes[c, seg]
    raise RuntimeError("the input changed between two scans")


@dataclass
class _Part:
    """A segment's values over ``low`` up to ``high`` (None: no bound), the
    number of distinct ones, and the ranks wanted: rank in the column to rank
    here."""

    c: int
    seg: int
    low: float | None
    high: float | None
    size: int
    ranks: dict[int, int]

    def holds(self) -> Column:
        test = (F.col("c") == self.c) & (F.col("seg") == self.seg)
        if self.low is not None:
            test &= F.col("value") > F.lit(self.low)
        return test if self.high is None else test & (F.col("value") <= F.lit(self.high))


def _labelled(table: DataFrame, parts: list[_Part]) -> DataFrame:
    g = F
    for k, p in enumerate(parts):
        g = g.when(p.holds(), k)
    return table.select(g.alias("g"), "value", "w").where("g is not null")


def _at_ranks(table: DataFrame, parts: list[_Part]) -> dict[tuple[int, int], float]:
    """``{(column, rank): value}`` from counted values."""
    while large := [p for p in parts if p.size > BRACKET_ROWS]:
        parts = [p for p in parts if p.size <= BRACKET_ROWS] + _split(table, large)
    # the wanted ranks of each part, as many places for all
    most = max(len(p.ranks) for p in parts)
    here = [[*p.ranks.values()] + [-1] * (most - len(p.ranks)) for p in parts]
    ranks = F.array(*[F.array(*[F.lit(r).cast("long") for r in row]) for row in here])[F.col("g")]
    run = Window.partitionBy("g").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = _labelled(table, parts).withColumn("upto", F.sum("w").over(run))

    def at(k: int) -> Column:
        hit = (F.col("upto") - F.col("w") <= ranks[k]) & (ranks[k] < F.col("upto"))
        return F.max(F.when(hit, F.col("value")))

    out = {}
    for row in ranked.groupBy("g").agg(*[at(k).alias(f"v{k}") for k in range(most)]).collect():  # one row per part
        for k, rank in enumerate(parts[row["g"]].ranks):
            out[parts[row["g"]].c, rank] = row[f"v{k}"]
    return out


def _split(table: DataFrame, parts: list[_Part]) -> list[_Part]:
    """Each part cut at ``SPLITS`` quantiles of its distinct values; what
    comes back are the pieces that hold a wanted rank."""
    rows = _labelled(table, parts)
    shares = F.array(*[F.lit(k / SPLITS) for k in range(1, SPLITS)])
    cuts = {r["g"]: r["cuts"] for r in rows.groupBy("g").agg(F.percentile_approx("value", shares, 10_000).alias("cuts")).collect()}
    listed = F.array(*[F.array(*[F.lit(v) for v in cuts[g]]) for g in range(len(parts))])[F.col("g")]
    piece = F.size(F.filter(listed, lambda v: v < F.col("value")))
    told = rows.groupBy("g", piece.alias("b")).agg(F.sum("w").alias("n"), F.count("value").alias("k")).collect()
    out = []
    for g, part in enumerate(parts):
        below = 0
        for r in sorted((r for r in told if r["g"] == g), key=lambda r: r["b"]):
            ranks = {rank: local - below for rank, local in part.ranks.items() if 0 <= local - below < r["n"]}
            if ranks:
                low = cuts[g][r["b"] - 1] if r["b"] else part.low
                high = cuts[g][r["b"]] if r["b"] < len(cuts[g]) else part.high
                out.append(_Part(part.c, part.seg, low, high, r["k"], ranks))
            below += r["n"]
    return out


METHODS = ("exact", "approx")


def _numeric_stats(
    df: DataFrame, cols: Sequence[str], method: str = "exact", accuracy: int = ACCURACY
) -> DataFrame:
    """One row per column: count, mean, std, min, p25, p50, p75, max of the
    values that are not missing. ``approx`` takes ``percentile_approx`` for
    the quartiles and is one lazy aggregate; ``exact`` runs the passes of
    ``exact_quantiles`` here and returns a frame of one row per column."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    cols = list(cols)
    fields = "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    if not cols:
        return df.sparkSession.createDataFrame([], fields)
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    aggs = []
    for i, name in enumerate(cols):
        x = _present(df, name)
        aggs += [
            F.count(x).alias(f"n{i}"),
            F.avg(x).alias(f"mean{i}"),
            F.stddev_samp(x).alias(f"std{i}"),
            F.min(x).alias(f"min{i}"),
            F.max(x).alias(f"max{i}"),
        ]
        aggs.append((F.percentile_approx(x, qs, accuracy) if method == "approx" else _sketch(x, QUANTILES)).alias(f"q{i}"))
    wide = df.agg(*aggs)
    if method == "approx":
        return _tidy(
            wide,
            [
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.col(f"n{i}").alias("count"),
                    *[F.col(f"{s}{i}").alias(s) for s in ("mean", "std", "min")],
                    *[F.col(f"q{i}")[k].alias(p) for k, p in enumerate(("p25", "p50", "p75"))],
                    F.col(f"max{i}").alias("max"),
                )
                for i, name in enumerate(cols)
            ],
        )
    row = wide.first()
    told = [(row[f"n{i}"], row[f"min{i}"], row[f"max{i}"], row[f"q{i}"]) for i in range(len(cols))]
    q = {(r["column_name"], r["q_index"]): r["value"] for r in _exact_quantiles(df, cols, list(QUANTILES), told).collect()}
    rows = [
        (name, row[f"n{i}"], row[f"mean{i}"], row[f"std{i}"], row[f"min{i}"], q[name, 0], q[name, 1], q[name, 2], row[f"max{i}"])
        for i, name in enumerate(cols)
    ]
    return df.sparkSession.createDataFrame(rows, fields)


def describe_numeric(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    method: str = "exact",
    accuracy: int = ACCURACY,
) -> DataFrame:
    """pandas ``describe()``: count, mean, sample std, min, quartiles, max,
    one row per numeric column. Quartiles are exact unless
    ``method="approx"`` (see ``_numeric_stats``)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return _numeric_stats(df, cols, method, accuracy)


DESCRIBE_STATS = ("count", "mean", "stddev", "min", "max")
# Text that a cast to double can read: decimal / scientific notation, NaN,
# infinities. Testing this first avoids a failing cast per row.
NUMERIC_TEXT = r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:nan)|[+-]?(?i:inf|infinity))\s*$"


def describe_text(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Spark ``describe()`` layout — a ``summary`` column (count, mean,
    stddev, min, max) and one string column per input column; text columns
    get lexical min/max and a mean only where the text parses as a number —
    computed as one aggregate over all columns (Spark's own ``describe``
    runs several times slower on the same input)."""
    if cols:
        names = list(cols)
    else:
        names = [
            f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.StringType))
        ]
    aggs = []
    for i, name in enumerate(names):
        c = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            x = F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double"))
        else:
            x = c
        aggs += [
            F.count(c).cast("string").alias(f"count{i}"),
            F.avg(x).cast("string").alias(f"mean{i}"),
            F.stddev_samp(x).cast("string").alias(f"stddev{i}"),
            F.min(c).cast("string").alias(f"min{i}"),
            F.max(c).cast("string").alias(f"max{i}"),
        ]
    wide = df.agg(*aggs)
    rows = [
        F.struct(F.lit(stat).alias("summary"), *[F.col(f"{stat}{i}").alias(n) for i, n in enumerate(names)])
        for stat in DESCRIBE_STATS
    ]
    return wide.select(F.inline(F.array(*rows)))


def _text_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count / unique / top / freq per text column.

    Text columns are unpivoted to (column, value) so one shuffle aggregate
    serves all of them; the most frequent value is picked with an
    aggregate (``min`` of ``(-count, value)``: highest count, then the
    smallest value) instead of a window, so a column with a billion
    distinct values is still a partial aggregation, never a sort of one
    group in one task.
    """
    long = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in cols
                ]
            )
        )
    ).where(F.col("value").isNotNull())
    freq = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("freq"))
    best = F.min(F.struct((-F.col("freq")).alias("neg"), F.col("value").alias("value")))
    stats = freq.groupBy("column_name").agg(
        F.sum("freq").alias("count"),
        F.count(F.lit(1)).alias("unique"),
        best.getField("value").alias("top"),
        (-best.getField("neg")).alias("freq"),
    )
    # every requested column appears, an all-null one with count 0
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name")
    )
    return F.broadcast(names).join(stats, "column_name", "left").select(
        "column_name",
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
        F.coalesce(F.col("unique"), F.lit(0)).cast("long").alias("unique"),
        "top",
        "freq",
    )


def describe_mixed(df: DataFrame, cols: Sequence[str] | None = None, method: str = "exact") -> DataFrame:
    """pandas ``describe(include="all")``: one row per column with mean, std,
    min, quartiles, max for a numeric one, and unique, top, freq (of the
    values as text) for one of any other type; the other group's fields are
    null. Without columns the result is empty."""
    cols = list(cols) if cols is not None else df.columns
    num = [c for c in cols if c in numeric_columns(df)]
    other = [c for c in cols if c not in num]
    null_long = F.lit(None).cast("long")
    null_double = F.lit(None).cast("double")
    parts = []
    if num or not other:
        parts.append(
            _numeric_stats(df, num, method).select(
                "column_name",
                "count",
                null_long.alias("unique"),
                F.lit(None).cast("string").alias("top"),
                null_long.alias("freq"),
                "mean",
                "std",
                "min",
                "p25",
                "p50",
                "p75",
                "max",
            )
        )
    if other:
        parts.append(
            _text_stats(df, other).select(
                "column_name",
                "count",
                "unique",
                "top",
                "freq",
                *[null_double.alias(n) for n in ("mean", "std", "min", "p25", "p50", "p75", "max")],
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per distinct value, missing ones left out, most frequent first."""
    return (
        df.where(~is_missing(df, col))
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(col))
    )


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """Percentage of rows per value, missing ones left out. The total is a scalar
    subquery (one partial aggregate, evaluated once, its value inlined), not
    a global window that would pull every row into one task."""
    counts = df.where(~is_missing(df, col)).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.select(F.sum("count")).scalar()
    return counts.select(col, (F.col("count") * 100.0 / total).alias("share_pct")).orderBy(
        F.desc("share_pct"), F.asc(col)
    )


def histogram(df: DataFrame, col: str, edges: Sequence[float]) -> DataFrame:
    """Rows per bin for ascending ``edges``: bins are left-closed, the last
    one closed on both sides, values outside are ignored; empty bins are
    kept with count 0.

    The bin index is a balanced tree of comparisons (codegen), for any number
    of edges, infinite ones included; counts are a partial aggregate; the bin
    frame is built from ``range`` and has ``len(edges) - 1`` rows, a size
    fixed by the parameter, so it is broadcast.
    """
    edges = [float(e) for e in edges]
    if len(edges) < 2 or any(not b > a for a, b in zip(edges, edges[1:])):
        raise ValueError("edges must be strictly ascending with at least two values")
    x = _present(df, col)
    nb = len(edges) - 1

    def bin_of(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        mid = (first + last + 1) // 2
        return F.when(x < edges[mid], bin_of(first, mid - 1)).otherwise(bin_of(mid, last))

    binned = df.select(F.when(x.between(edges[0], edges[-1]), bin_of(0, nb - 1)).alias("bin"))
    counts = (
        binned.where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    spark = df.sparkSession
    lows = F.array(*[F.lit(e) for e in edges[:-1]])
    highs = F.array(*[F.lit(e) for e in edges[1:]])
    bins = spark.range(nb).select(
        F.col("id").cast("int").alias("bin"),
        lows[F.col("id").cast("int")].alias("lower"),
        highs[F.col("id").cast("int")].alias("upper"),
    )
    return F.broadcast(bins).join(counts, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count")
    )


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surplus rows over the distinct keys (null equals null): all rows but
    the first of each key. Partial aggregation collapses a hot key on the
    map side before the shuffle."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column (NaN counts as missing for floats)."""
    fields = df.schema.fields
    wide = df.agg(
        *[F.count_if(is_missing(df, f.name)).alias(f"m{i}") for i, f in enumerate(fields)]
    )
    return _tidy(
        wide,
        [
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"m{i}").alias("n_missing"))
            for i, f in enumerate(fields)
        ],
    )


def null_total(df: DataFrame) -> DataFrame:
    """Missing cells over the whole table and an ok/alert flag."""
    fields = df.schema.fields
    total = None
    for f in fields:
        term = F.count_if(is_missing(df, f.name))
        total = term if total is None else total + term
    if total is None:
        total = F.lit(0).cast("long")
    return df.agg(total.alias("n_missing")).select(
        "n_missing",
        F.when(F.col("n_missing") == 0, F.lit("ok")).otherwise(F.lit("alert")).alias("status"),
    )
