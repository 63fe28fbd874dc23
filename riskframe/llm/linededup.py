"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; the lines of frequent hashes go and the rest is put together again by
position. Expressions, group-bys and joins alone.

Scale. A hash is 128 bits, so that a clean line of a large corpus does not
meet another's. Documents are counted by (hash, document) first and by hash
then, both pre-aggregated, so a line that every document has is many small
counts and never one group. Only hashes and positions are shuffled for that;
whole texts move at most once, to meet the positions they lose (none move
where those are small enough for Spark to broadcast them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import SPACES, ascii_lower, free_name, written

MIN_DOCS = 3
MIN_CHARS = 20


def lines_of(text: Column) -> Column:
    """The ``\\n``-split lines; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line without space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _two_hashes(*values: Column) -> list[Column]:
    """128 bits: the second hash starts from another seed."""
    return [F.xxhash64(*values), F.xxhash64(F.lit(1), *values)]


def _row_hashes(doc_id: Column, text: Column) -> list[Column]:
    """Rows with one id and one text lose the same lines and share these."""
    values = [doc_id.isNull(), doc_id, text.isNull(), text]
    a, b = _two_hashes(*values)
    return [a.alias("r1"), b.alias("r2")]


def hashed_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``rows(id, text)`` as ``id, r1, r2, pos, h1, h2``, one row for each
    line whose key has ``min_chars`` code points or more."""
    lines = rows.select("id", *_row_hashes(F.col("id"), F.col("text")), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("id", "r1", "r2", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.length("key") >= min_chars)
    h1, h2 = _two_hashes(F.col("key"))
    return keyed.select("id", "r1", "r2", "pos", h1.alias("h1"), h2.alias("h2"))


def frequent_lines(rows: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, n_docs, last_id`` of the line hashes that ``min_docs`` or
    more ids hold; ``last_id`` is the largest of them. A null id is one id,
    the smallest."""
    lines = hashed_lines(rows, min_chars).select("h1", "h2", "id")
    counted = lines.groupBy("h1", "h2").agg(
        F.count_distinct(F.struct("id")).alias("n_docs"), F.max("id").alias("last_id")
    )
    return counted.where(F.col("n_docs") >= min_docs)


def dropped_lines(rows: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``r1, r2, drop``: the sorted positions (from 0) that a row loses."""
    lines = hashed_lines(rows, min_chars).join(frequent.select("h1", "h2", "last_id"), ["h1", "h2"])
    lost = lines.where(~F.col("id").eqNullSafe(F.col("last_id")))
    return lost.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("drop"))


def without(lines: Column, drop: Column) -> Column:
    """``lines`` without the sorted positions ``drop``: the slices between
    them, so the work is linear in the lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    ends = F.concat(drop, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_col``, and ``n_lines``
    (before) and ``n_dropped`` (numbered if ``docs`` has these names).

    A line counts by its key: space at both ends stripped, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that ``min_docs`` or more ids
    hold lose all their lines except in the largest id that holds them, where
    every one stays. The other lines keep their order and their own text.

    Rows of one id are one document. Null ids are one document, smaller than
    all others. A null text is one empty line and stays null; a text that
    loses all lines becomes empty. Repeated rows each give a row; an empty
    table gives an empty result. Other columns are kept and not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    frequent = written(frequent_lines(rows, min_docs, min_chars), "lines")
    drops = written(dropped_lines(rows, frequent, min_chars), "drops")

    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    text = F.col(f"doc.`{text_col}`").cast("string")
    met = docs.select(F.struct("*").alias("doc")).select("doc", *_row_hashes(F.col(f"doc.`{id_col}`"), text))
    met = met.join(drops, ["r1", "r2"], "left").select(
        "doc", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"), lines_of(text).alias("lines")
    )
    kept = F.array_join(without(F.col("lines"), F.col("drop")), "\n")
    put = F.when(text.isNotNull(), F.when(F.size("drop") > 0, kept).otherwise(text))
    columns = [
        put.alias(c) if c.lower() == text_col.lower() else F.col(f"doc.`{c}`").alias(c) for c in docs.columns
    ]
    return met.select(
        *columns, F.size("lines").cast("long").alias(n_lines), F.size("drop").cast("long").alias(n_dropped)
    )
