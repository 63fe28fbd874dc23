"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# One CSV dialect for both directions: a quote inside a quoted value is
# doubled, nothing else is an escape, white space belongs to the value, and a
# null is written as NULL_TOKEN, so it differs from an empty text.
NULL_TOKEN = "\\N"
_DIALECT = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Types tried in this order for text read with several null tokens.
_INFERRED = ("int", "bigint", "double", "boolean", "timestamp")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    header: bool = True,
    infer_schema: bool = True,
    schema: T.StructType | str | None = None,
    null_value: str | Sequence[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Header CSV (or parquet) → frame. An explicit ``schema`` skips the
    inference pass (a full extra read of the file).

    ``null_value`` names the token, or tokens, read as null (default
    ``NULL_TOKEN``, which ``write_table`` writes); a missing value between
    two commas is null too. Quoted values may hold newlines; such files are
    read whole by a task, so ``multi_line=False`` lets Spark split large files
    that have none.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    tokens = [NULL_TOKEN] if null_value is None else [null_value] if isinstance(null_value, str) else list(null_value)
    reader = spark.read.options(
        header=header, multiLine=multi_line, nullValue=tokens[0] if tokens else NULL_TOKEN, **_DIALECT
    )
    if len(tokens) <= 1:
        if schema is not None:
            return reader.schema(schema).csv(path)
        return reader.option("inferSchema", infer_schema).csv(path)
    # several tokens: read text, blank the tokens out, then give types
    raw = reader.csv(path)
    if schema is not None:
        schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        raw = raw.toDF(*schema.fieldNames())
    text = raw.select(*[F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is not None:
        types = {f.name: f.dataType for f in schema.fields}
    elif infer_schema:
        types = _infer(text)
    else:
        types = {}
    return text.select(
        *[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in text.columns]
    )


def _infer(text: DataFrame) -> dict[str, str]:
    """The first type of ``_INFERRED`` that reads all values of a column; one
    aggregate over all columns."""
    aggs = []
    for c in text.columns:
        x = F.col(f"`{c}`")
        aggs += [F.count(x), *[F.count(x.try_cast(t)) for t in _INFERRED]]
    row = text.agg(*aggs).first()
    step, out = len(_INFERRED) + 1, {}
    for i, c in enumerate(text.columns):
        n, *good = row[i * step : (i + 1) * step]
        fits = [t for t, k in zip(_INFERRED, good) if k == n]
        if n and fits:
            out[c] = fits[0]
    return out


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", header: bool = True) -> str:
    """Write with a header row (CSV) or as parquet; one file per task, no
    index column. Text comes back from ``read_table`` as it was: quotes,
    newlines, padding, empty and null values. Returns the path."""
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    else:
        writer.options(header=header, nullValue=NULL_TOKEN, emptyValue="", quoteAll=True, **_DIALECT).csv(path)
    return path


# The nested document: {model: {metric: "0.857", ...}, ...}.
_DOC = "map<string,map<string,string>>"
MAX_METRIC_ROWS = 10_000


def read_metrics(
    spark: SparkSession,
    path: str,
    engine: str | None = None,
    f1_means: str = "f1",
) -> DataFrame:
    """Nested metrics JSON → (engine, model, metric, value double).

    The whole file is one JSON document (``wholetext``), parsed with
    ``from_json`` and exploded twice; values are cast with ``try_cast``
    (the reference writes numbers as strings). The ambiguous key
    ``f1-score`` is renamed to what it means for that engine —
    ``f1`` (positive class) or ``weighted_f1`` — so two engines' F1 are
    never compared as if they were one metric.
    """
    if f1_means not in ("f1", "weighted_f1", "macro_f1"):
        raise ValueError("f1_means must be f1, weighted_f1 or macro_f1")
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", _DOC).alias("doc"))
    rows = doc.select(F.explode("doc").alias("model", "m")).select(
        "model", F.explode("m").alias("metric", "raw")
    )
    metric = (
        F.when(F.col("metric") == "f1-score", F.lit(f1_means))
        .when(F.col("metric") == "time", F.lit("fit_seconds"))
        .otherwise(F.col("metric"))
    )
    out = rows.select(
        "model", metric.alias("metric"), F.col("raw").try_cast("double").alias("value")
    )
    if engine is not None:
        out = out.select(F.lit(engine).alias("engine"), "model", "metric", "value")
    return out


def write_metrics(metrics: DataFrame, path: str, digits: int = 3, mode: str = "overwrite") -> str:
    """Tidy (model, metric, value) → one nested JSON document
    ``{model: {metric: "0.857"}}`` (values as fixed-point strings, like the
    reference). The document is one value, so the frame must be small: more
    than ``MAX_METRIC_ROWS`` rows (models × metrics) raise."""
    if metrics.limit(MAX_METRIC_ROWS + 1).count() > MAX_METRIC_ROWS:
        raise ValueError(f"more than {MAX_METRIC_ROWS} metric rows do not make one document")
    fmt = f"%.{digits}f"
    # entries are sorted so the document text does not depend on task order
    inner = metrics.groupBy("model").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_list(F.struct(F.col("metric"), F.format_string(fmt, F.col("value").cast("double"))))
            )
        ).alias("m")
    )
    by_model = F.array_sort(
        F.collect_list(F.struct("model", "m")),
        lambda a, b: F.when(a["model"] < b["model"], -1).when(a["model"] > b["model"], 1).otherwise(0),
    )
    doc = inner.agg(F.map_from_entries(by_model).alias("doc"))
    doc.select(F.to_json("doc").alias("value")).coalesce(1).write.mode(mode).text(path)
    return path
