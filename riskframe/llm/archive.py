"""Pages to WARC archives with revisit records, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import warc
from riskframe.llm.common import written

#: Fixed value: smaller payloads are always written whole.
LEAST_BYTES = 100
#: Repeated digests (some 50 bytes each) that are broadcast; more are left to
#: Spark's join.
BROADCAST_DIGESTS = 1_000_000


def page_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = LEAST_BYTES,
) -> DataFrame:
    """A WARC record for each row of ``pages``, with the data source's
    columns.

    The payload is the html in UTF-8 (null: empty). Of records with equal
    payloads of ``least_bytes`` or more, those with the smallest id are
    responses and the others revisit it; smaller ones are all responses.
    Repeated rows of the smallest id are all responses. A null id is larger
    than any other; where all ids of a payload are null, all are responses. A
    null url leaves its header out; extra columns are not read.

    Only digests that occur twice meet the pages again, and the smallest id
    is pre-aggregated, so a page copied many times is no hot group. These
    digests are written and counted; up to ``BROADCAST_DIGESTS`` of them are
    broadcast, so no payload is shuffled. Beyond that the join shuffles it once.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))
    first = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select(F.col("digest").alias("d"), "first_id")
    )
    first = written(first, "repeats")
    if first.count() <= BROADCAST_DIGESTS:
        first = F.broadcast(first)
    met = rows.join(first, F.col("digest") == F.col("d"), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return met.select(
        record_name(F.col("id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"),
        F.when(revisit, record_name(F.col("first_id"))).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def page_of(name: Column) -> Column:
    """The id in a record's name; null for none."""
    digits = F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme it has for Hadoop: without one of its own, the
    default file system's, so that all machines mean the same folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString()


def write_archives(records: DataFrame, path: str, **options: str) -> None:
    spark = records.sparkSession
    spark.dataSource.register(warc.WarcSource)
    records.write.format("warc").options(**options).mode("append").save(qualified(spark, path))


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The records under ``path``. Filters reach the reader while
    ``spark.sql.python.filterPushdown.enabled`` is true, which is set here."""
    spark.dataSource.register(warc.WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(qualified(spark, path))
