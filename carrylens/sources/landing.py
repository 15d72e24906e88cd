"""Landing and storing: JSON log pages in, partitioned tables out (SRC-6, SRC-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .schemas import SCHEMAS

CORRUPT = "_corrupt_record"
PAGE_ROWS = 250_000  # lines of a written page, some 100 MB of text


def read_json_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Landed pages of raw logs, one JSON object a line, with the declared
    schema; a line that isn't one has NULL columns and stands in
    ``_corrupt_record``, so a bad line costs itself alone."""
    schema = StructType([*SCHEMAS["raw_logs"].fields, StructField(CORRUPT, StringType(), True)])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(list(paths))


def landed_logs(pages: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per (block, log index): pages that overlap bring a log several
    times.  Of different rows with one key the least by emitter, topics and
    data stays.  The rows combine before they move; given ``parts``, they move
    first, into that many partitions, and combine there: copies seldom share a
    page, and a task then sorts its partition, not all the pages it reads."""
    cols = ["address", "topics", "data"]
    good = pages.filter(F.col(CORRUPT).isNull() & F.col("block_number").isNotNull() & F.col("log_index").isNotNull())
    if parts:
        good = good.select("block_number", "log_index", *cols).repartition(parts, "block_number", "log_index")
    g = good.groupBy("block_number", "log_index").agg(F.min(F.struct(*cols)).alias("row"))
    return g.select(*[F.col("row")[c].alias(c) for c in cols], "block_number", "log_index")


def corrupt_lines(pages: DataFrame) -> DataFrame:
    """The lines that couldn't be read, as text, with what could be read of their place."""
    return pages.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"), "block_number", "log_index")


def write_pages(lines: DataFrame, path: str, rows: int = PAGE_ROWS) -> None:
    """Write text lines (column ``value``) as compressed pages of at most
    ``rows`` lines: a compressed file isn't split, so its size is bounded."""
    lines.select("value").write.option("compression", "gzip").option("maxRecordsPerFile", rows).text(path)


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Write ``df`` partitioned by ``by``; a repeated run replaces just the
    partitions that it brings and leaves the others."""
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A written table with its declared schema: nothing is inferred."""
    return spark.read.schema(schema).parquet(path)
