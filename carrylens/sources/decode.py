"""Landed raw logs and call-return blobs -> typed columns (SRC-6..SRC-8, SC-9..SC-12).

The studied analysis pages a JSON-RPC endpoint by block window and decodes
topics in Python; here the logs are a landed table and decoding is pure
column arithmetic (hex limbs through ``conv``), so it runs in codegen and
scales with the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import address_from_topic, n_words, word_at, word_to_decimal, word_to_double


def filter_logs(logs: DataFrame, topic0: str, topic1: str | None = None, address: str | None = None) -> DataFrame:
    """Topic (and emitter) filtered logs (SRC-7); hex case doesn't matter."""
    # ``get`` is the NULL-on-missing, 0-based array access (no ANSI error)
    t = F.col("topics")
    cond = F.lower(F.get(t, 0)) == F.lit(topic0.lower())
    if topic1 is not None:
        cond = cond & (F.lower(F.get(t, 1)) == F.lit(topic1.lower()))
    if address is not None:
        cond = (F.lower(F.col("address")) == F.lit(address.lower())) & cond
    return logs.filter(cond)


def decode_transfers(logs: DataFrame, topic0: str) -> DataFrame:
    """ERC-20 Transfer logs -> (contract_address, from, to, value, value_double,
    block_number, log_index) (SRC-6, SC-9, SC-10).  ``value`` is an exact
    DECIMAL(38,0) (NULL above 128 bits); ``value_double`` covers all 256."""
    x = filter_logs(logs, topic0).filter(F.get(F.col("topics"), 2).isNotNull())
    return x.select(
        F.lower(F.col("address")).alias("contract_address"),
        address_from_topic(F.get(F.col("topics"), 1)).alias("from"),
        address_from_topic(F.get(F.col("topics"), 2)).alias("to"),
        word_to_decimal(word_at("data", 0)).alias("value"),
        word_to_double(word_at("data", 0)).alias("value_double"),
        "block_number", "log_index",
    )


def decode_account_words(words: DataFrame, base_unit: float = 1e8, bps: float = 1e4, hf_unit: float = 1e18) -> DataFrame:
    """Six-word account records -> scaled columns (SC-12).  Records shorter
    than six words are failed reads and are dropped (T20)."""
    x = words.filter(n_words("data") >= 6)
    w = [word_to_double(word_at("data", i)) for i in range(6)]
    return x.select(
        "block_number", "address",
        (w[0] / F.lit(base_unit)).alias("collateral"),
        (w[1] / F.lit(base_unit)).alias("debt"),
        (w[2] / F.lit(base_unit)).alias("available"),
        (w[3] / F.lit(bps)).alias("liquidation_threshold"),
        (w[4] / F.lit(bps)).alias("ltv"),
        (w[5] / F.lit(hf_unit)).alias("health_factor"),
    )


def block_windows(spark: SparkSession, first: int, last: int, size: int) -> DataFrame:
    """Inclusive windows ``[start, min(start + size, last)]`` stepping by
    ``size + 1`` over ``[first, last]`` (SRC-8).  Built with ``range``: the
    row count is set by the arguments, not by any data."""
    step = size + 1
    n = (last - first) // step + 1
    w = spark.range(n).select(F.col("id").alias("window_index"))
    start = F.lit(first) + F.col("window_index") * F.lit(step)
    return w.select("window_index", start.alias("start_block"), F.least(start + F.lit(size), F.lit(last)).alias("end_block"))


def window_counts(spark: SparkSession, logs: DataFrame, first: int, last: int, size: int) -> DataFrame:
    """Logs per block window, empty windows included: a coverage check of a
    landed log table against the windows a pager would have requested."""
    step = size + 1
    x = logs.filter(F.col("block_number").between(first, last))
    c = x.groupBy(F.floor((F.col("block_number") - F.lit(first)) / F.lit(step)).cast("bigint").alias("window_index")).agg(
        F.count(F.lit(1)).alias("n_logs"))
    w = block_windows(spark, first, last, size)
    return w.join(c, "window_index", "left").select(
        "window_index", "start_block", "end_block", F.coalesce(F.col("n_logs"), F.lit(0)).alias("n_logs"))

