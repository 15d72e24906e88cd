"""Domain schemas (FIXTURES part A) and schema-enforcing readers (SRC-1, SRC-2, SRC-9).

Amounts are raw fixed-point integers, exact ``DECIMAL(38,0)`` on landing
(token amounts at 1e18 scale up to 1e20 tokens); addresses are lower-case
``0x`` strings.  Readers never infer a schema: they read with the declared
one, so a landed table with extra columns or reordered columns still
yields the same typed frame, and filters on the key columns reach the
parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

AMOUNT = DecimalType(38, 0)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


S, L, I, D, TS = StringType(), LongType(), IntegerType(), DoubleType(), TimestampNTZType()

SCHEMAS: dict[str, StructType] = {
    "transfer": _s(("contract_address", S), ("from", S), ("to", S), ("value", AMOUNT), ("evt_block_time", TS),
                   ("evt_block_number", L), ("evt_index", I)),
    "borrow": _s(("reserve", S), ("on_behalf_of", S), ("amount", AMOUNT), ("evt_block_time", TS)),
    "repay": _s(("reserve", S), ("user", S), ("amount", AMOUNT), ("evt_block_time", TS)),
    "supply": _s(("reserve", S), ("on_behalf_of", S), ("amount", AMOUNT), ("evt_block_time", TS)),
    "withdraw": _s(("reserve", S), ("user", S), ("amount", AMOUNT)),
    "liquidation_call": _s(("user", S), ("debt_asset", S), ("debt_to_cover", AMOUNT), ("collateral_asset", S),
                           ("liquidated_collateral_amount", AMOUNT), ("evt_block_time", TS)),
    "reserve_data_updated": _s(("reserve", S), ("evt_block_time", TS), ("evt_block_number", L), ("evt_index", I),
                               ("liquidity_rate", AMOUNT), ("variable_borrow_rate", AMOUNT),
                               ("liquidity_index", AMOUNT), ("variable_borrow_index", AMOUNT)),
    "creation_traces": _s(("address", S)),
    "raw_logs": _s(("address", S), ("topics", ArrayType(S)), ("data", S), ("block_number", L), ("log_index", I)),
    "balances": _s(("block_number", L), ("token", S), ("address", S), ("balance", AMOUNT)),
    "account_words": _s(("block_number", L), ("address", S), ("data", S)),
    "code": _s(("address", S), ("code", BinaryType())),
    "categories": _s(("category_id", I), ("label", S), ("collateral_bitmap", S), ("borrowable_bitmap", S),
                     ("ltv", I), ("lt", I), ("bonus", I)),
    "lineage": _s(("token", S), ("relation", S), ("target", S)),
    "token_supply": _s(("token", S), ("total_supply", AMOUNT), ("vault_balance", AMOUNT)),
    "cluster": _s(("address", S), ("debt", D), ("leverage", D), ("health_factor", D)),
    "curves": _s(("config", S), ("r0", D), ("uopt", D), ("slope1", D), ("slope2", D), ("reserve_factor", D)),
}


def read_events(spark: SparkSession, path: str, kind: str, **equals: str) -> DataFrame:
    """Read a landed event table of ``kind`` with its declared schema and
    optional equality filters (``reserve=...``, ``contract_address=...``),
    written as literals so they reach the reader (SRC-1, SRC-2)."""
    df = spark.read.schema(SCHEMAS[kind]).parquet(path)
    for c, v in equals.items():
        df = df.filter(F.col(c) == F.lit(v))
    return df


def snapshot_as_of(df: DataFrame, keys: list[str], pin: int, block: str = "block_number",
                   index: str | None = None) -> DataFrame:
    """State of every entity as of a pinned block (SRC-9): the latest row with
    ``block <= pin`` per key, by (block, index).  One ``max_by`` per column
    over a packed BIGINT order key keeps primitive aggregation buffers, so
    this is a hash aggregate with partial aggregation and no sort.  A table
    holding exactly one snapshot per pin reduces to ``block = pin``."""
    k = F.col(block).cast("bigint")
    if index is not None:
        k = k * F.lit(1 << 20) + F.col(index).cast("bigint")
    cols = [c for c in df.columns if c not in keys]
    x = df.filter(F.col(block) <= F.lit(pin)).withColumn("_k", k)
    return x.groupBy(*keys).agg(*[F.max_by(c, "_k").alias(c) for c in cols])
