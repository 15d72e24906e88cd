"""Account risk profile (J-7) and top-k profile (J-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import r8, weighted_mean
from .bands import banded_median

# Fixed leverage bucket edges of the studied histogram, half-open, last one
# open-ended (T11): <5, 5-8, 8-10, 10-12.5, >=12.5.
LEVERAGE_EDGES = (5.0, 8.0, 10.0, 12.5)
LEVERAGE_LABELS = ("<5x", "5-8x", "8-10x", "10-12.5x", ">=12.5x")


def account_leverage(accounts: DataFrame) -> DataFrame:
    """Equity and leverage ``C / (C - D)``; NULL with ``is_insolvent`` when
    equity <= 0 instead of +inf, which would poison weighted means (T10)."""
    c, d = F.col("collateral"), F.col("debt")
    eq = c - d
    return accounts.select(
        "*", eq.alias("equity"), F.when(eq > 0, c / eq).alias("leverage"), (eq <= 0).alias("is_insolvent"))


def segment(dust_cut: float) -> F.Column:
    """dust (debt < cut) / near_liquidation (HF < 1) / normal (AG-14)."""
    d, hf = F.col("debt"), F.col("health_factor")
    return (F.when(d < F.lit(dust_cut), F.lit("dust"))
            .when(hf < 1.0, F.lit("near_liquidation")).otherwise(F.lit("normal")))


def with_segments(accounts: DataFrame, dust_cut: float) -> DataFrame:
    return account_leverage(accounts).withColumn("segment", segment(dust_cut))


def risk_segments(accounts: DataFrame, dust_cut: float) -> DataFrame:
    s = with_segments(accounts, dust_cut)
    return s.groupBy("segment").agg(F.count(F.lit(1)).alias("n_accounts"),
                                    F.count(F.when(F.col("is_insolvent"), F.lit(1))).alias("n_insolvent"))


def leverage_stats(accounts: DataFrame, dust_cut: float) -> DataFrame:
    """Median (exact, mean of the middle pair, by distributed rank), debt-
    weighted mean, min and max leverage over normal accounts (AG-10..AG-12)."""
    n = with_segments(accounts, dust_cut).filter(F.col("segment") == "normal")
    med = banded_median(n, "leverage", "address").select(F.col("median").alias("median_leverage"))
    g = n.agg(
        F.count(F.lit(1)).alias("n_accounts"),
        weighted_mean("leverage", "debt").alias("weighted_leverage"),
        F.min("leverage").alias("min_leverage"),
        F.max("leverage").alias("max_leverage"),
    ).crossJoin(F.broadcast(med))
    return g.select("n_accounts", *[r8(F.col(k)).alias(k) for k in
                                    ("median_leverage", "weighted_leverage", "min_leverage", "max_leverage")])


def over_cap(accounts: DataFrame, dust_cut: float, cap: float) -> DataFrame:
    """Healthy non-dust accounts above the origination leverage cap (uses
    ``> cap``; the histogram's top bucket uses ``>= cap``, T11)."""
    n = with_segments(accounts, dust_cut).filter((F.col("segment") == "normal") & (F.col("leverage") > cap))
    return n.select("address", r8(F.col("leverage")).alias("leverage"), r8(F.col("health_factor")).alias("health_factor"),
                    r8(F.col("debt") / F.col("collateral")).alias("ltv_in_use"),
                    F.col("liquidation_threshold"))


def bucket_index(x: F.Column, edges: Sequence[float]) -> F.Column:
    out = None
    for i, e in enumerate(edges):
        out = F.when(x < e, F.lit(i)) if out is None else out.when(x < e, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def leverage_histogram(accounts: DataFrame, dust_cut: float, edges=LEVERAGE_EDGES, names=LEVERAGE_LABELS) -> DataFrame:
    """Fixed-edge histogram over normal accounts with empty buckets kept
    (AG-13): counts are joined onto the bucket dimension."""
    n = with_segments(accounts, dust_cut).filter(F.col("segment") == "normal")
    c = n.groupBy(bucket_index(F.col("leverage"), edges).alias("bucket_index")).agg(F.count(F.lit(1)).alias("n_accounts"))
    dim = accounts.sparkSession.createDataFrame(list(enumerate(names)), "bucket_index int, bucket string")
    return dim.join(c, "bucket_index", "left").select(
        F.col("bucket_index").cast("bigint").alias("bucket_index"), "bucket",
        F.coalesce(F.col("n_accounts"), F.lit(0)).alias("n_accounts"))


def top_profile(loopers: DataFrame, accounts: DataFrame, code: DataFrame, mints: DataFrame, k: int) -> DataFrame:
    """Profile of the top ``k`` loopers by debt (J-8): account kind from code
    size, whole-account leverage and HF, direct mint count.  The top k are a
    bounded set; each large side is first reduced by a join against the
    broadcast top-k, so none of them is shuffled."""
    order = [F.col("debt_raw").desc_nulls_last(), F.col("address").asc_nulls_last()]
    top = loopers.orderBy(*order).limit(k).select("address", "debt", "debt_raw")
    keys = F.broadcast(top.select("address"))
    acc = account_leverage(accounts).join(keys, "address").select("address", "leverage", "health_factor")
    kind = code.join(keys, "address").select(
        "address", F.when(F.length("code") == 0, F.lit("EOA")).otherwise(F.lit("contract")).alias("kind"))
    # mint events (one row per event, receiver in ``address``) are cut to the
    # top k before counting, so the full mint history is never aggregated
    m = mints.join(keys, "address").groupBy("address").agg(F.count(F.lit(1)).alias("mint_events"))
    j = top.join(kind, "address", "left").join(acc, "address", "left").join(m, "address", "left")
    return j.select(
        "address", F.coalesce(F.col("kind"), F.lit("EOA")).alias("kind"), "debt",
        r8(F.col("leverage")).alias("leverage"), r8(F.col("health_factor")).alias("health_factor"),
        F.coalesce(F.col("mint_events"), F.lit(0)).alias("mint_events"),
    )
