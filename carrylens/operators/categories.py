"""Collateral-category selection by bitmaps and token lineage (J-24, J-25).

A category's bitmaps are exploded into ``(category_id, reserve_index)`` rows
once; every later step is an equi-join or a grouped boolean aggregate, so the
whole selection is distributed and never loops over categories on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.curves import loop_roe, max_leverage
from ..functions.units import bit_is_set, hex_bit_is_set, hex_set_bits, r8, set_bits


def _wide(df: DataFrame, bitmap: str) -> bool:
    """Whether a bitmap column is 32 hex digits (all 128 bits) rather than a decimal (126)."""
    return df.schema[bitmap].dataType.typeName() == "string"


def _has(df: DataFrame, bitmap: str, bit: int):
    return hex_bit_is_set(bitmap, bit) if _wide(df, bitmap) else bit_is_set(bitmap, bit)


def _bits(df: DataFrame, bitmap: str, width: int):
    return hex_set_bits(bitmap, width) if _wide(df, bitmap) else set_bits(bitmap, width)


def _some(df: DataFrame, bitmap: str):
    return F.col(bitmap).rlike("[1-9a-fA-F]") if _wide(df, bitmap) else F.col(bitmap) != 0


def bit_lists(categories: DataFrame, width: int = 128) -> DataFrame:
    """Every category with the positions of its set bits, both sides (SC-13)."""
    return categories.select("category_id", _bits(categories, "collateral_bitmap", width).alias("collateral_bits"), _bits(categories, "borrowable_bitmap", width).alias("borrowable_bits"))


def candidates(categories: DataFrame, collateral_bit: int, borrowable_bit: int) -> DataFrame:
    """Categories where reserve A is collateral and reserve B borrowable (SC-13)."""
    return categories.filter(
        _has(categories, "collateral_bitmap", collateral_bit) & _has(categories, "borrowable_bitmap", borrowable_bit))


def collateral_members(categories: DataFrame, width: int = 128) -> DataFrame:
    """``(category_id, reserve_index)`` for every set collateral bit (SC-13)."""
    return categories.select("category_id", F.explode(_bits(categories, "collateral_bitmap", width)).alias("reserve_index"))


def lineage_resolved(reserves: DataFrame, lineage: DataFrame) -> DataFrame:
    """Reserve -> SY -> yield token by two left self-joins of the edge table
    (JN-9).  A reserve without the first or second hop resolves to NULL."""
    sy = lineage.filter(F.col("relation") == "SY").select(F.col("token").alias("address"), F.col("target").alias("sy"))
    yt = lineage.filter(F.col("relation") == "yieldToken").select(F.col("token").alias("sy"), F.col("target").alias("yield_token"))
    return reserves.select("reserve_index", "address", "symbol").join(sy, "address", "left").join(yt, "sy", "left")


def pure_flags(cands: DataFrame, reserves: DataFrame, lineage: DataFrame, collateral_bit: int, target: str) -> DataFrame:
    """A candidate is pure when every *other* collateral asset resolves to the
    target (AG-15, PF-15).  An empty set of others is vacuously pure; an
    unresolvable asset (missing reserve, missing hop) is not pure (T20)."""
    members = collateral_members(cands).filter(F.col("reserve_index") != collateral_bit)
    res = lineage_resolved(reserves, lineage)
    j = members.join(res, "reserve_index", "left")
    ok = F.coalesce(F.col("yield_token") == F.lit(target), F.lit(False))
    per_cat = j.groupBy("category_id").agg(F.bool_and(ok).alias("_all_ok"))
    return cands.join(per_cat, "category_id", "left").withColumn(
        "is_pure", F.coalesce(F.col("_all_ok"), F.lit(True))).drop("_all_ok")


def coverage(categories: DataFrame, scan_bound: int) -> DataFrame:
    """Highest configured category id and whether it is close to the scan
    bound (AG-16)."""
    nz = _some(categories, "collateral_bitmap") | _some(categories, "borrowable_bitmap")
    g = categories.agg(F.max(F.when(nz, F.col("category_id"))).alias("max_configured_id"),
                       F.count(F.when(nz, F.lit(1))).alias("n_configured"))
    return g.select("max_configured_id", "n_configured",
                    (F.col("max_configured_id") >= F.lit(int(scan_bound * 0.9))).alias("near_scan_bound"))


def best(flagged: DataFrame) -> DataFrame:
    """Best pure category: highest LTV, then lowest bonus, then lowest id (SL-4)."""
    p = flagged.filter(F.col("is_pure"))
    return p.orderBy(F.col("ltv").desc(), F.col("bonus").asc(), F.col("category_id").asc()).limit(1)


def loop_economics(cats: DataFrame, equity: float, y: float, r: float) -> DataFrame:
    """Max leverage, position build and ROE at each category's LTV (J-17)."""
    ltv = F.col("ltv") / F.lit(1e4)
    L = max_leverage(ltv)
    return cats.select(
        "category_id", r8(ltv).alias("ltv"), r8(L).alias("max_leverage"),
        r8(F.lit(equity) * L).alias("collateral"), r8(F.lit(equity) * (L - F.lit(1.0))).alias("debt"),
        r8(loop_roe(L, y, r)).alias("roe"),
    )


def baskets(cands: DataFrame, reserves: DataFrame, lineage: DataFrame, target: str) -> DataFrame:
    """Every collateral asset of each candidate with its symbol and, for PT-
    tokens, the resolved yield token and whether it is the target (J-25,
    JN-8, SC-14)."""
    members = collateral_members(cands)
    res = lineage_resolved(reserves, lineage)
    j = members.join(res, "reserve_index", "left")
    is_pt = F.coalesce(F.col("symbol").startswith("PT-"), F.lit(False))
    return j.select(
        "category_id", F.col("reserve_index").cast("int").alias("reserve_index"), "address", "symbol",
        F.when(is_pt, F.col("yield_token")).alias("yield_token"),
        F.when(is_pt, F.coalesce(F.col("yield_token") == F.lit(target), F.lit(False))).alias("yield_is_target"),
    )
