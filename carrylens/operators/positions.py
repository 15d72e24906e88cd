"""Loop classification, leaderboard, shares and concentration (J-3..J-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.units import r8, safe_div, scale
from .bands import banded_rank
from .ranking import top_k_with_running


def contract_flag(positions: DataFrame, creation_traces: DataFrame, key: str = "user_addr") -> DataFrame:
    """``addr_type`` = 'contract' when the address appears in the creation
    traces, else 'EOA' (PF-14, JN-5).  The traces are made distinct before the
    semi join against the position set: equal ones combine before they move,
    and the join's tasks sort distinct addresses, not the whole history (R4)."""
    keys = positions.select(F.col(key).alias("address"))
    contracts = creation_traces.select("address").distinct().join(keys, "address", "left_semi")
    flagged = positions.join(
        contracts.withColumn("_is_contract", F.lit(True)).withColumnRenamed("address", key), key, "left")
    return flagged.withColumn(
        "addr_type", F.when(F.col("_is_contract"), F.lit("contract")).otherwise(F.lit("EOA"))).drop("_is_contract")


def classify_positions(positions: DataFrame, rate: DataFrame, ltv_min: float, ltv_max: float) -> DataFrame:
    """Value collateral with a one-row exchange-rate side, LTV, loop band flag
    and implied leverage (J-3, PF-8, PF-10, JN-2).  ``rate`` has one row, so
    the cross join is a broadcast of a single row.  LTV above 1 keeps its
    negative leverage (T9); a NULL LTV is not a loop (CASE gives FALSE)."""
    r = F.broadcast(rate.select("exchange_rate"))
    j = positions.crossJoin(r)
    equiv = F.col("collateral") * F.col("exchange_rate")
    ltv = safe_div(F.col("debt"), equiv)
    return j.select(
        *[c for c in positions.columns],
        equiv.alias("collateral_equiv"),
        ltv.alias("ltv"),
    ).select(
        "*",
        F.coalesce(F.col("ltv").between(F.lit(ltv_min), F.lit(ltv_max)), F.lit(False)).alias("is_loop_position"),
        safe_div(F.lit(1.0), F.lit(1.0) - F.col("ltv")).alias("implied_leverage"),
    )


def debt_totals(classified: DataFrame) -> DataFrame:
    """One-row totals over the joined set: all debt and loop-only debt, exact."""
    return classified.agg(
        F.sum("debt_raw").alias("total_debt_raw"),
        F.sum(F.when(F.col("is_loop_position"), F.col("debt_raw"))).alias("loop_debt_raw"),
    )


def _order(debt: str = "debt_raw", key: str = "user_addr") -> list[Column]:
    # ties on debt are broken by address so ranks are deterministic (T13)
    return [F.col(debt).desc_nulls_last(), F.col(key).asc_nulls_last()]


def _share_columns(running_col: str | None) -> list[Column]:
    d = F.col("debt_raw").cast("double")
    loop_tot = F.col("loop_debt_raw").cast("double")
    cols = [
        r8(F.when(F.col("is_loop_position"), safe_div(d, loop_tot))).alias("share_of_loop_debt"),
        r8(safe_div(d, F.col("total_debt_raw").cast("double"))).alias("share_of_joined_debt"),
    ]
    if running_col:
        cols.insert(1, r8(F.when(F.col("is_loop_position"),
                                 safe_div(F.col(running_col).cast("double"), loop_tot))).alias("cumulative_share_of_loop"))
    return cols


def leaderboard(classified: DataFrame, k: int, all_debt: DataFrame | None = None) -> DataFrame:
    """Top ``k`` by debt with rank, loop shares, cumulative loop share and
    share of the joined set's debt (J-4), without a single-partition window
    over all positions (R2a).  With ``all_debt`` (one row, ``all_debt_raw``)
    the share of all borrowers' net debt is added as well (T4)."""
    tot = debt_totals(classified)
    if all_debt is not None:
        tot = tot.crossJoin(all_debt)
    tot = F.broadcast(tot)
    top = top_k_with_running(
        classified, _order(), k,
        running={"_cum_loop": F.when(F.col("is_loop_position"), F.col("debt_raw"))},
    )
    j = top.crossJoin(tot)
    extra = []
    if all_debt is not None:
        extra = [r8(safe_div(F.col("debt_raw").cast("double"), F.col("all_debt_raw").cast("double"))).alias("share_of_all_debt")]
    return j.select(
        "rank", "user_addr", "addr_type", "is_loop_position", "debt", "collateral_equiv",
        r8(F.col("ltv")).alias("ltv"), r8(F.col("implied_leverage")).alias("implied_leverage"),
        *_share_columns("_cum_loop"), *extra, "n_borrows", "first_borrow", "last_borrow",
    )


def full_ranking(classified: DataFrame) -> DataFrame:
    """Every position ranked with its cumulative loop share (WN-1, WN-3), the
    distributed way (R2b)."""
    tot = F.broadcast(debt_totals(classified))
    slim = classified.select("user_addr", "is_loop_position", "debt", "debt_raw")
    ranked = banded_rank(slim, [("debt_raw", False), ("user_addr", True)], running={"_cum_loop": F.when(F.col("is_loop_position"), F.col("debt_raw"))})
    j = ranked.crossJoin(tot)
    return j.select("rank", "user_addr", "is_loop_position", "debt", *_share_columns("_cum_loop"))


def debt_shares(classified: DataFrame) -> DataFrame:
    """Share of total (and of loop) debt for every row (WN-2): aggregate once,
    broadcast the single row back, no window."""
    tot = F.broadcast(debt_totals(classified))
    return classified.crossJoin(tot).select("user_addr", "is_loop_position", "debt", *_share_columns(None))


# ------------------------------------------------------------ balance-based loopers
def holder_legs(balances: DataFrame, collateral_token: str, debt_token: str, pin: int) -> DataFrame:
    """Pivot the balance snapshot of block ``pin`` to one row per address with
    both legs (J-5); other snapshots in the table are left out (SRC-9)."""
    t = F.col("token")
    b = balances.filter(t.isin(collateral_token, debt_token) & (F.col("block_number") == F.lit(pin)))
    return b.groupBy("address").agg(
        F.sum(F.when(t == collateral_token, F.col("balance").cast("decimal(38,0)"))).alias("collateral_raw"),
        F.sum(F.when(t == debt_token, F.col("balance").cast("decimal(38,0)"))).alias("debt_raw"),
    )


def both_legs_positive(legs: DataFrame, unit: float) -> DataFrame:
    """Looper set: both balances > 0 (PF-12, SO-4).  A missing balance read
    counts as 0 (T20)."""
    x = legs.filter((F.coalesce(F.col("collateral_raw"), F.lit(0)) > 0) & (F.coalesce(F.col("debt_raw"), F.lit(0)) > 0))
    return x.select("address", "collateral_raw", "debt_raw", scale("collateral_raw", unit).alias("collateral"),
                    scale("debt_raw", unit).alias("debt"))


def loop_share_of_reserve(legs: DataFrame, unit: float) -> DataFrame:
    """Looper totals against the whole reserve (AG-7): one pass, one row."""
    c = F.coalesce(F.col("collateral_raw"), F.lit(0))
    d = F.coalesce(F.col("debt_raw"), F.lit(0))
    both = (c > 0) & (d > 0)
    g = legs.agg(
        F.sum(c).alias("tc"), F.sum(d).alias("td"),
        F.sum(F.when(both, c)).alias("lc"), F.sum(F.when(both, d)).alias("ld"),
        F.count(F.when(both, F.lit(1))).alias("n_loopers"),
        F.count(F.when(c > 0, F.lit(1))).alias("n_collateral_holders"),
        F.count(F.when(d > 0, F.lit(1))).alias("n_debt_holders"),
    )
    return g.select(
        "n_loopers", "n_collateral_holders", "n_debt_holders",
        scale("tc", unit).alias("total_collateral"), scale("td", unit).alias("total_debt"),
        scale("lc", unit).alias("looper_collateral"), scale("ld", unit).alias("looper_debt"),
        r8(safe_div(F.col("lc").cast("double"), F.col("tc").cast("double"))).alias("looper_collateral_share"),
        r8(safe_div(F.col("ld").cast("double"), F.col("td").cast("double"))).alias("looper_debt_share"),
    )


def concentration_topn(loopers: DataFrame, ns: tuple[int, ...] = (3, 10)) -> DataFrame:
    """Share of looper debt held by the top n addresses, for each n (AG-8).
    The top max(n) rows come from a bounded top-k; the total from an aggregate."""
    kmax = max(ns)
    order = [F.col("debt_raw").desc_nulls_last(), F.col("address").asc_nulls_last()]
    top = top_k_with_running(loopers, order, kmax, running={"_cum": F.col("debt_raw")})
    tot = F.broadcast(loopers.agg(F.sum("debt_raw").alias("_tot"), F.count(F.lit(1)).alias("n_loopers")))
    # with fewer than n loopers, the top n are all of them: read the last rank
    ns_df = loopers.sparkSession.createDataFrame([(n,) for n in ns], "top_n int")
    j = ns_df.crossJoin(tot).withColumn("_at", F.least(F.col("top_n").cast("bigint"), F.col("n_loopers")))
    j = j.join(F.broadcast(top.select(F.col("rank").alias("_at"), "_cum")), "_at", "left")
    return j.select(
        F.col("top_n").cast("bigint").alias("top_n"), "n_loopers",
        r8(safe_div(F.col("_cum").cast("double"), F.col("_tot").cast("double"))).alias("share_of_looper_debt"),
    )


def size_bands(loopers: DataFrame, unit: float, small_cut: float, large_cut: float) -> DataFrame:
    """Retail (< small_cut) and large (>= large_cut) positions: counts and
    debt share (AG-9), one pass."""
    d = F.col("debt_raw")
    small = d < F.lit(small_cut * unit)
    large = d >= F.lit(large_cut * unit)
    g = loopers.agg(
        F.count(F.when(small, F.lit(1))).alias("n_small"),
        F.sum(F.when(small, d)).alias("small_raw"),
        F.count(F.when(large, F.lit(1))).alias("n_large"),
        F.sum(F.when(large, d)).alias("large_raw"),
        F.sum(d).alias("tot"),
    )
    return g.select(
        "n_small", r8(safe_div(F.coalesce(F.col("small_raw"), F.lit(0)).cast("double"), F.col("tot").cast("double"))).alias("small_share"),
        "n_large", r8(safe_div(F.coalesce(F.col("large_raw"), F.lit(0)).cast("double"), F.col("tot").cast("double"))).alias("large_share"),
    )
