"""Hurdle, equilibrium and scenario grids (J-18..J-23).

The studied analysis solves each scenario in a Python loop on one machine.
Here a scenario is a row: a literal scenario table is cross-joined (broadcast,
its size is fixed by the caller) with the one-row cluster statistics computed
from the account data, and every formula is a column expression.  A grid of
positions x scenarios stays a distributed product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.curves import (
    curve_branch,
    curve_utilisation,
    hf_from_leverage,
    indifference_rate,
    leverage_from_hf,
    loop_roe,
)
from ..functions.units import r8, real_sum, safe_div, weighted_mean
from .accounts import with_segments


@dataclass(frozen=True)
class Curve:
    r0: float = 0.0
    uopt: float = 0.90
    slope1: float = 0.04
    slope2: float = 0.12
    reserve_factor: float = 0.25


def r4(c: Column) -> Column:
    """Money results are rounded to 4 places (8 would exceed double digits)."""
    return F.round(c, 4)


def cluster_members(accounts: DataFrame, dust_cut: float, k: int, min_leverage: float) -> DataFrame:
    """Top ``k`` healthy non-dust accounts by debt, minus the members running a
    materially lower-leverage strategy (JN-10: a left anti join against the
    excluded set).  Bounded by ``k``."""
    n = with_segments(accounts, dust_cut).filter(F.col("segment") == "normal")
    top = n.orderBy(F.col("debt").desc(), F.col("address").asc()).limit(k).select(
        "address", "debt", "leverage", "health_factor")
    excluded = top.filter(F.col("leverage") < F.lit(min_leverage)).select("address")
    return top.join(F.broadcast(excluded), "address", "left_anti")


def cluster_stats(members: DataFrame, y: float, r: float, loop_debt: DataFrame | None = None) -> DataFrame:
    """Debt-weighted leverage and HF, realised ROE range and the hurdle (the
    debt-weighted realised ROE), plus the cluster's share of loop debt (J-18).
    ``loop_debt`` is a one-row frame with column ``loop_debt``."""
    roe = loop_roe(F.col("leverage"), y, r)
    g = members.agg(
        F.count(F.lit(1)).alias("n_members"),
        real_sum("debt").alias("cluster_debt"),
        weighted_mean("leverage", "debt").alias("w_leverage"),
        weighted_mean("health_factor", "debt").alias("w_hf"),
        weighted_mean(roe, "debt").alias("hurdle"),
        F.min(roe).alias("roe_min"),
        F.max(roe).alias("roe_max"),
    )
    if loop_debt is not None:
        g = g.crossJoin(F.broadcast(loop_debt)).withColumn(
            "share_of_loop_debt", safe_div(F.col("cluster_debt"), F.col("loop_debt"))).drop("loop_debt")
    return g


def _c(x) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else (F.col(x) if isinstance(x, str) else x)


def solve(df: DataFrame, y: float, hurdle, leverage, curve: Curve, deposits: float,
          uopt=None, slope1=None) -> DataFrame:
    """Equilibrium per row (J-19): the indifference borrow rate, the
    utilisation the curve needs to deliver it (and on which branch), DAO
    revenue on ``deposits`` and supply APY.  ``uopt``/``slope1`` may name
    per-row columns (configuration grids); otherwise the curve's values."""
    uo = _c(uopt if uopt is not None else curve.uopt)
    s1 = _c(slope1 if slope1 is not None else curve.slope1)
    rstar = indifference_rate(y, _c(hurdle), _c(leverage))
    x = df.withColumn("r_star", rstar)
    u = curve_utilisation(F.col("r_star"), curve.r0, uo, s1, curve.slope2)
    x = x.withColumn("u_star", u).withColumn("branch", curve_branch(F.col("r_star"), curve.r0, s1))
    rf = F.lit(curve.reserve_factor)
    return x.withColumn("revenue", F.lit(deposits) * F.col("u_star") * F.col("r_star") * rf).withColumn(
        "supply_apy", F.col("r_star") * F.col("u_star") * (F.lit(1.0) - rf))


def sensitivity(stats: DataFrame, hf_targets: Sequence[float], l_targets: Sequence[float], lt: float,
                y: float, curve: Curve, deposits: float) -> DataFrame:
    """Six-style sensitivity table (J-20): rows targeting an HF derive L from
    ``L = 1/(1 - LT/HF)``; rows targeting L derive HF from ``HF = LT/(1 - 1/L)``;
    the base row (L = the cluster's own weighted leverage, ``None`` in
    ``l_targets``) shows the cluster's measured HF."""
    spark = stats.sparkSession
    rows = [(f"HF = {h}", "hf", float(h)) for h in hf_targets] + [
        ("L = base" if t is None else f"L = {t:g}x", "base" if t is None else "l", None if t is None else float(t))
        for t in l_targets]
    sc = spark.createDataFrame(rows, "scenario string, kind string, target double")
    j = sc.crossJoin(F.broadcast(stats))
    L = (F.when(F.col("kind") == "hf", leverage_from_hf(F.col("target"), lt))
         .when(F.col("kind") == "l", F.col("target")).otherwise(F.col("w_leverage")))
    j = j.withColumn("L", L)
    hf = (F.when(F.col("kind") == "hf", F.col("target"))
          .when(F.col("kind") == "l", hf_from_leverage(F.col("L"), lt)).otherwise(F.col("w_hf")))
    j = j.withColumn("HF", hf)
    return solve(j, y, "hurdle", "L", curve, deposits)


def config_grid(stats: DataFrame, configs: Sequence[tuple[str, float, float]], y: float, curve: Curve,
                deposits: float, base: str) -> DataFrame:
    """Curve configurations solved against the same cluster, with revenue and
    utilisation change against the base configuration (J-21).  The base row's
    values come from a window over the configurations (a handful of rows), so
    the cluster is computed once."""
    spark = stats.sparkSession
    cf = spark.createDataFrame(list(configs), "config string, uopt double, slope1 double")
    j = solve(cf.crossJoin(F.broadcast(stats)), y, "hurdle", "w_leverage", curve, deposits, uopt="uopt", slope1="slope1")
    rows = Window.partitionBy(F.lit(1))
    of_base = lambda c: F.max(F.when(F.col("config") == base, F.col(c))).over(rows)
    return j.withColumn("base_revenue", of_base("revenue")).withColumn("base_u", of_base("u_star")).withColumn(
        "revenue_change", F.col("revenue") / F.col("base_revenue") - F.lit(1.0)).withColumn(
        "u_change_points", (F.col("u_star") - F.col("base_u")) * F.lit(100.0))


def slope_sweep(stats: DataFrame, slopes: Sequence[float], y: float, curve: Curve, deposits: float) -> DataFrame:
    spark = stats.sparkSession
    sw = spark.createDataFrame([(float(s),) for s in slopes], "slope1 double")
    return solve(sw.crossJoin(F.broadcast(stats)), y, "hurdle", "w_leverage", curve, deposits, slope1="slope1")


def monotone(sweep: DataFrame, x: str, v: str) -> DataFrame:
    """Is ``v`` non-increasing along ``x`` (WN-7)?  ``lag`` over the sweep
    (a handful of rows) then ``bool_and``."""
    w = Window.orderBy(x)
    prev = F.lag(v).over(w)
    s = sweep.select(x, v, prev.alias("_prev"))
    return s.agg(F.count(F.lit(1)).alias("n_points"),
                 F.coalesce(F.bool_and(F.when(F.col("_prev").isNotNull(), F.col(v) <= F.col("_prev"))), F.lit(True))
                 .alias("is_non_increasing"))


def positions_x_rates(accounts: DataFrame, rates: Sequence[float], y: float) -> DataFrame:
    """Every position x every scenario borrow rate (JN-11): the scenario side
    is a literal table of fixed size, broadcast; the position side is never
    shuffled."""
    spark = accounts.sparkSession
    rt = spark.createDataFrame([(float(r),) for r in rates], "borrow_rate double")
    j = accounts.crossJoin(F.broadcast(rt))
    return j.select("address", "borrow_rate", r8(F.col("leverage")).alias("leverage"),
                    r8(loop_roe(F.col("leverage"), y, F.col("borrow_rate"))).alias("roe"))
