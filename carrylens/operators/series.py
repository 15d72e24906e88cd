"""Daily rate, balance, exchange-rate and carry series (J-2 daily, J-9..J-14).

Plan shape
----------
Every transfer-derived series comes from **one** scan of the transfer table
(contract IN (...) pushed to parquet) and **one** ``groupBy(day)`` with
conditional sums (R1); the reserve updates are reduced to one row per day
with ``max_by`` (no sort, AG-17).  After those two aggregations the data is
one row per calendar day, so the calendar joins are broadcast joins and the
running windows run over a few thousand rows whatever the input size (R5).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.units import ZERO_ADDRESS, apr_to_apy, exact, pos_div, r8, scale


@dataclass(frozen=True)
class CarryParams:
    asset: str  # debt asset = reserve of the rate updates = vault's underlying
    vault: str  # staking vault, whose share token is the collateral
    a_token: str  # deposit token of the asset reserve (scaled balances)
    debt_token: str  # variable-debt token of the asset reserve (scaled balances)
    reserve_factor: float
    start_day: date
    end_day: date
    window_start: date
    unit: float  # raw units per natural unit of transfer values
    rate_unit: float = 1.0  # raw units per natural unit of rates/indices (1e27 on chain)
    secs_per_year: float = 31_536_000.0
    amounts_are_scaled: bool = True  # T19: mint/burn carry scaled amounts
    # T17: balances carried into start_day (raw units); flows before start_day
    # are otherwise off the calendar
    opening_scaled_supply: int = 0
    opening_scaled_debt: int = 0
    opening_assets: int = 0
    opening_shares: int = 0
    forward_fill_rates: bool = False  # T16: default drops days without an update
    reserve: str = ""  # reserve of the rate updates, where it isn't the asset


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day, inclusive (SC-4).  Its size is set by the date range,
    not by the data, so it is always safe to broadcast."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("INTERVAL 1 DAY"))).alias("day"))


def calendar_span(df: DataFrame, ts: str) -> DataFrame:
    """Dense calendar from the first to the last day present in ``df[ts]``:
    a one-row min/max aggregate (partial aggregation) exploded into days."""
    b = df.agg(F.min(F.to_date(ts)).alias("lo"), F.max(F.to_date(ts)).alias("hi"))
    return b.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))


def event_order_key(block: str = "evt_block_number", index: str = "evt_index") -> F.Column:
    """(block, log index) packed into one BIGINT that sorts the same way:
    ``block * 2^20 + index`` (log indices stay far below 2^20 and block
    numbers far below 2^43)."""
    return F.col(block) * F.lit(1 << 20) + F.col(index).cast("bigint")


def latest_per_day(updates: DataFrame, reserve: str, start: date, rate_unit: float = 1.0) -> DataFrame:
    """Last update of each day by (block desc, log index desc) (AG-17, WN-6,
    SRC-4).  One ``max_by`` per column over a packed BIGINT order key: the
    buffers are primitive, so this stays a hash aggregate with partial
    aggregation -- no per-day sort, no window, no sort aggregate."""
    u = updates.filter((F.col("reserve") == reserve) & (F.col("evt_block_time") >= F.lit(start)))
    u = u.select(F.to_date("evt_block_time").alias("day"), event_order_key().alias("_k"), "evt_block_number",
                 "liquidity_rate", "variable_borrow_rate", "liquidity_index", "variable_borrow_index")
    cols = ["evt_block_number", "liquidity_rate", "variable_borrow_rate", "liquidity_index", "variable_borrow_index"]
    g = u.groupBy("day").agg(*[F.max_by(c, "_k").alias(c) for c in cols])
    return g.select(
        "day", "evt_block_number",
        scale("liquidity_rate", rate_unit).alias("supply_apr"),
        scale("variable_borrow_rate", rate_unit).alias("borrow_apr"),
        scale("liquidity_index", rate_unit).alias("liq_index"),
        scale("variable_borrow_index", rate_unit).alias("debt_index"),
    )


def daily_flows(transfers: DataFrame, p: CarryParams) -> DataFrame:
    """All four daily flows of the carry query from one scan and one
    aggregation (AG-2, R1): deposit-token and debt-token mint/burn, the
    asset's vault flow and the vault share mint/burn.  Exact sums."""
    c, frm, to = F.col("contract_address"), F.col("from"), F.col("to")
    z = F.lit(ZERO_ADDRESS)
    touches_zero = (frm == z) | (to == z)
    touches_vault = (to == F.lit(p.vault)) | (frm == F.lit(p.vault))
    # contract IN (...) prunes partitions; the disjunctions (PF-6) are pushed to the reader
    t = transfers.filter(c.isin(p.a_token, p.debt_token, p.asset, p.vault)).filter(
        (c.isin(p.a_token, p.debt_token, p.vault) & touches_zero) | ((c == p.asset) & touches_vault))
    v = exact("value")
    mint = F.when(frm == z, v).when(to == z, -v)
    vault = F.when(to == F.lit(p.vault), v).when(frm == F.lit(p.vault), -v)
    g = t.groupBy(F.to_date("evt_block_time").alias("day")).agg(
        F.sum(F.when(c == p.a_token, mint)).alias("a_net"),
        F.sum(F.when(c == p.debt_token, mint)).alias("d_net"),
        F.sum(F.when(c == p.asset, vault)).alias("u_net"),
        F.sum(F.when(c == p.vault, mint)).alias("s_net"),
    )
    return g


def densified_flows(spark: SparkSession, transfers: DataFrame, p: CarryParams) -> DataFrame:
    """Calendar left-joined to the daily flows, NULL -> 0 (JN-6, PF-11).
    Flows dated before ``start_day`` fall off the calendar (T17)."""
    cal = calendar(spark, p.start_day, p.end_day)
    # one row per day on both sides; the daily aggregate is the build side
    f = daily_flows(transfers, p)
    j = cal.join(F.broadcast(f), "day", "left")
    zero = F.lit(0).cast("decimal(38,0)")
    return j.select("day", *[F.coalesce(F.col(k), zero).alias(k) for k in ("a_net", "d_net", "u_net", "s_net")])


def running_state(spark: SparkSession, transfers: DataFrame, p: CarryParams) -> DataFrame:
    """Running totals over the dense calendar (WN-4): scaled supply and debt,
    vault assets and share supply, exact, then scaled.  One row per day is
    guaranteed before the window (T14), so the default RANGE frame is safe;
    the window runs over the calendar only (days, not events)."""
    d = densified_flows(spark, transfers, p)
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opening = {"a_net": p.opening_scaled_supply, "d_net": p.opening_scaled_debt,
               "u_net": p.opening_assets, "s_net": p.opening_shares}
    r = d.select("day", *[(F.sum(k).over(w) + F.lit(str(v)).cast("decimal(38,0)")).alias(k) for k, v in opening.items()])
    return r.select(
        "day",
        scale("a_net", p.unit).alias("scaled_supply"),
        scale("d_net", p.unit).alias("scaled_debt"),
        scale("u_net", p.unit).alias("total_assets"),
        scale("s_net", p.unit).alias("total_shares"),
    )


def with_exchange_rate(state: DataFrame) -> DataFrame:
    """Vault assets per share, defined only when both are positive (J-2)."""
    ok = (F.col("total_shares") > 0) & (F.col("total_assets") > 0)
    return state.select("*", F.when(ok, F.col("total_assets") / F.col("total_shares")).alias("exch_rate"))


def exchange_rate_daily(state: DataFrame) -> DataFrame:
    return with_exchange_rate(state).select("day", "total_assets", "total_shares", "exch_rate")


def annualised_growth(df: DataFrame, col: str, lag_rows: int = 30, days_per_year: float = 365.0) -> DataFrame:
    """``(x / lag(x, n))^(365/n) - 1`` over a dense daily calendar (J-13,
    WN-5).  The lag is in rows, so the input must be dense (T15); exponent in
    DOUBLE (T2)."""
    w = Window.orderBy("day")
    prev = F.lag(col, lag_rows).over(w)
    x = F.col(col)
    return df.select(
        "*", F.when((x > 0) & (prev > 0), F.pow(x / prev, F.lit(days_per_year) / F.lit(float(lag_rows))) - 1)
        .alias(f"{col}_growth_{lag_rows}d"))


def reserve_daily(spark: SparkSession, updates: DataFrame, transfers: DataFrame, p: CarryParams,
                  state: DataFrame | None = None) -> DataFrame:
    """Per calendar day with a rate update: rates, indices, running scaled
    balances and actual balances = scaled x index (J-9).  Days without an
    update are dropped, not forward-filled (T16): the left join plus the
    NOT NULL filter becomes an inner join in the optimised plan (PF-9)."""
    rates = latest_per_day(updates, p.reserve or p.asset, p.start_day, p.rate_unit)
    state = state if state is not None else running_state(spark, transfers, p)
    j = state.join(rates, "day", "left")
    if p.forward_fill_rates:
        # carry the last update forward over the (calendar-bounded) day axis
        w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cols = ["evt_block_number", "supply_apr", "borrow_apr", "liq_index", "debt_index"]
        j = j.select(*[c for c in j.columns if c not in cols], *[F.last(c, ignorenulls=True).over(w).alias(c) for c in cols])
    j = j.filter(F.col("borrow_apr").isNotNull())
    if p.amounts_are_scaled:
        supply = F.col("scaled_supply") * F.col("liq_index")
        borrow = F.col("scaled_debt") * F.col("debt_index")
    else:
        supply, borrow = F.col("scaled_supply"), F.col("scaled_debt")
    return j.select("*", supply.alias("total_supply"), borrow.alias("total_borrow"))


def utilisation(df: DataFrame, reserve_factor: float) -> DataFrame:
    """Utilisation two ways (J-10): balances ``borrow/supply`` and rates
    ``supply_apr / (borrow_apr * (1 - RF))``."""
    return df.select(
        "*",
        pos_div(F.col("total_borrow"), F.col("total_supply")).alias("utilisation_balances"),
        pos_div(F.col("supply_apr"), F.col("borrow_apr") * F.lit(1.0 - reserve_factor)).alias("utilisation_rates"),
    )


def carry_daily(spark: SparkSession, updates: DataFrame, transfers: DataFrame, p: CarryParams,
                period_cuts, last_period: str) -> DataFrame:
    """The carry dashboard (J-14): one row per day from ``window_start`` with
    a rate update; carry = vault 30-day annualised yield - borrow APY."""
    # exchange rate and lag stand on the state's own rows, so transfers are scanned once
    state = annualised_growth(with_exchange_rate(running_state(spark, transfers, p)), "exch_rate")
    j = utilisation(reserve_daily(spark, updates, transfers, p, state), p.reserve_factor)
    j = j.filter(F.col("day") >= F.lit(p.window_start))
    borrow_apy = apr_to_apy("borrow_apr", p.secs_per_year)
    supply_apy = apr_to_apy("supply_apr", p.secs_per_year)
    return j.select(
        "day",
        labels.year_label("day").alias("year"),
        labels.quarter_label("day").alias("quarter"),
        labels.month_label("day").alias("month"),
        labels.period_label("day", period_cuts, last_period).alias("period"),
        "evt_block_number",
        r8(borrow_apy).alias("borrow_apy"),
        r8(supply_apy).alias("supply_apy"),
        "total_supply",
        "total_borrow",
        r8(F.col("utilisation_balances")).alias("utilisation_balances"),
        r8(F.col("utilisation_rates")).alias("utilisation_rates"),
        r8(F.col("exch_rate_growth_30d")).alias("vault_apy_30d"),
        r8(F.col("exch_rate")).alias("vault_exchange_rate"),
        r8(F.col("exch_rate_growth_30d") - borrow_apy).alias("carry"),
    ).orderBy("day")  # SL-2: a few thousand rows, one per day
