"""Daily state and carry of many markets in one run (WN-4, WN-5, J-9, J-14).

A market is a row of a parameter table: reserve, underlying asset, vault, its
two tokens, calendar, window and opening balances (T17).  One scan of the
transfers serves all markets: a token's flows go to every market that names
it, in the role it has there.  Everything after the daily sums is one row per
market and day, with windows partitioned by market.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.units import ZERO_ADDRESS, exact, pos_div, r8
from .series import CarryParams, event_order_key

_SCHEMA = ("market string, reserve string, asset string, vault string, a_token string, debt_token string, reserve_factor double, "
           "start_day date, end_day date, window_start date, unit double, rate_unit double, secs_per_year double, "
           "a_open decimal(38,0), d_open decimal(38,0), u_open decimal(38,0), s_open decimal(38,0), scaled boolean, fill boolean")
ROLES = {"a": "a_token", "d": "debt_token", "u": "asset", "s": "vault"}


def market_table(spark: SparkSession, markets: Mapping[str, CarryParams]) -> DataFrame:
    """The parameter table, one row per market."""
    from decimal import Decimal

    rows = [(name, p.reserve or p.asset, p.asset, p.vault, p.a_token, p.debt_token, p.reserve_factor, p.start_day, p.end_day, p.window_start,
             float(p.unit), float(p.rate_unit), float(p.secs_per_year),
             *(Decimal(x) for x in (p.opening_scaled_supply, p.opening_scaled_debt, p.opening_assets, p.opening_shares)),
             p.amounts_are_scaled, p.forward_fill_rates) for name, p in markets.items()]
    return spark.createDataFrame(rows, _SCHEMA)


def market_flows(transfers: DataFrame, markets: DataFrame) -> DataFrame:
    """(market, day, a_net, d_net, u_net, s_net): mint and burn of the deposit
    and debt token and of the vault's shares, and the asset's flow into the
    vault.  The role table has four rows a market and is left to Spark's size
    check; the join prunes transfers partitioned by contract."""
    roles = markets.select("market", "vault", F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(c).alias("contract_address")) for r, c in ROLES.items()])).alias("r")).select("market", F.col("vault").alias("_vault"), "r.*")
    t = transfers.join(roles, "contract_address")
    z, frm, to, v = F.lit(ZERO_ADDRESS), F.col("from"), F.col("to"), exact("value")
    into_vault = F.when(to == F.col("_vault"), v).when(frm == F.col("_vault"), -v)
    minted = F.when(frm == z, v).when(to == z, -v)
    flow = F.when(F.col("role") == "u", into_vault).otherwise(minted)
    x = t.select("market", "role", F.to_date("evt_block_time").alias("day"), flow.alias("flow")).filter("flow is not null")
    return x.groupBy("market", "day").agg(*[F.sum(F.when(F.col("role") == r, F.col("flow"))).alias(f"{r}_net") for r in ROLES])


def market_state(transfers: DataFrame, markets: DataFrame) -> DataFrame:
    """Running balances of every market on each day of its calendar (WN-4),
    from its opening balances; flows off its calendar don't count."""
    days = markets.select("*", F.explode(F.sequence("start_day", "end_day", F.expr("INTERVAL 1 DAY"))).alias("day"))
    x = days.join(market_flows(transfers, markets), ["market", "day"], "left")
    w = Window.partitionBy("market").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.lit(0).cast("decimal(38,0)")
    run = {r: F.sum(F.coalesce(f"{r}_net", zero)).over(w) + F.col(f"{r}_open") for r in ROLES}
    names = {"a": "scaled_supply", "d": "scaled_debt", "u": "total_assets", "s": "total_shares"}
    return x.select(*markets.columns, "day", *[run[r].alias(n) for r, n in names.items()]).select(
        *markets.columns, "day", *[(F.col(n).cast("double") / F.col("unit")).alias(n) for n in names.values()])


def market_yield(state: DataFrame, lag_days: int = 30) -> DataFrame:
    """``state`` with the vault's exchange rate and its annualised growth over
    ``lag_days`` rows of the market's dense calendar (WN-5), on the same rows."""
    ok = (F.col("total_shares") > 0) & (F.col("total_assets") > 0)
    x = state.withColumn("exch_rate", F.when(ok, F.col("total_assets") / F.col("total_shares")))
    prev = F.lag("exch_rate", lag_days).over(Window.partitionBy("market").orderBy("day"))
    growth = F.pow(F.col("exch_rate") / F.col("_prev"), F.lit(365.0) / F.lit(float(lag_days))) - 1
    return x.withColumn("_prev", prev).withColumn(
        "vault_growth", F.when((F.col("exch_rate") > 0) & (F.col("_prev") > 0), growth)).drop("_prev")


RATES = ("evt_block_number", "liquidity_rate", "variable_borrow_rate", "liquidity_index", "variable_borrow_index")


def market_rates(updates: DataFrame, markets: DataFrame) -> DataFrame:
    """The last update of each market's reserve on each day (AG-17)."""
    m = markets.select("market", "reserve", "start_day", F.col("rate_unit").alias("_unit"))
    u = updates.join(m, "reserve").filter(F.col("evt_block_time") >= F.col("start_day"))
    g = u.select("market", F.to_date("evt_block_time").alias("day"), event_order_key().alias("_k"), "_unit", *RATES).groupBy("market", "day").agg(
        F.max("_unit").alias("_unit"), *[F.max_by(c, "_k").alias(c) for c in RATES])
    per = lambda c: F.col(c).cast("double") / F.col("_unit")
    return g.select("market", "day", "evt_block_number", per("liquidity_rate").alias("supply_apr"), per("variable_borrow_rate").alias("borrow_apr"),
                    per("liquidity_index").alias("liq_index"), per("variable_borrow_index").alias("debt_index"))


def carry_markets(updates: DataFrame, transfers: DataFrame, markets: DataFrame, period_cuts, last_period: str) -> DataFrame:
    """The carry dashboard (J-14) of every market: ``market`` and its columns
    per day from ``window_start`` with a rate update (or, where ``fill`` is
    set, with the last one carried forward)."""
    j = market_yield(market_state(transfers, markets)).join(market_rates(updates, markets), ["market", "day"], "left")
    w = Window.partitionBy("market").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in ("evt_block_number", "supply_apr", "borrow_apr", "liq_index", "debt_index"):
        j = j.withColumn(c, F.when(F.col("fill"), F.last(c, ignorenulls=True).over(w)).otherwise(F.col(c)))
    j = j.filter("borrow_apr is not null and day >= window_start")
    one = F.lit(1.0)
    supply = F.col("scaled_supply") * F.when(F.col("scaled"), F.col("liq_index")).otherwise(one)
    borrow = F.col("scaled_debt") * F.when(F.col("scaled"), F.col("debt_index")).otherwise(one)
    j = j.withColumns({"total_supply": supply, "total_borrow": borrow})
    apy = {f"{side}_apy": apr_to_apy_at(f"{side}_apr", "secs_per_year") for side in ("borrow", "supply")}
    return j.select(
        "market", "day", labels.year_label("day").alias("year"), labels.quarter_label("day").alias("quarter"), labels.month_label("day").alias("month"),
        labels.period_label("day", period_cuts, last_period).alias("period"), "evt_block_number", *[r8(x).alias(n) for n, x in apy.items()],
        "total_supply", "total_borrow",
        r8(pos_div("total_borrow", "total_supply")).alias("utilisation_balances"),
        r8(pos_div(F.col("supply_apr"), F.col("borrow_apr") * (one - F.col("reserve_factor")))).alias("utilisation_rates"),
        r8(F.col("vault_growth")).alias("vault_apy_30d"), r8(F.col("exch_rate")).alias("vault_exchange_rate"),
        r8(F.col("vault_growth") - apy["borrow_apy"]).alias("carry"))


def apr_to_apy_at(apr: str, n: str) -> F.Column:
    """Per-second compounding with the number of seconds from a column (T3)."""
    return F.expm1(F.col(n) * F.log1p(F.col(apr) / F.col(n)))
