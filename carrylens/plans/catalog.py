"""The query catalog: one named job per operator of SURVEY section 2.

Every entry is ``fn(spark, sf_dir) -> DataFrame``; it builds the stand-in
views of ``FIXTURES.md`` over the tables in ``sf_dir`` and runs library
operators on them.  Nothing is collected; parameters are the fixed values
below, so filters become literals that reach the parquet scans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, units
from ..functions.units import r8, safe_div, scale, weighted_mean
from ..operators import ledger, positions
from ..plans.session import materialize
from ..sources import standins as S
from ..sources.standins import ZERO_ADDRESS  # noqa: F401

# Fixed parameters of the catalog queries (FIXTURES.md, "Parameters").
MIN_DEBT = 500_000.0
MIN_COLLATERAL = 500_000.0
LTV_MIN, LTV_MAX = 0.85, 0.95
TOP_K = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- shared
def _legs(s: S.StandIns) -> DataFrame:
    return ledger.lending_legs(s.borrow, s.repay, s.supply, s.withdraw, s.liquidation, S.ASSET, S.SHARE)


def _rate(s: S.StandIns) -> DataFrame:
    return ledger.exchange_rate_scalar(s.transfers, S.ASSET, S.VAULT, S.UNIT)


def _sums(s: S.StandIns) -> DataFrame:
    # one row per user (thresholds off), read by several branches: the kept
    # positions, the contract semi join, the totals and the all-debt total.
    # Materialised once instead of re-aggregating every event per branch.
    return materialize(ledger.position_sums(_legs(s)))


def _positions(s: S.StandIns, shared: bool = True, sums: DataFrame | None = None) -> DataFrame:
    if not shared:
        return ledger.net_positions(_legs(s), S.UNIT, MIN_DEBT, MIN_COLLATERAL)
    return ledger.threshold_positions(sums if sums is not None else _sums(s), S.UNIT, MIN_DEBT, MIN_COLLATERAL)


def _classified(s: S.StandIns, sums: DataFrame | None = None) -> DataFrame:
    pos = positions.contract_flag(_positions(s, sums=sums), s.creation_traces)
    return positions.classify_positions(pos, _rate(s), LTV_MIN, LTV_MAX)


# ======================================================= lending events
@query
def scan_lending_events(spark, sf):
    """SRC-2: reserve-filtered scans of the four lending event kinds."""
    legs = _legs(S.StandIns(spark, sf))
    return legs.groupBy("leg").agg(
        F.count(F.lit(1)).alias("n_events"), scale(F.sum("amount"), S.UNIT).alias("amount"))


@query
def liquidation_legs(spark, sf):
    """SRC-3: one LiquidationCall scan split into its two signed legs."""
    s = S.StandIns(spark, sf)
    x = ledger.liquidation_legs(s.liquidation, S.ASSET, S.SHARE)
    return x.select("leg", "user_addr", scale("amount", S.UNIT).alias("amount"))


@query
def event_legs_union(spark, sf):
    """SO-1, PF-1, PF-3: all signed legs of both position sides."""
    x = _legs(S.StandIns(spark, sf))
    return x.select("leg", "user_addr", scale("amount", S.UNIT).alias("amount"))


@query
def net_debt(spark, sf):
    """AG-3: net debt per user, HAVING > threshold."""
    p = ledger.position_sums(_legs(S.StandIns(spark, sf)))
    return p.filter(F.col("debt_raw") > MIN_DEBT * S.UNIT).select("user_addr", scale("debt_raw", S.UNIT).alias("debt"))


@query
def net_collateral(spark, sf):
    """AG-3: net collateral per user, HAVING > threshold."""
    p = ledger.position_sums(_legs(S.StandIns(spark, sf)))
    return p.filter(F.col("collateral_raw") > MIN_COLLATERAL * S.UNIT).select(
        "user_addr", scale("collateral_raw", S.UNIT).alias("collateral"))


@query
def borrow_activity(spark, sf):
    """AG-4: first/last borrow and borrow count per borrower."""
    p = ledger.position_sums(_legs(S.StandIns(spark, sf)))
    return p.filter(F.col("n_borrows") > 0).select("user_addr", "first_borrow", "last_borrow", "n_borrows")


@query
def net_positions(spark, sf):
    """J-1: both sides netted and thresholded in one grouped pass."""
    return _positions(S.StandIns(spark, sf), shared=False).select("user_addr", "debt", "collateral", "n_borrows")


@query
def positions_joined(spark, sf):
    """JN-3 + JN-2: positions with collateral valued at the vault exchange rate."""
    s = S.StandIns(spark, sf)
    j = _positions(s, shared=False).crossJoin(F.broadcast(_rate(s).select("exchange_rate")))
    return j.select("user_addr", "debt", "collateral", (F.col("collateral") * F.col("exchange_rate")).alias("collateral_equiv"))


@query
def activity_enriched(spark, sf):
    """JN-4 + JN-5: positions with borrow activity and contract/EOA type."""
    s = S.StandIns(spark, sf)
    x = positions.contract_flag(_positions(s), s.creation_traces)
    return x.select("user_addr", "addr_type", "debt", "n_borrows", "first_borrow", "last_borrow")


@query
def contract_flag(spark, sf):
    """PF-14, SC-21, JN-5: address type of every kept position."""
    s = S.StandIns(spark, sf)
    return positions.contract_flag(_positions(s), s.creation_traces).select("user_addr", "addr_type")


@query
def loop_positions(spark, sf):
    """J-3: LTV against the valued collateral, loop band flag, implied leverage."""
    c = _classified(S.StandIns(spark, sf))
    return c.select("user_addr", "debt", "collateral_equiv", r8(F.col("ltv")).alias("ltv"), "is_loop_position",
                    r8(F.col("implied_leverage")).alias("implied_leverage"))


@query
def loop_flag(spark, sf):
    """PF-8: inclusive band -> loop / over / under band counts."""
    c = _classified(S.StandIns(spark, sf))
    band = (F.when(F.col("is_loop_position"), F.lit("loop")).when(F.col("ltv") > LTV_MAX, F.lit("over"))
            .when(F.col("ltv") < LTV_MIN, F.lit("under")).otherwise(F.lit("unpriced")))
    return c.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_positions"),
                                             scale(F.sum("debt_raw"), S.UNIT).alias("debt"))


@query
def safe_ratio(spark, sf):
    """PF-10: guarded LTV and leverage over every netted user, thresholds off,
    so zero and negative denominators occur and must give NULL, not an error."""
    s = S.StandIns(spark, sf)
    p = ledger.position_sums(_legs(s)).crossJoin(F.broadcast(_rate(s).select("exchange_rate")))
    equiv = F.col("collateral_raw").cast("double") * F.col("exchange_rate")
    ltv = safe_div(F.col("debt_raw").cast("double"), equiv)
    return p.select("user_addr", r8(ltv).alias("ltv"), r8(safe_div(F.lit(1.0), F.lit(1.0) - ltv)).alias("implied_leverage"))


@query
def loop_ranking(spark, sf):
    """WN-1: every position ranked by debt, distributed (R2b)."""
    r = positions.full_ranking(_classified(S.StandIns(spark, sf)))
    return r.select("rank", "user_addr", "is_loop_position", "debt")


@query
def cumulative_loop_share(spark, sf):
    """WN-3: running loop-debt share over the full ranking (R2b)."""
    r = positions.full_ranking(_classified(S.StandIns(spark, sf)))
    return r.select("rank", "user_addr", "cumulative_share_of_loop")


@query
def debt_shares(spark, sf):
    """WN-2: each position's share of joined and of loop debt."""
    return positions.debt_shares(_classified(S.StandIns(spark, sf)))


@query
def top_loopers(spark, sf):
    """J-4 / SL-1: the leaderboard, top 20 by debt, with shares of the loop
    set, of the joined set and of all borrowers' debt (T4)."""
    s = S.StandIns(spark, sf)
    sums = _sums(s)
    return positions.leaderboard(_classified(s, sums), TOP_K, ledger.all_debt_total(sums))


@query
def params_cross_join(spark, sf):
    """JN-1: a one-row parameter table joined to every borrow; the reserve
    filter is resolved to a literal so it still reaches the parquet scan."""
    s = S.StandIns(spark, sf)
    params = spark.createDataFrame([(S.ASSET, LTV_MIN, LTV_MAX)], "debt_asset string, ltv_min double, ltv_max double")
    b = s.borrow.filter(F.col("reserve") == S.ASSET)
    j = b.crossJoin(F.broadcast(params))
    return j.groupBy("debt_asset", "ltv_min", "ltv_max").agg(
        F.count(F.lit(1)).alias("n_borrows"), scale(F.sum(F.col("amount").cast("decimal(38,0)")), S.UNIT).alias("borrowed"))


# ============================================================ transfers
@query
def scan_transfers(spark, sf):
    """SRC-1: one transfer scan for every watched contract, filter pushed."""
    s = S.StandIns(spark, sf)
    t = s.transfers.filter(F.col("contract_address").isin(S.ASSET, S.SHARE, S.ATOKEN, S.DTOKEN))
    return t.groupBy("contract_address").agg(F.count(F.lit(1)).alias("n_transfers"),
                                             scale(F.sum(F.col("value").cast("decimal(38,0)")), S.UNIT).alias("volume"))


@query
def vault_net_flow(spark, sf):
    """PF-4: per-transfer signed flow relative to the vault, asset contract."""
    s = S.StandIns(spark, sf)
    f = ledger.flow_kinds(s.transfers, [S.ASSET], S.VAULT)
    return f.filter((F.col("from") == S.VAULT) | (F.col("to") == S.VAULT)).select(
        "from", "to", F.to_date("evt_block_time").alias("day"), scale("vault_flow", S.UNIT).alias("flow"))


@query
def mint_burn_flow(spark, sf):
    """PF-5: per-transfer mint (+) / burn (-) flow of the share token."""
    s = S.StandIns(spark, sf)
    z = S.ZERO_ADDRESS
    f = ledger.flow_kinds(s.transfers, [S.SHARE], None)
    return f.filter((F.col("from") == z) | (F.col("to") == z)).select(
        "from", "to", F.to_date("evt_block_time").alias("day"), scale("mint_flow", S.UNIT).alias("flow"))


@query
def daily_net_flows(spark, sf):
    """AG-2: daily vault and mint/burn net flows of four contracts, one pass."""
    s = S.StandIns(spark, sf)
    return ledger.daily_net_flows(s.transfers, [S.ASSET, S.SHARE, S.ATOKEN, S.DTOKEN], S.VAULT, S.UNIT)


@query
def exchange_rate_scalar(spark, sf):
    """J-2 scalar / AG-1: vault assets over share supply."""
    return _rate(S.StandIns(spark, sf)).select(
        "total_assets", "total_shares", r8(F.col("exchange_rate")).alias("exchange_rate"))


@query
def distinct_holders(spark, sf):
    """J-30 / SO-2 / SO-3 / SL-6: every address that ever held either position token."""
    s = S.StandIns(spark, sf)
    # SL-6: sorted list; a range-partitioned sort, not a single-task one
    return ledger.distinct_holders(s.transfers, [S.ATOKEN, S.DTOKEN]).orderBy("address")


# ===================================================== calendar and carry
from datetime import date  # noqa: E402

from ..operators import markets, series  # noqa: E402

CARRY = series.CarryParams(
    asset=S.ASSET, vault=S.VAULT, a_token=S.ATOKEN, debt_token=S.DTOKEN, reserve_factor=0.25,
    start_day=S.CAL_START, end_day=S.CAL_END, window_start=S.WINDOW_START, unit=S.UNIT,
)
# a second market: another reserve, the tokens' roles swapped, a later calendar, balances carried in
MARKETS = {"base": CARRY, "second": series.CarryParams(
    asset=S.ASSET, vault=S.VAULT, a_token=S.DTOKEN, debt_token=S.ATOKEN, reserve_factor=0.1, reserve=S.SHARE,
    start_day=date(1996, 7, 1), end_day=date(2000, 12, 31), window_start=date(1997, 1, 1), unit=S.UNIT,
    opening_scaled_supply=10**13, opening_scaled_debt=10**12, opening_assets=5 * 10**12, opening_shares=4 * 10**12)}
# period labels: the studied query labels three open-ended periods by two
# cut dates; the stand-in calendar gets its own cut dates and labels
PERIODS = [(date(1998, 1, 1), "1. 1996-1997"), (date(2000, 1, 1), "2. 1998-1999")]
LAST_PERIOD = "3. 2000-2001"
DIVERGENCE_TOL = 0.05


@query
def calendar(spark, sf):
    """SC-4 / SC-5: dense day calendar spanning the transfer history (the
    carry jobs use the same generator between two argument dates)."""
    return series.calendar_span(S.StandIns(spark, sf).transfers, "evt_block_time")


@query
def calendar_labels(spark, sf):
    """SC-2 / SC-3: year, quarter and month labels of every day with flows."""
    s = S.StandIns(spark, sf)
    d = series.densified_flows(spark, s.transfers, CARRY)
    return d.select("day", labels.year_label("day").alias("year"), labels.quarter_label("day").alias("quarter"),
                    labels.month_label("day").alias("month"))


@query
def period_label(spark, sf):
    """PF-13: open-ended period label per day with rates."""
    s = S.StandIns(spark, sf)
    r = series.latest_per_day(s.reserve_updates, S.ASSET, CARRY.start_day)
    return r.select("day", labels.period_label("day", PERIODS, LAST_PERIOD).alias("period"))


@query
def calendar_densify(spark, sf):
    """JN-6 / PF-11: calendar left-joined to the four daily flows, NULL -> 0."""
    s = S.StandIns(spark, sf)
    d = series.densified_flows(spark, s.transfers, CARRY)
    return d.select("day", *[scale(k, S.UNIT).alias(k) for k in ("a_net", "d_net", "u_net", "s_net")])


@query
def latest_per_day(spark, sf):
    """AG-17 / WN-6 / SRC-4: last rate update of each day."""
    s = S.StandIns(spark, sf)
    return series.latest_per_day(s.reserve_updates, S.ASSET, CARRY.start_day)


@query
def running_balances(spark, sf):
    """WN-4: running scaled balances, vault assets and shares over the calendar."""
    s = S.StandIns(spark, sf)
    return series.running_state(spark, s.transfers, CARRY)


@query
def exchange_rate_daily(spark, sf):
    """J-2 daily: vault exchange rate per calendar day."""
    s = S.StandIns(spark, sf)
    e = series.exchange_rate_daily(series.running_state(spark, s.transfers, CARRY))
    return e.select("day", r8(F.col("exch_rate")).alias("exch_rate"))


@query
def annualised_yield_30d(spark, sf):
    """J-13 / WN-5: 30-row lagged annualised growth of the exchange rate."""
    s = S.StandIns(spark, sf)
    e = series.annualised_growth(series.exchange_rate_daily(series.running_state(spark, s.transfers, CARRY)), "exch_rate")
    return e.select("day", r8(F.col("exch_rate_growth_30d")).alias("vault_apy_30d"))


@query
def reserve_balances_daily(spark, sf):
    """J-9: actual supply and borrow = running scaled balance x index."""
    s = S.StandIns(spark, sf)
    d = series.reserve_daily(spark, s.reserve_updates, s.transfers, CARRY)
    return d.select("day", "total_supply", "total_borrow")


@query
def utilisation_dual(spark, sf):
    """J-10: utilisation from balances and from rates."""
    s = S.StandIns(spark, sf)
    d = series.utilisation(series.reserve_daily(spark, s.reserve_updates, s.transfers, CARRY), CARRY.reserve_factor)
    return d.select("day", r8(F.col("utilisation_balances")).alias("utilisation_balances"),
                    r8(F.col("utilisation_rates")).alias("utilisation_rates"))


@query
def utilisation_divergence(spark, sf):
    """J-11: days where the two utilisation measures differ by more than a tolerance."""
    s = S.StandIns(spark, sf)
    d = series.utilisation(series.reserve_daily(spark, s.reserve_updates, s.transfers, CARRY), CARRY.reserve_factor)
    gap = F.col("utilisation_balances") - F.col("utilisation_rates")
    return d.filter(F.abs(gap) > DIVERGENCE_TOL).select("day", r8(gap).alias("utilisation_gap"))


@query
def apr_to_apy(spark, sf):
    """J-12 / SC-6: per-second compounded APY of the daily rates."""
    s = S.StandIns(spark, sf)
    r = series.latest_per_day(s.reserve_updates, S.ASSET, CARRY.start_day)
    return r.select("day", r8(units.apr_to_apy("borrow_apr")).alias("borrow_apy"),
                    r8(units.apr_to_apy("supply_apr")).alias("supply_apy"))


@query
def carry_daily(spark, sf):
    """J-14: the carry dashboard, 15 columns per day."""
    s = S.StandIns(spark, sf)
    return series.carry_daily(spark, s.reserve_updates, s.transfers, CARRY, PERIODS, LAST_PERIOD)


def _markets(s: S.StandIns) -> DataFrame:
    return markets.market_table(s.spark, MARKETS)


@query
def running_balances_markets(spark, sf):
    """WN-4 / T17: running balances of two markets, each from its opening balances."""
    s = S.StandIns(spark, sf)
    return markets.market_state(s.transfers, _markets(s)).select("market", "day", "scaled_supply", "scaled_debt", "total_assets", "total_shares")


@query
def carry_markets(spark, sf):
    """J-14 / WN-5 / J-9: the carry dashboard of two markets in one run."""
    s = S.StandIns(spark, sf)
    return markets.carry_markets(s.reserve_updates, s.transfers, _markets(s), PERIODS, LAST_PERIOD)


# ================================================= raw logs and account words
from ..operators import accounts, asof  # noqa: E402
from ..sources import decode, landing  # noqa: E402

# block windows: the studied pager requests inclusive windows of 9,999 + 1 blocks
WINDOW_FIRST, WINDOW_SIZE = 0, 9_999
ZERO_WORD = "0x" + "0" * 64
HF_UNIT = 1e4  # the stand-in account records carry HF in 1e-4 units
DUST_CUT = 1_000_000.0
LARGE_CUT = 2_000_000.0
LEVERAGE_CAP = 12.5
PROFILE_K = 10
AS_OF_BLOCK = 10_000
RESERVE_PINS = (300, 3_000, 10_000)
SNAPSHOT_PINS = (S.PIN_BLOCK - 2, S.PIN_BLOCK - 1, S.PIN_BLOCK)
RECONCILE_TOL = 0.15  # interest over some years


def _decoded(s: S.StandIns) -> DataFrame:
    return decode.decode_transfers(s.raw_logs, S.TRANSFER_TOPIC)


def _accounts(s: S.StandIns) -> DataFrame:
    pinned = s.account_words.filter(F.col("block_number") == F.lit(S.PIN_BLOCK))
    return decode.decode_account_words(pinned, hf_unit=HF_UNIT)


def _looper_accounts(s: S.StandIns) -> DataFrame:
    """The account records of loopers: the risk profile is theirs alone (J-7)."""
    return _accounts(s).join(_loopers(s).select("address"), "address", "left_semi")


def _holder_legs(s: S.StandIns) -> DataFrame:
    return positions.holder_legs(s.balances, S.ATOKEN, S.DTOKEN, S.PIN_BLOCK)


def _loopers(s: S.StandIns) -> DataFrame:
    return positions.both_legs_positive(_holder_legs(s), S.UNIT)


def _mints(s: S.StandIns) -> DataFrame:
    m = decode.filter_logs(s.raw_logs, S.TRANSFER_TOPIC, ZERO_WORD, S.ASSET)
    return decode.decode_transfers(m, S.TRANSFER_TOPIC)


@query
def decode_transfer_logs(spark, sf):
    """SRC-6 / SC-9 / SC-10 / SC-11: landed logs decoded back into transfers."""
    d = _decoded(S.StandIns(spark, sf))
    return d.select("contract_address", "from", "to", F.col("value").cast("string").alias("value"),
                    "block_number", "log_index")


@query
def decode_account_words(spark, sf):
    """SC-12: six-word account records decoded, short records skipped."""
    a = _accounts(S.StandIns(spark, sf))
    return a.select("address", "collateral", "debt", "available", "liquidation_threshold", "ltv", "health_factor")


@query
def mint_events(spark, sf):
    """SRC-7: topic-filtered logs: mints (from = zero) of the asset."""
    m = _mints(S.StandIns(spark, sf))
    return m.select("to", F.col("value").cast("string").alias("value"), "block_number", "log_index")


@query
def block_window_counts(spark, sf):
    """SRC-8: fixed-size inclusive block windows with log counts (coverage), up
    to the last block that has a log."""
    s = S.StandIns(spark, sf)
    last = s.raw_logs.agg(F.max("block_number")).first()[0]
    return decode.window_counts(spark, s.raw_logs, WINDOW_FIRST, WINDOW_FIRST if last is None else last, WINDOW_SIZE)


@query
def snapshot_as_of(spark, sf):
    """SRC-9: state of every reserve as of a pinned block, by max_by."""
    from ..sources.schemas import snapshot_as_of as as_of

    s = S.StandIns(spark, sf)
    x = as_of(s.reserve_updates, ["reserve"], AS_OF_BLOCK, block="evt_block_number", index="evt_index")
    return x.select("reserve", "evt_block_number", F.col("variable_borrow_rate").alias("borrow_apr"),
                    F.col("liquidity_rate").alias("supply_apr"))


# ======================================== balances, accounts, code, traces
@query
def both_legs_positive(spark, sf):
    """J-5 / PF-12 / SO-4: addresses holding both position tokens."""
    return _loopers(S.StandIns(spark, sf)).select("address", "collateral", "debt")


@query
def loop_share_of_reserve(spark, sf):
    """AG-7: looper totals against the whole reserve."""
    return positions.loop_share_of_reserve(_holder_legs(S.StandIns(spark, sf)), S.UNIT)


@query
def concentration_topn(spark, sf):
    """AG-8 / SL-3: top-3 and top-10 share of looper debt."""
    return positions.concentration_topn(_loopers(S.StandIns(spark, sf)), (3, 10))


@query
def size_bands(spark, sf):
    """AG-9: small and large positions, counts and debt share."""
    return positions.size_bands(_loopers(S.StandIns(spark, sf)), S.UNIT, DUST_CUT, LARGE_CUT)


@query
def account_leverage(spark, sf):
    """J-7 / SC-18: equity and leverage per account, NULL when insolvent."""
    a = accounts.account_leverage(_looper_accounts(S.StandIns(spark, sf)))
    return a.select("address", "equity", r8(F.col("leverage")).alias("leverage"), "is_insolvent",
                    r8(F.col("health_factor")).alias("health_factor"))


@query
def risk_segments(spark, sf):
    """AG-14: dust / near-liquidation / normal counts."""
    return accounts.risk_segments(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT)


@query
def leverage_stats(spark, sf):
    """AG-11 / AG-12: median, weighted, min and max leverage of normal accounts."""
    return accounts.leverage_stats(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT)


@query
def weighted_leverage(spark, sf):
    """AG-10: debt-weighted leverage of normal accounts by HF band."""
    a = accounts.with_segments(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT).filter(F.col("segment") == "normal")
    band = F.when(F.col("health_factor") < 1.05, F.lit("hf<1.05")).otherwise(F.lit("hf>=1.05"))
    g = a.groupBy(band.alias("hf_band")).agg(
        weighted_mean("leverage", "debt").alias("w"), F.count(F.lit(1)).alias("n_accounts"))
    return g.select("hf_band", "n_accounts", r8(F.col("w")).alias("weighted_leverage"))


@query
def over_cap_positions(spark, sf):
    """J-7: healthy non-dust accounts above the 12.5x cap."""
    return accounts.over_cap(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT, LEVERAGE_CAP)


@query
def leverage_histogram(spark, sf):
    """AG-13: fixed-edge leverage histogram with empty buckets."""
    return accounts.leverage_histogram(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT)


@query
def mint_profile(spark, sf):
    """JN-7 / AG-6: direct mint count of every looper, default 0."""
    s = S.StandIns(spark, sf)
    m = ledger.mint_counts(_mints(s))
    return _loopers(s).join(m, "address", "left").select(
        "address", F.coalesce(F.col("mint_events"), F.lit(0)).alias("mint_events"))


@query
def top_profile(spark, sf):
    """J-8: kind, debt, leverage, HF and mint count of the top 10 loopers."""
    s = S.StandIns(spark, sf)
    mints = _mints(s).select(F.col("to").alias("address"))
    return accounts.top_profile(_loopers(s), _accounts(s), s.code, mints, PROFILE_K)


@query
def intra_cluster_transfers(spark, sf):
    """JN-12: asset and share transfers with both ends among the loopers."""
    s = S.StandIns(spark, sf)
    t = s.transfers.filter(F.col("contract_address").isin(S.ASSET, S.SHARE))
    x = ledger.intra_set_transfers(t, _loopers(s).select("address"), hubs=(S.ZERO_ADDRESS, S.VAULT))
    return x.select("contract_address", "from", "to", scale(F.col("value"), S.UNIT).alias("value"), "evt_block_number")


def _debt_events(s: S.StandIns) -> DataFrame:
    return asof.debt_events(s.borrow, s.repay, s.liquidation, [S.ASSET])


@query
def index_as_of_events(spark, sf):
    """T5: every debt event with the borrow index of the last update at or before it."""
    s = S.StandIns(spark, sf)
    x = asof.with_index(_debt_events(s), s.reserve_updates, "variable_borrow_index")
    return x.select("user_addr", F.to_date("evt_block_time").alias("day"), scale("amount", S.UNIT).alias("amount"),
                    r8(F.col("variable_borrow_index")).alias("debt_index"))


@query
def accrued_debt(spark, sf):
    """J-27 / T5: principal against accrued debt (scaled balance x current index) per borrower."""
    s = S.StandIns(spark, sf)
    x = asof.accrued_debt(_debt_events(s), s.reserve_updates, S.UNIT)
    return x.select("user_addr", "n_events", "principal_debt", "scaled_debt", F.round("accrued_debt", 4).alias("accrued_debt"), F.round("interest", 4).alias("interest"))


@query
def reconcile_positions(spark, sf):
    """J-27: event-netted (principal) debt against the accrued debt of the
    addresses that hold the debt token; the gap is the interest (T5)."""
    s = S.StandIns(spark, sf)
    from ..operators import quality

    ev = ledger.position_sums(_legs(s)).select(F.col("user_addr").alias("address"), scale("debt_raw", S.UNIT).alias("a"))
    holders = _holder_legs(s).filter("debt_raw is not null").select("address")
    accrued = asof.accrued_debt(_debt_events(s), s.reserve_updates, S.UNIT).select(F.col("user_addr").alias("address"), F.round("accrued_debt", 4).alias("b"))
    return quality.reconcile(ev, accrued.join(holders, "address", "left_semi"), "address", RECONCILE_TOL)


def _pins(spark, *blocks: int) -> DataFrame:
    return spark.createDataFrame([(b,) for b in blocks], "pin bigint")


@query
def reserves_at_pins(spark, sf):
    """SRC-9: every reserve's rates at three pinned blocks, one pass over the updates."""
    s = S.StandIns(spark, sf)
    x = asof.states_at_pins(s.reserve_updates, ["reserve"], _pins(spark, *RESERVE_PINS), "evt_block_number", "evt_index")
    return x.select("pin", "reserve", "evt_block_number", F.col("variable_borrow_rate").alias("borrow_apr"), F.col("liquidity_rate").alias("supply_apr"),
                    F.col("variable_borrow_index").alias("debt_index"))


@query
def balances_at_pins(spark, sf):
    """SRC-9: token balances at three pinned blocks (none yet at the first)."""
    x = asof.states_at_pins(S.StandIns(spark, sf).balances, ["token", "address"], _pins(spark, *SNAPSHOT_PINS))
    return x.select("pin", "token", "address", "block_number", scale("balance", S.UNIT).alias("balance"))


@query
def accounts_at_pins(spark, sf):
    """SRC-9 / SC-12: decoded account records at three pinned blocks; a short record stays a failed read."""
    x = asof.states_at_pins(S.StandIns(spark, sf).account_words, ["address"], _pins(spark, *SNAPSHOT_PINS))
    d = decode.decode_account_words(x.withColumn("key", F.concat_ws("@", "address", "pin")).select("block_number", F.col("key").alias("address"), "data"), hf_unit=HF_UNIT)
    at = F.split("address", "@")
    return d.select(at[1].cast("bigint").alias("pin"), at[0].alias("address"), "collateral", "debt", "health_factor")


# ======================================== categories, reserves, lineage
from ..operators import categories, quality, scenarios  # noqa: E402

TARGET = "0xa" + "0" * 39  # lineage target: address of region TARGET_REGION (= 0)
CATEGORY_SCAN_BOUND = 1_000_000
PERIOD_ROWS = [("early", None, date(1996, 3, 1)), ("launch", date(1996, 1, 1), date(1996, 7, 1)), ("middle", date(1997, 1, 1), date(1999, 1, 1)),
               ("incident", date(1998, 5, 1), date(1998, 6, 1)), ("late", date(2000, 1, 1), None)]
LOOP_EQUITY, LOOP_Y, LOOP_R = 1000.0, 0.04, 0.032


def _cands(s: S.StandIns) -> DataFrame:
    return categories.candidates(s.categories, S.COLLATERAL_BIT, S.BORROWABLE_BIT)


def _flagged(s: S.StandIns) -> DataFrame:
    return categories.pure_flags(_cands(s), s.reserves, s.lineage, S.COLLATERAL_BIT, TARGET)


def _cat_terms(df: DataFrame) -> DataFrame:
    return df.select("category_id", "label", r8(F.col("ltv") / 1e4).alias("ltv"), r8(F.col("lt") / 1e4).alias("lt"),
                     r8((F.col("bonus") - 10000) / 1e4).alias("bonus"))


@query
def category_candidates(spark, sf):
    """J-24 / SC-13: categories with A as collateral and B borrowable."""
    return _cat_terms(_cands(S.StandIns(spark, sf)))


@query
def category_pure_flag(spark, sf):
    """J-24 / AG-15 / PF-15: every other collateral resolves to the target."""
    return _flagged(S.StandIns(spark, sf)).select("category_id", "is_pure")


@query
def category_bits(spark, sf):
    """SC-13: the positions of all set bits, 0 to 127, of both bitmaps of every category."""
    x = categories.bit_lists(S.StandIns(spark, sf).categories)
    return x.select("category_id", F.array_join(F.transform("collateral_bits", lambda b: b.cast("string")), ",").alias("collateral_bits"),
                    F.array_join(F.transform("borrowable_bits", lambda b: b.cast("string")), ",").alias("borrowable_bits"))


@query
def category_coverage(spark, sf):
    """AG-16: highest configured category id against the scan bound."""
    return categories.coverage(S.StandIns(spark, sf).categories, CATEGORY_SCAN_BOUND)


@query
def token_lineage(spark, sf):
    """JN-9 / SC-14: reserve -> SY -> yield token, compared with the target."""
    s = S.StandIns(spark, sf)
    r = categories.lineage_resolved(s.reserves, s.lineage)
    return r.select("reserve_index", "address", "symbol", "sy", "yield_token",
                    F.coalesce(F.col("yield_token") == F.lit(TARGET), F.lit(False)).alias("resolves_to_target"))


@query
def best_category(spark, sf):
    """SL-4: best pure category by LTV desc, bonus asc, id asc."""
    return _cat_terms(categories.best(_flagged(S.StandIns(spark, sf))))


@query
def max_leverage_roe(spark, sf):
    """J-17: max leverage, position build and ROE per candidate category."""
    return categories.loop_economics(_cands(S.StandIns(spark, sf)), LOOP_EQUITY, LOOP_Y, LOOP_R)


@query
def category_baskets(spark, sf):
    """J-25 / JN-8: collateral basket of every candidate with PT lineage."""
    s = S.StandIns(spark, sf)
    return categories.baskets(_cands(s), s.reserves, s.lineage, TARGET)


# ============================================ reserve snapshot, token supply
def _scaled_reserves(s: S.StandIns) -> DataFrame:
    r = s.reserves
    d = lambda c, u: r8(F.col(c).cast("double") / F.lit(u))
    return r.select(
        "reserve_index", "address",
        d("ltv", 1e4).alias("ltv"), d("liquidation_threshold", 1e4).alias("liquidation_threshold"),
        r8((F.col("liquidation_bonus") - 10000) / F.lit(1e4)).alias("liquidation_bonus"),
        d("reserve_factor", 1e4).alias("reserve_factor"),
        scenarios.r4(F.col("total_supplied").cast("double") / F.lit(1e18)).alias("total_supplied"),
        scenarios.r4(F.col("total_variable_debt").cast("double") / F.lit(1e18)).alias("total_variable_debt"),
        d("liquidity_rate", 1e27).alias("supply_rate"), d("variable_borrow_rate", 1e27).alias("borrow_rate"),
        F.to_date(F.timestamp_seconds("last_update")).alias("last_update_day"),
        d("optimal_usage", 1e4).alias("uopt"), d("base_rate", 1e4).alias("base_rate"),
        d("slope1", 1e4).alias("slope1"), d("slope2", 1e4).alias("slope2"),
    )


@query
def scale_units(spark, sf):
    """PF-2 / SC-8 / SC-15: raw reserve snapshot fields in natural units."""
    return _scaled_reserves(S.StandIns(spark, sf))


@query
def curve_rate(spark, sf):
    """J-15: borrow rate implied by each reserve's curve at its utilisation,
    against the stored rate (formula self-check)."""
    from ..functions.curves import curve_rate as rate_at

    r = _scaled_reserves(S.StandIns(spark, sf))
    u = F.col("total_variable_debt") / F.col("total_supplied")
    x = r.select("reserve_index", u.alias("u"), "borrow_rate", "base_rate", "uopt", "slope1", "slope2")
    implied = rate_at("u", "base_rate", "uopt", "slope1", "slope2")
    return x.select("reserve_index", r8(F.col("u")).alias("utilisation"), r8(implied).alias("implied_rate"),
                    F.col("borrow_rate").alias("stored_rate"), r8(implied - F.col("borrow_rate")).alias("rate_gap"))


@query
def staking_state(spark, sf):
    """J-26: asset supply, staked part, vault shares, ratio and exchange rate."""
    return quality.staking_state(S.StandIns(spark, sf).token_supply, S.ASSET, S.VAULT, S.UNIT)


def _param_row(s: S.StandIns) -> DataFrame:
    r = _scaled_reserves(s).filter(F.col("reserve_index") == S.BORROWABLE_BIT).select(
        F.col("ltv").alias("debt_reserve_ltv"), F.col("reserve_factor").alias("debt_reserve_factor"),
        F.col("uopt").alias("ir_uopt"), F.col("base_rate").alias("ir_base"), F.col("slope1").alias("ir_slope1"),
        F.col("slope2").alias("ir_slope2"), F.col("borrow_rate").alias("debt_borrow_rate"),
        F.col("supply_rate").alias("debt_supply_rate"),
        r8(F.col("total_variable_debt") / F.col("total_supplied")).alias("debt_utilisation"))
    b = _cat_terms(categories.best(_flagged(s))).select(
        F.col("category_id").alias("best_category_id"), F.col("ltv").alias("best_category_ltv"),
        F.col("lt").alias("best_category_lt"), F.col("bonus").alias("best_category_bonus"))
    st = quality.staking_state(s.token_supply, S.ASSET, S.VAULT, S.UNIT).select("staking_ratio", "exchange_rate")
    return r.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(st))


@query
def param_table(spark, sf):
    """J-29: consolidated parameter table, one (param, value) row each."""
    return quality.param_table(_param_row(S.StandIns(spark, sf)))


REFERENCE_CATEGORY = 16  # the category the best one is set against
GROSS_YIELD = 0.0457
INCENTIVE = "none observed"


@query
def setup_table(spark, sf):
    """J-29: the whole setup table as text: snapshot block and time, rates, caps
    and totals of the debt and collateral reserves, curve, best and reference
    category with labels, staking, and the caller's own settings."""
    s = S.StandIns(spark, sf)
    block = s.reserve_updates.agg(F.max("evt_block_number").alias("block_number"), F.max("evt_block_time").alias("block_time_utc"))
    caps = s.reserves.select("reserve_index", "symbol", "supply_cap", "borrow_cap")
    scaled = _scaled_reserves(s).join(caps, "reserve_index")
    whole = lambda c: F.round(c).cast("bigint")
    debt = scaled.filter(F.col("reserve_index") == S.BORROWABLE_BIT).select(
        F.col("symbol").alias("debt_symbol"), F.col("borrow_rate").alias("debt_borrow_rate"), F.col("supply_rate").alias("debt_supply_rate"),
        F.col("reserve_factor").alias("debt_reserve_factor"), F.col("base_rate").alias("ir_base"), F.col("uopt").alias("ir_uopt"),
        F.col("slope1").alias("ir_slope1"), F.col("slope2").alias("ir_slope2"), F.col("supply_cap").alias("debt_supply_cap"),
        F.col("borrow_cap").alias("debt_borrow_cap"), whole("total_supplied").alias("debt_total_supplied"),
        whole("total_variable_debt").alias("debt_total_borrowed"),
        r8(safe_div("total_variable_debt", "total_supplied")).alias("debt_utilisation"))
    collateral = scaled.filter(F.col("reserve_index") == S.COLLATERAL_BIT).select(
        F.col("symbol").alias("collateral_symbol"), F.col("reserve_factor").alias("collateral_reserve_factor"),
        F.col("supply_cap").alias("collateral_supply_cap"))

    def named(category: DataFrame, name: str) -> DataFrame:
        return _cat_terms(category).select(*[F.col(c).alias(f"{name}_{c}") for c in ("category_id", "label", "ltv", "lt", "bonus")])

    staking = quality.staking_state(s.token_supply, S.ASSET, S.VAULT, S.UNIT).select(
        whole("asset_total_supply").alias("asset_total_supply"), "staking_ratio")
    given = spark.range(1).select(F.lit(Y).alias("net_yield"), F.lit(GROSS_YIELD).alias("gross_yield"), F.lit(INCENTIVE).alias("active_incentive"))
    reference = s.categories.filter(F.col("category_id") == REFERENCE_CATEGORY)
    return quality.setup_table(block, debt, collateral, named(categories.best(_flagged(s)), "best"), named(reference, "reference"), staking, given)


@query
def params_as_json(spark, sf):
    """SC-20 / SRC-11: the same parameters as one JSON object, numbers as text with eight places."""
    row = _param_row(S.StandIns(spark, sf))
    text = [F.when(F.col(c).isNotNull(), F.format_string("%.8f", F.col(c).cast("double"))).alias(c) for c in row.columns]
    return row.select(F.to_json(F.struct(*text), {"ignoreNullFields": "false"}).alias("params_json"))


@query
def integrity_checks(spark, sf):
    """J-28: identity and pointer rules as (rule, n_checked, n_bad) rows."""
    s = S.StandIns(spark, sf)
    members = categories.collateral_members(s.categories)
    sy = s.lineage.filter(F.col("relation") == "SY")
    yt = s.lineage.filter(F.col("relation") == "yieldToken")
    return quality.run_checks(
        quality.duplicates(s.reserves, "reserve_index_unique", ["reserve_index"]),
        quality.duplicates(s.reserves, "reserve_address_unique", ["address"]),
        quality.dangling(members, "category_bit_has_reserve", "reserve_index", s.reserves, "reserve_index"),
        quality.dangling(sy, "sy_hop_resolves", "target", yt, "token"),
        quality.duplicates(s.reserve_updates, "update_key_unique", ["reserve", "evt_block_number", "evt_index"]),
        quality.rule(s.transfers, "transfer_not_to_self", quality.transfers_self(s.transfers)),
    )


def _pointers(s: S.StandIns) -> DataFrame:
    """Reserves that name each other in pairs; every 17th names another one."""
    k = F.col("reserve_index")
    peer = F.when(k % 17 == 3, k.bitwiseXOR(F.lit(2))).otherwise(k.bitwiseXOR(F.lit(1)))
    return s.reserves.select(F.col("address").alias("source"), S.reserve_address(peer).alias("target"))


@query
def pointer_symmetry(spark, sf):
    """J-28: pointers that aren't answered by one back."""
    return quality.asymmetric_pointers(_pointers(S.StandIns(spark, sf)))


@query
def row_rules(spark, sf):
    """J-28: all row rules of the transfer table in one scan."""
    z, frm, to = F.lit(ZERO_ADDRESS), F.col("from"), F.col("to")
    return quality.row_rules(S.StandIns(spark, sf).transfers, {
        "transfer_to_self": (frm == to) & (frm != z), "no_value": F.col("value") <= 0, "address_malformed": ~(frm.rlike("^0x[0-9a-f]{40}$") & to.rlike("^0x[0-9a-f]{40}$")),
        "zero_to_zero": (frm == z) & (to == z), "no_time": F.col("evt_block_time").isNull()})


def _shared_path(spark, name: str) -> str:
    import uuid

    from ..plans.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def stored_daily_flows(spark, sf):
    """SRC-11: daily flows written by year, one year written again, one copy read back."""
    s = S.StandIns(spark, sf)
    flows = ledger.daily_net_flows(s.transfers, [S.ASSET, S.SHARE, S.ATOKEN, S.DTOKEN], S.VAULT, S.UNIT).withColumn("year", F.year("day"))
    path = _shared_path(spark, "flows")
    landing.write_partitions(flows, path, ["year"])
    landing.write_partitions(flows.filter("year = 1997"), path, ["year"])
    return landing.read_table(spark, path, flows.schema)


PAGE_PART_BYTES = 8 << 20  # bytes of compressed pages for each partition of their logs


@query
def json_landing(spark, sf):
    """SRC-6: JSON pages of raw logs, one page twice and some lines cut off, read
    with the declared schema, one row per (block, log index), decoded."""
    s = S.StandIns(spark, sf)
    lines = s.raw_logs.select("block_number", F.to_json(F.struct("address", "topics", "data", "block_number", "log_index")).alias("value"))
    path = _shared_path(spark, "pages")
    landing.write_pages(lines, f"{path}/page-1")
    landing.write_pages(lines.filter("block_number % 3 = 0"), f"{path}/page-2")
    landing.write_pages(lines.filter("block_number % 50 = 0").select(F.left("value", F.lit(40)).alias("value")), f"{path}/page-3")
    parts = max(S.parallelism(spark), -(-S.stored_bytes(spark, path) // PAGE_PART_BYTES))
    logs = landing.landed_logs(landing.read_json_logs(spark, *(f"{path}/page-{k}" for k in (1, 2, 3))), parts)
    return decode.decode_transfers(logs, S.TRANSFER_TOPIC).select("contract_address", "from", "to", F.col("value").cast("string").alias("value"), "block_number", "log_index")


@query
def period_ranges(spark, sf):
    """PF-13: days of rate updates with periods as rows, which overlap and leave holes."""
    r = series.latest_per_day(S.StandIns(spark, sf).reserve_updates, S.ASSET, CARRY.start_day).select("day")
    return labels.period_of(r, "day", spark.createDataFrame(PERIOD_ROWS, "label string, since date, until date"))


# ============================ accounts as cluster + literal scenario tables
# Fixed values of the studied scenario model, as stated there: vault yield,
# case borrow rate, liquidation threshold, status-quo curve (base 0, kink
# 0.90, slope1 0.04, slope2 0.12, reserve factor 0.25), deposits 1e9, a
# 10-member cluster excluding leverage below 5x, HF targets 1.025 / 1.05 /
# 1.10, leverage targets 10x / cluster / 12x, the four configurations
# (status quo 0.90/0.04, A 0.80/0.04, B 0.90/0.07, C 0.85/0.055), the slope1
# sweep 0.02 0.03 0.034 0.04 0.05 0.07 0.10 0.15 0.20 and the placeholder
# slope1 0.035.
Y, R_CASE, LT = 0.04, 0.033, 0.94
CURVE = scenarios.Curve()
DEPOSITS = 1e9
CLUSTER_K, CLUSTER_MIN_LEVERAGE = 10, 5.0
HF_TARGETS = (1.025, 1.05, 1.10)
L_TARGETS = (10.0, None, 12.0)
CONFIGS = [("Status quo", 0.90, 0.04), ("A: lower Uopt", 0.80, 0.04), ("B: raise slope1", 0.90, 0.07),
           ("C: moderate both", 0.85, 0.055)]
SLOPES = (0.02, 0.03, 0.034, 0.04, 0.05, 0.07, 0.10, 0.15, 0.20)
PLACEHOLDER_SLOPE1 = 0.035
RATE_SCENARIOS = (0.02, 0.025, 0.03, 0.033, 0.035, 0.04)


def _members(s: S.StandIns) -> DataFrame:
    loopers = _accounts(s).join(_loopers(s).select("address"), "address", "left_semi")
    return scenarios.cluster_members(loopers, DUST_CUT, CLUSTER_K, CLUSTER_MIN_LEVERAGE)


def _stats(s: S.StandIns) -> DataFrame:
    loop_debt = _loopers(s).agg(scale(F.sum("debt_raw"), S.UNIT).alias("loop_debt"))
    return scenarios.cluster_stats(_members(s), Y, R_CASE, loop_debt)


def _eq_cols(money=("revenue",)) -> list:
    return [r8(F.col("r_star")).alias("r_star"), r8(F.col("u_star")).alias("u_star"), "branch",
            scenarios.r4(F.col("revenue")).alias("revenue"), r8(F.col("supply_apy")).alias("supply_apy")]


@query
def cluster_excluding(spark, sf):
    """JN-10: top-10 account cluster with the low-leverage outliers left out."""
    m = _members(S.StandIns(spark, sf))
    return m.select("address", "debt", r8(F.col("leverage")).alias("leverage"), r8(F.col("health_factor")).alias("health_factor"))


@query
def cluster_hurdle(spark, sf):
    """J-18: weighted leverage, HF, ROE range, hurdle and share of loop debt."""
    st = _stats(S.StandIns(spark, sf))
    return st.select("n_members", scenarios.r4(F.col("cluster_debt")).alias("cluster_debt"),
                     *[r8(F.col(c)).alias(c) for c in ("w_leverage", "w_hf", "hurdle", "roe_min", "roe_max", "share_of_loop_debt")])


@query
def equilibrium(spark, sf):
    """J-19: status-quo equilibrium rate, utilisation, revenue and supply APY."""
    st = _stats(S.StandIns(spark, sf))
    return scenarios.solve(st, Y, "hurdle", "w_leverage", CURVE, DEPOSITS).select(*_eq_cols())


@query
def curve_inverse(spark, sf):
    """J-16: utilisation the status-quo curve needs for each day's borrow rate."""
    from ..functions.curves import curve_branch, curve_utilisation

    s = S.StandIns(spark, sf)
    r = series.latest_per_day(s.reserve_updates, S.ASSET, CARRY.start_day)
    return r.select("day", "borrow_apr",
                    r8(curve_utilisation("borrow_apr", CURVE.r0, CURVE.uopt, CURVE.slope1, CURVE.slope2)).alias("implied_utilisation"),
                    curve_branch("borrow_apr", CURVE.r0, CURVE.slope1).alias("branch"))


@query
def scenario_grid(spark, sf):
    """JN-11: every healthy account x every scenario borrow rate -> ROE."""
    a = accounts.with_segments(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT).filter(F.col("segment") == "normal")
    return scenarios.positions_x_rates(a, RATE_SCENARIOS, Y)


@query
def hf_leverage_map(spark, sf):
    """J-20: HF <-> leverage conversions against each account's measured values."""
    from ..functions.curves import hf_from_leverage, leverage_from_hf

    a = accounts.with_segments(_looper_accounts(S.StandIns(spark, sf)), DUST_CUT).filter(F.col("segment") == "normal")
    lt = F.col("liquidation_threshold")
    return a.select("address", r8(F.col("health_factor")).alias("health_factor"), r8(F.col("leverage")).alias("leverage"),
                    r8(leverage_from_hf("health_factor", lt)).alias("leverage_from_hf"),
                    r8(hf_from_leverage("leverage", lt)).alias("hf_from_leverage"))


def _sens(s: S.StandIns) -> DataFrame:
    return scenarios.sensitivity(_stats(s), HF_TARGETS, L_TARGETS, LT, Y, CURVE, DEPOSITS)


@query
def sensitivity_table(spark, sf):
    """J-20 / SL-5: six HF / leverage scenarios, ranked by revenue."""
    from pyspark.sql import Window

    x = _sens(S.StandIns(spark, sf))
    rk = F.row_number().over(Window.orderBy(F.col("revenue").asc(), F.col("scenario").asc())).cast("bigint")
    return x.select("scenario", r8(F.col("L")).alias("leverage"), r8(F.col("HF")).alias("health_factor"),
                    *_eq_cols(), rk.alias("revenue_rank"))


@query
def scenario_range(spark, sf):
    """AG-12: revenue range across the sensitivity scenarios, also in bps."""
    x = _sens(S.StandIns(spark, sf))
    g = x.agg(F.min("revenue").alias("lo"), F.max("revenue").alias("hi"))
    return g.select(scenarios.r4(F.col("lo")).alias("revenue_min"), scenarios.r4(F.col("hi")).alias("revenue_max"),
                    r8(F.col("lo") / F.lit(DEPOSITS) * 1e4).alias("bps_min"), r8(F.col("hi") / F.lit(DEPOSITS) * 1e4).alias("bps_max"))


def _configs(s: S.StandIns) -> DataFrame:
    return scenarios.config_grid(_stats(s), CONFIGS, Y, CURVE, DEPOSITS, "Status quo")


@query
def curve_configs(spark, sf):
    """J-21: curve configurations and their change against the status quo."""
    x = _configs(S.StandIns(spark, sf))
    return x.select("config", "uopt", "slope1", *_eq_cols(), r8(F.col("revenue_change")).alias("revenue_change"),
                    r8(F.col("u_change_points")).alias("u_change_points"))


@query
def config_table_text(spark, sf):
    """SC-19: the configuration table as display text, formatted last."""
    x = _configs(S.StandIns(spark, sf))
    return x.select(
        "config", labels.pct_text("uopt", 0).alias("uopt_text"), labels.pct_text("slope1", 1).alias("slope1_text"),
        labels.pct_text("u_star").alias("u_star_text"), labels.pct_text("r_star").alias("r_star_text"),
        labels.money_m_text("revenue").alias("revenue_text"), labels.pct_text("supply_apy").alias("supply_apy_text"), "branch")


@query
def slope_sweep(spark, sf):
    """J-22: slope1 sweep at the status-quo kink."""
    x = scenarios.slope_sweep(_stats(S.StandIns(spark, sf)), SLOPES, Y, CURVE, DEPOSITS)
    return x.select("slope1", r8(F.col("u_star")).alias("u_star"), "branch", scenarios.r4(F.col("revenue")).alias("revenue"))


@query
def sweep_monotone(spark, sf):
    """WN-7: is revenue non-increasing along the sweep?"""
    x = scenarios.slope_sweep(_stats(S.StandIns(spark, sf)), SLOPES, Y, CURVE, DEPOSITS)
    return scenarios.monotone(x, "slope1", "revenue")


@query
def fit_gap(spark, sf):
    """J-23: model U* against the latest observed utilisation, and the same
    with the placeholder slope1."""
    s = S.StandIns(spark, sf)
    st = _stats(s)
    obs = series.utilisation(series.latest_per_day(s.reserve_updates, S.ASSET, CARRY.start_day)
                             .withColumn("total_supply", F.lit(None).cast("double"))
                             .withColumn("total_borrow", F.lit(None).cast("double")), CARRY.reserve_factor)
    obs = obs.agg(F.max_by("utilisation_rates", "day").alias("observed_u"))
    # both curves as rows against one cluster, then one row again
    both = scenarios.slope_sweep(st, (CURVE.slope1, PLACEHOLDER_SLOPE1), Y, CURVE, DEPOSITS)
    at = lambda s1: F.max(F.when(F.col("slope1") == s1, F.col("u_star")))
    j = both.agg(at(CURVE.slope1).alias("u_star"), at(PLACEHOLDER_SLOPE1).alias("u_alt")).crossJoin(F.broadcast(obs))
    return j.select(r8(F.col("observed_u")).alias("observed_u"), r8(F.col("u_star")).alias("u_star"),
                    r8(F.col("u_star") - F.col("observed_u")).alias("gap"), r8(F.col("u_alt")).alias("u_star_placeholder"),
                    r8(F.col("u_alt") - F.col("observed_u")).alias("gap_placeholder"))
