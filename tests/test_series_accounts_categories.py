"""Daily series, account risk and category selection edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from carrylens.operators import accounts, categories, series

R = "0xreserve"


def test_latest_per_day_breaks_block_ties_by_log_index(spark):
    rows = [(R, dt.datetime(2024, 1, 1, 10), 5, 1, 0.01, 0.02, 1.0, 1.0),
            (R, dt.datetime(2024, 1, 1, 11), 5, 3, 0.03, 0.04, 1.0, 1.0),
            (R, dt.datetime(2024, 1, 1, 9), 4, 9, 0.05, 0.06, 1.0, 1.0),
            (R, dt.datetime(2024, 1, 3, 9), 7, 0, 0.07, 0.08, 1.0, 1.0),
            ("0xother", dt.datetime(2024, 1, 1, 9), 99, 0, 0.9, 0.9, 1.0, 1.0)]
    u = spark.createDataFrame(rows, "reserve string, evt_block_time timestamp_ntz, evt_block_number long, evt_index int, "
                                    "liquidity_rate double, variable_borrow_rate double, liquidity_index double, variable_borrow_index double")
    r = {x.day: x for x in series.latest_per_day(u, R, dt.date(2024, 1, 1)).collect()}
    assert set(r) == {dt.date(2024, 1, 1), dt.date(2024, 1, 3)}  # the gap day is absent (T16)
    assert r[dt.date(2024, 1, 1)].supply_apr == 0.03


def test_running_state_dense_and_flows_before_start_dropped(spark):
    z = "0x" + "0" * 40
    p = series.CarryParams(asset="A", vault="V", a_token="AT", debt_token="DT", reserve_factor=0.25,
                           start_day=dt.date(2024, 1, 1), end_day=dt.date(2024, 1, 5), window_start=dt.date(2024, 1, 1), unit=1.0)
    t = spark.createDataFrame([
        ("AT", z, "u", 10, dt.datetime(2023, 12, 31)),  # before the calendar: falls off (T17)
        ("AT", z, "u", 5, dt.datetime(2024, 1, 2)),
        ("AT", "u", z, 2, dt.datetime(2024, 1, 4)),
        ("A", "u", "V", 8, dt.datetime(2024, 1, 3)),
        ("V", z, "u", 4, dt.datetime(2024, 1, 3)),
    ], "contract_address string, from string, to string, value long, evt_block_time timestamp_ntz")
    s = {r.day: r for r in series.running_state(spark, t, p).collect()}
    assert len(s) == 5
    assert [s[dt.date(2024, 1, d)].scaled_supply for d in range(1, 6)] == [0, 5, 5, 3, 3]
    e = {r.day: r.exch_rate for r in series.exchange_rate_daily(series.running_state(spark, t, p)).collect()}
    assert e[dt.date(2024, 1, 2)] is None and e[dt.date(2024, 1, 3)] == 2.0


def _acc(spark, rows):
    return spark.createDataFrame([(f"a{i}", c, d, h, 0.94) for i, (c, d, h) in enumerate(rows)],
                                 "address string, collateral double, debt double, health_factor double, liquidation_threshold double")


def test_leverage_null_when_insolvent(spark):
    r = accounts.account_leverage(_acc(spark, [(100.0, 100.0, 0.94), (100.0, 150.0, 0.6), (100.0, 90.0, 1.04)])).collect()
    assert [x.leverage for x in r][:2] == [None, None] and all(x.is_insolvent for x in r[:2])
    assert r[2].leverage == pytest.approx(10.0)


def test_histogram_edges_half_open_and_empty_buckets(spark):
    # leverage exactly 5, 8, 10, 12.5 -> the upper bucket of each edge (T11)
    levs = [5.0, 8.0, 10.0, 12.5, 2.0]
    rows = [(L * 1e7, (L - 1) * 1e7, 1.1) for L in levs]  # c / (c - d) = L
    h = {r.bucket: r.n_accounts for r in accounts.leverage_histogram(_acc(spark, rows), 1.0).collect()}
    assert h == {"<5x": 1, "5-8x": 1, "8-10x": 1, "10-12.5x": 1, ">=12.5x": 1}
    h2 = {r.bucket: r.n_accounts for r in accounts.leverage_histogram(_acc(spark, rows[:1]), 1.0).collect()}
    assert h2["<5x"] == 0 and len(h2) == 5
    over = accounts.over_cap(_acc(spark, rows), 1.0, 12.5).collect()
    assert over == []  # "over cap" is strictly greater than 12.5


def test_median_even_count_and_segments(spark):
    rows = [(c * 1e7, (c - 1) * 1e7, 1.1) for c in (1.5, 2.0, 4.0, 10.0)]
    st = accounts.leverage_stats(_acc(spark, rows + [(10.0, 5.0, 1.1)]), 100.0).first()
    assert st.n_accounts == 4 and st.median_leverage == pytest.approx(3.0)  # dust row excluded, mean of the middle pair
    seg = {r.segment: r.n_accounts for r in accounts.risk_segments(_acc(spark, [(10.0, 5.0, 1.5), (1e9, 9e8, 0.99), (1e9, 9e8, 1.1)]), 1000.0).collect()}
    assert seg == {"dust": 1, "near_liquidation": 1, "normal": 1}


def test_category_purity_vacuous_and_unresolvable(spark):
    cats = spark.createDataFrame([
        (1, "only A", 1 << 3, 1 << 5, 9300, 9500, 10100),  # no other collateral: vacuously pure
        (2, "A + good", (1 << 3) | (1 << 1), 1 << 5, 9200, 9400, 10100),
        (3, "A + unresolvable", (1 << 3) | (1 << 2), 1 << 5, 9400, 9600, 10100),
        (4, "not borrowable", 1 << 3, 1 << 4, 9900, 9950, 10000),
    ], "category_id int, label string, collateral_bitmap long, borrowable_bitmap long, ltv int, lt int, bonus int")
    cats = cats.withColumn("collateral_bitmap", F.col("collateral_bitmap").cast("decimal(38,0)")).withColumn(
        "borrowable_bitmap", F.col("borrowable_bitmap").cast("decimal(38,0)"))
    reserves = spark.createDataFrame([(1, "r1", "PT-1"), (2, "r2", "PT-2"), (3, "r3", "A")], "reserve_index int, address string, symbol string")
    lineage = spark.createDataFrame([("r1", "SY", "sy1"), ("sy1", "yieldToken", "TARGET"), ("r2", "SY", "sy2")],
                                    "token string, relation string, target string")
    cands = categories.candidates(cats, 3, 5)
    f = {r.category_id: r.is_pure for r in categories.pure_flags(cands, reserves, lineage, 3, "TARGET").collect()}
    assert f == {1: True, 2: True, 3: False}
    best = categories.best(categories.pure_flags(cands, reserves, lineage, 3, "TARGET")).first()
    assert best.category_id == 1


def test_opening_balance_and_forward_fill_options(spark):
    import dataclasses

    z = "0x" + "0" * 40
    p = series.CarryParams(asset="A", vault="V", a_token="AT", debt_token="DT", reserve_factor=0.25,
                           start_day=dt.date(2024, 1, 1), end_day=dt.date(2024, 1, 4), window_start=dt.date(2024, 1, 1), unit=1.0)
    t = spark.createDataFrame([("AT", z, "u", 5, dt.datetime(2024, 1, 2))],
                              "contract_address string, from string, to string, value long, evt_block_time timestamp_ntz")
    s = {r.day: r.scaled_supply for r in series.running_state(spark, t, dataclasses.replace(p, opening_scaled_supply=10)).collect()}
    assert [s[dt.date(2024, 1, d)] for d in range(1, 5)] == [10, 15, 15, 15]
    u = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1, 0, 0.01, 0.02, 1.0, 1.0),
                               ("A", dt.datetime(2024, 1, 3), 2, 0, 0.03, 0.04, 1.1, 1.1)],
                              "reserve string, evt_block_time timestamp_ntz, evt_block_number long, evt_index int, "
                              "liquidity_rate double, variable_borrow_rate double, liquidity_index double, variable_borrow_index double")
    dropped = series.reserve_daily(spark, u, t, p).select("day").collect()
    filled = {r.day: r.borrow_apr for r in series.reserve_daily(spark, u, t, dataclasses.replace(p, forward_fill_rates=True)).collect()}
    assert len(dropped) == 2  # default: days without an update are dropped (T16)
    assert filled == {dt.date(2024, 1, 1): 0.02, dt.date(2024, 1, 2): 0.02, dt.date(2024, 1, 3): 0.04, dt.date(2024, 1, 4): 0.04}
