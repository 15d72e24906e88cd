"""Netting, classification, ranking and the leaderboard on hand-built frames."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carrylens.operators import ledger, positions
from carrylens.operators.ranking import global_rank

D, C = "0xdebt", "0xcoll"
T0 = dt.datetime(2024, 1, 1)


def _events(spark, borrows, repays=(), supplies=(), withdraws=(), liqs=()):
    b = spark.createDataFrame([(r, u, a, T0 + dt.timedelta(days=i)) for i, (r, u, a) in enumerate(borrows)],
                              "reserve string, on_behalf_of string, amount long, evt_block_time timestamp_ntz")
    rp = spark.createDataFrame(list(repays), "reserve string, user string, amount long")
    s = spark.createDataFrame([(r, u, a, T0) for r, u, a in supplies],
                              "reserve string, on_behalf_of string, amount long, evt_block_time timestamp_ntz")
    w = spark.createDataFrame(list(withdraws), "reserve string, user string, amount long")
    lq = spark.createDataFrame(list(liqs), "user string, debt_asset string, debt_to_cover long, collateral_asset string, liquidated_collateral_amount long")
    return ledger.lending_legs(b, rp, s, w, lq, D, C)


def test_net_positions_signs_filters_and_thresholds(spark):
    legs = _events(
        spark,
        borrows=[(D, "u1", 3000), (D, "u1", 500), (D, "u2", 900), ("0xother", "u1", 10**6)],
        repays=[(D, "u1", 400)],
        supplies=[(C, "u1", 5000), (C, "u2", 5000)],
        withdraws=[(C, "u1", 100)],
        liqs=[("u1", D, 100, C, 200), ("u2", "0xother", 5, "0xother", 5)],
    )
    p = {r.user_addr: r for r in ledger.net_positions(legs, 1.0, 1000, 1000).collect()}
    assert set(p) == {"u1"}  # u2's debt 900 is under the threshold; the other reserve is ignored
    assert p["u1"].debt == 3000 + 500 - 400 - 100
    assert p["u1"].collateral == 5000 - 100 - 200
    assert p["u1"].n_borrows == 2
    assert p["u1"].first_borrow == T0 and p["u1"].last_borrow == T0 + dt.timedelta(days=1)


def test_net_positions_invariant_under_repartition(spark):
    legs = _events(spark, borrows=[(D, f"u{i % 7}", 1000 + i) for i in range(200)],
                   supplies=[(C, f"u{i % 7}", 2000 + i) for i in range(200)])
    a = sorted(ledger.net_positions(legs, 1.0, 0, 0).collect())
    b = sorted(ledger.net_positions(legs.repartition(13), 1.0, 0, 0).collect())
    assert a == b


def _pos(spark, rows):
    df = spark.createDataFrame(rows, "user_addr string, debt_raw long, collateral_raw long")
    df = df.select("*", F.col("debt_raw").cast("decimal(38,0)").alias("d"), F.col("debt_raw").cast("double").alias("debt"),
                   F.col("collateral_raw").cast("double").alias("collateral"), F.lit(1).alias("n_borrows"),
                   F.lit(None).cast("timestamp_ntz").alias("first_borrow"), F.lit(None).cast("timestamp_ntz").alias("last_borrow"),
                   F.lit("EOA").alias("addr_type")).drop("debt_raw").withColumnRenamed("d", "debt_raw")
    rate = spark.createDataFrame([(1.0,)], "exchange_rate double")
    return positions.classify_positions(df, rate, 0.85, 0.95)


def test_band_inclusive_and_negative_leverage(spark):
    c = {r.user_addr: r for r in _pos(spark, [("a", 85, 100), ("b", 95, 100), ("c", 96, 100), ("d", 200, 100), ("e", 10, 0)]).collect()}
    assert c["a"].is_loop_position and c["b"].is_loop_position  # BETWEEN is inclusive (T12)
    assert not c["c"].is_loop_position
    assert c["d"].implied_leverage == pytest.approx(-1.0)  # LTV > 1 keeps negative leverage (T9)
    assert c["e"].ltv is None and c["e"].is_loop_position is False  # NULL ltv is not a loop


def test_leaderboard_ties_and_cumulative_share(spark):
    rows = [("b", 100, 110), ("a", 100, 110), ("c", 50, 200), ("d", 30, 33)]
    top = positions.leaderboard(_pos(spark, rows), 3).orderBy("rank").collect()
    assert [r.user_addr for r in top] == ["a", "b", "c"]  # equal debt broken by address (T13)
    loop_total = 100 + 100 + 30  # a, b, d are in band; c is not
    assert top[0].share_of_loop_debt == pytest.approx(100 / loop_total)
    assert top[1].cumulative_share_of_loop == pytest.approx(200 / loop_total)
    assert top[2].share_of_loop_debt is None and top[2].cumulative_share_of_loop is None
    assert top[2].share_of_joined_debt == pytest.approx(50 / 280)


def test_no_loop_rows_gives_null_shares(spark):
    top = positions.leaderboard(_pos(spark, [("a", 10, 100), ("b", 20, 100)]), 5).collect()
    assert all(r.share_of_loop_debt is None and r.cumulative_share_of_loop is None for r in top)


def test_global_rank_matches_plain_window(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), ((F.col("id") * 7919) % 101).alias("v"))
    order = [F.col("v").desc(), F.col("k").asc()]
    got = global_rank(df, order, running={"cum": F.col("v")}, num_partitions=7)
    w = Window.orderBy(*order)
    want = df.select("k", F.row_number().over(w).alias("rank"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    assert sorted(got.select("k", "rank", "cum").collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_concentration_with_fewer_loopers_than_n(spark):
    df = spark.createDataFrame([("a", 60), ("b", 40)], "address string, debt_raw long").select(
        "address", F.col("debt_raw").cast("decimal(38,0)").alias("debt_raw"))
    r = {x.top_n: x.share_of_looper_debt for x in positions.concentration_topn(df, (1, 3)).collect()}
    assert r == {1: 0.6, 3: 1.0}


def test_read_events_schema_and_pushdown(spark, tmp_path):
    from carrylens.sources.schemas import read_events

    df = spark.createDataFrame([("0xr", "0xu", 5, None), ("0xq", "0xu", 7, None)],
                               "reserve string, on_behalf_of string, amount long, evt_block_time timestamp_ntz")
    df.select("amount", "on_behalf_of", "reserve").write.parquet(str(tmp_path / "b"))  # reordered, a column missing
    r = read_events(spark, str(tmp_path / "b"), "borrow", reserve="0xr")
    assert [f.name for f in r.schema.fields] == ["reserve", "on_behalf_of", "amount", "evt_block_time"]
    assert r.schema["amount"].dataType.simpleString() == "decimal(38,0)"
    assert [x.amount for x in r.collect()] == [5]
    assert "EqualTo(reserve,0xr)" in r._jdf.queryExecution().executedPlan().toString()


def test_snapshot_as_of_takes_latest_at_or_before_pin(spark):
    from carrylens.sources.schemas import snapshot_as_of

    df = spark.createDataFrame([("a", 1, 0, 10), ("a", 5, 0, 50), ("a", 5, 2, 52), ("a", 9, 0, 90), ("b", 9, 0, 99)],
                               "k string, block_number long, idx int, v long")
    r = {x.k: x for x in snapshot_as_of(df, ["k"], 5, index="idx").collect()}
    assert set(r) == {"a"} and r["a"].v == 52 and r["a"].block_number == 5


def test_holder_legs_reads_one_pinned_snapshot(spark):
    rows = [(7, "c", "x", 10), (7, "d", "x", 5), (8, "c", "x", 30), (8, "d", "y", 4)]
    balances = spark.createDataFrame(rows, "block_number bigint, token string, address string, balance bigint")
    at = {pin: {r.address: (r.collateral_raw, r.debt_raw) for r in positions.holder_legs(balances, "c", "d", pin).collect()} for pin in (7, 8, 9)}
    assert at == {7: {"x": (10, 5)}, 8: {"x": (30, None), "y": (None, 4)}, 9: {}}
